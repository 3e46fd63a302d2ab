"""All stages from transactions to scored customers, each written as a table that the next one reads."""

from __future__ import annotations

from dataclasses import dataclass
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FEATURES, EngineConfig
from ..operators import baselines, clean, features, metrics, preprocess, selection, validate
from ..operators.clusters import Model, fit
from ..sources.model_store import load_model, save_model, scaler_of, scaler_text


@dataclass
class Result:
    profiles: DataFrame
    scaled: DataFrame
    grid: DataFrame | None
    model: Model
    descriptions: DataFrame
    comparison: DataFrame
    predictions: DataFrame
    test_metrics: DataFrame
    #: What validation found wrong; empty if all is well.
    problems: list[str]


def scored(model: Model, points: DataFrame, descriptions: DataFrame, id_column: str = "CustomerID") -> DataFrame:
    """Predictions with the cluster's name and description; noise has its own."""
    names = descriptions.select("cluster_id", "business_label", "description")
    noise = F.col("cluster_id") < 0
    out = model.predict(points).select(id_column, "cluster_id").join(F.broadcast(names), "cluster_id", "left")  # a row for each cluster
    return out.select(id_column, "cluster_id", noise.alias("is_noise"), F.when(noise, "Noise").otherwise(F.col("business_label")).alias("business_label"), F.when(noise, "No cluster").otherwise(F.col("description")).alias("description"))


def distribution(predictions: DataFrame) -> DataFrame:
    """Rows and name of each predicted cluster, most first."""
    return predictions.groupBy("cluster_id").agg(F.count("*").alias("count"), F.min("business_label").alias("label")).orderBy(F.desc("count"), "cluster_id")


class Pipeline:
    """Stages under one folder; each can be run alone from the tables of those before."""

    STEPS = ("data", "preprocess", "train", "benchmark")

    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig = EngineConfig()):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config
        self.features = list(FEATURES)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def data(self, tx: DataFrame) -> DataFrame:
        cleaned = self._write(clean.clean(tx, self.config.country), "clean_transactions")
        cancelled = self._write(clean.cancellations(tx), "cancellations")
        profile = features.repeat_buyers(features.profiles(cleaned, cancelled), self.config.min_frequency)
        return self._write(profile, "customer_profiles")

    def preprocess(self) -> tuple[DataFrame, preprocess.Scaler]:
        rows, scaler = preprocess.preprocess(self.read("customer_profiles"), self.config)
        rows.write.mode("overwrite").partitionBy("split").parquet(f"{self.folder}/scaled")
        self._write(self.spark.createDataFrame([(scaler_text(scaler),)], "scaler string"), "scaler")
        return self.read("scaled"), scaler

    def train(self, search: bool = True) -> tuple[Model, DataFrame, DataFrame | None]:
        train = self.read("scaled").where("split = 'train'").select("CustomerID", *self.features)
        xi, tau, grid = self.config.xi, self.config.tau, None
        if search:
            grid = self._write(selection.grid_search(train, self.features, self.config), "grid_search")
            xi, tau = selection.select_best(grid, self.config).first()
        model, cells = fit(train, self.features, xi, tau)
        described = self._write(model.descriptions(cells), "cluster_descriptions")
        self._write(model.subspace_coverage(self.spark).drop("pos"), "subspace_coverage")
        self._write(model.heatmap(self.spark), "subspace_heatmap")
        cells.unpersist()
        scaler = scaler_of(self.read("scaler").first()[0])
        save_model(self.spark, model, f"{self.folder}/model", scaler, self.read("customer_profiles"))
        return model, described, grid

    def benchmark(self, most: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The comparison with other algorithms (the first `most` settings) on the training rows, and predictions of the test rows.
        Agglomerative settings over a configured limit of rows have a row that says so, without scores."""
        model, _, _ = load_model(self.spark, f"{self.folder}/model")
        scaled = self.read("scaled")
        train = scaled.where("split = 'train'").select("CustomerID", *self.features).persist()
        rows = []
        for name, settings in [("grid", {"xi": model.xi, "tau": model.tau}), *baselines.SETTINGS[:most]]:
            params, limit = ", ".join(f"{k}={v}" for k, v in settings.items()), self.config.agglomerative_rows
            if name == "Agglomerative" and limit is not None and train.count() > limit:
                rows.append({"algorithm": name, "params": f"{params} (not run: over {limit} rows)"})
                continue
            began = perf_counter()
            labelled = (model.predict(train) if name == "grid" else baselines.run(train, self.features, name, settings, self.config.seed, most=self.config.agglomerative_rows)).persist()
            labelled.count()
            took = perf_counter() - began
            row = metrics.evaluate(labelled, self.features, name, params, most=self.config.silhouette_rows)
            rows.append(row | {"runtime_sec": took})
            labelled.unpersist()
        train.unpersist()
        comparison = self._write(selection.compare(self.spark, rows), "baseline_comparison")
        test = scaled.where("split = 'test'")
        predictions = self._write(scored(model, test, self.read("cluster_descriptions")), "test_predictions")
        labelled = model.predict(test).persist()
        row = metrics.evaluate(labelled, self.features, "grid", f"xi={model.xi}, tau={model.tau}", most=self.config.silhouette_rows)
        labelled.unpersist()
        self._write(selection.compare(self.spark, [row]).drop("runtime_sec"), "test_metrics")
        return comparison, predictions

    def validate(self) -> list[str]:
        """What is wrong with the written tables; empty if all is well."""
        wrong = [f"{r['check']}: {r['violations']}" for df in (validate.profile_violations(self.read("customer_profiles"), self.features, self.config.min_frequency), validate.scaled_violations(self.read("scaled"), self.features)) for r in df.collect() if r["violations"]]
        model, _, _ = load_model(self.spark, f"{self.folder}/model")
        train = self.read("scaled").where("split = 'train'")
        labelled = train.withColumn("cluster_id", model.label()).persist()
        silhouette = metrics.silhouette(labelled, self.features, most=self.config.silhouette_rows)
        wrong += validate.check_model(len(model.clusters), metrics.coverage(labelled).first()["n_clusters"], silhouette)
        labelled.unpersist()
        wrong += validate.check_comparison(self.read("baseline_comparison"), silhouette)
        wrong += validate.check_tables({name: self._columns(name) for name in validate.TABLES})
        if (grid := self._columns("grid_search")) is not None:
            wrong += validate.check_grid(self.read("grid_search"), self.config) if grid else ["grid_search is empty"]
        n = self.read("test_predictions").count()
        return wrong + ([f"only {n} rows of predictions"] if n < validate.LEAST_TEST_ROWS else [])

    def _columns(self, name: str) -> list[str] | None:
        """The columns of a written table, none of an empty one; None if it isn't there."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        df = self.read(name)
        return [] if df.isEmpty() else df.columns

    def run(self, tx: DataFrame, search: bool = True, most: int | None = None) -> Result:
        profiles = self.data(tx)
        scaled, _ = self.preprocess()
        model, described, grid = self.train(search)
        comparison, predictions = self.benchmark(most)
        return Result(profiles, scaled, grid, model, described, comparison, predictions, self.read("test_metrics"), self.validate())
