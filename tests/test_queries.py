import dataclasses
import datetime
import decimal
import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellgrove.config import EngineConfig
from cellgrove.operators import baselines
from cellgrove.plans import oracle, pipeline, queries
from cellgrove.plans.pipeline import Pipeline
from cellgrove.sources import transactions

QUERIES, SQL = queries.queries(), oracle.oracle_sql()


def _duck(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return c


@pytest.fixture(scope="module")
def duck(small):
    return _duck(small)


@pytest.fixture(scope="module")
def medium_duck(medium):
    return _duck(medium)


def value(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(round(float(v), 5) + 0.0)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else repr(v)


#: In the smallest tables there are dense cells of four dimensions, which the SQL doesn't go to: these take larger ones.
DEEP = {"labels", "clusters", "unit_adjacency", "unit_components", "cluster_members", "cluster_profiles", "cluster_descriptions", "subspace_coverage", "predict_scores", "grid_search", "best_params", "test_metrics"}


@pytest.mark.parametrize("name", list(SQL))
def test_query_against_sql(spark, small, duck, medium, medium_duck, name):
    folder, duck = (medium, medium_duck) if name in DEEP else (small, duck)
    df = QUERIES[name](spark, folder)
    sql = duck.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    order = [sql.columns.index(n) for n in names]
    assert sorted(tuple(map(value, r)) for r in df.select(names).collect()) == sorted(tuple(value(r[i]) for i in order) for r in sql.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pipeline_end_to_end(spark, small, tmp_path):
    p = Pipeline(spark, str(tmp_path / "run"))
    result = p.run(transactions.from_star_schema(spark, small), search=False, most=1)
    assert result.predictions.count() == 30 and result.comparison.count() == 2
    assert {r.business_label for r in result.predictions.where("is_noise").collect()} <= {"Noise"}
    assert all(w.startswith("unusually low silhouette") for w in result.problems), result.problems
    assert result.test_metrics.first().n_clusters >= 1
    shutil.rmtree(tmp_path / "run" / "subspace_heatmap")
    assert "subspace_heatmap is missing" in p.validate()


def test_prefix_is_made_anew_when_inputs_change(spark, small, tmp_path):
    folder = shutil.copytree(small, tmp_path / "tables")
    before = queries.prefix(spark, str(folder))[1]
    assert queries.prefix(spark, str(folder))[1] is before
    os.chmod(folder, 0o755)
    os.remove(folder / "orders.parquet")
    spark.read.parquet(f"{small}/orders.parquet").limit(500).write.parquet(f"{folder}/orders.parquet")
    assert queries.prefix(spark, str(folder))[1].count() < before.count()


def test_agglomerative_summary_has_all_training_rows(spark, small, monkeypatch):
    monkeypatch.setattr(queries, "CONFIG", dataclasses.replace(queries.CONFIG, agglomerative_rows=40))
    n = {r.split: r.n for r in QUERIES["split_counts"](spark, small).collect()}
    assert sum(r.n for r in QUERIES["agglomerative_summary"](spark, small).collect()) == n["train"]


def test_pipeline_reports_settings_it_skips(spark, tmp_path, monkeypatch):
    class Fixed:
        xi, tau = 8, 0.05

        def predict(self, df):
            return df.withColumn("cluster_id", F.lit(0))

    monkeypatch.setattr(pipeline, "load_model", lambda *a: (Fixed(), None, None))
    monkeypatch.setattr(pipeline, "scored", lambda model, test, names: test)
    monkeypatch.setattr(baselines, "SETTINGS", baselines.SETTINGS[-2:])
    p = Pipeline(spark, str(tmp_path), EngineConfig(agglomerative_rows=3))
    rows = spark.range(5).select(F.col("id").cast("string").alias("CustomerID"), *(F.lit(0.5).alias(c) for c in p.features), F.when(F.col("id") < 4, "train").otherwise("test").alias("split"))
    rows.write.parquet(f"{tmp_path}/scaled")
    rows.limit(0).write.parquet(f"{tmp_path}/cluster_descriptions")
    skipped = p.benchmark()[0].where("algorithm = 'Agglomerative'").orderBy("params").collect()
    assert [(r.params, r.silhouette) for r in skipped] == [("k=5 (not run: over 3 rows)", None), ("k=6 (not run: over 3 rows)", None)]
