"""The engine's queries by name; each takes (spark, sf_dir). Their SQL is in oracle.py.

Transactions come from the star schema. Features are scaled as in the pipeline; models are fitted on the
training rows with cells rounded to nine places, so that another engine's sums give the same cells.

Queries on profiles as such make them from the transactions. Those that follow them in the pipeline read
profiles and scaled features from tables in the shared folder, written once for each state of the inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FEATURES, EngineConfig
from ..functions.columns import joined
from ..operators import baselines, clean, features, grid, metrics, preprocess, selection, validate
from ..operators.clusters import Model, adjacent_pairs, fit
from ..sources import transactions
from .components import written
from .pipeline import distribution, scored

COLS = list(FEATURES)
DIGITS = 9
FINE, COARSE = (8, 0.05), (12, 0.18)
CONFIG = EngineConfig()


def _tx(spark: SparkSession, d: str) -> DataFrame:
    return transactions.from_star_schema(spark, d)


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    return transactions.with_dirt(_tx(spark, d))


def _rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    tx = _tx(spark, d)
    return features.profiles(clean.clean(tx), clean.cancellations(tx))


_PREFIX: dict[tuple[str, str], tuple] = {}


def _state(spark: SparkSession, d: str) -> tuple:
    """Size and time of the input tables, so that a changed one isn't taken for the one before."""
    out = []
    for name in ("lineitem", "orders", "customer", "nation"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append((fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def prefix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, preprocess.Scaler]:
    """Profiles, scaled features and what scaling learned, from tables that are written at the first call."""
    key, state = (spark.sparkContext.applicationId, d), _state(spark, d)
    if key not in _PREFIX or _PREFIX[key][0] != state:
        profile = written(_profiles(spark, d), "profiles")
        scaled, scaler = preprocess.preprocess(features.repeat_buyers(profile), CONFIG)
        _PREFIX[key] = state, profile, written(scaled, "scaled"), scaler
    return _PREFIX[key][1:]


def _scaled(spark: SparkSession, d: str) -> tuple[DataFrame, preprocess.Scaler]:
    return prefix(spark, d)[1:]


def _train(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d)[0].where("split = 'train'").drop("split")


def _fitted(spark: SparkSession, d: str, at: tuple[int, float] = FINE) -> tuple[Model, DataFrame, DataFrame]:
    """Model, cell table (cached until the result is made), training rows."""
    train = _train(spark, d)
    model, cells = fit(train, COLS, at[0], at[1], DIGITS)
    return model, cells, train


def _model(spark: SparkSession, d: str, at: tuple[int, float] = FINE) -> tuple[Model, DataFrame]:
    """Model and training rows."""
    model, cells, train = _fitted(spark, d, at)
    cells.unpersist()
    return model, train


# cleaning
def clean_transactions(spark, d):
    rows = clean.clean(_dirty(spark, d))
    return rows.select("InvoiceNo", "StockCode", F.col("LineNo").cast("long").alias("LineNo"), "Quantity", F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss").alias("InvoiceDate"), F.round("UnitPrice", 8).alias("UnitPrice"), "CustomerID", "Country", F.col("Revenue").cast("double").alias("Revenue"))


def cancellations(spark, d):
    rows = clean.cancellations(_dirty(spark, d))
    return rows.groupBy(F.coalesce("CustomerID", F.lit("none")).alias("CustomerID")).agg(F.count("*").alias("n_rows"), F.count_distinct("InvoiceNo").alias("n_invoices"))


def cleaning_funnel(spark, d):
    return clean.funnel(_dirty(spark, d), "NATION_7").select(F.col("step_no").cast("long").alias("step_no"), "step", "n_rows")


def clean_summary(spark, d):
    s = clean.summary(clean.clean(_dirty(spark, d)))
    return s.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_date", "last_date")})


def country_filter(spark, d):
    return clean.clean(_tx(spark, d), "NATION_7").groupBy("Country").agg(F.count("*").alias("n_rows"), F.sum("Revenue").cast("double").alias("revenue"))


def sheet_union(spark, d):
    tx = _tx(spark, d)
    early, late = tx.where("InvoiceDate < '1998'").withColumnsRenamed({"InvoiceNo": "Invoice", "CustomerID": "Customer ID"}), tx.where("InvoiceDate >= '1998'").drop("LineNo")
    return transactions.union_sheets(early, late).groupBy(F.substring("InvoiceDate", 1, 4).alias("year")).agg(F.count("*").alias("n_rows"), F.count("LineNo").alias("n_lines"), F.count_distinct("CustomerID").alias("n_customers"))


# features
def _feature(*columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _rounded(_profiles(spark, d).select("CustomerID", *columns), list(columns))


def repeat_buyers(spark, d):
    return features.repeat_buyers(_profiles(spark, d), 5).groupBy("frequency").agg(F.count("*").alias("n"))


def top_category(spark, d):
    return features.top_category(clean.clean(_tx(spark, d)))


def event_recency(spark, d):
    """Recency on event times, which aren't all at midnight."""
    e = transactions.table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    at = e.agg((F.max("last") + F.expr("INTERVAL 1 DAY")).alias("at"))
    return e.crossJoin(F.broadcast(at)).select("user_id", features.recency_days(F.col("at"), F.col("last")).cast("long").alias("recency"))  # one row


def event_weekend(spark, d):
    e = transactions.table(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(F.avg(F.when(F.weekday("ts") >= 5, 1.0).otherwise(0.0)), 6).alias("weekend_ratio"))


# preprocessing
def feature_stats(spark, d):
    s = preprocess.stats(prefix(spark, d)[0], COLS).drop("skewness", "needs_log")
    return _rounded(s, ["mean", "std", "min", "max"], 4)


def feature_skew(spark, d):
    return _rounded(preprocess.stats(prefix(spark, d)[0], COLS).select("feature", "skewness", "needs_log"), ["skewness"], 4)


def feature_corr(spark, d):
    return _rounded(preprocess.correlations(prefix(spark, d)[0], COLS), ["r"])


def feature_histogram(spark, d):
    return preprocess.histogram(prefix(spark, d)[0], COLS, 40).select("feature", F.col("bin").cast("long").alias("bin"), "n")


def feature_quartiles(spark, d):
    return _rounded(preprocess.quartiles(prefix(spark, d)[0], COLS), ["q1", "median", "q3"])


def winsor_bounds(spark, d):
    q = preprocess.quantiles(features.repeat_buyers(prefix(spark, d)[0]), COLS, CONFIG.winsor_quantiles)
    return _rounded(spark.createDataFrame([(c, *map(float, v)) for c, v in q.items()], "feature string, lo double, hi double"), ["lo", "hi"])


def winsorized(spark, d):
    p = features.repeat_buyers(prefix(spark, d)[0])
    return _rounded(preprocess.winsorised(p, preprocess.quantiles(p, COLS, CONFIG.winsor_quantiles)), COLS)


def log_features(spark, d):
    return _rounded(preprocess.logged(prefix(spark, d)[0]).select("CustomerID", *COLS[:5]), COLS[:5])


def split_counts(spark, d):
    rows = preprocess.with_split(features.repeat_buyers(prefix(spark, d)[0]))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("CustomerID").alias("first_id"), F.max("CustomerID").alias("last_id"))


def scaler_fit(spark, d):
    _, s = _scaled(spark, d)
    return _rounded(spark.createDataFrame([(c, *r) for c, r in s.ranges.items()], "feature string, lo double, hi double"), ["lo", "hi"])


def scaled_features(spark, d):
    return _rounded(_scaled(spark, d)[0], COLS)


# dense units
def grid_cells(spark, d):
    b = grid.with_cells(_train(spark, d), COLS, 8, DIGITS)
    long = b.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("dim"), F.col(f"b{i}").cast("long").alias("cell")) for i in range(len(COLS))))).alias("c"))
    return long.groupBy("c.dim", "c.cell").agg(F.count("*").alias("cnt"))


def _units(k: int):
    def query(spark, d):
        model, _ = _model(spark, d)
        t = grid.unit_table(spark, [u for u in model.units if u.k == k], model.n)
        return t.select(joined(F.col("dims")).alias("dims"), joined(F.col("cells")).alias("cells"), "cnt", F.round("density", 6).alias("density"))

    return query


def _candidates(k: int):
    def query(spark, d):
        model, _ = _model(spark, d)
        rows = [(",".join(map(str, a)), ",".join(map(str, b))) for a, b in grid.candidates([u for u in model.units if u.k == k - 1])]
        return spark.createDataFrame(rows, "dims string, cells string")

    return query


def unit_adjacency(spark, d):
    model, _ = _model(spark, d)
    text = lambda t: ",".join(map(str, t))
    rows = [(text(model.units[i].dims), text(min(model.units[i].cells, model.units[j].cells)), text(max(model.units[i].cells, model.units[j].cells))) for i, j in adjacent_pairs(model.units)]
    return spark.createDataFrame(rows, "dims string, cells_1 string, cells_2 string")


def unit_components(spark, d):
    model, _ = _model(spark, d)
    t = model.cluster_units(spark)
    return t.select(F.col("cluster_id").cast("long").alias("cluster_id"), joined(F.col("dims")).alias("dims"), joined(F.col("cells")).alias("cells"), "cnt")


def clusters(spark, d):
    model, _ = _model(spark, d)
    t = model.cluster_table(spark)
    return t.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("k_dim").cast("long").alias("k_dim"), joined(F.col("dims")).alias("dims"), F.col("n_units").cast("long").alias("n_units"), "size", F.round("coverage", 6).alias("coverage"), "description")


def cluster_members(spark, d):
    model, train = _model(spark, d)
    return model.members(train).groupBy(F.col("cluster_id").cast("long").alias("cluster_id")).agg(F.count("*").alias("n"), F.min("CustomerID").alias("first_id"), F.max("CustomerID").alias("last_id"))


def cluster_profiles(spark, d):
    model, cells, _ = _fitted(spark, d)
    return _rounded(model.profiles(cells).withColumn("cluster_id", F.col("cluster_id").cast("long")), COLS)


def cluster_descriptions(spark, d):
    model, cells, _ = _fitted(spark, d)
    t = model.descriptions(cells)
    return t.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col("k_dim").cast("long").alias("k_dim"), F.array_join("subspace", " & ").alias("subspace"), "size", "coverage_pct", "description", "business_label")


def subspace_coverage(spark, d):
    model, _ = _model(spark, d)
    return model.subspace_coverage(spark).select("subspace", F.col("dimensions").cast("long").alias("dimensions"), F.col("n_clusters").cast("long").alias("n_clusters"), F.round("coverage", 6).alias("coverage"))


def subspace_heatmap(spark, d):
    model, _ = _model(spark, d)
    return _rounded(model.heatmap(spark).withColumn("n_clusters", F.col("n_clusters").cast("long")), ["coverage"])


def heatmap_pivot(spark, d):
    model, _ = _model(spark, d)
    return model.heatmap(spark).groupBy("dim_1").pivot("dim_2", COLS).agg(F.avg("n_clusters")).na.fill(0.0)


def top_subspaces(spark, d):
    model, _ = _model(spark, d)
    return model.top_planes(spark).select("subspace", F.col("n_clusters").cast("long").alias("n_clusters"), F.round("coverage", 6).alias("coverage"))


def labels(spark, d):
    model, train = _model(spark, d)
    return model.labels(train).withColumn("cluster_id", F.col("cluster_id").cast("long"))


# scoring
def predict_scores(spark, d):
    scaled, _ = _scaled(spark, d)
    model, _ = fit(scaled.where("split = 'train'"), COLS, *FINE, DIGITS)
    return model.predict(scaled).select("CustomerID", "split", F.col("cluster_id").cast("long").alias("cluster_id"))


def test_distribution(spark, d):
    scaled, _ = _scaled(spark, d)
    model, cells = fit(scaled.where("split = 'train'"), COLS, *COARSE, DIGITS)
    p = scored(model, scaled.where("split = 'test'"), model.descriptions(cells))
    return distribution(p).select(F.col("cluster_id").cast("long").alias("cluster_id"), "count", "label")


# quality
def _labelled(spark, d, at=COARSE):
    model, train = _model(spark, d, at)
    return written(train.withColumn("cluster_id", model.label()), "labelled")


def coverage_noise(spark, d):
    return _rounded(metrics.coverage(_labelled(spark, d)), ["coverage"])


def silhouette(spark, d):
    rows = metrics.silhouette_rows(_labelled(spark, d), COLS)
    return rows.groupBy(F.col("cluster_id").cast("long").alias("cluster_id")).agg(F.count("*").alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


def davies_bouldin(spark, d):
    return spark.createDataFrame([(round(metrics.davies_bouldin(_labelled(spark, d), COLS), 5),)], "davies_bouldin double")


def calinski_harabasz(spark, d):
    return spark.createDataFrame([(round(metrics.calinski_harabasz(_labelled(spark, d), COLS), 3),)], "calinski_harabasz double")


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with their label and a cluster: cells of the first two dimensions, noise where both are low."""
    e = transactions.table(spark, d, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(2)))
    p = F.when((F.col("x0") < 0) & (F.col("x1") < 0), -1).otherwise(F.when(F.col("x0") > 0.05, 2).otherwise(0) + F.when(F.col("x1") > 0.05, 1).otherwise(0))
    return e.select("vec_id", F.col("label").cast("long").alias("y"), p.cast("long").alias("p"))


def contingency_table(spark, d):
    return metrics.contingency(_known(spark, d), "y", "p")


def majority_vote(spark, d):
    return metrics.majority_vote(contingency_table(spark, d))


def confusion_matrix(spark, d):
    t = contingency_table(spark, d)
    return metrics.confusion(t, metrics.majority_vote(t))


def supervised_scores(spark, d):
    t = contingency_table(spark, d)
    s = metrics.supervised(t, metrics.majority_vote(t))
    return _rounded(s, s.columns)


def agreement_scores(spark, d):
    s = metrics.agreement(contingency_table(spark, d))
    return _rounded(s, s.columns)


def intrinsic_metrics(spark, d):
    m = metrics.intrinsic(_labelled(spark, d), COLS)
    return spark.createDataFrame([(round(m["silhouette"], 5), round(m["davies_bouldin"], 5), round(m["calinski_harabasz"], 3))], "silhouette double, davies_bouldin double, calinski_harabasz double")


def aligned_labels(spark, d):
    known = _known(spark, d)
    return metrics.align(known, metrics.majority_vote(metrics.contingency(known, "y", "p")), "p").select("vec_id", "y", "p", "mapped")


def evaluation(spark, d):
    """All indices of one labelling with known classes, by the first two components of the vectors."""
    e = transactions.table(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(2)))
    row = metrics.evaluate(written(_known(spark, d).join(e, "vec_id"), "known"), ["x0", "x1"], "grid", truth="y", label="p", id_column="vec_id")
    names = [k for k in row if k not in ("algorithm", "params", "n_clusters")]
    return spark.createDataFrame([(row["n_clusters"], *(round(float(row[k]), 5) for k in names))], "n_clusters long" + "".join(f", {k} double" for k in names))


def test_metrics(spark, d):
    """Coverage, silhouette and Davies-Bouldin index of the test rows under the model's predictions."""
    model, _ = _model(spark, d, COARSE)
    rows = written(model.predict(_scaled(spark, d)[0].where("split = 'test'")), "predicted")
    c, m = metrics.coverage(rows).first(), metrics.intrinsic(rows, COLS)
    return spark.createDataFrame([(c["n_points"], c["n_noise"], c["n_clusters"], round(c["coverage"], 5), round(m["silhouette"], 5), round(m["davies_bouldin"], 5))], "n_points long, n_noise long, n_clusters long, coverage double, silhouette double, davies_bouldin double")


# search and comparison
def grid_search(spark, d):
    """The search for all xi and tau over the training rows, with every index and the score."""
    g = selection.grid_search(_train(spark, d), COLS, CONFIG, DIGITS)
    return g.select(F.col("xi").cast("long").alias("xi"), "tau", "n_clusters", "n_noise", "coverage", "silhouette", "davies_bouldin", "calinski_harabasz", F.round("quality_score", 5).alias("quality_score"))


def best_params(spark, d):
    """The choice from the search."""
    g = selection.grid_search(_train(spark, d), COLS, CONFIG, DIGITS)
    return selection.select_best(g, CONFIG).select(F.col("xi").cast("long").alias("xi"), "tau")


def _compared(spark: SparkSession, d: str, algorithms: set[str]) -> DataFrame:
    train, (model, _) = _train(spark, d), _model(spark, d, COARSE)
    settings = [x for x in baselines.SETTINGS if x[0] in algorithms]
    labelled = [("grid", f"xi={COARSE[0]}, tau={COARSE[1]}", model.predict(train))]
    labelled += [(name, ", ".join(f"{k}={v}" for k, v in s.items()), df) for (name, s), df in zip(settings, baselines.run_all(train, COLS, settings, CONFIG.seed), strict=True)]
    wide = train
    for i, (_, _, df) in enumerate(labelled):
        wide = wide.join(written(df.select("CustomerID", F.col("cluster_id").alias(f"run_{i}")), "compared"), "CustomerID")
    rows = metrics.evaluate_many(written(wide, "compared"), COLS, {f"run_{i}": (name, params) for i, (name, params, _) in enumerate(labelled)})
    return selection.compare(spark, rows).drop("runtime_sec")


def baseline_comparison(spark, d):
    """Our own clustering and all settings of the others, on the training rows."""
    return _compared(spark, d, {"KMeans", "DBSCAN", "Agglomerative"})


def best_per_algorithm(spark, d):
    """The best setting of each algorithm that starts from no random numbers."""
    return _rounded(selection.best_per_algorithm(_compared(spark, d, {"DBSCAN"})), ["silhouette"], 5)


def contract_violations(spark, d):
    scaled, _ = _scaled(spark, d)
    return validate.profile_violations(prefix(spark, d)[0], COLS).union(validate.scaled_violations(scaled, COLS))


def dbscan_core_points(spark, d):
    """Training rows with four others within 0.5."""
    return baselines.near_counts(_train(spark, d), COLS, 0.5).where("n_near >= 4")


def dbscan_labels(spark, d):
    out = baselines.dbscan(_train(spark, d), COLS, 0.5)
    return out.select("CustomerID", F.col("cluster_id").cast("long").alias("cluster_id"))


def kmeans_summary(spark, d):
    out = baselines.kmeans(_train(spark, d), COLS, 4)
    return out.groupBy("cluster_id").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in COLS))


def agglomerative_summary(spark, d):
    """Ward clusters of all training rows."""
    out = baselines.agglomerative(_train(spark, d), COLS, 5)
    return out.groupBy("cluster_id").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in COLS))


def _synthetic(spark: SparkSession) -> DataFrame:
    """Two hundred points, uniform by hash in eight dimensions, the first sixty dense in two of them, with their class."""
    u = lambda i: F.conv(F.substring(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(i))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    planted = {0: (0.6, 0.2), 1: (0.7, 0.2)}
    x = [F.when(F.col("id") < 60, planted[i][0] + planted[i][1] * u(i)).otherwise(u(i)) if i in planted else u(i) for i in range(8)]
    return spark.range(200).select(F.col("id").cast("string").alias("CustomerID"), (F.col("id") < 60).cast("long").alias("y"), *(c.alias(f) for f, c in zip(COLS, x, strict=True)))


def _smoke(spark: SparkSession) -> DataFrame:
    """The synthetic points with the predictions of a model fitted on them."""
    points = written(_synthetic(spark), "synthetic")
    model, cells = fit(points, COLS, *FINE, DIGITS)
    cells.unpersist()
    return model.predict(points)


def synthetic_smoke(spark, d):
    return _smoke(spark).groupBy(F.col("cluster_id").cast("long").alias("cluster_id")).agg(F.count("*").alias("n"))


def synthetic_verify(spark, d):
    """The supervised scores of the fit on synthetic points against the planted class."""
    t = metrics.contingency(written(_smoke(spark), "smoke"), "y", "cluster_id")
    s = metrics.supervised(t, metrics.majority_vote(t))
    return _rounded(s, s.columns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    one = {name: _feature(name) for name in ("recency", "avg_basket", "product_diversity", "return_rate", "weekend_ratio", "repeat_category_rate")}
    made = {"frequency_monetary": _feature("frequency", "monetary"), "customer_profiles": _feature(*COLS)}
    units = {f"dense_units_{k}d": _units(k) for k in (1, 2, 3)} | {"candidates_2d": _candidates(2), "candidates_3d_pruned": _candidates(3)}
    plain = [
        clean_transactions, cancellations, cleaning_funnel, clean_summary, country_filter, sheet_union, repeat_buyers, top_category, event_recency, event_weekend,
        feature_stats, feature_skew, feature_corr, feature_histogram, feature_quartiles, winsor_bounds, winsorized, log_features, split_counts, scaler_fit, scaled_features,
        grid_cells, unit_adjacency, unit_components, clusters, cluster_members, cluster_profiles, cluster_descriptions, subspace_coverage, subspace_heatmap, heatmap_pivot, top_subspaces, labels,
        predict_scores, test_distribution, coverage_noise, silhouette, davies_bouldin, calinski_harabasz, contingency_table, majority_vote, confusion_matrix, supervised_scores, agreement_scores,
        intrinsic_metrics, aligned_labels, evaluation, test_metrics, grid_search, best_params, baseline_comparison, best_per_algorithm, contract_violations, dbscan_core_points, dbscan_labels, kmeans_summary, agglomerative_summary, synthetic_smoke, synthetic_verify,
    ]
    return one | made | units | {f.__name__: f for f in plain}
