"""Quality of a labelling: from distances, and against known classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NOISE
from ..plans.components import written


def assigned(points: DataFrame, label: str = "cluster_id") -> DataFrame:
    return points.where(F.col(label) >= 0)


def coverage(points: DataFrame, label: str = "cluster_id") -> DataFrame:
    """One row: rows, noise rows, share in clusters, clusters in use."""
    hit = F.col(label) >= 0
    return points.agg(
        F.count("*").alias("n_points"),
        F.count_if(F.col(label) == NOISE).alias("n_noise"),
        F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("coverage"),
        F.count_distinct(F.when(hit, F.col(label))).alias("n_clusters"),
    )


def _squared(features: list[str], other: list[Column]) -> Column:
    return sum(((F.col(c) - o) * (F.col(c) - o) for c, o in zip(features, other, strict=True)), F.lit(0.0))


def centroids(points: DataFrame, features: list[str], label: str = "cluster_id") -> DataFrame:
    return assigned(points, label).groupBy(label).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c_{c}") for c in features))


def davies_bouldin(points: DataFrame, features: list[str], label: str = "cluster_id") -> float | None:
    """Mean over clusters of the worst ratio of scatter to distance of centroids; None for fewer than two clusters."""
    return intrinsic_many(points, features, [label], parts=("davies_bouldin",))[label]["davies_bouldin"]


def _davies_bouldin(s: np.ndarray, x: np.ndarray) -> float | None:
    """From the clusters' scatters and centroids."""
    if len(s) < 2:
        return None
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (s[:, None] + s[None]) / d
    ratio[~np.isfinite(ratio)] = 0.0
    np.fill_diagonal(ratio, 0.0)
    return float(ratio.max(axis=1).mean())


def calinski_harabasz(points: DataFrame, features: list[str], label: str = "cluster_id") -> float | None:
    """Between over within dispersion, each by its degrees of freedom; None for fewer than two clusters."""
    return intrinsic_many(points, features, [label], parts=("calinski_harabasz",))[label]["calinski_harabasz"]


def _calinski_harabasz(size: np.ndarray, x: np.ndarray, spread: np.ndarray) -> float | None:
    """From the clusters' sizes, centroids and variances."""
    k, n = len(size), size.sum()
    if k < 2 or n <= k:
        return None
    within = float((spread * size[:, None]).sum())
    mean = (x * size[:, None]).sum(axis=0) / n
    between = float((((x - mean) ** 2).sum(axis=1) * size).sum())
    return 1.0 if within == 0 else float(between * (n - k) / (within * (k - 1)))


def _long(points: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """(run, label, features, or other columns): the assigned rows of each labelling."""
    runs = F.array(*(F.struct(F.lit(i).alias("run"), F.col(c).cast("int").alias("label")) for i, c in enumerate(labels)))
    return points.select(F.explode(F.filter(runs, lambda r: r["label"] >= 0)).alias("r"), *features).select("r.run", "r.label", *features)


def intrinsic_many(points: DataFrame, features: list[str], labels: list[str], most: int | None = None, id_column: str = "CustomerID", parts: tuple[str, ...] = ("silhouette", "davies_bouldin", "calinski_harabasz"), weight: str | None = None) -> dict[str, dict[str, float | None]]:
    """The indices of several labellings of the same points, whose distances are computed once for all.

    weight: a column that says for how many equal points a row stands; then `most` can't be given."""
    out: dict[str, dict[str, float | None]] = {c: {} for c in labels}
    long = _long(points, [*features, weight] if weight else features, labels)
    w = F.col(weight) if weight else F.lit(1)
    mean_of = lambda x: F.sum(x * w) / F.sum(F.when(x.isNotNull(), w))
    if {"davies_bouldin", "calinski_harabasz"} & set(parts):
        means = long.groupBy("run", "label").agg(F.sum(w).alias("n"), *(mean_of(F.col(f)).alias(f"c_{f}") for f in features)).orderBy("run", "label").collect()
    scatter, spread = {}, {}
    if {"davies_bouldin", "calinski_harabasz"} & set(parts) and means:
        centre = points.sparkSession.createDataFrame([(r["run"], r["label"], *(r[f"c_{f}"] for f in features)) for r in means], "run int, label int" + "".join(f", c_{f} double" for f in features))
        apart = F.sqrt(_squared(features, [F.col(f"c_{f}") for f in features]))
        var_of = lambda f: F.when(F.min(f) == F.max(f), 0.0).otherwise(mean_of((F.col(f) - F.col(f"c_{f}")) * (F.col(f) - F.col(f"c_{f}"))))
        for r in long.join(F.broadcast(centre), ["run", "label"]).groupBy("run", "label").agg(mean_of(apart), *map(var_of, features)).collect():  # a row for each cluster
            scatter[r[0], r[1]], spread[r[0], r[1]] = r[2], list(r[3:])
    rows = silhouette_rows_many(points, features, labels, most, id_column, weight=weight) if "silhouette" in parts else None
    mean = {r[0]: r[1] for r in rows.groupBy("run").agg(F.avg("silhouette")).collect()} if rows is not None else {}
    for i, c in enumerate(labels):
        if "silhouette" in parts:
            out[c]["silhouette"] = mean.get(i)
        if "davies_bouldin" in parts or "calinski_harabasz" in parts:
            mine = [r for r in means if r["run"] == i]
            x = np.array([[r[f"c_{f}"] for f in features] for r in mine])
            if "davies_bouldin" in parts:
                out[c]["davies_bouldin"] = _davies_bouldin(np.array([scatter[i, r["label"]] for r in mine]), x)
            if "calinski_harabasz" in parts:
                out[c]["calinski_harabasz"] = _calinski_harabasz(np.array([r["n"] for r in mine], float), x, np.array([spread[i, r["label"]] for r in mine]))
    return out


def silhouette_rows(points: DataFrame, features: list[str], label: str = "cluster_id", most: int | None = None, id_column: str = "CustomerID", block: int = 1 << 19) -> DataFrame | None:
    """(label, silhouette) of each assigned point, by Euclidean distances; a cluster of one point gives 0. Like silhouette_rows_many, for one labelling."""
    rows = silhouette_rows_many(points, features, [label], most, id_column, block)
    return None if rows is None else rows.select(F.col("label").alias("cluster_id"), "silhouette")


def silhouette_rows_many(points: DataFrame, features: list[str], labels: list[str], most: int | None = None, id_column: str = "CustomerID", block: int = 1 << 19, weight: str | None = None) -> DataFrame | None:
    """(run, label, silhouette) of each point in each labelling that assigns it; labellings of fewer than two clusters have no rows.

    Points of equal features and labels are one point with a weight until the last step. Points are sent to every task in
    blocks of about `block`, ordered by their labels in all labellings; each point's
    distances to a block are computed once, summed over the points of equal labels, and these sums added to those by
    cluster of each labelling, which are written between blocks. Where `most` is given, a
    sample by hash of the id stands for more points than that, on both sides. weight: a column that says for how
    many equal points a row stands; there is no id and no `most` then."""
    if weight and most is not None:
        raise ValueError("a sample by id is of points, not of rows that stand for several")
    spark, runs = points.sparkSession, len(labels)
    rows = points.select((F.lit(None) if weight else F.col(id_column)).cast("string").alias("id"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"), F.array(*(F.col(c).cast("int") for c in labels)).alias("y"), F.array(*(F.col(f).cast("double") for f in features)).alias("x")).where(F.exists("y", lambda v: v >= 0))
    if most is not None and (n := rows.count()) > most:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    parts = spark.sparkContext.defaultParallelism * 4
    rows = written(rows.groupBy("y", "x").agg(F.sum("w").alias("w")), "silhouette")
    parts = max(parts, -(-(n := rows.count()) // block))
    held = written(rows.select("y", "x", F.array().cast("array<double>").alias("total"), "w").repartition(parts).withColumn("part", F.spark_partition_id()), "silhouette")
    whole, held = held, held.drop("part")
    counted = held.select("w", F.posexplode("y").alias("run", "label")).where("label >= 0").groupBy("run", "label").agg(F.sum("w")).orderBy("run", "label").collect()
    known = [np.array([r[1] for r in counted if r[0] == i], np.int32) for i in range(runs)]
    size = [np.array([r[2] for r in counted if r[0] == i], float) for i in range(runs)]
    if all(len(k) < 2 for k in known):
        return None
    begin = np.cumsum([0, *map(len, known)])
    done = held
    for i, (y, x, w) in enumerate(_blocks(whole, parts, max(1, block * parts // max(1, n)))):
        done = done if i == 0 else written(done, "silhouette")
        order = np.lexsort(y.T)
        start = np.flatnonzero(np.concatenate([[True], (np.diff(y[order], axis=0) != 0).any(axis=1)]))
        groups, to = y[order[start]], []
        for r in range(runs):
            of = np.argsort(groups[:, r], kind="stable")
            of = of[groups[of, r] >= 0]
            found, first = np.unique(groups[of, r], return_index=True)
            to.append((of, first, begin[r] + np.searchsorted(known[r], found)))
        shared = spark.sparkContext.broadcast((x[order], w[order], start, to, int(begin[-1])))
        done = done.mapInArrow(_adding(shared), held.schema)

    def finish(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            every, total = _matrix(batch.column(0), runs), _matrix(batch.column(2), int(begin[-1]))
            for r in range(runs):
                if len(known[r]) < 2:
                    continue
                rows_ = np.flatnonzero(every[:, r] >= 0)
                mine, sums = np.searchsorted(known[r], every[rows_, r]), total[rows_, begin[r] : begin[r + 1]]
                at, n = np.arange(len(mine)), size[r]
                a = sums[at, mine] / np.maximum(n[mine] - 1, 1)
                other = sums / n
                other[at, mine] = np.inf
                b = other.min(axis=1)
                s = np.where(n[mine] > 1, (b - a) / np.where(np.maximum(a, b) > 0, np.maximum(a, b), 1), 0.0)
                mine, s = (np.repeat(v, batch.column(3).to_numpy()[rows_]) for v in (mine, s))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), r, np.int32)), pa.array(known[r][mine]), pa.array(s)], ["run", "label", "silhouette"])

    return done.mapInArrow(finish, "run int, label int, silhouette double")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _blocks(whole: DataFrame, parts: int, step: int):
    """(labels, points, weights) of `step` parts at a time."""
    for at in range(0, parts, step):
        got = whole.where(F.col("part").between(at, at + step - 1)).select("y", "x", "w").toArrow()
        if got.num_rows:
            y, x = (np.vstack([_matrix(c, len(c[0])) for c in got[name].chunks if len(c)]) for name in ("y", "x"))
            yield y, x, got["w"].to_numpy().astype(float)


def _adding(shared):
    """Adds the distances to a block's points, times their weights, to each row's sums by cluster of each labelling."""

    def run(batches):
        x, w, start, to, k = shared.value
        middle = x.mean(axis=0)
        other, tiles = _sides(x - middle)[1], _tiles(start, len(x), 1024)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _matrix(batch.column(1), x.shape[1])
            total = _matrix(batch.column(2), k).copy() if len(batch.column(2).flatten()) else np.zeros((len(own), k))
            for i in range(0, len(own), 128):
                some, mine = own[i : i + 128], _sides(own[i : i + 128] - middle)[0]
                sums = np.zeros((len(some), len(start)))
                for a, b, g, first in tiles:
                    sums[:, g : g + len(first)] += np.add.reduceat(_distances(some, x[a:b], mine, other[a:b], w[a:b]), first, axis=1)
                for of, first, at in to:
                    if len(of):
                        total[i : i + 128, at] += np.add.reduceat(sums[:, of], first, axis=1)
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, k), pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out, batch.column(3)], ["y", "x", "total", "w"])

    return run


def _tiles(start: np.ndarray, n: int, width: int) -> list[tuple[int, int, int, np.ndarray]]:
    """Stretches of at most `width` points: from, to, the first one's group, and where in the stretch groups begin."""
    out = []
    for a in range(0, n, width):
        b, g = min(n, a + width), int(np.searchsorted(start, a, "right")) - 1
        out.append((a, b, g, np.concatenate([[0], start[g + 1 : np.searchsorted(start, b)] - a])))
    return out


def _sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points as rows and as columns of a product that gives squared distances."""
    square, one = (x * x).sum(axis=1, keepdims=True), np.ones((len(x), 1))
    return np.hstack([x, square, one]), np.hstack([-2 * x, one, square])


def _distances(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Distances of a and b, times the weights of b, which are in the product as squares; where it would leave too few
    digits they are computed from differences."""
    square, least = w * w, 1e-8 * max(left[:, -2].max(), right[:, -1].max())
    d = left @ (right * square[:, None]).T
    if d.min() <= least * square.max():
        i, j = np.divmod(np.flatnonzero(d <= least * square), d.shape[1])
        d[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1) * square[j]
    return np.sqrt(d, out=d)


def silhouette(points: DataFrame, features: list[str], label: str = "cluster_id", most: int | None = None, id_column: str = "CustomerID") -> float | None:
    """Mean silhouette of the assigned points; None for fewer than two clusters."""
    rows = silhouette_rows(points, features, label, most, id_column)
    return None if rows is None else rows.agg(F.avg("silhouette")).first()[0]


def intrinsic(points: DataFrame, features: list[str], label: str = "cluster_id", most: int | None = None, id_column: str = "CustomerID") -> dict[str, float | None]:
    return intrinsic_many(points, features, [label], most, id_column)[label]


def contingency(labelled: DataFrame, truth: str, label: str) -> DataFrame:
    """(y, p, n): rows of each class and cluster. Everything below reads this small table."""
    return labelled.groupBy(F.col(truth).alias("y"), F.col(label).alias("p")).agg(F.count("*").alias("n"))


def majority_vote(table: DataFrame) -> DataFrame:
    """(p, mapped): each cluster's most frequent class, noise included; of several the least."""
    return table.groupBy("p").agg(F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("mapped"))


def align(labelled: DataFrame, mapping: DataFrame, label: str) -> DataFrame:
    """labelled with a column `mapped`. The mapping has a row for each cluster."""
    m = mapping.withColumnRenamed("p", label)
    return labelled.join(m, label, "left")


def confusion(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """(y, mapped, n) with zeros, for all classes in either."""
    aligned = table.join(mapping, "p").groupBy("y", "mapped").agg(F.sum("n").alias("n"))
    classes = table.select("y").union(mapping.select("mapped")).distinct()
    grid = classes.join(classes.select(F.col("y").alias("mapped")))  # classes are few
    return grid.join(aligned, ["y", "mapped"], "left").select("y", "mapped", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def supervised(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: accuracy, macro precision, recall and F1, weighted F1; 0 where a class is never predicted or never true."""
    c = confusion(table, mapping)
    hit = F.sum(F.when(F.col("y") == F.col("mapped"), F.col("n")).otherwise(0))
    rows = c.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    cols = c.groupBy(F.col("mapped").alias("c")).agg(F.sum("n").alias("predicted"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = rows.join(cols, "c").where((F.col("support") > 0) | (F.col("predicted") > 0))
    per = per.withColumn("p", ratio(F.col("tp"), F.col("predicted"))).withColumn("r", ratio(F.col("tp"), F.col("support")))
    per = per.withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return per.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("p").alias("precision_macro"),
        F.avg("r").alias("recall_macro"),
        F.avg("f").alias("f1_macro"),
        (F.sum(F.col("f") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def agreement(table: DataFrame) -> DataFrame:
    """One row: adjusted Rand index, normalised mutual information (arithmetic mean), homogeneity, completeness, V."""
    n = F.col("n").cast("double")
    pairs = lambda c: c * (c - 1) / 2
    entropy = lambda c: -F.sum(c / F.col("total") * F.log(c / F.col("total")))
    total = table.agg(F.sum("n").cast("double").alias("total"))
    t = table.crossJoin(F.broadcast(total))  # one row
    ys = t.groupBy("y", "total").agg(F.sum(n).alias("a"))
    ps = t.groupBy("p", "total").agg(F.sum(n).alias("b"))
    mi = t.join(ys.drop("total"), "y").join(ps.drop("total"), "p").agg(
        F.sum(n / F.col("total") * F.log(n * F.col("total") / (F.col("a") * F.col("b")))).alias("mi"), F.sum(pairs(n)).alias("same"), F.max("total").alias("total")
    )
    hy = ys.agg(entropy(F.col("a")).alias("hy"), F.sum(pairs(F.col("a"))).alias("pa"))
    hp = ps.agg(entropy(F.col("b")).alias("hp"), F.sum(pairs(F.col("b"))).alias("pb"))
    one = mi.crossJoin(F.broadcast(hy)).crossJoin(F.broadcast(hp))  # one row each
    expected, most = F.col("pa") * F.col("pb") / pairs(F.col("total")), (F.col("pa") + F.col("pb")) / 2
    h, c = F.when(F.col("hy") > 1e-15, F.col("mi") / F.col("hy")).otherwise(1.0), F.when(F.col("hp") > 1e-15, F.col("mi") / F.col("hp")).otherwise(1.0)
    v = F.when(h + c > 0, 2 * h * c / (h + c)).otherwise(0.0)
    mean = (F.col("hy") + F.col("hp")) / 2
    return one.select(
        F.when(F.abs(most - expected) > 0, (F.col("same") - expected) / (most - expected)).otherwise(1.0).alias("ari"),
        F.when(mean > 1e-15, F.col("mi") / mean).otherwise(1.0).alias("nmi"),
        h.alias("homogeneity"),
        c.alias("completeness"),
        v.alias("v_measure"),
    )


def evaluate_many(points: DataFrame, features: list[str], labellings: dict[str, tuple[str, str]], most: int | None = None, id_column: str = "CustomerID") -> list[dict]:
    """A row of a comparison for each column of labels (its algorithm and parameters); distances are computed once for all."""
    per = [f for c in labellings for f in (F.count_if(F.col(c) == NOISE), F.count_if(F.col(c) >= 0))]
    sums = points.agg(F.count("*"), *per).first()
    used = {r[0]: r[1] for r in _long(points, [], list(labellings)).groupBy("run", "label").count().groupBy("run").count().collect()}
    found = intrinsic_many(points, features, list(labellings), most, id_column)
    return [
        {"algorithm": name, "params": params, "n_clusters": used.get(i, 0), "noise_pct": 100.0 * sums[1 + 2 * i] / sums[0] if sums[0] else None} | found[c]
        for i, (c, (name, params)) in enumerate(labellings.items())
    ]


def evaluate(points: DataFrame, features: list[str], name: str, params: str = "", truth: str | None = None, label: str = "cluster_id", most: int | None = None, id_column: str = "CustomerID") -> dict:
    """A row of a comparison; the supervised parts are None without truth."""
    c = coverage(points, label).first()
    row = {"algorithm": name, "params": params, "n_clusters": c["n_clusters"], "noise_pct": 100.0 * c["n_noise"] / c["n_points"] if c["n_points"] else None}
    row |= intrinsic(points, features, label, most, id_column)
    names = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted", "ari", "nmi", "homogeneity", "completeness", "v_measure")
    row |= dict.fromkeys(names)
    if truth:
        table = contingency(points, truth, label).persist()
        row |= supervised(table, majority_vote(table)).first().asDict() | agreement(table).first().asDict()
        table.unpersist()
    return row
