import itertools
import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellgrove.config import EngineConfig
from cellgrove.functions.columns import cell, edge_text
from cellgrove.operators import baselines, grid, metrics, preprocess, selection, validate
from cellgrove.operators.clusters import Cluster, Model, adjacent_pairs, clusters_of, fit, fit_many
from cellgrove.operators.grid import Unit
from cellgrove.sources.model_store import load_model, save_model
from cellgrove.streaming.score import score_stream


def points(spark, rows, names=None):
    d = len(rows[0])
    names = names or [f"f{i}" for i in range(d)]
    return spark.createDataFrame([(f"p{i:04d}", *map(float, r)) for i, r in enumerate(rows)], "CustomerID string" + "".join(f", {n} double" for n in names)), names


@pytest.mark.parametrize("xi", [8, 10, 12, 49])
def test_cells_at_edges(spark, xi):
    xs = sorted({v for k in range(xi + 1) for v in (k / xi, np.nextafter(k / xi, 0)) if 0 <= v <= 1})
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").select(cell(F.col("x"), xi)).collect()]
    want = [next(i for i in range(xi) if i / xi <= x and (x < (i + 1) / xi or i == xi - 1)) for x in xs]
    assert got == want


def test_rounded_cells_keep_exact_edges(spark):
    got = [r[0] for r in spark.createDataFrame([(k / 12,) for k in (1, 4, 7, 10)], "x double").select(cell(F.col("x"), 12, 9)).collect()]
    assert got == [1, 4, 7, 10]


def test_nan_and_null_are_in_no_cell(spark):
    assert [r[0] for r in spark.createDataFrame([(float("nan"),), (None,)], "x double").select(cell(F.col("x"), 8)).collect()] == [None, None]


def test_edge_text_goes_to_even():
    assert [edge_text(k, 8) for k in (1, 3, 5, 7)] == ["0.12", "0.38", "0.62", "0.88"]


def brute_units(x, xi, tau):
    b = np.minimum((x * xi).astype(int), xi - 1)
    out = {}
    for k in range(1, x.shape[1] + 1):
        for dims in itertools.combinations(range(x.shape[1]), k):
            cells, n = np.unique(b[:, dims], axis=0, return_counts=True)
            out |= {(dims, tuple(map(int, c))): int(m) for c, m in zip(cells, n) if m >= tau * len(x)}
    return out


def test_dense_units_are_those_of_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.random((150, 4)), 0.3 + 0.05 * rng.random((60, 4))])
    df, names = points(spark, x)
    cells = grid.cell_table(df, names, 6)
    units = grid.dense_units(cells, 4, len(x), 6, 0.06)
    assert {(u.dims, u.cells): u.count for u in units} == brute_units(x, 6, 0.06)
    assert max(u.k for u in units) == 4 and len({(u.dims, u.cells) for u in units}) == len(units)
    fewer = grid.at_threshold(units, len(x), 0.2)
    direct = grid.dense_units(cells, 4, len(x), 6, 0.2)
    assert fewer == direct
    for u in units:  # downward closure
        for i in range(u.k if u.k > 1 else 0):
            assert any(v.dims == u.dims[:i] + u.dims[i + 1 :] and v.cells == u.cells[:i] + u.cells[i + 1 :] and v.count >= u.count for v in units)


def test_a_unit_met_twice_is_one():
    level = [Unit((0, 1), (0, 2), 9), Unit((0, 1), (1, 2), 9), Unit((0, 2), (1, 3), 9), Unit((1, 2), (2, 3), 9)]
    assert grid.candidates(level) == [((0, 1, 2), (1, 2, 3))]


def test_subspaces_are_numbered_as_discovered():
    units = [Unit((0,), (0,), 5), Unit((0,), (3,), 5), Unit((0, 2), (0, 1), 4), Unit((0, 1), (3, 0), 4)]
    assert [c.dims for c in clusters_of(units)] == [(0,), (0,), (0, 2), (0, 1)]


def test_diagonal_cells_are_apart_and_l_shapes_have_a_box():
    assert adjacent_pairs([Unit((0, 1), (0, 0), 1), Unit((0, 1), (1, 1), 1)]) == []
    shape = clusters_of([Unit((0, 1), (0, 0), 1), Unit((0, 1), (1, 0), 1), Unit((0, 1), (1, 1), 1)])
    assert len(shape) == 1 and shape[0].box() == [(0, 2), (0, 2)] and shape[0].size == 3


def test_fit_and_predict_differ_on_edges(spark):
    model = Model(4, 0.1, ["f0", "f1"], 10, [Unit((0, 1), (3, 1), 5)])
    df, _ = points(spark, [(1.0, 0.3), (0.9, 0.5), (0.9, 0.3), (0.75, 0.25), (0.74, 0.3)])
    assert [r.cluster_id for r in model.labels(df).orderBy("CustomerID").collect()] == [0, -1, 0, 0, -1]
    assert [r.cluster_id for r in model.predict(df).orderBy("CustomerID").collect()] == [-1, 0, 0, 0, -1]


def test_more_dimensions_come_first_and_then_the_least_id(spark):
    model = Model(4, 0.1, ["f0", "f1"], 10, [Unit((0,), (0,), 5), Unit((1,), (0,), 5), Unit((0, 1), (0, 0), 4)])
    df, _ = points(spark, [(0.1, 0.1), (0.1, 0.9), (0.9, 0.1), (0.9, 0.9), (float("nan"), 0.1)])
    assert [r.cluster_id for r in model.labels(df).orderBy("CustomerID").collect()] == [2, 0, 1, -1, 1]
    members = {(r.CustomerID, r.cluster_id) for r in model.members(df).collect()}
    assert members == {("p0000", 0), ("p0000", 1), ("p0000", 2), ("p0001", 0), ("p0002", 1), ("p0004", 1)}


def test_no_clusters(spark):
    df, names = points(spark, [(i / 50, (i * 7 % 50) / 50) for i in range(50)])
    model, cells = fit(df, names, 8, 0.9)
    assert model.clusters == [] and {r.cluster_id for r in model.labels(df).collect()} == {-1}
    assert model.descriptions(cells).count() == 0 and model.heatmap(spark).count() == 4
    with pytest.raises(RuntimeError):
        model.predict(df)


def test_empty_points(spark):
    df, names = points(spark, [(0.1, 0.2)])
    model, _ = fit(df.where("false"), names)
    assert model.units == []


def test_model_round_trip_and_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    df, names = points(spark, rng.random((80, 3)))
    model, cells = fit(df, names, 4, 0.2)
    scaler = preprocess.Scaler({"f0": [0.1, 0.9]}, {"f0": (0.0, 1.0)})
    save_model(spark, model, str(tmp_path / "m"), scaler, df)
    again, s, profiles = load_model(spark, str(tmp_path / "m"))
    assert again.units == model.units and again.clusters == model.clusters and s == scaler and profiles.count() == 80
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path / "none"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, model).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, model.predict(df).select("CustomerID", "cluster_id").collect()))


def test_quantiles_interpolate_and_large_tables_agree(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (float("nan"),)], "x double")
    assert preprocess.quantiles(df, ["x"], (0.01,))["x"] == pytest.approx([1.02])
    many = spark.range(5000).select(((F.col("id") * 7919) % 4999).cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    a, b = preprocess.quantiles(many, ["x"], (0.01, 0.5, 0.99)), preprocess.quantiles(many, ["x", "none"], (0.01, 0.5, 0.99), direct=10)
    assert a["x"] == pytest.approx(b["x"]) and b["none"] == [None] * 3


def test_skewness_is_corrected(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (4.0,)], "x double")
    assert preprocess.stats(df, ["x"]).first().skewness == pytest.approx(1.3309, abs=1e-4)


def test_constant_feature_is_scaled_to_zero(spark):
    df = spark.createDataFrame([("a", 5.0, 1.0), ("b", 5.0, 2.0), ("c", 5.0, 3.0)], "CustomerID string, recency double, frequency double")
    rows, scaler = preprocess.preprocess(df)
    assert {r.recency for r in rows.collect()} == {0.0} and scaler.ranges["recency"][0] == scaler.ranges["recency"][1]


def test_split_is_the_share_rounded_up(spark):
    df = spark.range(101).select(F.col("id").cast("string").alias("CustomerID"))
    rows = preprocess.with_split(df)
    assert rows.where("split = 'test'").count() == math.ceil(0.2 * 101)
    assert preprocess.with_split(df.where("false")).count() == 0


def brute_metrics(x, y):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    s = []
    for i in range(len(x)):
        own = y == y[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, y == k].mean() for k in set(y) - {y[i]})
        s.append((b - a) / max(a, b))
    ks = sorted(set(y))
    c = np.array([x[y == k].mean(axis=0) for k in ks])
    sp = np.array([np.sqrt(((x[y == k] - c[i]) ** 2).sum(axis=1)).mean() for i, k in enumerate(ks)])
    db = np.mean([max((sp[i] + sp[j]) / np.linalg.norm(c[i] - c[j]) for j in range(len(ks)) if j != i) for i in range(len(ks))])
    w = sum(((x[y == k] - c[i]) ** 2).sum() for i, k in enumerate(ks))
    b = sum((y == k).sum() * ((c[i] - x.mean(axis=0)) ** 2).sum() for i, k in enumerate(ks))
    return np.mean(s), db, b * (len(x) - len(ks)) / (w * (len(ks) - 1))


def test_intrinsic_metrics_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((60, 3)), np.array([0] * 25 + [1] * 24 + [2] + [-1] * 10)
    df, names = points(spark, x)
    ids = spark.createDataFrame([(f"p{i:04d}", int(v)) for i, v in enumerate(y)], "CustomerID string, cluster_id int")
    got = metrics.intrinsic(df.join(ids, "CustomerID"), names)
    want = brute_metrics(x[y >= 0], y[y >= 0])
    assert [got["silhouette"], got["davies_bouldin"], got["calinski_harabasz"]] == pytest.approx(list(want))
    one = metrics.intrinsic(df.withColumn("cluster_id", F.lit(0)), names)
    assert set(one.values()) == {None}


def test_vote_tie_goes_to_the_smaller_class(spark):
    t = spark.createDataFrame([(1, 7, 2), (0, 7, 2), (3, -1, 1)], "y int, p int, n long")
    assert {r.p: r.mapped for r in metrics.majority_vote(t).collect()} == {7: 0, -1: 3}


def test_supervised_and_agreement_extremes(spark):
    same = spark.createDataFrame([(0, 5, 10), (1, 6, 10)], "y int, p int, n long")
    s = metrics.supervised(same, metrics.majority_vote(same)).first()
    assert set(s.asDict().values()) == {1.0}
    assert set(metrics.agreement(same).first().asDict().values()) == {1.0}
    none = spark.createDataFrame([(0, 5, 5), (1, 5, 5), (0, 6, 5), (1, 6, 5)], "y int, p int, n long")
    a = metrics.agreement(none).first()
    assert a.nmi == pytest.approx(0) and a.ari < 0


def test_search_agrees_with_single_fits_and_choice_follows_tiers(spark):
    rng = np.random.default_rng(5)
    df, names = points(spark, np.concatenate([rng.random((60, 3)), 0.1 + 0.05 * rng.random((60, 3))]))
    models, _ = fit_many(df, names, 8, (0.1, 0.3))
    for tau, m in models.items():
        single, _ = fit(df, names, 8, tau)
        assert single.clusters == m.clusters
    assert isinstance(models[0.1].clusters[0], Cluster)
    schema = "xi int, tau double, n_clusters long, coverage double, silhouette double, davies_bouldin double"
    pick = lambda rows: tuple(selection.select_best(spark.createDataFrame(rows, schema).withColumn("quality_score", selection.quality_score())).first())
    assert pick([(8, 0.1, 12, 0.9, 0.3, 1.0), (8, 0.2, 5, 0.9, 0.1, 1.0)]) == (8, 0.2)  # within the limits
    assert pick([(8, 0.1, 12, 0.9, 0.3, 1.0), (8, 0.2, 11, 0.9, 0.1, 1.0)]) == (8, 0.1)  # none is within
    assert pick([(8, 0.1, 5, 0.9, -0.3, 1.0), (8, 0.2, 5, 0.9, -0.1, None)]) == (8, 0.2)  # none is positive
    assert pick([(8, 0.1, 2, 0.9, None, None), (10, 0.1, 2, 0.5, 0.2, None)]) == (10, 0.1)  # all missed a minimum


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0.2, 0.03, (40, 3)), rng.normal(0.7, 0.03, (40, 3)), rng.random((10, 3))])
    df, names = points(spark, x)
    got = {r.CustomerID: r.cluster_id for r in baselines.dbscan(df, names, 0.1).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.1
    core = d.sum(axis=1) >= 5
    label = np.full(len(x), -1)
    k = 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            work, seen = [i], {i}
            while work:
                j = work.pop()
                label[j] = k
                for m in np.flatnonzero(d[j] & core):
                    if m not in seen:
                        seen.add(m)
                        work.append(m)
            k += 1
    for i in np.flatnonzero(~core):
        near = [label[j] for j in np.flatnonzero(d[i] & core)]
        label[i] = min(near, default=-1)
    assert [got[f"p{i:04d}"] for i in range(len(x))] == label.tolist()


def test_near_counts_list_no_pairs(spark):
    """20,000 points in a ball: 200 million pairs, of which none is written. Rows without a feature have no neighbours."""
    x = np.random.default_rng(5).random((20_000, 3)) * 0.1
    got = baselines.near_counts(spark.createDataFrame(pd.DataFrame({"CustomerID": [str(i) for i in range(len(x))], **{f"f{i}": x[:, i] for i in range(3)}})), ["f0", "f1", "f2"], 0.5)
    assert [tuple(r) for r in got.groupBy("n_near").count().collect()] == [(19_999, 20_000)]
    odd = spark.createDataFrame([("a", 0.0), ("b", None), ("c", float("nan")), ("d", 0.5), ("e", float("inf"))], "CustomerID string, f0 double")
    assert {r.CustomerID: r.n_near for r in baselines.near_counts(odd, ["f0"], 0.5).collect()} == {"a": 1, "b": 0, "c": 0, "d": 1, "e": 0}


def test_near_counts_on_the_edge(spark):
    """Points a step of eps apart in a coordinate, some by a rounding more: as the sums in double precision have it."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 8, (1500, 4)) * 0.1
    df = spark.createDataFrame([(str(i), *map(float, v)) for i, v in enumerate(x)], "CustomerID string, f0 double, f1 double, f2 double, f3 double")
    d = np.zeros((len(x), len(x)))
    for k in range(4):
        d += (x[:, None, k] - x[None, :, k]) ** 2
    want = (np.sqrt(d) <= 0.3).sum(axis=1) - 1
    assert {r.CustomerID: r.n_near for r in baselines.near_counts(df, ["f0", "f1", "f2", "f3"], 0.3).collect()} == {str(i): int(n) for i, n in enumerate(want)}


def test_dbscan_of_many_clusters(spark):
    """More than 100,000 clusters, and a chain of points that is one."""
    x = np.concatenate([np.arange(100_500) * 10.0, -10 - np.arange(3000) * 0.5])
    df = spark.createDataFrame(pd.DataFrame({"CustomerID": [f"{i:06d}" for i in range(len(x))], "f0": x}))
    out = baselines.dbscan(df, ["f0"], 0.5, 1).groupBy("cluster_id").count().groupBy("count").agg(F.count("*").alias("n"), F.max("cluster_id").alias("last"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 100_500, 100_499), (3000, 1, 100_500)]


def test_ward_merges_least_squares_first():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    assert baselines.ward(x, 3).tolist() == [0, 0, 1, 1, 2]
    assert baselines.ward(x, 2).tolist() == [0, 0, 1, 1, 1]


def test_ward_in_rounds_equals_chains(spark):
    """Merges of all pairs that are nearest to each other, on the driver and in tasks, are those of chains; equal rows count."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(900, 4)), rng.normal(3, 0.2, (300, 4))])
    x = np.concatenate([x, x[:200], x[:50]])
    chains = baselines.merges(x, few=len(x))
    for got in (baselines.merges(x, few=10), baselines.merges(np.concatenate([x] * 8) + np.repeat(np.arange(8), len(x))[:, None] * 100, spark, few=10)):
        assert len(got[0]) in (len(x) - 1, 8 * len(x) - 1)
        if len(got[0]) == len(x) - 1:
            assert np.allclose(np.sort(got[0]), np.sort(chains[0]))
            assert all((baselines.cut(got, len(x), k) == baselines.cut(chains, len(x), k)).all() for k in (2, 5, 60))
        else:
            assert (baselines.cut(got, 8 * len(x), 8) == np.repeat(np.arange(8), len(x))).all()


def test_comparison_shares_distances(spark, monkeypatch):
    """Ten labellings of the same points: one pass of distances, and the figures of each alone."""
    rng, calls, many = np.random.default_rng(3), [], metrics.silhouette_rows_many
    df, names = points(spark, rng.random((90, 3)))
    df = df.withColumns({f"run_{i}": (F.pmod(F.xxhash64("CustomerID", F.lit(i)), F.lit(i + 2)) - 1).cast("int") for i in range(10)})
    monkeypatch.setattr(metrics, "silhouette_rows_many", lambda *a, **k: calls.append(1) or many(*a, **k))
    got = metrics.evaluate_many(df, names, {f"run_{i}": ("hash", str(i)) for i in range(10)})
    assert len(calls) == 1
    for i in (0, 1, 9):
        alone = metrics.evaluate(df, names, "hash", str(i), label=f"run_{i}")
        assert all(got[i][k] == (pytest.approx(alone[k]) if isinstance(alone[k], float) else alone[k]) for k in got[i])


def test_search_shares_distances(spark, monkeypatch):
    calls, many = [], metrics.silhouette_rows_many
    df, names = points(spark, np.random.default_rng(8).random((300, 3)) ** 2)
    monkeypatch.setattr(metrics, "silhouette_rows_many", lambda *a, **k: calls.append(1) or many(*a, **k))
    assert selection.grid_search(df, names).count() == 15 and len(calls) == 1


def test_silhouettes_of_equal_and_distant_points(spark):
    """Sums by product leave too few digits for equal points far from the origin: these have distance 0."""
    x = np.concatenate([np.full((40, 2), 1e6), np.full((40, 2), 1e6)])
    df, names = points(spark, x)
    rows = metrics.silhouette_rows(df.withColumn("cluster_id", F.pmod(F.xxhash64("CustomerID"), F.lit(2)).cast("int")), names)
    assert {r.silhouette for r in rows.collect()} == {0.0}


def test_agglomerative_has_a_limit(spark):
    df, names = points(spark, [(0.1,), (0.2,), (0.9,)])
    with pytest.raises(ValueError):
        baselines.agglomerative(df, names, 2, most=2)
    assert {r.CustomerID: r.cluster_id for r in baselines.agglomerative(df, names, 2).collect()} == {"p0000": 0, "p0001": 0, "p0002": 1}


def test_violations_are_counted(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (3.0, 2.0), (3.0, float("inf"))], "frequency double, x double")
    got = {r.check: r.violations for r in validate.profile_violations(df, ["frequency", "x"]).collect()}
    assert got == {"null_or_nan": 1, "infinite": 1, "too_few_orders": 1}
    with pytest.raises(ValueError):
        validate.profile_violations(df, ["y"])


def test_ward_of_more_rows_than_fit_a_table_of_pairs(spark):
    rng = np.random.default_rng(3)
    df, names = points(spark, np.concatenate([rng.normal(c, 0.01, (2100, 2)) for c in (0.2, 0.8)]))
    out = baselines.agglomerative(df, names, 2).groupBy("cluster_id").count().collect()
    assert sorted(map(tuple, out)) == [(0, 2100), (1, 2100)]


def test_ward_against_all_pairs():
    x = np.random.default_rng(4).random((50, 3))
    groups = [[i] for i in range(len(x))]
    while len(groups) > 4:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    of = {i: min(g) for g in groups for i in g}
    number = {m: n for n, m in enumerate(sorted(set(of.values())))}
    assert baselines.ward(x, 4).tolist() == [number[of[i]] for i in range(len(x))]


def test_silhouette_takes_all_rows(spark):
    df = spark.range(20_400).select(F.col("id").cast("string").alias("CustomerID"), (F.col("id") / 20_400).alias("f0"), F.when(F.col("id") < 10_000, 0).otherwise(1).alias("cluster_id"))
    got = metrics.silhouette_rows(df, ["f0"]).groupBy("cluster_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 10_000), (1, 10_400)]


def test_silhouette_by_blocks_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x, y = rng.random((60, 3)), np.array([0] * 25 + [1] * 24 + [2] + [-1] * 10)
    df, names = points(spark, x)
    ids = spark.createDataFrame([(f"p{i:04d}", int(v)) for i, v in enumerate(y)], "CustomerID string, cluster_id int")
    got = metrics.silhouette_rows(df.join(ids, "CustomerID"), names, block=23).agg(F.count("*"), F.avg("silhouette")).first()
    assert tuple(got) == pytest.approx((50, brute_metrics(x[y >= 0], y[y >= 0])[0]))


def test_units_by_subspace():
    units = [Unit((0,), (1,), 5), Unit((1,), (2,), 6), Unit((0, 1), (1, 2), 5), Unit((0,), (2,), 4)]
    model = Model(8, 0.05, ["a", "b"], 10, units)
    assert model.dense_units() == {(0,): [units[0], units[3]], (1,): [units[1]], (0, 1): [units[2]]}


def test_repeated_points_are_one_point_with_a_weight(spark, monkeypatch):
    rng, seen = np.random.default_rng(8), []
    x, y = np.repeat(rng.random((40, 3)), 5, axis=0), np.repeat([0] * 15 + [1] * 15 + [-1] * 10, 5)
    df, names = points(spark, x)
    ids = spark.createDataFrame([(f"p{i:04d}", int(v)) for i, v in enumerate(y)], "CustomerID string, cluster_id int")
    blocks, counts = metrics._blocks, baselines.space.counts
    monkeypatch.setattr(metrics, "_blocks", lambda *a: (seen.append(len(b[0])) or b for b in blocks(*a)))
    got = metrics.silhouette_rows(df.join(ids, "CustomerID"), names, block=23).agg(F.count("*"), F.avg("silhouette")).first()
    assert tuple(got) == pytest.approx((150, brute_metrics(x[y >= 0], y[y >= 0])[0])) and sum(seen) == 30
    seen.clear()
    monkeypatch.setattr(baselines.space, "counts", lambda s, t, *a: seen.append(len(t.x)) or counts(s, t, *a))
    near = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.2).sum(axis=1)
    assert [r.n_near + 1 for r in baselines.near_counts(df, names, 0.2).orderBy("CustomerID").collect()] == near.tolist()
    found = {r.CustomerID: r.cluster_id for r in baselines.dbscan(df, names, 0.2, 11).collect()}
    core, cluster = near >= 11, np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if cluster[i] < 0:
            left, number = [i], cluster.max() + 1
            while left:
                at = left.pop()
                for j in np.flatnonzero((np.sqrt(((x - x[at]) ** 2).sum(axis=1)) <= 0.2) & core & (cluster < 0)):
                    cluster[j] = number
                    left.append(j)
    for i in np.flatnonzero(~core):
        cluster[i] = min((cluster[j] for j in np.flatnonzero((np.sqrt(((x - x[i]) ** 2).sum(axis=1)) <= 0.2) & core)), default=-1)
    assert [found[f"p{i:04d}"] for i in range(len(x))] == cluster.tolist() and seen == [40, 40]


def test_search_sends_repeated_points_once(spark, monkeypatch):
    rng, seen, blocks = np.random.default_rng(9), [], metrics._blocks
    once = np.concatenate([rng.normal(c, 0.02, (30, 2)) for c in (0.2, 0.8)])
    df, names = points(spark, np.repeat(once, 4, axis=0))
    monkeypatch.setattr(metrics, "_blocks", lambda *a: (seen.append(len(b[0])) or b for b in blocks(*a)))
    found = selection.grid_search(df, names, EngineConfig(xi_grid=(4,), tau_grid=(0.1,))).first()
    assert 0 < sum(seen) <= 60 and found.silhouette is not None


def test_search_labels_repeated_points_once(spark, monkeypatch):
    """Equal points are one row when they are labelled, and the results are those of points one by one."""
    rng = np.random.default_rng(3)
    x = np.repeat(np.round(rng.random((60, 2)) ** 2, 2), 20, axis=0)
    points = spark.createDataFrame([(str(i), *map(float, p)) for i, p in enumerate(x)], "CustomerID string, a double, b double")
    config, seen = EngineConfig(xi_grid=(4, 5), tau_grid=(0.1, 0.15)), []
    whole = metrics.intrinsic_many
    monkeypatch.setattr(metrics, "intrinsic_many", lambda p, f, labels, *a, **k: seen.append((p, labels)) or whole(p, f, labels, *a, **k))
    once = [r[:5] + r[6:] for r in selection.grid_search(points, ["a", "b"], config).collect()]
    assert seen[0][0].count() == len(np.unique(x, axis=0)) < 1200
    each = [r[:5] + r[6:] for r in selection.grid_search(points, ["a", "b"], replace(config, silhouette_rows=10**9)).collect()]
    assert once == each and any(r[5] is not None for r in once)
    assert seen[1][0].count() == 1200
