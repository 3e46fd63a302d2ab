"""Clusters: adjacent dense units of a subspace, with descriptions, labels of points and scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FEATURES, NOISE
from ..functions.columns import cell, clipped, edge_text, on_edge, packed
from . import grid
from .grid import Unit


@dataclass(frozen=True)
class Cluster:
    id: int
    dims: tuple[int, ...]
    units: tuple[Unit, ...]

    @property
    def k(self) -> int:
        return len(self.dims)

    @property
    def size(self) -> int:
        """Points in the cluster: cells of a subspace don't overlap."""
        return sum(u.count for u in self.units)

    def box(self) -> list[tuple[int, int]]:
        """First edge and last edge in each dimension, over all units."""
        return [(min(u.cells[i] for u in self.units), max(u.cells[i] for u in self.units) + 1) for i in range(self.k)]


def adjacent_pairs(units: list[Unit]) -> list[tuple[int, int]]:
    """Pairs of units of one subspace that differ by one step in one dimension, found by looking up each unit's next cells."""
    place = {(u.dims, u.cells): i for i, u in enumerate(units)}
    pairs = []
    for i, u in enumerate(units):
        for d in range(u.k):
            after = u.cells[:d] + (u.cells[d] + 1,) + u.cells[d + 1 :]
            if (j := place.get((u.dims, after))) is not None:
                pairs.append((min(i, j), max(i, j)))
    return sorted(pairs)


def clusters_of(units: list[Unit]) -> list[Cluster]:
    """Connected units, numbered by level, subspace and first unit in order of discovery."""
    root = list(range(len(units)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in adjacent_pairs(units):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    groups: dict[int, list[Unit]] = {}
    for i, u in enumerate(units):
        groups.setdefault(find(i), []).append(u)
    space: dict[tuple[int, ...], int] = {}
    for i, u in enumerate(units):
        space.setdefault(u.dims, i)
    order = sorted(groups, key=lambda r: (units[r].k, space[units[r].dims], r))
    return [Cluster(i, units[r].dims, tuple(groups[r])) for i, r in enumerate(order)]


def business_label(dims: Column, profile: dict[str, Column]) -> Column:
    """A name from a cluster's features and their means: the first rule that holds."""
    has = lambda *names: F.array_size(F.array_intersect(dims, F.array(*map(F.lit, names)))) == len(names)
    both = has("frequency", "monetary")
    # fixed values: thresholds and names
    return (
        F.when(both & (profile["frequency"] > 0.6) & (profile["monetary"] > 0.6), "VIP - Mua nhieu, chi tieu cao")
        .when(both & (profile["frequency"] < 0.3), "One-time buyer")
        .when(has("recency", "weekend_ratio"), "Seasonal / Weekend shopper")
        .when(has("repeat_category_rate", "frequency"), "Brand-loyal customer")
        .when(has("product_diversity", "avg_basket"), "Explorer - Thich da dang san pham")
        .when(has("return_rate") & (profile["return_rate"] > 0.4), "High-return risk")
        .otherwise("General cluster")
    )


@dataclass
class Model:
    """A fitted subspace clustering."""

    xi: int
    tau: float
    features: list[str]
    n: int
    units: list[Unit]
    digits: int | None = None
    clusters: list[Cluster] = field(init=False)

    def __post_init__(self):
        self.clusters = clusters_of(self.units)

    def dense_units(self) -> dict[tuple[int, ...], list[Unit]]:
        """Dense units by subspace, in order of discovery."""
        out: dict[tuple[int, ...], list[Unit]] = {}
        for u in self.units:
            out.setdefault(u.dims, []).append(u)
        return out

    def _spaces(self) -> list[tuple[tuple[int, ...], dict[int, Cluster]]]:
        """For each subspace, clusters by packed cell."""
        out: dict[tuple[int, ...], dict[int, Cluster]] = {}
        for c in self.clusters:
            for u in c.units:
                key = 0
                for x in u.cells:
                    key = key * self.xi + x
                out.setdefault(c.dims, {})[key] = c
        return list(out.items())

    def _first(self, hits: list[Column]) -> Column:
        """The id in the least of structs (-k, id); noise if there is none."""
        if not hits:
            return F.lit(NOISE)
        best = F.array_min(F.filter(F.array(*hits), lambda h: h.isNotNull()))
        return F.coalesce(best["id"], F.lit(NOISE))

    @staticmethod
    def _look_up(key: Column, by_key: dict[int, Cluster], k: int) -> Column:
        """(-k, id) of the cluster at a packed cell, or null. A subspace has at most 1/tau cells."""
        ids = F.create_map(*(F.lit(x) for k_, c in sorted(by_key.items()) for x in (k_, c.id)))
        found = F.try_element_at(ids, key)
        return F.when(found.isNotNull(), F.struct(F.lit(-k).alias("rank"), found.alias("id")))

    def label(self, cells: list[Column] | None = None) -> Column:
        """The label that fitting gives a point: of the clusters whose cells hold it the one of most dimensions, then of least id.

        cells: columns that hold the point's intervals; made from the features if absent."""
        b = cells or [cell(clipped(F.col(c)), self.xi, self.digits) for c in self.features]
        return self._first([self._look_up(packed([b[d] for d in dims], self.xi), by_key, len(dims)) for dims, by_key in self._spaces()]).cast("int")

    def predicted(self) -> Column:
        """The label of a new point. Other than in fitting, the upper edge belongs to a cell in the last of its
        dimensions only; so a point may lie in two cells there, and at 1 in none in the others."""
        if not self.clusters:
            raise RuntimeError("there is no cluster to score with: fit a model first, or with a smaller tau")
        x = [clipped(F.col(c)) for c in self.features]
        b = [cell(v, self.xi, self.digits) for v in x]
        edge = [on_edge(v, self.xi, self.digits) for v in x]
        open_ = [F.when(v < 1, c) for v, c in zip(x, b, strict=True)]
        hits = []
        for dims, by_key in self._spaces():
            last = dims[-1]
            front = [open_[d] for d in dims[:-1]]
            below = F.when(edge[last] & (b[last] > 0) & (x[last] < 1), b[last] - 1)
            hits += [self._look_up(packed([*front, at], self.xi), by_key, len(dims)) for at in (b[last], below)]
        return self._first(hits).cast("int")

    def labels(self, points: DataFrame, id_column: str = "CustomerID") -> DataFrame:
        return points.select(id_column, self.label().alias("cluster_id"))

    def predict(self, points: DataFrame) -> DataFrame:
        """points with cluster_id; also for a stream."""
        return points.withColumn("cluster_id", self.predicted())

    def members(self, points: DataFrame, id_column: str = "CustomerID") -> DataFrame:
        """(id, cluster_id) of every cluster whose cells hold the point; clusters of several subspaces overlap."""
        b = [cell(clipped(F.col(c)), self.xi, self.digits) for c in self.features]
        hits = [self._look_up(packed([b[d] for d in dims], self.xi), by_key, len(dims)) for dims, by_key in self._spaces()]
        if not hits:
            return points.select(id_column, F.lit(NOISE).alias("cluster_id")).where("false")
        found = F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull()))
        return points.select(id_column, found.alias("h")).select(id_column, F.col("h.id").alias("cluster_id"))

    def description(self, c: Cluster) -> str:
        return " AND ".join(f"{self.features[d]} in [{edge_text(lo, self.xi)}, {edge_text(hi, self.xi)}]" for d, (lo, hi) in zip(c.dims, c.box(), strict=True))

    def cluster_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c.id, c.k, list(c.dims), [self.features[d] for d in c.dims], len(c.units), c.size, c.size / self.n, self.description(c)) for c in self.clusters]
        return spark.createDataFrame(rows, "cluster_id int, k_dim int, dims array<int>, subspace array<string>, n_units int, size long, coverage double, description string")

    def cluster_units(self, spark: SparkSession) -> DataFrame:
        rows = [(c.id, c.k, list(u.dims), list(u.cells), u.count) for c in self.clusters for u in c.units]
        return spark.createDataFrame(rows, "cluster_id int, k int, dims array<int>, cells array<int>, cnt long")

    def profiles(self, cells: DataFrame) -> DataFrame:
        """Mean of each feature over a cluster's members (before assignment), from the cell table's sums."""
        b = [F.col(f"b{i}") for i in range(len(self.features))]
        hits = [self._look_up(packed([b[d] for d in dims], self.xi), by_key, len(dims)) for dims, by_key in self._spaces()]
        if not hits:
            return cells.sparkSession.createDataFrame([], "cluster_id int, size long" + "".join(f", {c} double" for c in self.features))
        long = cells.select(F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"), "n", *(f"s{i}" for i in range(len(self.features))))
        return long.groupBy(F.col("h.id").alias("cluster_id")).agg(F.sum("n").alias("size"), *((F.sum(f"s{i}") / F.sum("n")).alias(c) for i, c in enumerate(self.features)))

    def subspace_coverage(self, spark: SparkSession) -> DataFrame:
        """Per subspace its dimensions, clusters, and the coverage of the largest one; by coverage, then discovery."""
        rows: dict[tuple[int, ...], list] = {}
        for c in self.clusters:
            row = rows.setdefault(c.dims, [" & ".join(self.features[d] for d in c.dims), c.k, 0, 0.0, len(rows)])
            row[2] += 1
            row[3] = max(row[3], c.size / self.n)
        return spark.createDataFrame(list(map(tuple, rows.values())), "subspace string, dimensions int, n_clusters int, coverage double, pos int").orderBy(F.desc("coverage"), "pos")

    def heatmap(self, spark: SparkSession) -> DataFrame:
        """Every pair of features with the clusters and coverage of its plane; 0 on the diagonal."""
        d = len(self.features)
        count, cover = np.zeros((d, d), int), np.zeros((d, d))
        for c in self.clusters:
            if c.k == 2:
                i, j = c.dims
                count[i, j] += 1
                cover[i, j] = max(cover[i, j], c.size / self.n)
        rows = [(self.features[i], self.features[j], int((count + count.T)[i, j]), float((cover + cover.T)[i, j])) for i in range(d) for j in range(d)]
        return spark.createDataFrame(rows, "dim_1 string, dim_2 string, n_clusters int, coverage double")

    def top_planes(self, spark: SparkSession, n: int = 2) -> DataFrame:
        return self.subspace_coverage(spark).where("dimensions = 2").orderBy(F.desc("coverage"), "pos").limit(n)

    def descriptions(self, cells: DataFrame) -> DataFrame:
        """Cluster table with business labels, largest first."""
        table = self.cluster_table(cells.sparkSession).join(F.broadcast(self.profiles(cells).drop("size")), "cluster_id", "left")
        known = {c: F.col(c) if c in self.features else F.lit(None).cast("double") for c in FEATURES}
        out = table.withColumn("business_label", business_label(F.col("subspace"), known))
        return out.select("cluster_id", "k_dim", "subspace", "size", F.round(F.col("coverage") * 100, 1).alias("coverage_pct"), "description", "business_label").orderBy(F.desc("size"), "cluster_id")


def fit_many(points: DataFrame, features: list[str], xi: int, taus: tuple[float, ...], digits: int | None = None) -> tuple[dict[float, Model], DataFrame]:
    """A model for each tau from one search, and the cell table (cached; unpersist it when done)."""
    cells = grid.cell_table(points, features, xi, digits).persist()
    n = cells.agg(F.sum("n")).first()[0] or 0
    units = grid.dense_units(cells, len(features), n, xi, min(taus)) if n else []
    return {t: Model(xi, t, features, n, grid.at_threshold(units, n, t) if t > min(taus) else units, digits) for t in taus}, cells


def fit(points: DataFrame, features: list[str] = list(FEATURES), xi: int = 8, tau: float = 0.05, digits: int | None = None) -> tuple[Model, DataFrame]:
    models, cells = fit_many(points, features, xi, (tau,), digits)
    return models[tau], cells
