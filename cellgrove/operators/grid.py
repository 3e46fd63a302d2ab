"""Dense grid cells of all subspaces, level by level.

Points are first counted by their full tuple of cells, one shuffle with partial aggregation; everything
after that reads this cell table, which has at most min(n, xi**d) rows. A subspace has at most 1/tau dense
units, as their counts add up to n or less, so lists of units are small whatever n is, and candidates are made from
them on the driver. Counts don't depend on tau: one search at the least tau serves all larger ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import check_parameters
from ..functions.columns import cell, clipped, packed


@dataclass(frozen=True)
class Unit:
    """A dense cell of a subspace: dimensions in order, its interval in each, points in it."""

    dims: tuple[int, ...]
    cells: tuple[int, ...]
    count: int

    @property
    def k(self) -> int:
        return len(self.dims)


UNIT_SCHEMA = T.StructType(
    [
        T.StructField("k", T.IntegerType()),
        T.StructField("dims", T.ArrayType(T.IntegerType())),
        T.StructField("cells", T.ArrayType(T.IntegerType())),
        T.StructField("cnt", T.LongType()),
        T.StructField("density", T.DoubleType()),
        T.StructField("pos", T.LongType()),
    ]
)


def with_cells(points: DataFrame, features: list[str], xi: int, digits: int | None = None) -> DataFrame:
    """points with a column b0, b1, ... for each feature's interval."""
    return points.withColumns({f"b{i}": cell(clipped(F.col(c)), xi, digits) for i, c in enumerate(features)})


def cell_table(points: DataFrame, features: list[str], xi: int, digits: int | None = None) -> DataFrame:
    """(b0.., n, s0..): points in each full tuple of cells, and sums of their clipped features."""
    binned = with_cells(points, features, xi, digits)
    return binned.groupBy(*(f"b{i}" for i in range(len(features)))).agg(F.count("*").alias("n"), *(F.sum(clipped(F.col(c))).alias(f"s{i}") for i, c in enumerate(features)))


def count_cells(cells: DataFrame, subspaces: list[tuple[int, ...]], xi: int, least: float) -> dict[tuple[int, ...], dict[tuple[int, ...], int]]:
    """Counts of the cells of these subspaces that hold at least `least` points, from one job."""
    if not subspaces:
        return {}
    keys = [F.struct(F.lit(i).alias("s"), packed([F.col(f"b{d}") for d in dims], xi).alias("key")) for i, dims in enumerate(subspaces)]
    long = cells.select(F.explode(F.array(*keys)).alias("e"), "n").where("e.key IS NOT NULL")
    rows = long.groupBy("e.s", "e.key").agg(F.sum("n").alias("cnt")).where(F.col("cnt") >= F.lit(least)).collect()
    out: dict[tuple[int, ...], dict[tuple[int, ...], int]] = {}
    for s, key, cnt in rows:
        dims, digits = subspaces[s], []
        for _ in dims:
            key, digit = divmod(key, xi)
            digits.append(digit)
        out.setdefault(dims, {})[tuple(reversed(digits))] = cnt
    return out


def candidates(level: list[Unit]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Cells of the next level all of whose projections are dense, each once, in order of discovery.

    Two units whose dimensions differ in the last one only give a cell: the second one's intervals, where both
    have one. With other intervals in front the same cell is met again; the first meeting gives its place."""
    dense = {(u.dims, u.cells) for u in level}
    fronts: dict[tuple[int, ...], list[Unit]] = {}
    for u in level:
        fronts.setdefault(u.dims[:-1], []).append(u)
    found: dict[tuple[tuple[int, ...], tuple[int, ...]], None] = {}
    for units in fronts.values():
        for a, b in combinations(units, 2):
            if a.dims[-1] != b.dims[-1]:
                at = dict(zip(a.dims, a.cells, strict=True)) | dict(zip(b.dims, b.cells, strict=True))
                dims = tuple(sorted(at))
                found[dims, tuple(at[d] for d in dims)] = None
    drop = lambda t, i: t[:i] + t[i + 1 :]
    return [(d, c) for d, c in found if all((drop(d, i), drop(c, i)) in dense for i in range(len(d)))]


def dense_units(cells: DataFrame, d: int, n: int, xi: int, tau: float) -> list[Unit]:
    """All dense units, in levels and within them in order of discovery. One job for each level."""
    check_parameters(xi, tau)
    counts = count_cells(cells, [(i,) for i in range(d)], xi, tau * n)
    level = [Unit(dims, c, counts[dims][c]) for dims in sorted(counts) for c in sorted(counts[dims])]
    units = list(level)
    while level and level[0].k < d:
        wanted = candidates(level)
        counts = count_cells(cells, sorted({dims for dims, _ in wanted}), xi, tau * n)
        level = [Unit(dims, c, counts[dims][c]) for dims, c in wanted if c in counts.get(dims, {})]
        units += level
    return units


def at_threshold(units: list[Unit], n: int, tau: float) -> list[Unit]:
    """The units that are dense at a larger tau, in the order of a search at that tau."""
    left = {(u.dims, u.cells): u for u in units if u.count >= tau * n}
    level = [u for u in left.values() if u.k == 1]
    out = list(level)
    while level:
        level = [left[key] for key in candidates(level) if key in left]
        out += level
    return out


def unit_table(spark: SparkSession, units: list[Unit], n: int) -> DataFrame:
    return spark.createDataFrame([(u.k, list(u.dims), list(u.cells), u.count, u.count / n, i) for i, u in enumerate(units)], UNIT_SCHEMA)
