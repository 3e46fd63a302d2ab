"""From profiles to features in [0, 1]: winsorised, log-transformed, split and scaled."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FEATURES, LOG_FEATURES, EngineConfig
from ..functions.columns import log_feature, number


def quantiles(df: DataFrame, columns: list[str], qs: tuple[float, ...], direct: int = 2_000_000) -> dict[str, list[float]]:
    """Exact quantiles with linear interpolation; None for a column without values.

    Up to `direct` rows by one aggregate. Beyond, an approximation first finds for all quantiles narrow brackets
    of values, one pass counts what lies below each, and only the values inside are ordered exactly."""
    n = df.agg(*(F.count(number(F.col(c))).alias(c) for c in columns)).first()
    if max(n, default=0) <= direct:
        row = df.agg(*(F.percentile(number(F.col(c)), [*map(float, qs)]).alias(c) for c in columns)).first()
        return {c: row[c] for c in columns}
    known = [c for c in columns if n[c]]
    asked = [v for q in qs for v in (max(0.0, q - 0.001), min(1.0, q + 0.001))]
    brackets = df.agg(*(F.percentile_approx(number(F.col(c)), asked, 100_000).alias(c) for c in known)).first()
    spans = {(c, i): (brackets[c][2 * i], brackets[c][2 * i + 1]) for c in known for i in range(len(qs))}
    below = df.agg(*(F.count_if(number(F.col(c)) < lo).alias(f"{c}_{i}") for (c, i), (lo, _) in spans.items())).first()
    out: dict[str, list[float]] = {c: [None] * len(qs) for c in columns}
    for (c, i), (lo, hi) in spans.items():
        x, place = number(F.col(c)), qs[i] * (n[c] - 1)
        inside = df.where((x >= lo) & (x <= hi)).groupBy(x.alias("v")).count().orderBy("v")
        seen, want, got = below[f"{c}_{i}"], [math.floor(place), math.ceil(place)], []
        for r in inside.toLocalIterator():
            seen += r["count"]
            while len(got) < 2 and want[len(got)] < seen:
                got.append(r["v"])
            if len(got) == 2:
                break
        out[c][i] = got[0] + (got[1] - got[0]) * (place - want[0])
    return out


def winsorised(df: DataFrame, bounds: dict[str, list[float]]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))) for c, (lo, hi) in bounds.items() if c in df.columns})


def logged(df: DataFrame, columns: tuple[str, ...] = LOG_FEATURES) -> DataFrame:
    return df.withColumns({c: log_feature(F.col(c)) for c in columns if c in df.columns})


def split_rank_key(id_column: str) -> Column:
    return F.concat(F.md5(F.col(id_column).cast("binary")), F.col(id_column))


def with_split(df: DataFrame, id_column: str = "CustomerID", share: float = 0.2) -> DataFrame:
    """A `split` column: the ceil(share * n) rows with the least md5 of the id are the test split.

    The cut is found from counts of the hash's first four digits and the ids of one such bucket, so no global sort is needed."""
    key = split_rank_key(id_column)
    counts = sorted((r[0], r[1]) for r in df.groupBy(F.substring(key, 1, 4).alias("p")).count().collect())
    want, seen = math.ceil(share * sum(n for _, n in counts)), 0
    for prefix, n in counts:
        if seen + n >= want > 0:
            ids = sorted(r[0] for r in df.where(F.substring(key, 1, 4) == prefix).select(key).collect())
            return df.withColumn("split", F.when(key <= ids[want - seen - 1], "test").otherwise("train"))
        seen += n
    return df.withColumn("split", F.lit("train"))


@dataclass(frozen=True)
class Scaler:
    """What was learned: caps for each feature, and minimum and maximum of the training rows."""

    bounds: dict[str, list[float]]
    ranges: dict[str, tuple[float, float]]
    log_features: tuple[str, ...] = field(default=LOG_FEATURES)

    def apply(self, df: DataFrame) -> DataFrame:
        df = logged(winsorised(df, self.bounds), self.log_features)
        return df.withColumns({c: scaled(F.col(c), lo, hi) for c, (lo, hi) in self.ranges.items() if c in df.columns})


def scaled(x: Column, lo: float, hi: float) -> Column:
    """Min-max scaling; a constant feature becomes 0."""
    return (x - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.when(x.isNotNull(), F.lit(0.0))


def ranges_of(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*(f(number(F.col(c))).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max)))).first()
    return {c: (row[f"lo_{c}"] or 0.0, row[f"hi_{c}"] or 0.0) for c in columns}


def preprocess(profile: DataFrame, config: EngineConfig = EngineConfig(), columns: tuple[str, ...] = FEATURES, id_column: str = "CustomerID") -> tuple[DataFrame, Scaler]:
    """(id, features in about [0, 1], split) and what was learned. The scaler learns from the training split only."""
    cols = [c for c in columns if c in profile.columns]
    rows = with_split(profile.select(id_column, *cols), id_column, config.test_share)
    seen = rows if config.winsor_on == "all" else rows.where("split = 'train'")
    bounds = {c: v for c, v in quantiles(seen, cols, config.winsor_quantiles).items() if v and None not in v}
    ranges = ranges_of(logged(winsorised(rows.where("split = 'train'"), bounds)), cols)
    scaler = Scaler(bounds, ranges)
    return scaler.apply(rows), scaler


def corrected_skew(c: str) -> Column:
    """Skewness with the correction for bias; null for fewer than three values."""
    n = F.count(number(F.col(c)))
    return F.when(n > 2, F.skewness(number(F.col(c))) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each feature: mean, sample deviation, minimum, maximum, skewness, and whether that asks for a log."""
    per = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), corrected_skew(c).alias("skewness")) for c in columns]
    rows = df.agg(F.array(*per).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return rows.withColumn("needs_log", F.abs("skewness") > 1)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of all pairs of features, each pair in both orders, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs)).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    both = row.union(row.select("b", "a", "r"))
    ones = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, r double")
    return both.union(ones).select(F.col("a").alias("feature_1"), F.col("b").alias("feature_2"), "r")


def histogram(df: DataFrame, columns: list[str], bins: int = 40) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins have no row."""
    bounds = ranges_of(df, columns)
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), number(F.col(c)).alias("x"), F.lit(bounds[c][0]).alias("lo"), F.lit(bounds[c][1]).alias("hi")) for c in columns))).alias("s")).select("s.*")
    width = F.when(F.col("hi") > F.col("lo"), F.floor(F.round((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins, 9))).otherwise(0)
    return long.where("x IS NOT NULL").groupBy("feature", F.least(width, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    q = quantiles(df, columns, (0.25, 0.5, 0.75))
    return df.sparkSession.createDataFrame([(c, *map(float, v)) for c, v in q.items() if v and None not in v], "feature string, q1 double, median double, q3 double")
