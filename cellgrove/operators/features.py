"""Behavioural features of each customer, from clean transactions and cancellations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot(cleaned: DataFrame) -> DataFrame:
    """One row: a day after the last purchase."""
    return cleaned.agg((F.max("InvoiceDate") + F.expr("INTERVAL 1 DAY")).alias("snapshot"))


def recency_days(snapshot_at: Column, last: Column) -> Column:
    """Whole periods of 24 hours, not calendar days."""
    return F.timestamp_diff("DAY", last, snapshot_at)


def cancel_counts(cancelled: DataFrame) -> DataFrame:
    return cancelled.where(F.col("CustomerID").isNotNull()).groupBy("CustomerID").agg(F.count_distinct("InvoiceNo").alias("n_cancelled"))


def line_features(cleaned: DataFrame) -> DataFrame:
    """Per customer, from a tree of small aggregates: invoices, products and categories are counted once each, so
    that no distinct aggregate expands the lines."""
    weekend = F.when(F.weekday("InvoiceDate") >= 5, 1).otherwise(0)
    lines = cleaned.select("CustomerID", "InvoiceNo", "StockCode", "InvoiceDate", "Revenue", weekend.alias("w"))
    by_invoice = lines.groupBy("CustomerID", "InvoiceNo").agg(F.max("InvoiceDate").alias("last"), F.sum("Revenue").alias("revenue"), F.count("*").alias("lines"), F.sum("w").alias("weekend"))
    one = by_invoice.groupBy("CustomerID").agg(F.max("last").alias("last"), F.count("*").alias("frequency"), F.sum("revenue").cast("double").alias("monetary"), F.sum("lines").alias("lines"), F.sum("weekend").alias("weekend"))
    by_stock = lines.groupBy("CustomerID", "StockCode").agg(F.count("*").alias("n"))
    by_category = by_stock.groupBy("CustomerID", F.substring("StockCode", 1, 2).alias("category")).agg(F.sum("n").alias("n"), F.count("StockCode").alias("products"))
    two = by_category.groupBy("CustomerID").agg(F.max("n").alias("top_category"), F.sum("products").alias("product_diversity"))
    return one.join(two, "CustomerID")


def profiles(cleaned: DataFrame, cancelled: DataFrame, at: datetime | None = None) -> DataFrame:
    """CustomerID and the eight features as doubles. Customers with cancellations only have none."""
    lines = line_features(cleaned)
    base = lines.join(cancel_counts(cancelled), "CustomerID", "left")
    if at is None:  # from the customers' last dates, whose shuffles are there already; one row
        base = base.crossJoin(F.broadcast(lines.agg((F.max("last") + F.expr("INTERVAL 1 DAY")).alias("snapshot"))))
    else:
        base = base.withColumn("snapshot", F.lit(at))
    c = F.coalesce(F.col("n_cancelled"), F.lit(0))
    return base.select(
        "CustomerID",
        recency_days(F.col("snapshot"), F.col("last")).cast("double").alias("recency"),
        F.col("frequency").cast("double").alias("frequency"),
        F.col("monetary"),
        (F.col("monetary") / F.col("frequency")).alias("avg_basket"),
        F.col("product_diversity").cast("double").alias("product_diversity"),
        (c / (c + F.col("frequency"))).cast("double").alias("return_rate"),
        (F.col("weekend") / F.col("lines")).cast("double").alias("weekend_ratio"),
        (F.col("top_category") / F.col("lines")).cast("double").alias("repeat_category_rate"),
    )


def repeat_buyers(profile: DataFrame, least: int = 2) -> DataFrame:
    return profile.where(F.col("frequency") >= least)


def top_category(cleaned: DataFrame) -> DataFrame:
    """Each customer's most frequent category; of several the first by name."""
    n = cleaned.groupBy("CustomerID", F.substring("StockCode", 1, 2).alias("category")).agg(F.count("*").alias("n"))
    best = n.groupBy("CustomerID").agg(F.min_by(F.struct("category", "n"), F.struct(-F.col("n"), F.col("category"))).alias("b"))
    return best.select("CustomerID", F.col("b.category").alias("category"), F.col("b.n").alias("n"))
