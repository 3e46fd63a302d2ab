"""Cleaning of transactions: cancellations apart, unusable and repeated rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number


def with_invoice(tx: DataFrame) -> DataFrame:
    """The invoice as text; a missing one is the text "nan", so that both halves of the split keep their rows."""
    return tx.withColumn("InvoiceNo", F.coalesce(F.col("InvoiceNo").cast("string"), F.lit("nan")))


def is_cancellation() -> Column:
    return F.col("InvoiceNo").startswith("C")


def has_customer() -> Column:
    return F.col("CustomerID").isNotNull() & (F.col("CustomerID") != "")


def cancellations(tx: DataFrame) -> DataFrame:
    """All cancelled rows, otherwise as they came."""
    return with_invoice(tx).where(is_cancellation())


def _parsed(tx: DataFrame) -> DataFrame:
    if dict(tx.dtypes)["InvoiceDate"] == "string":
        return tx.withColumn("InvoiceDate", F.try_to_timestamp("InvoiceDate"))
    return tx


def _steps(country: str | None) -> list[tuple[str, Column]]:
    steps = [("purchases", ~is_cancellation()), ("with_customer", has_customer()), ("positive_quantity", number(F.col("Quantity")) > 0), ("positive_price", number(F.col("UnitPrice")) > 0)]
    return steps + [("distinct", F.lit(True)), ("with_date", F.col("__ts").isNotNull())] + ([("country", F.col("Country") == country)] if country else [])


def clean(tx: DataFrame, country: str | None = None) -> DataFrame:
    """Purchases with customer, positive quantity and price and a readable date, each row once, with Revenue."""
    rows = with_invoice(tx).where(~is_cancellation() & has_customer() & (number(F.col("Quantity")) > 0) & (number(F.col("UnitPrice")) > 0))
    rows = _parsed(rows.dropDuplicates()).where(F.col("InvoiceDate").isNotNull())
    if country:
        rows = rows.where(F.col("Country") == country)
    if "Revenue" not in rows.columns:
        rows = rows.withColumn("Revenue", F.col("Quantity") * F.col("UnitPrice"))
    return rows


def funnel(tx: DataFrame, country: str | None = None) -> DataFrame:
    """(step, rows) after each step of cleaning, from one shuffle: equal rows are counted together first."""
    rows = with_invoice(tx).groupBy(*tx.columns).agg(F.count("*").alias("__n"))
    stamp = F.try_to_timestamp("InvoiceDate") if dict(tx.dtypes)["InvoiceDate"] == "string" else F.col("InvoiceDate")
    rows = rows.withColumn("__ts", stamp)
    passed, sums, weight = F.lit(True), [F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("loaded")], F.col("__n")
    for name, keeps in _steps(country):
        passed = passed & F.coalesce(keeps, F.lit(False))
        weight = F.lit(1).cast("long") if name == "distinct" else weight
        sums.append(F.coalesce(F.sum(F.when(passed, weight)), F.lit(0)).cast("long").alias(name))
    wide = rows.agg(*sums)
    names = wide.columns
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(n).alias("n_rows")) for i, n in enumerate(names))))
    return wide.select(pairs.alias("p")).select("p.*")


def summary(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(F.count("*").alias("n_rows"), F.count_distinct("CustomerID").alias("n_customers"), F.min("InvoiceDate").alias("first_date"), F.max("InvoiceDate").alias("last_date"))
