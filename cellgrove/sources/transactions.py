"""Transaction tables: readers for files and the mapping of the star schema onto transactions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.DoubleType()),
        T.StructField("InvoiceDate", T.StringType()),
        T.StructField("UnitPrice", T.DoubleType()),
        T.StructField("CustomerID", T.StringType()),
        T.StructField("Country", T.StringType()),
    ]
)
#: Other names of columns in use.
RENAMES = {"Invoice": "InvoiceNo", "Price": "UnitPrice", "Customer ID": "CustomerID"}


def resolve(path: str | None, default: str) -> str:
    """The given path, or the default if that exists."""
    chosen = path or default
    if "://" not in chosen and not Path(chosen).exists():
        raise FileNotFoundError(f"no transactions at {chosen}")
    return chosen


def renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RENAMES)


def union_sheets(*sheets: DataFrame) -> DataFrame:
    """All rows, by column name; a column that a sheet lacks is null there."""
    first, *rest = [renamed(s) for s in sheets]
    for s in rest:
        first = first.unionByName(s, allowMissingColumns=True)
    return first


def read_transactions(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet by suffix or folder, else CSV in Latin-1 with a header; several are sheets of one table.

    A CSV header decides which column is which; types are those of SCHEMA, and numbers that can't be read are null."""
    sheets = []
    for path in paths:
        if path.rstrip("/").endswith(".csv"):
            raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
            raw = renamed(raw)
            kinds = {f.name: f.dataType.simpleString() for f in SCHEMA}
            sheets.append(raw.select(*(F.expr(f"try_cast(`{c}` AS {kinds.get(c, 'string')})").alias(c) for c in raw.columns)))
        elif path.endswith((".xls", ".xlsx")):
            raise ValueError("workbooks aren't read: export each sheet as CSV or Parquet")
        else:
            sheets.append(spark.read.parquet(path))
    return union_sheets(*sheets)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_star_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as transactions; returned lines are cancellations. Revenue is a decimal, so that sums are exact."""
    li, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    home = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(home, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.concat(F.when(F.col("l_returnflag") == "R", "C").otherwise(""), F.col("o_orderkey").cast("string")).alias("InvoiceNo"),
            F.col("l_partkey").cast("string").alias("StockCode"),
            F.col("l_linenumber").alias("LineNo"),
            F.col("l_quantity").alias("Quantity"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("InvoiceDate"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("UnitPrice"),
            F.col("o_custkey").cast("string").alias("CustomerID"),
            F.col("n_name").alias("Country"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("Revenue"),
        )
    )


def with_dirt(tx: DataFrame) -> DataFrame:
    """tx with faulty copies of some of its rows, from one scan: repeated, without customer, invoice or date, or with unusable numbers.

    A quarter of the rows, by stock code modulo 40, have a copy with the fault of that number."""
    part = F.pmod(F.col("StockCode").cast("long"), F.lit(40))
    fault = F.explode(F.when(part < 10, F.array(F.lit(-1).cast("long"), part)).otherwise(F.array(F.lit(-1).cast("long"))))
    v = F.col("__v")
    faults = {
        "CustomerID": F.when(v == 1, F.lit(None)).when(v == 2, "").otherwise(F.col("CustomerID")),
        "Quantity": F.when(v == 3, 0.0).when(v == 4, -F.col("Quantity")).otherwise(F.col("Quantity")),
        "UnitPrice": F.when(v == 5, float("nan")).when(v == 6, F.lit(None)).otherwise(F.col("UnitPrice")),
        "InvoiceDate": F.when(v == 7, "not a date").when(v == 9, F.lit(None)).otherwise(F.col("InvoiceDate")),
        "InvoiceNo": F.when(v == 8, F.lit(None)).otherwise(F.col("InvoiceNo")),
    }
    return tx.withColumn("__v", fault).withColumns(faults).drop("__v")
