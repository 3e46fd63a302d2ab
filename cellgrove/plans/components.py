"""Connected components of a table of links."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder shared by the driver and the executors: spark.checkpoint.dir, or in local mode our own where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        if not _ROOT:
            _ROOT.append(tempfile.mkdtemp(prefix="cellgrove-"))
        root = _ROOT[0]
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage."""
    path = f"{shared_root(df.sparkSession)}/plans/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp): the least id reachable from each of nodes (id) over links (a, b).

    Each round takes the least label among neighbours and then that label's label, so that paths halve; the
    number of rounds grows with the logarithm of the longest path."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = written(nodes.select("id", F.col("id").alias("comp")).distinct(), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"], "left").select("id", "comp", F.least("comp", F.coalesce("near", "comp")).alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("comp").alias("far"))
        after = written(lower.join(jump, "new").select("id", F.least("new", "far").alias("comp"), (F.least("new", "far") != F.col("comp")).alias("moved")), "labels")
        labels = after.select("id", "comp")
        if after.where("moved").isEmpty():
            return labels
