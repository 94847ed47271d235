"""Written intermediate tables and connected components."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="skein-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of
    this process if all runs in it, as in tests, and the warehouse on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        alone = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
        root = _own_folder() if alone else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read from there: computed once, and safe from lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root (the smallest node that can be reached) of all nodes of the undirected edges (a, b).

    Alternating large-star and small-star rounds: each node's neighbours are hung on the smallest of them, first the
    larger neighbours, then the smaller ones, until nothing changes. Nothing is collected but a count and a checksum.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        under = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        hung = large.join(under, large.a == under.u).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(hung.unionByName(under.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), name)
