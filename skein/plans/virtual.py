"""The virtual archive over the test tables: one member per document, path lang/source/doc_id.txt, in doc_id order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import paths
from skein.operators import toc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive, doc_id, path, size of each document."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.lit("docs").alias("archive"), "doc_id", F.concat_ws("/", "lang", "source", F.concat("doc_id", F.lit(".txt"))).alias("path"), F.octet_length("text").cast("long").alias("size"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with seq and offset."""
    return toc.with_offsets(members(spark, sf_dir), ["archive"], "doc_id")


def tree(spark: SparkSession, sf_dir: str, leave_out: str = "") -> DataFrame:
    """Files and the directories above them (but those under leave_out), as a table of contents without a root."""
    own = members(spark, sf_dir).select("archive", "path", F.lit("0").alias("typeflag"), "size", F.col("doc_id").alias("seq"))
    dirs = own.select("archive", F.explode(paths.prefixes("path")).alias("path")).distinct().where(F.col("path") != leave_out)
    dirs = dirs.select("archive", "path", F.lit("5").alias("typeflag"), F.lit(0).cast("long").alias("size"), F.lit(-1).cast("long").alias("seq"))
    return own.unionByName(dirs).withColumns({"parent": paths.listing_parent("path"), "base": paths.base("path")})
