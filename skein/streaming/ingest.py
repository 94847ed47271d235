"""Keeping indexes up to date: a stream of new archives appended to tables of contents and restart points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.functions import paths
from skein.sources.datasource import restart_table
from skein.sources.members import unpack


def index_batch(archives: DataFrame, toc_path: str, points_path: str | None = None) -> None:
    """Appends the entries (without contents) of (archive, content) rows, and restart points if a path is given."""
    got = unpack(archives).where("error is null").drop("content", "error")
    got.withColumns({"parent": paths.listing_parent("path"), "base": paths.base("path")}).write.mode("append").parquet(toc_path)
    if points_path:
        gzipped = archives.where(F.expr("substring(content, 1, 3) = X'1F8B08'"))
        restart_table(gzipped).write.mode("append").parquet(points_path)


def follow(spark: SparkSession, landing: str, toc_path: str, checkpoint: str, points_path: str | None = None, pattern: str = "*.tar*") -> StreamingQuery:
    """Indexes all archives in a landing folder, each once, and stops; run again for those that came since."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(landing)
    named = stream.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return named.writeStream.foreachBatch(lambda df, _: index_batch(df, toc_path, points_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
