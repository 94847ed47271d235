"""Indexes as tables and as JSON: {"Entries": [...]} for tables of contents, {"Checkpoints": [...]} for restart points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import paths

#: Fixed names of the JSON form.
ENTRIES = "struct<Entries:array<struct<Header:struct<Typeflag:int,Name:string,Linkname:string,Size:bigint>,Offset:bigint,Filename:string>>>"
CHECKPOINTS = "struct<Checkpoints:array<struct<In:bigint,Out:bigint,B:bigint,NB:int,Hist:string,WrPos:int,RdPos:int,Full:boolean,Empty:boolean>>>"


def toc_to_json(toc: DataFrame) -> DataFrame:
    """archive and json, one row per archive, entries in archive order. Needs seq, path, size, offset and typeflag."""
    name = F.col("name") if "name" in toc.columns else F.col("path")
    link = F.col("linkname") if "linkname" in toc.columns else F.lit("")
    entry = F.struct(F.struct(F.ascii("typeflag").alias("Typeflag"), name.alias("Name"), link.alias("Linkname"), F.col("size").alias("Size")).alias("Header"), F.col("offset").alias("Offset"), F.col("path").alias("Filename"))
    held = toc.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("seq", entry.alias("entry")))).alias("_e"))
    return held.select("archive", F.to_json(F.struct(F.transform("_e", lambda x: x["entry"]).alias("Entries"))).alias("json"))


def toc_from_json(index: DataFrame) -> DataFrame:
    """Entries of (archive, json) rows with parents and directories worked out again, so that listings work as before."""
    e = index.select("archive", F.posexplode(F.from_json("json", ENTRIES)["Entries"]).alias("seq", "e"))
    return e.select(
        "archive", F.col("seq").cast("long").alias("seq"), F.col("e.Header.Name").alias("name"), F.col("e.Filename").alias("path"), paths.listing_parent(F.col("e.Filename")).alias("parent"), paths.base(F.col("e.Filename")).alias("base"),
        F.char(F.col("e.Header.Typeflag")).alias("typeflag"), F.col("e.Header.Linkname").alias("linkname"), F.col("e.Header.Size").alias("size"), F.col("e.Offset").alias("offset"), (F.col("e.Header.Typeflag") == 53).alias("is_dir"),
    )


def checkpoints_to_json(points: DataFrame) -> DataFrame:
    """archive and json of (archive, into, out, bits, value, history) rows, in stream order."""
    one = F.struct(
        F.col("into").alias("In"), F.col("out").alias("Out"), F.col("value").alias("B"), F.col("bits").alias("NB"), F.base64("history").alias("Hist"),
        F.length("history").alias("WrPos"), F.length("history").alias("RdPos"), (F.length("history") >= 32768).alias("Full"), (F.length("history") == 0).alias("Empty"),
    )
    held = points.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("out", "into", one.alias("p")))).alias("_p"))
    return held.select("archive", F.to_json(F.struct(F.transform("_p", lambda x: x["p"]).alias("Checkpoints"))).alias("json"))


def checkpoints_from_json(index: DataFrame) -> DataFrame:
    """Points of (archive, json) rows; Out counts flushed bytes, so what stands unread in the window is added."""
    p = index.select("archive", F.explode(F.from_json("json", CHECKPOINTS)["Checkpoints"]).alias("p"))
    history = F.coalesce(F.unbase64("p.Hist"), F.lit(b""))
    wr, rd = F.coalesce("p.WrPos", F.lit(0)), F.coalesce("p.RdPos", F.lit(0))
    # A full window is a ring: its oldest byte is at the write position.
    ring = F.when(F.col("p.Full") & (wr < F.length(history)), F.concat(F.substring(history, wr + 1, F.lit(1 << 15)), F.substring(history, F.lit(1), wr))).otherwise(F.substring(history, F.lit(1), wr))
    return p.select("archive", F.col("p.In").alias("into"), (F.col("p.Out") + wr - rd).alias("out"), F.coalesce("p.NB", F.lit(0)).alias("bits"), F.coalesce("p.B", F.lit(0)).alias("value"), F.when(F.col("p.Empty"), F.lit(b"")).otherwise(ring).alias("history"))
