"""Operators on a table of contents: one row per archive entry, columns archive, seq, path, typeflag, linkname, size ...

Archives are the natural partition: every join and window is keyed by archive first, and what would need one task for a
whole archive (running sums, numbering) is done in two phases over blocks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import paths

MAX_HOPS = 255
SYMLINK, HARDLINK, DIRECTORY = "2", "1", "5"


def running_total(df: DataFrame, by: list[str], order: str, values: dict[str, Column], block: int = 4096) -> DataFrame:
    """Adds for each value the sum over all rows before in `order` (a number), per `by`.

    Blocks of `block` order numbers are summed first, the few block sums are accumulated, then rows within their block.
    """
    held = df.withColumns({f"_v_{n}": v for n, v in values.items()}).withColumn("_block", F.floor(F.col(order) / block))
    keys = [*by, "_block"]
    sums = held.groupBy(*keys).agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in values))
    inner = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = held.join(starts, keys)
    return out.withColumns({n: (F.col(f"_s_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0))).cast("long") for n in values}).drop("_block", *(f"_{k}_{n}" for n in values for k in "sv"))


def padded(size: Column | str) -> Column:
    """A member's bytes in a tar archive: header and content, in blocks of 512."""
    c = F.col(size) if isinstance(size, str) else size
    return F.lit(512) + F.ceil(c / 512).cast("long") * 512


def with_offsets(entries: DataFrame, by: list[str], order: str) -> DataFrame:
    """seq (position in the archive) and offset (where the content starts) of plainly written members."""
    out = running_total(entries, by, order, {"seq": F.lit(1).cast("long"), "offset": padded("size")})
    return out.withColumn("offset", F.col("offset") + 512)


def with_root(toc: DataFrame) -> DataFrame:
    """Adds a root directory '.' to each archive that has none."""
    have = toc.where(F.col("path") == ".").select("archive")
    missing = toc.select("archive").distinct().join(have, "archive", "left_anti")
    made = {"path": F.lit("."), "name": F.lit("."), "typeflag": F.lit(DIRECTORY), "is_dir": F.lit(True), "size": F.lit(0), "offset": F.lit(0), "seq": F.lit(-1), "parent": F.lit(""), "base": F.lit(".")}
    root = missing.select(*(F.col("archive") if f.name == "archive" else made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in toc.schema.fields))
    return toc.unionByName(root)


def live(toc: DataFrame, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """One row per path: the last entry wins."""
    keys = keys or ["archive", "path"]
    rest = [c for c in toc.columns if c not in keys]
    last = toc.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    return last.select(*(c if c in keys else F.col(f"_last.{c}").alias(c) for c in toc.columns))


def lookup(requests: DataFrame, toc: DataFrame) -> DataFrame:
    """Entries for (archive, path) requests; requests without an entry have found = false."""
    named = live(toc).withColumn("found", F.lit(True))
    return requests.withColumn("path", paths.normalize("path")).join(named, ["archive", "path"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def children_count(toc: DataFrame) -> DataFrame:
    return toc.groupBy("archive", "parent").agg(F.count("*").alias("n_entries"))


def list_directories(toc: DataFrame) -> DataFrame:
    """All entries with their place (from 1) in their directory, by name; duplicates stay, in archive order."""
    w = Window.partitionBy("archive", "parent").orderBy("base", "seq")
    return toc.where("path <> '.'").withColumn("pos", F.row_number().over(w).cast("long"))


def read_directory(toc: DataFrame, cursor: int, n: int) -> DataFrame:
    """The next n entries of each directory after a cursor: n < 0 all that are left, n = 0 none."""
    listed = list_directories(toc).where(F.col("pos") > cursor)
    return listed if n < 0 else listed.where(F.col("pos") <= cursor + n)


def reachable(toc: DataFrame) -> DataFrame:
    """Entries that a walk from the root meets: those whose every ancestor is a directory entry of the archive."""
    dirs = toc.where(F.col("typeflag") == DIRECTORY).select("archive", F.col("path").alias("_up")).distinct()
    ups = toc.select("archive", "path").distinct().select("archive", "path", F.explode(paths.prefixes("path")).alias("_up"))
    cut_off = ups.join(dirs, ["archive", "_up"], "left_anti").select("archive", "path").distinct()
    return toc.join(cut_off, ["archive", "path"], "left_anti")


def walk(toc: DataFrame, depth: int = 2) -> DataFrame:
    """Adds pos (from 1): the entry's place in a pre-order walk of its archive, children by name.

    Entries are numbered within blocks that share their first `depth` components, and blocks are counted first.
    """
    keyed = toc.withColumn("_key", paths.walk_key("path")).withColumn("_block", F.slice("_key", 1, depth))
    counts = keyed.groupBy("archive", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("archive").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("archive", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy("archive", "_block").orderBy("_key", "seq")
    return keyed.join(starts, ["archive", "_block"]).withColumn("pos", (F.col("_start") + F.row_number().over(w)).cast("long")).drop("_key", "_block", "_start")


def listing(toc: DataFrame) -> DataFrame:
    """archive, pos and the printed line of each entry but the root, in walk order."""
    return walk(toc.where("path <> '.'")).select("archive", "pos", paths.listing_line("offset", "size", "path").alias("line"))


def readlink(toc: DataFrame) -> DataFrame:
    return live(toc).where(F.col("typeflag").isin(HARDLINK, SYMLINK)).select("archive", "path", "linkname")


def rewrite_directories(requests: DataFrame, toc: DataFrame) -> DataFrame:
    """Replaces, in each requested path, the shortest proper prefix that is a symbolic link by what the link points to.

    Adds rewritten (the path, null if no prefix is a symbolic link). Hard links among the prefixes don't count.
    """
    return _rewritten(requests, live(toc).where(F.col("typeflag") == SYMLINK).select("archive", F.col("path").alias("_up"), F.col("linkname").alias("_to")))


def _rewritten(requests: DataFrame, links: DataFrame) -> DataFrame:
    ups = requests.select("archive", "path").distinct().select("archive", "path", F.explode(paths.prefixes("path")).alias("_up"))
    hit = ups.join(links, ["archive", "_up"]).groupBy("archive", "path").agg(F.min_by(F.struct("_up", "_to"), F.length("_up")).alias("_hit"))
    rest = F.expr("substring(path, length(_hit._up) + 2)")
    target = F.when(F.col("_hit._to").startswith("/"), paths.join(paths.normalize("_hit._to"), rest)).otherwise(paths.join(paths.parent(F.col("_hit._up")), F.col("_hit._to"), rest))
    return requests.join(hit.select("archive", "path", paths.normalize(target).alias("rewritten")), ["archive", "path"], "left")


def _cut(df: DataFrame) -> DataFrame:
    """Ends the plan's growth: a written table where a folder is set, else rows kept on the executors, which can be redone."""
    root = df.sparkSession.conf.get("spark.checkpoint.dir", None) or df.sparkSession.sparkContext.getCheckpointDir()
    if not root:
        return df.persist()
    at = f"{root.rstrip('/')}/toc-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def resolve(requests: DataFrame, toc: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Follows links from (archive, path) requests: adds target (null if there is none), hops and error.

    Each round takes one hop for the paths that aren't there yet: an entry that is a link, or else a prefix that is a
    symbolic link; the prefixes are looked at only if an entry is missing. After max_hops hops a request fails, so cycles
    end. The root always resolves to itself.
    """
    named = _cut(live(toc).select("archive", F.col("path").alias("_at"), F.col("typeflag").alias("_t"), F.col("linkname").alias("_l")))
    links = named.where(F.col("_t") == SYMLINK).select("archive", F.col("_at").alias("_up"), F.col("_l").alias("_to"))
    some_links = links.limit(1).count() > 0
    todo = requests.select("archive", "path").distinct().withColumns({"_at": paths.normalize("path"), "hops": F.lit(0)})
    done = None
    while True:
        seen = todo.join(named, ["archive", "_at"], "left")
        is_link = F.coalesce(F.col("_t").isin(HARDLINK, SYMLINK), F.lit(False))
        missing = F.col("_t").isNull() & (F.col("_at") != ".")
        seen = _cut(seen.select("archive", "path", "_at", "hops", F.when(is_link, paths.link_target("_at", "_t", "_l")).alias("_next"), missing.alias("_missing")))
        state = seen.agg(F.coalesce(F.bool_or("_missing"), F.lit(False)), F.coalesce(F.bool_or(F.col("_next").isNotNull() & (F.col("hops") < max_hops)), F.lit(False))).first()
        lost, more = state
        if some_links and lost:
            moved = _rewritten(seen.where("_missing").select("archive", F.col("_at").alias("path")).distinct(), links)
            seen = _cut(seen.join(moved.select("archive", F.col("path").alias("_at"), "rewritten"), ["archive", "_at"], "left").withColumn("_next", F.coalesce("_next", "rewritten")).drop("rewritten"))
            more = bool(seen.where(F.col("_next").isNotNull() & (F.col("hops") < max_hops)).limit(1).count())
        over = seen.where(F.col("_next").isNull() | (F.col("hops") >= max_hops))
        error = F.when(F.col("_next").isNotNull(), F.lit("too many links")).when(F.col("_missing"), F.lit("not found"))
        found = over.select("archive", "path", F.when(error.isNull(), F.col("_at")).alias("target"), F.col("hops").cast("long").alias("hops"), error.alias("error"))
        done = found if done is None else done.unionByName(found)
        if not more:
            return done
        todo = seen.where(F.col("_next").isNotNull() & (F.col("hops") < max_hops)).select("archive", "path", F.col("_next").alias("_at"), (F.col("hops") + 1).alias("hops"))


def stat(requests: DataFrame, toc: DataFrame) -> DataFrame:
    """Metadata after links are followed; lookup() is the one before."""
    at = resolve(requests, toc)
    own = live(with_root(toc)).withColumnRenamed("path", "target")
    return at.join(own, ["archive", "target"], "left")


def compare(left: DataFrame, right: DataFrame, content: str = "content") -> DataFrame:
    """archive, path, state of all that two archives' entries don't have in common: left, right or changed."""
    a = left.select("archive", "path", F.sha2(content, 256).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select("archive", "path", F.sha2(content, 256).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, ["archive", "path"], "full_outer")
    state = F.when(F.col("_in_b").isNull(), "left").when(F.col("_in_a").isNull(), "right").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select("archive", "path", state.alias("state")).where("state is not null")


def path_listing(toc: DataFrame) -> DataFrame:
    """archive, pos and path of every entry, the root included, in walk order."""
    return walk(toc).select("archive", "pos", "path")


def write_listing(toc: DataFrame, path: str) -> None:
    """Writes the lines of listing() as text, one folder per archive, sorted within each."""
    lines = listing(toc).repartitionByRange("archive", "pos").sortWithinPartitions("archive", "pos")
    lines.select("archive", F.col("line").alias("value")).write.partitionBy("archive").text(path)
