"""The archive engine's queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import paths
from skein.operators import reads, toc
from skein.plans import virtual
from skein.plans.virtual import table
from skein.sources import datasource
from skein.sources import members as member_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: SQL of the virtual archive: v members, t members with seq and offset, dirs, tree.
_V = "v AS (SELECT doc_id, lang || '/' || source || '/' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents)"
_T = _V + """, t AS (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS seq, doc_id, path, size,
 CAST(512 + coalesce(sum(512 + ((size + 511) // 512) * 512) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM v)"""
_TREE = _V + """, tree AS (SELECT path, '0' AS typeflag, size, doc_id AS seq, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS base FROM v
 UNION ALL SELECT DISTINCT lang, '5', CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '.', lang FROM documents
 UNION ALL SELECT DISTINCT lang || '/' || source, '5', CAST(0 AS BIGINT), CAST(-1 AS BIGINT), lang, source FROM documents)"""


@_query(f'WITH {_T} SELECT seq, path, size, "offset" FROM t')
def toc_offsets(spark, sf_dir):
    return virtual.files(spark, sf_dir).select("seq", "path", "size", "offset")


@_query(f"""WITH {_T} SELECT CAST(row_number() OVER (ORDER BY string_split(path, '/')) AS BIGINT) AS pos, "offset" || '+' || size || ': ' || path AS line FROM t""")
def listing(spark, sf_dir):
    return toc.listing(virtual.files(spark, sf_dir)).select("pos", "line")


@_query(f"WITH {_TREE} SELECT path, CAST(row_number() OVER (ORDER BY string_split(path, '/')) AS BIGINT) AS pos FROM tree")
def walk_order(spark, sf_dir):
    return toc.walk(virtual.tree(spark, sf_dir)).select("path", "pos")


@_query(f"""WITH RECURSIVE {_TREE}, have AS (SELECT * FROM tree WHERE path <> 'es'),
 met AS (SELECT path, typeflag FROM have WHERE parent = '.' UNION ALL SELECT h.path, h.typeflag FROM have h JOIN met m ON h.parent = m.path AND m.typeflag = '5')
 SELECT path FROM met""")
def walk_reachable(spark, sf_dir):
    return toc.reachable(virtual.tree(spark, sf_dir, leave_out="es")).select("path")


@_query(f"""WITH {_V} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(raw, '/$', ''), '^/', ''), '^\\./', '') AS path
 FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN './' || path WHEN 1 THEN '/' || path WHEN 2 THEN path || '/' ELSE '/./' || path || '//' END AS raw FROM v)""")
def normalize_path(spark, sf_dir):
    v = virtual.members(spark, sf_dir)
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("./"), "path")).when(k == 1, F.concat(F.lit("/"), "path")).when(k == 2, F.concat("path", F.lit("/"))).otherwise(F.concat(F.lit("/./"), "path", F.lit("//")))
    return v.select("doc_id", paths.normalize(raw).alias("path"))


@_query(f"WITH {_V} SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS base, size, '0' = '5' AS is_dir FROM v")
def entry_metadata(spark, sf_dir):
    return virtual.members(spark, sf_dir).select("path", paths.parent("path").alias("parent"), paths.base("path").alias("base"), "size", (F.lit("0") == "5").alias("is_dir"))


@_query(f"WITH {_V} SELECT path, CAST(i AS BIGINT) AS depth, array_to_string(string_split(path, '/')[1:i], '/') AS prefix FROM v, unnest([1, 2]) AS u(i)")
def path_prefixes(spark, sf_dir):
    v = virtual.members(spark, sf_dir).select("path", F.posexplode(paths.prefixes("path")).alias("i", "prefix"))
    return v.select("path", (F.col("i") + 1).cast("long").alias("depth"), "prefix")


@_query("SELECT doc_id, lang || '/other/' || doc_id AS joined, '../../' || source AS above FROM documents")
def path_join_clean(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    joined = paths.join(F.concat_ws("/", "lang", "source"), F.concat(F.lit("../other/./"), "doc_id"))
    return d.select("doc_id", joined.alias("joined"), paths.join("lang", F.concat(F.lit("../x/../../../"), "source")).alias("above"))


@_query(f"WITH {_TREE} SELECT parent, CAST(count(*) AS BIGINT) AS n_entries FROM tree GROUP BY parent")
def dir_counts(spark, sf_dir):
    return toc.children_count(virtual.tree(spark, sf_dir)).select("parent", "n_entries")


@_query(f"WITH {_TREE} SELECT parent, base, CAST(row_number() OVER (PARTITION BY parent ORDER BY base, seq) AS BIGINT) AS pos FROM tree")
def dir_listing(spark, sf_dir):
    return toc.list_directories(virtual.tree(spark, sf_dir)).select("parent", "base", "pos")


@_query(f"WITH {_TREE} SELECT parent, base, CAST(row_number() OVER (PARTITION BY parent ORDER BY base, seq) AS BIGINT) AS pos FROM tree QUALIFY pos BETWEEN 4 AND 8")
def readdir_page(spark, sf_dir):
    return toc.read_directory(virtual.tree(spark, sf_dir), 3, 5).select("parent", "base", "pos")


def _event_entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("archive"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"), F.col("event_id").alias("seq"), "value")


_EVENTS = "e AS (SELECT user_id || '/' || event_type AS path, event_id AS seq, value FROM events)"


@_query(f"WITH {_EVENTS} SELECT path, seq, value FROM e QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1")
def lookup_last_wins(spark, sf_dir):
    return toc.live(_event_entries(spark, sf_dir)).select("path", "seq", "value")


@_query(f"WITH {_EVENTS} SELECT path, CAST(count(*) AS BIGINT) AS copies, min(seq) AS first_seq, max(seq) AS last_seq FROM e GROUP BY path HAVING count(*) > 1")
def duplicates_listed(spark, sf_dir):
    e = _event_entries(spark, sf_dir).groupBy("path").agg(F.count("*").alias("copies"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return e.where("copies > 1")


@_query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def exists_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id")


@_query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def exists_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@_query(f"""WITH {_V}, r AS (SELECT path FROM v UNION ALL SELECT 'gone/' || doc_id FROM v WHERE doc_id % 3 = 0)
 SELECT r.path, v.size, v.path IS NOT NULL AS found FROM r LEFT JOIN v ON r.path = v.path""")
def entry_lookup(spark, sf_dir):
    v = virtual.members(spark, sf_dir)
    gone = v.where("doc_id % 3 = 0").select("archive", F.concat(F.lit("gone/"), "doc_id").alias("path"))
    asked = v.select("archive", F.concat(F.lit("/"), "path").alias("path")).unionByName(gone)
    return toc.lookup(asked, v.withColumnRenamed("doc_id", "seq")).select("path", "size", "found")


def _geography(spark, sf_dir):
    """region: directories; nation: symbolic links to regions; customers and orders: links one step further each."""
    flat = lambda df, path, kind, link, seq: df.select(F.lit("geo").alias("archive"), path.alias("path"), F.lit(kind).alias("typeflag"), link.alias("linkname"), seq.cast("long").alias("seq"), F.lit(0).cast("long").alias("size"))
    at = lambda name, key: F.concat(F.lit(f"{name}/"), F.col(key).cast("string"))
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    out = flat(r, at("region", "r_regionkey"), "5", F.lit(""), F.col("r_regionkey"))
    out = out.unionByName(flat(n, at("nation", "n_nationkey"), "2", F.concat(F.lit("../region/"), "n_regionkey"), F.col("n_nationkey")))
    out = out.unionByName(flat(c, at("customer", "c_custkey"), "2", F.concat(F.lit("/nation/"), "c_nationkey"), F.col("c_custkey")))
    return out.unionByName(flat(o, at("order", "o_orderkey"), "1", F.concat(F.lit("customer/"), "o_custkey"), F.col("o_orderkey")))


@_query("""SELECT 'nation/' || n_nationkey AS path, '../region/' || n_regionkey AS linkname FROM nation
 UNION ALL SELECT 'customer/' || c_custkey, '/nation/' || c_nationkey FROM customer UNION ALL SELECT 'order/' || o_orderkey, 'customer/' || o_custkey FROM orders""")
def readlink(spark, sf_dir):
    return toc.readlink(_geography(spark, sf_dir)).select("path", "linkname")


@_query("""SELECT 'order/' || o_orderkey AS path, 'region/' || n_regionkey AS target, CAST(CASE WHEN c_custkey IS NULL THEN 1 ELSE 3 END AS BIGINT) AS hops,
 CASE WHEN c_custkey IS NULL THEN 'not found' END AS error FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def symlink_resolve(spark, sf_dir):
    geo = _geography(spark, sf_dir)
    return toc.resolve(geo.where("path like 'order/%'").select("archive", "path"), geo).select("path", "target", "hops", "error")


@_query("""SELECT 'nation/' || n_nationkey AS path, '2' AS own_type, 'region/' || n_regionkey AS target, '5' AS target_type FROM nation
 UNION ALL SELECT 'customer/' || c_custkey, '2', 'region/' || n_regionkey, '5' FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'order/' || o_orderkey, '1', 'region/' || n_regionkey, CASE WHEN n_regionkey IS NOT NULL THEN '5' END FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def stat_and_lstat(spark, sf_dir):
    geo = _geography(spark, sf_dir)
    asked = geo.where(F.col("typeflag") != "5").select("archive", "path")
    before = toc.lookup(asked, geo).select("path", F.col("typeflag").alias("own_type"))
    return toc.stat(asked, geo.withColumn("is_dir", F.col("typeflag") == "5")).select("path", "target", F.col("typeflag").alias("target_type")).join(before, "path")


@_query("SELECT 'alias_' || lang || '/' || source || '/' || doc_id || '.txt' AS path, lang || '/' || source || '/' || doc_id || '.txt' AS rewritten FROM documents")
def symlink_dir_rewrite(spark, sf_dir):
    v = virtual.members(spark, sf_dir)
    own = v.select("archive", "path", F.lit("0").alias("typeflag"), F.lit("").alias("linkname"), F.col("doc_id").alias("seq"))
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    links = langs.select(F.lit("docs").alias("archive"), F.concat(F.lit("alias_"), "lang").alias("path"), F.lit("2").alias("typeflag"), F.concat(F.lit("./"), "lang").alias("linkname"), F.lit(-1).cast("long").alias("seq"))
    asked = v.select("archive", F.concat(F.lit("alias_"), "path").alias("path"))
    return toc.rewrite_directories(asked, own.unionByName(links)).select("path", "rewritten")


@_query(f"""WITH {_T}, r AS (SELECT CAST(unnest(range(0, (SELECT max("offset") FROM t) + 10000, 10000)) AS BIGINT) AS pos)
 SELECT pos, m."offset" AS floor_offset FROM r ASOF LEFT JOIN t m ON r.pos >= m."offset" """)
def checkpoint_floor(spark, sf_dir):
    marks = virtual.files(spark, sf_dir).select("archive", "offset")
    top = marks.groupBy("archive").agg(F.max("offset").alias("top"))
    asked = top.select("archive", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top") + 9999, F.lit(10000).cast("long"))).alias("pos"))
    return reads.floor_join(asked, marks, ["archive"], "pos", "offset", 1 << 16).select("pos", F.col("offset").alias("floor_offset"))


@_query(f"""WITH RECURSIVE {_T}, step AS (SELECT min("offset") AS pos FROM t WHERE "offset" > 65536
 UNION ALL SELECT (SELECT min("offset") FROM t WHERE "offset" - step.pos > 65536) FROM step WHERE pos IS NOT NULL)
 SELECT pos FROM step WHERE pos IS NOT NULL""")
def checkpoint_emit(spark, sf_dir):
    return reads.emit_spans(virtual.files(spark, sf_dir), ["archive"], "offset", 1 << 16).select(F.col("offset").alias("pos"))


@_query("SELECT doc_id, substr(hex(encode(text)), 2 * (doc_id % 50) + 1, 80) AS bytes FROM documents")
def range_read(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.hex(reads.slice_bytes(F.col("text").cast("binary"), F.col("doc_id") % 50, F.lit(40))).alias("bytes"))


@_query(f"""WITH {_T}, c AS (SELECT unnest(range(0, (SELECT max("offset" + size) // 65536 + 1 FROM t))) AS chunk)
 SELECT path, CAST(chunk AS BIGINT) AS chunk, greatest("offset", chunk * 65536) AS from_byte, least("offset" + size, (chunk + 1) * 65536) AS to_byte
 FROM t JOIN c ON "offset" < (chunk + 1) * 65536 AND "offset" + size > chunk * 65536""")
def range_overlap(spark, sf_dir):
    return reads.overlaps(virtual.files(spark, sf_dir), 1 << 16).select("path", "chunk", "from_byte", "to_byte")


@_query("SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS size FROM pages")
def section_reassemble(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    cut = p.select("page_id", F.expr("explode(sequence(0, cast(ceil(length(content) / 1000) as int)))").alias("chunk"), "content")
    pieces = cut.select("page_id", "chunk", reads.slice_bytes("content", F.col("chunk") * 1000, F.lit(1000)).alias("piece"))
    whole = reads.concatenate(pieces, ["page_id"], "chunk", "piece", "content")
    return whole.select("page_id", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"))


@_query("SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS content FROM conversations GROUP BY conv_id")
def concat_members(spark, sf_dir):
    return reads.concatenate(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", "content")


@_query(f"WITH {_V} SELECT path, size FROM v UNION ALL SELECT '.', CAST(0 AS BIGINT)")
def root_synthesis(spark, sf_dir):
    return toc.with_root(virtual.members(spark, sf_dir)).select("path", "size")


@_query()
def crc_verify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


@_query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@_query("SELECT lang, CAST(sum(strlen(text) * 100003) % 4294967296 AS BIGINT) AS isize FROM documents GROUP BY lang")
def isize_mod(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg((F.sum(F.octet_length("text").cast("long") * 100003) % 4294967296).alias("isize"))


@_query("SELECT event_id, nullif(event_type, 'click') AS name, CASE WHEN event_id % 256 = 255 THEN NULL ELSE event_id % 256 END AS os, nullif(event_type, 'click') IS NULL AND event_id % 256 = 255 AS all_default FROM events")
def header_defaults(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name, os = F.nullif("event_type", F.lit("click")), F.nullif(F.col("event_id") % 256, F.lit(255))
    return e.select("event_id", name.alias("name"), os.alias("os"), (name.isNull() & os.isNull()).alias("all_default"))


@_query(f'WITH {_T} SELECT seq, path, size, "offset" FROM t')
def toc_json_roundtrip(spark, sf_dir):
    from skein.sources import index_io

    entries = virtual.files(spark, sf_dir).withColumn("typeflag", F.lit("0"))
    return index_io.toc_from_json(index_io.toc_to_json(entries)).select("seq", "path", "size", "offset")


@_query("""WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)
 SELECT CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR) AS path, CASE WHEN b.doc_id IS NULL THEN 'left' WHEN a.doc_id IS NULL THEN 'right' ELSE 'changed' END AS state
 FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR md5(a.text) IS DISTINCT FROM md5(b.text)""")
def toc_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("docs").alias("archive"), F.col("doc_id").cast("string").alias("path"), "doc_id", F.col("text").alias("content"))
    b = d.where("doc_id % 11 <> 0").withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return toc.compare(d.where("doc_id % 7 <> 0"), b).select("path", "state")


@_query(f"""WITH {_T} SELECT path, 'bytes=' || "offset" || '-' || ("offset" + size - 1) AS range FROM t""")
def range_header(spark, sf_dir):
    return virtual.files(spark, sf_dir).select("path", paths.range_header("offset", "size").alias("range"))


@_query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, starts_with(url, 'http') AS remote FROM pages")
def url_resolve(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.startswith("url", F.lit("http")).alias("remote"))


@_query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE make_timestamp((event_id % 10) * 86400 * 1000000 + event_id * 1000000) END AS modified FROM events")
def epoch_ts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = F.when(F.col("event_id") % 10 == 0, F.lit(0)).otherwise((F.col("event_id") % 10) * 86400 + F.col("event_id"))
    return e.select("event_id", paths.unix_time(s).cast("timestamp_ntz").alias("modified"))


@_query("""SELECT source || '-' || (doc_id // 64) AS archive, doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents""")
def archive_members(spark, sf_dir):
    """Packs all documents into tar.gz archives of up to 64 members, then reads them back with the member reader."""
    d = table(spark, sf_dir, "documents").select(F.expr("source || '-' || (doc_id div 64)").alias("archive"), F.concat("doc_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    return member_source.unpack(member_source.pack_together(d)).select("archive", "path", "size", F.sha2("content", 256).alias("sha256"))


def _gzipped(spark, sf_dir):
    """A gzip stream of two members for each document: its text, then its source."""
    part = lambda name, c: F.struct(F.concat("doc_id", F.lit(name)).alias("name"), F.col(c).cast("binary").alias("content"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("archive"), F.array(part(".txt", "text"), part(".src", "source")).alias("parts"))
    return member_source.pack_gzip(d)


@_query("""SELECT CAST(doc_id AS VARCHAR) AS archive, CAST(0 AS BIGINT) AS member, doc_id || '.txt' AS name, CAST(0 AS BIGINT) AS out, CAST(strlen(text) AS BIGINT) AS isize, CAST(NULL AS VARCHAR) AS error FROM documents
 UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, doc_id || '.src', strlen(text), strlen(source), NULL FROM documents""")
def gzip_members(spark, sf_dir):
    """Members' headers, positions and sizes; their checksums are verified on the way."""
    return member_source.gzip_members(_gzipped(spark, sf_dir)).select("archive", "member", "name", "out", "isize", "error")


@_query("SELECT CAST(doc_id AS VARCHAR) AS archive, substr(hex(encode(text || source)), 2 * (strlen(text) // 2) + 1, 1200) AS bytes FROM documents")
def gzip_range_read(spark, sf_dir):
    """600 bytes from the middle of each text, into the next member where the text ends before, from restart points."""
    packed = _gzipped(spark, sf_dir)
    half = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("archive"), F.expr("cast(octet_length(text) div 2 as bigint)").alias("offset"), F.lit(600).cast("long").alias("length"))
    got = datasource.read_ranges(half, packed, datasource.restart_table(packed, 1 << 12))
    return got.select("archive", F.hex("content").alias("bytes"))
