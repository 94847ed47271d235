import gzip
import http.server
import io
import os
import random
import tarfile
import threading
import zlib

import pytest
from pyspark.sql import functions as F

from skein.functions import paths
from skein.operators import reads, toc
from skein.sources import access, datasource, gzip_index, index_io, members
from skein.sources.http_source import RangeError, RangeReader
from skein.streaming import ingest


def make_tar(rows, mode="w"):
    """rows: (name, type, content or link)."""
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode=mode, format=tarfile.PAX_FORMAT) as tar:
        for name, kind, what in rows:
            info = tarfile.TarInfo(name)
            info.type = kind
            if kind in (tarfile.SYMTYPE, tarfile.LNKTYPE):
                info.linkname = what
            elif kind == tarfile.REGTYPE:
                info.size = len(what)
            tar.addfile(info, io.BytesIO(what) if kind == tarfile.REGTYPE else None)
    return held.getvalue()


D, R, S, L = tarfile.DIRTYPE, tarfile.REGTYPE, tarfile.SYMTYPE, tarfile.LNKTYPE
LINKS = [
    ("usr", D, None), ("usr/bin", D, None), ("usr/bin/binary", R, b"pretend this is a binary"), ("weird", D, None), ("weird/linked", S, "/usr/bin"),
    ("weird/absolute", D, None), ("weird/absolute/binary", S, "/weird/linked/binary"), ("weird/relative", D, None), ("weird/relative/binary", S, "../linked/binary"),
    ("weird/hard", L, "usr/bin/binary"), ("loop/a", S, "b"), ("loop/b", S, "a"), ("lost", S, "nowhere"), ("top", S, "."),
]


def table(spark, data, name="a.tar"):
    rows = [tuple(e[c.split()[0]] for c in members.TOC.replace("map<string,string>", "map").split(",")) for e in members.entries(data, name)]
    return spark.createDataFrame(rows, members.TOC)


def test_paths(spark):
    def at(f, *args):
        return spark.range(1).select(f(*[F.lit(a) for a in args]).alias("x")).first().x

    want = {"./x": "x", "/x": "x", "x/": "x", "./": ".", "/": "", "a//": "a/", ".//a": "/a", "x": "x", "/./x/": "x"}
    assert {k: at(paths.normalize, k) for k in want} == want
    import posixpath

    for p in ("a/b/../c", "../x", "a/../../b", "/..", "/a/./b//c", "", ".", "a/..", "/"):
        assert at(paths.clean, p) == posixpath.normpath(p or ".").replace("//", "/"), p
    assert at(paths.join, "a/b", "../c") == "a/c" and at(paths.join, "", "") == "" and at(paths.join, "a", "../../b") == "../b"
    assert at(paths.parent, "a") == "." and at(paths.parent, "a/b/c") == "a/b" and at(paths.parent, "/a") == "/"
    assert at(paths.prefixes, "a/b/c") == ["a", "a/b"] and at(paths.prefixes, "a") == [] and at(paths.prefixes, "/a") == [""]
    assert at(paths.range_header, 5, 10) == "bytes=5-14" and at(paths.listing_line, 512, 3, "x") == "512+3: x"


@pytest.mark.parametrize("stream", [False, True])
def test_offsets_of_odd_sizes_and_names(stream):
    rows = [(f"d/{'é' * n}{n}", R, os.urandom(n)) for n in (0, 1, 60, 511, 512, 513)] + [("x" * 150, R, b"long")]
    data = make_tar(rows)
    got = list(members.entries(data, stream=stream))
    assert [e["path"] for e in got] == [r[0] for r in rows]
    assert all(data[e["offset"] : e["offset"] + e["size"]] == r[2] for e, r in zip(got, rows, strict=True))


def test_archive_without_its_end(spark):
    info = tarfile.TarInfo("hi jon")
    z = zlib.compressobj(wbits=31)
    whole = gzip.compress(info.tobuf())
    assert [e["path"] for e in members.entries(members.uncompressed(whole))] == ["hi jon"] and z


def test_links(spark):
    t = table(spark, make_tar(LINKS))
    want = {
        "weird/linked/binary": "usr/bin/binary", "weird/absolute/binary": "usr/bin/binary", "weird/relative/binary": "usr/bin/binary", "weird/hard": "usr/bin/binary", "usr": "usr",
        "/usr/bin/": "usr/bin", "loop/a": None, "lost": None, "no/such": None, "top": ".", ".": ".",
    }
    asked = spark.createDataFrame([("a.tar", p) for p in want], "archive string, path string")
    got = {r.path: r for r in toc.resolve(asked, t, max_hops=20).collect()}
    assert {p: got[p].target for p in want} == want
    assert got["loop/a"].error == "too many links" and got["lost"].error == got["no/such"].error == "not found"
    content = {r.path: r.content for r in spark.createDataFrame([(e["path"], make_tar(LINKS)[e["offset"] : e["offset"] + e["size"]]) for e in members.entries(make_tar(LINKS))], "path string, content binary").collect()}
    assert content[got["weird/relative/binary"].target] == b"pretend this is a binary"


def test_hops_at_the_cap(spark):
    t = table(spark, make_tar([(f"l{i}", S, f"l{i + 1}") for i in range(6)] + [("l6", R, b"x")]))
    asked = spark.createDataFrame([("a.tar", f"l{i}") for i in range(7)], "archive string, path string")
    got = {r.path: r for r in toc.resolve(asked, t, max_hops=5).collect()}
    assert got["l0"].error == "too many links" and got["l1"].target == "l6" and got["l1"].hops == 5


def test_duplicates_walk_and_pages(spark):
    t = table(spark, make_tar([("a", D, None), ("a/b", R, b"1"), ("a.b", R, b"2"), ("a-b", R, b"3"), ("a/b", R, b"22"), ("x/y/z", R, b"4")]))
    assert toc.live(t).where("path = 'a/b'").first()["size"] == 2
    assert [r.path for r in toc.walk(t).orderBy("pos").collect()] == ["a", "a/b", "a/b", "a-b", "a.b", "x/y/z"]
    assert {r.path for r in toc.reachable(t).collect()} == {"a", "a/b", "a.b", "a-b"}
    assert [r.base for r in toc.read_directory(t, 0, 2).where("parent = '.'").orderBy("pos").collect()] == ["a", "a-b"]
    assert toc.read_directory(t, 0, 0).count() == 0 and toc.read_directory(t, 1, -1).where("parent = '.'").count() == 2
    rooted = toc.with_root(t)
    assert rooted.where("path = '.'").count() == 1 and toc.with_root(rooted).count() == rooted.count()
    assert toc.lookup(spark.createDataFrame([("a.tar", "/a/b"), ("a.tar", "q")], "archive string, path string"), t).where("found").count() == 1


def streams():
    rng = random.Random(1)
    text = b"".join(rng.choice([b"alpha ", b"beta ", b"gamma\n", bytes([rng.randrange(256)])]) for _ in range(60_000))
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    flushed = b"".join(z.compress(text[i : i + 9000]) + z.flush(zlib.Z_SYNC_FLUSH) for i in range(0, len(text), 9000)) + z.flush()
    return {
        "plain": (gzip.compress(text), text), "members": (gzip.compress(text[:50_000]) + gzip.compress(b"") + gzip.compress(text[50_000:]), text), "flushed": (flushed, text),
        "stored": (gzip.compress(text, 0), text), "short": (gzip.compress(b"hello, world"), b"hello, world"), "lorem": (gzip.compress(b"Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 5000), b"Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 5000),
    }


@pytest.mark.parametrize("kind", ["plain", "members", "flushed", "stored", "short", "lorem"])
@pytest.mark.parametrize("lib", [True, False])
def test_random_ranges(kind, lib, monkeypatch):
    if not lib:
        monkeypatch.setattr(gzip_index, "libz", lambda: None)
    data, text = streams()[kind]
    points = gzip_index.restart_points(data, 20_000)
    assert points[0].out == 0 and all(b.out >= a.out for a, b in zip(points, points[1:]))
    if lib and kind in ("plain", "flushed", "stored"):
        assert len(points) > 1
    rng = random.Random(2)
    for _ in range(100):
        a, n = rng.randrange(len(text) + 5), rng.randrange(5000)
        assert gzip_index.read_range(data, points, a, n) == text[a : a + n]
    for p in points:  # every point, also at odd bits
        assert gzip_index.read_range(data, [p], p.out, 500) == text[p.out : p.out + 500] or kind == "members"
    assert gzip_index.read_range(data, points, 0, len(text) + 10) == text


def test_members_headers_and_damage(spark):
    body = zlib.compress(b"data", wbits=-15)
    head = bytes([0x1F, 0x8B, 8, 4 | 8 | 16 | 2, 1, 0, 0, 0, 0, 3]) + b"\x02\x00ab" + "né".encode("latin-1") + b"\0" + b"note\0"
    head += (zlib.crc32(head) & 0xFFFF).to_bytes(2, "little")
    good = head + body + zlib.crc32(b"data").to_bytes(4, "little") + (4).to_bytes(4, "little")
    bad = {
        "crc": good[:-8] + bytes(4) + good[-4:], "size": good[:-4] + bytes(4), "cut": good[:-9], "magic": b"\x1f\x8c" + good[2:], "header": good[: len(head) - 1] + b"\xff" + good[len(head) :], "block": good[: len(head)] + b"\xff" * 20,
    }
    df = spark.createDataFrame([("good", good + gzip.compress(b"more")), ("none", b""), *bad.items()], "archive string, content binary")
    got = members.gzip_members(df).collect()
    first = next(r for r in got if r.archive == "good" and r.member == 0)
    assert (first.name, first.comment, bytes(first.extra), first.os, first.isize) == ("né", "note", b"ab", 3, 4) and first.mod_time is not None
    assert next(r for r in got if r.archive == "good" and r.member == 1).out == 4
    assert {r.archive for r in got if r.error} == set(bad) and not [r for r in got if r.archive == "none"]


def test_large_rows_one_at_a_time(spark):
    import tracemalloc

    import pyarrow as pa

    body = bytes(1 << 20)
    made = [("a", [{"name": f"{i}.txt", "content": body}, {"name": "x", "content": b"y"}]) for i in range(24)]
    schema = pa.schema([("archive", pa.string()), ("parts", pa.list_(pa.struct([("name", pa.string()), ("content", pa.binary())])))])
    batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    class Frame:
        """Runs the function of mapInArrow here."""

        columns = ["archive", "parts"]

        def select(self, *names):
            return self

        def mapInArrow(self, f, ddl):
            return f([batch])

        def mapInPandas(self, f, ddl):
            return f(b.to_pandas() for b in [batch])

    del made
    tracemalloc.start()
    got = [c.as_py() if hasattr(c, "as_py") else c for b in members.pack_gzip(Frame()) for c in (b.column(1) if hasattr(b, "column") else b["content"])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 24 and all([c for _, c in gzip_index.read_members(d)] == [body, b"y"] for d in got)
    assert peak < 6 << 20


def test_many_members_are_read_in_steps():
    import tracemalloc

    one = gzip.compress(bytes(100), 1)
    many = one * 20_000 + gzip.compress(bytes(40 << 20))
    tracemalloc.start()
    found = [m for m, _ in gzip_index.read_members(many, keep=False)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 20_001 and found[-1].out == 2_000_000 and found[-1].isize == 40 << 20 and found[-1].end == len(many) and peak < 24 << 20
    for n in range(1, len(one)):
        with pytest.raises(gzip_index.GzipError):
            list(gzip_index.read_members(one + one[:n]))


def test_archives_packed_and_unpacked_in_streams(spark):
    rng = random.Random(9)
    rows = [(None if i % 7 == 0 else f"a{i % 30}", f"{i:04d}", rng.randbytes(rng.randrange(2000))) for i in range(600)]
    packed = members.pack_together(spark.createDataFrame(rows, "archive string, path string, content binary").repartition(5))
    assert packed.count() == len({a for a, _, _ in rows}) and "Groups" not in packed._jdf.queryExecution().toString()  # a call into Python for each archive
    bad = spark.createDataFrame([("bad", gzip.compress(b"x" * 700))], "archive string, content binary")
    got = members.unpack(packed.unionByName(bad)).collect()
    assert sorted((str(r.archive), r.path, bytes(r.content)) for r in got if not r.error) == sorted((str(a), p, c) for a, p, c in rows)
    own = [r for r in got if r.archive == "a1"]
    assert [r.path for r in own] == sorted(r.path for r in own) and [r.seq for r in own] == list(range(len(own)))
    assert [r.archive for r in got if r.error] == ["bad"]


def test_json_round_trip_and_range_reads(spark):
    data, text = streams()["plain"]
    archives = spark.createDataFrame([("a", data)], "archive string, content binary")
    points = datasource.restart_table(archives, 20_000)
    back = index_io.checkpoints_from_json(index_io.checkpoints_to_json(points))
    key = lambda r: (r.out, r.into, r.bits, r.value, bytes(r.history))
    assert sorted(map(key, back.collect())) == sorted(map(key, points.collect()))
    asked = spark.createDataFrame([("a", i * 7919, 100) for i in range(20)], "archive string, offset long, length long")
    assert all(bytes(r.content) == text[r.offset : r.offset + r.length] for r in datasource.read_ranges(asked, archives, back).collect())
    t = table(spark, make_tar(LINKS))
    again = index_io.toc_from_json(index_io.toc_to_json(t))
    cols = ["seq", "path", "parent", "typeflag", "linkname", "size", "offset", "is_dir"]
    assert sorted(map(str, again.select(*cols).collect())) == sorted(map(str, t.select(*cols).collect()))


def test_range_reads_of_many_archives(spark):
    rng, data = random.Random(8), {f"a{i}": text for i, (_, text) in enumerate(streams().values())} | {f"b{i}": b"%d " % i * (i % 40) for i in range(300)}
    archives = spark.createDataFrame([(a, gzip.compress(t[:7]) + gzip.compress(t[7:])) for a, t in data.items()] + [(None, gzip.compress(b"no name"))], "archive string, content binary")
    asked = [(a, rng.randrange(len(t) + 3), rng.randrange(3000)) for a, t in data.items() for _ in range(3)] + [("gone", 0, 5), (None, 3, 9)]
    got = datasource.read_ranges(spark.createDataFrame(asked, "archive string, offset long, length long"), archives, datasource.restart_table(archives, 20_000))
    want = [(a, o, n, None if a == "gone" else (data[a] if a else b"no name")[o : o + n]) for a, o, n in asked]
    assert sorted(map(repr, ((r.archive, r.offset, r.length, None if r.content is None else bytes(r.content)) for r in got.collect()))) == sorted(map(repr, want))
    assert "CoGroups" not in got._jdf.queryExecution().toString()  # a call into Python for each archive


def test_sources_and_blocks(spark, tmp_path):
    datasource.register(spark)
    rng = random.Random(3)
    rows = [(f"d/f{i}", R, bytes(rng.choice(b"abcdef \n") for _ in range(rng.randrange(5000)))) for i in range(60)]
    plain = make_tar(rows)
    (tmp_path / "a.tar").write_bytes(plain)
    (tmp_path / "b.tar.gz").write_bytes(gzip.compress(plain))
    t = spark.read.format("tar_toc").option("path", f"{tmp_path}/*.tar*").load()
    assert t.count() == 120
    blocks = spark.read.format("archive_blocks").option("path", f"{tmp_path}/*.tar*").option("span", "20000").option("chunk", "4096").load()
    assert blocks.rdd.getNumPartitions() > 2
    want = {n: c for n, _, c in rows}
    got = reads.read_members(t, blocks, 4096).collect()
    assert len(got) == 120 and all(bytes(r.content) == want[r.path] for r in got)


class Handler(http.server.BaseHTTPRequestHandler):
    body = bytes(range(256)) * 40

    def do_HEAD(self):
        self.send_response(200)
        self.send_header("Content-Length", str(len(self.body)))
        self.end_headers()

    def do_GET(self):
        if self.path == "/relative":
            return self._to("file")
        if self.path == "/absolute":
            return self._to(f"http://127.0.0.1:{self.server.server_port}/file")
        if self.path == "/loop":
            return self._to("/loop")
        if self.path == "/missing":
            return self.send_error(404)
        a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
        self.send_response(200 if self.path == "/whole" else 206)
        self.end_headers()
        self.wfile.write(self.body[a : b + 1])

    def _to(self, where):
        self.send_response(302)
        self.send_header("Location", where)
        self.end_headers()

    def log_message(self, *_):
        pass


def test_http_ranges():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = lambda p: RangeReader(f"http://127.0.0.1:{server.server_port}/{p}")
    rng = random.Random(4)
    for name in ("file", "relative", "absolute"):
        r = at(name)
        for _ in range(20):
            a, n = rng.randrange(10_000), rng.randrange(200)
            assert r.read_at(a, n) == Handler.body[a : a + n]
        assert r.url.endswith("/file")
    assert at("file").read_all(1000) == Handler.body
    for name in ("loop", "missing", "whole"):
        with pytest.raises(RangeError):
            at(name).read_at(0, 10)
    with pytest.raises(RangeError):
        at("file").read_at(len(Handler.body) - 5, 10)
    server.shutdown()


class Bytes:
    def __init__(self, data):
        self.data, self.read = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, offset, length):
        self.read += length
        return self.data[offset : offset + length]


@pytest.mark.parametrize("kind", ["plain", "members", "flushed", "stored", "short", "lorem"])
@pytest.mark.parametrize("step", [7, 4096])
def test_stores_are_indexed_and_read_in_steps(kind, step):
    data, text = streams()[kind]
    points = gzip_index.restart_points(data, 20_000)
    assert list(access.restart_points(Bytes(data), 20_000, step)) == points
    rng, store = random.Random(5), Bytes(data)
    for p in points:
        decoder, at = access.Decoder(store, len(data), p, step), p.out
        for _ in range(4):  # one after the other with one decoder
            n = rng.randrange(1, 3000)
            assert decoder.read(at, n) == text[at : at + n]
            at += n + rng.randrange(-min(n, 5), 500) if decoder.first() <= at + n - 5 else n
    with pytest.raises(gzip_index.GzipError):
        list(access.restart_points(Bytes(data[: len(data) * 2 // 3]), 20_000, step))


def test_requests_fetch_only_what_they_need(spark, tmp_path):
    rng = random.Random(6)
    want = {f"d/{i}.bin": rng.randbytes(rng.randrange(1, 60_000)) for i in range(60)}
    made = io.BytesIO()
    with tarfile.open(fileobj=made, mode="w") as tar:
        for name, content in want.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
        for name, to in (("link", "d/7.bin"), ("away", "d/none")):
            info = tarfile.TarInfo(name)
            info.type, info.linkname = tarfile.SYMTYPE, to
            tar.addfile(info)
    packed = gzip.compress(made.getvalue(), 1)
    (tmp_path / "a.tar.gz").write_bytes(packed)
    (tmp_path / "b.tar").write_bytes(made.getvalue())
    sent = []

    class Served(Handler):
        body = packed

        def do_GET(self):
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            sent.append(b - a + 1)
            super().do_GET()

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Served)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/a.tar.gz"
    archives = [str(tmp_path / "a.tar.gz"), str(tmp_path / "b.tar"), url]
    points = access.index_archives(spark.createDataFrame([(a,) for a in archives], "archive string"), 50_000).cache()
    assert sorted({r.archive for r in points.select("archive").collect()}) == sorted([archives[0], url]) and points.count() > 20
    rows = [(a, e["seq"], e["path"], e["typeflag"], e["linkname"], e["size"], e["offset"]) for a in archives for e in members.entries(made.getvalue())]
    entries = spark.createDataFrame(rows, "archive string, seq long, path string, typeflag string, linkname string, size long, offset long")
    sent.clear()
    asked = [(url, "d/30.bin"), (url, "link"), (url, "away"), (archives[0], "/d/59.bin"), (archives[1], "./d/0.bin")]
    got = {(r.archive, r.path): r for r in access.open_members(spark.createDataFrame(asked, "archive string, path string"), entries, points).collect()}
    server.shutdown()
    for a, p in asked:
        r = got[a, p]
        name = {"link": "d/7.bin"}.get(p, p.removeprefix("/").removeprefix("./"))
        assert r.error == "not found" if p == "away" else bytes(r.content) == want[name], p
    assert 0 < sum(sent) < len(packed) // 2


def test_stream_of_archives(spark, tmp_path):
    landing, out, points = tmp_path / "in", f"{tmp_path}/toc", f"{tmp_path}/points"
    landing.mkdir()
    (landing / "a.tar").write_bytes(make_tar(LINKS))
    ingest.follow(spark, str(landing), out, f"{tmp_path}/cp", points).awaitTermination(60)
    (landing / "b.tar.gz").write_bytes(gzip.compress(make_tar(LINKS[:4])))
    ingest.follow(spark, str(landing), out, f"{tmp_path}/cp", points).awaitTermination(60)
    assert {r.archive: r["count"] for r in spark.read.parquet(out).groupBy("archive").count().collect()} == {"a.tar": len(LINKS), "b.tar.gz": 4}
    assert spark.read.parquet(points).count() == 1


def test_floor_and_spans(spark):
    rng = random.Random(5)
    marks = sorted({rng.randrange(100_000) for _ in range(50)})
    asked = [rng.randrange(120_000) for _ in range(200)]
    m = spark.createDataFrame([("a", x) for x in marks], "archive string, mark long")
    r = spark.createDataFrame([("a", x) for x in asked], "archive string, pos long")
    got = {x.pos: x.mark for x in reads.floor_join(r, m, ["archive"], "pos", "mark", 1000).collect()}
    assert got == {x: max((k for k in marks if k <= x), default=None) for x in asked}
    taken, last = [], 0
    for k in marks:
        if k - last > 9000:
            taken.append(k)
            last = k
    assert sorted(x.mark for x in reads.emit_spans(m, ["archive"], "mark", 9000).collect()) == taken


def test_spans_over_stretches(spark):
    rng = random.Random(10)
    held = {"few": [5], "none": [], None: [rng.randrange(3000) for _ in range(200)], "dense": list(range(-50, 4000)), "gaps": [k * 997 + d for k in range(0, 60, 3) for d in (0, 0, 1, 250, 251)], "twice": [101, 101, 202, 202]}
    held |= {f"r{i}": [rng.randrange(20_000) for _ in range(rng.randrange(400))] for i in range(30)}
    m = spark.createDataFrame([(a, x) for a, xs in held.items() for x in xs] + [("few", None)], "archive string, mark long")
    want = []
    for a, xs in held.items():
        last = 0
        for x in sorted(xs):
            if x - last > 100:
                want.append((a, x))
                last = x
    for stretch in (1, 3, 4096):
        got = reads.emit_spans(m, ["archive"], "mark", 100, stretch)
        assert sorted(map(repr, ((r.archive, r.mark) for r in got.collect()))) == sorted(map(repr, want)), stretch
    spread = reads.emit_spans(spark.range(400_000).select(F.lit("a").alias("archive"), (F.col("id") * 50).alias("mark")), ["archive"], "mark", 100)
    spread.collect()
    assert "array_append" not in spread._jdf.queryExecution().toString()  # copies what was taken so far, again and again


def test_overlaps_of_empty_entries(spark):
    rows = [("a", 512, 0), ("b", 1000, 0), ("c", 1000, 3), ("d", 1500, 1600), ("e", 2000, 0), ("f", 0, 0), ("g", 3999, None)]
    want = {(p, k, max(o, k * 1000), min(o + n, k * 1000 + 1000)) for p, o, n in rows if n is not None for k in range(5) if o < k * 1000 + 1000 and o + n > k * 1000}
    got = reads.overlaps(spark.createDataFrame(rows, "path string, offset long, size long"), 1000).select("path", "chunk", "from_byte", "to_byte").collect()
    assert sorted(map(tuple, got)) == sorted(want) and ("a", 0, 512, 512) in want


def test_table_function_and_listing_files(spark, tmp_path):
    members.register_functions(spark)
    spark.createDataFrame([("a.tar", make_tar(LINKS)), ("b.tar.gz", gzip.compress(make_tar(LINKS[:3])))], "archive string, content binary").createOrReplaceTempView("archives")
    got = spark.sql("SELECT archive, e.path, e.offset FROM archives, LATERAL explode_archive(content) e").collect()
    assert len(got) == len(LINKS) + 3 and next(r.offset for r in got if r.path == "usr/bin/binary") == 1536
    t = table(spark, make_tar(LINKS[:3]))
    toc.write_listing(t, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out/archive=a.tar").collect()] == ["512+0: usr", "1024+0: usr/bin", "1536+24: usr/bin/binary"]
    assert [r.path for r in toc.path_listing(toc.with_root(t)).orderBy("pos").collect()] == [".", "usr", "usr/bin", "usr/bin/binary"]


def test_raw_streams():
    z = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=b"hello world")
    body = z.compress(b"hello world, hello") + z.flush()
    assert gzip_index.inflate(body, b"hello world") == b"hello world, hello"
    assert gzip_index.inflate(zlib.compress(b"x", wbits=-15)) == b"x"
    for bad in (body[:-3], b"\xff\xff"):
        with pytest.raises(gzip_index.GzipError):
            gzip_index.inflate(bad, b"hello world")
