"""Archive paths as Catalyst expressions. Every function takes and returns a Column (or a column's name)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(path: Column | str) -> Column:
    """Drops one trailing slash, then one leading slash, then one leading './'; nothing more."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(path), r"/$", ""), r"^/", ""), r"^\./", "")


def clean(path: Column | str) -> Column:
    """The shortest equal path: no '.', no empty components, '..' taken back where something is before it."""
    p = _c(path)
    rooted = p.startswith("/")

    def step(acc: Column, x: Column) -> Column:
        size = F.size(acc)
        last = F.try_element_at(acc, F.lit(-1))
        plain = F.array_append(acc, x)
        up = F.when((size > 0) & (last != ".."), F.slice(acc, 1, F.greatest(size - 1, F.lit(0)))).when(rooted, acc).otherwise(plain)
        return F.when(x.isin("", "."), acc).when(x == "..", up).otherwise(plain)

    joined = F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def join(*parts: Column | str) -> Column:
    """Parts joined by slashes and cleaned; empty parts don't count, and nothing at all gives ''."""
    kept = F.filter(F.array(*map(_c, parts)), lambda x: x != "")
    return F.when(F.size(kept) == 0, F.lit("")).otherwise(clean(F.array_join(kept, "/")))


def parent(path: Column | str) -> Column:
    """The directory of a path: '.' without a slash."""
    p = _c(path)
    return F.when(F.instr(p, "/") == 0, F.lit(".")).otherwise(clean(F.concat(F.regexp_extract(p, r"^(.*)/[^/]*$", 1), F.when(p.rlike(r"^/[^/]*$"), F.lit("/")).otherwise(F.lit("")))))


def listing_parent(path: Column | str) -> Column:
    """The parent for directory listings: the root isn't its own child."""
    p = _c(path)
    return F.when(p == ".", F.lit("")).otherwise(parent(p))


def base(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def prefixes(path: Column | str) -> Column:
    """All that stands before a slash, shortest first; the path itself isn't among them."""
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def walk_key(path: Column | str) -> Column:
    """Sorts a tree in pre-order: by components, not by characters, so that 'a/b' stands before 'a.b'. The root is first."""
    p = _c(path)
    return F.when(p == ".", F.array().cast("array<string>")).otherwise(F.split(p, "/"))


def link_target(path: Column | str, typeflag: Column | str, linkname: Column | str) -> Column:
    """Where a link entry points: hard links and absolute links from the archive's root, others from the link's directory."""
    link = _c(linkname)
    return F.when((_c(typeflag) == "1") | link.startswith("/"), normalize(link)).otherwise(join(parent(path), link))


def listing_line(offset: Column | str, size: Column | str, path: Column | str) -> Column:
    return F.format_string("%d+%d: %s", _c(offset), _c(size), _c(path))


def range_header(offset: Column | str, length: Column | str) -> Column:
    """An HTTP range, both ends included."""
    return F.format_string("bytes=%d-%d", _c(offset), _c(offset) + _c(length) - 1)


def unix_time(seconds: Column | str) -> Column:
    """A timestamp; 0 stands for none."""
    return F.timestamp_seconds(F.nullif(_c(seconds), F.lit(0)))
