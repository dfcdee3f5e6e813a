"""References made absolute, as RFC 3986 (section 5) does it, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole parts with their marks: "" where a part is absent.
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
SCHEME, AUTHORITY, PATH, QUERY, FRAGMENT = range(1, 6)


def part(url: Column, which: int) -> Column:
    """One part of a reference with its mark (``http:``, ``//host``, ``/a``, ``?q``, ``#f``), "" where it is absent."""
    return F.regexp_extract(url, f"(?s){_PARTS}", which)


def without_dots(path: Column) -> Column:
    """The path without its segments . and .., by a stack of segments."""
    segments = F.split(path, "/", -1)
    rooted = path.startswith("/")
    deep = lambda stack: F.size(stack) > F.when(rooted, 1).otherwise(0)
    up = lambda stack: F.when(deep(stack), F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)
    stack = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda stack, s: F.when(s == "..", up(stack)).when(s == ".", stack).otherwise(F.concat(stack, F.array(s))),
    )
    open_end = F.element_at(segments, -1).isin(".", "..")
    joined = F.array_join(F.when(open_end, F.concat(stack, F.array(F.lit("")))).otherwise(stack), "/")
    return F.when(rooted & ~joined.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def resolve(base: Column, reference: Column) -> Column:
    """The reference seen from the absolute link ``base``; null where either is null."""
    r, b = ({i: part(url, i) for i in range(1, 6)} for url in (F.trim(reference), base))
    folder = F.regexp_extract(b[PATH], "(?s)^(.*/)?", 0)
    merged = F.when((b[AUTHORITY] != "") & (b[PATH] == ""), F.concat(F.lit("/"), r[PATH])).otherwise(F.concat(folder, r[PATH]))
    full, own = r[SCHEME] != "", r[AUTHORITY] != ""
    path = F.when(full | own | r[PATH].startswith("/"), without_dots(r[PATH])).when(r[PATH] == "", b[PATH]).otherwise(without_dots(merged))
    query = F.when(full | own | (r[PATH] != "") | (r[QUERY] != ""), r[QUERY]).otherwise(b[QUERY])
    scheme = F.when(full, r[SCHEME]).otherwise(b[SCHEME])
    authority = F.when(full | own, r[AUTHORITY]).otherwise(b[AUTHORITY])
    return F.concat(scheme, authority, path, query, r[FRAGMENT])
