"""Text expressions: cleaning, comparison keys, patterns.  All are Column -> Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities that are decoded, the ampersand last so that nothing is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))

EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]"
PHONE = r"\(?0[0-9]{1,2}\)?[-. ][0-9]{3,4}[-. ][0-9]{4}|\+[0-9]{1,3}[-. ][0-9]{2,4}[-. ][0-9]{3,4}[-. ][0-9]{3,4}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
LONG_NUMBER = r"(^|[^0-9])[0-9]{8,12}($|[^0-9])"
TOKEN = r"[가-힣A-Za-z0-9]+"

#: Endings of words in Korean questions, and words that ask without naming anything.
ENDINGS = ("알려주세요", "알려줘", "인가요", "까지야", "에서는", "에서", "으로", "하는", "해줘", "해야", "은", "는", "이", "가", "을", "를", "에", "로", "와", "과", "도", "요", "해")
STOPWORDS = ("어떻게", "방법", "절차", "알려줘", "알려주세요", "언제", "언제까지", "어디서", "뭐야", "무엇")


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " "))


def decode_entities(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def normalize(c: Column) -> Column:
    """NUL and tags become blanks, then entities are decoded, then white space is squeezed; null is empty."""
    c = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\0"), F.lit(" ")), "<[^>]+>", " ")
    return squeeze(decode_entities(c))


def compact(c: Column) -> Column:
    """Lower-cased ASCII letters and digits (and Hangul) only, for comparisons."""
    return F.regexp_replace(F.lower(c), "[^0-9a-z가-힣]+", "")


def lowered(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def without_ending(w: Column, endings: Sequence[str]) -> Column:
    """A word without the first of the endings, in the order of the list, that leaves at least 2 characters."""
    cut = w
    for e in reversed(endings):
        cut = F.when(w.endswith(e) & (F.length(w) >= len(e) + 2), F.left(w, F.length(w) - len(e))).otherwise(cut)
    return cut


def keywords(c: Column, most: int = 15, endings: Sequence[str] = ENDINGS, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """The first different words of at least 2 characters, in order, without endings and stop words."""
    words = F.transform(tokens(c), lambda w: without_ending(w, endings))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stopwords))), 1, most)


def drop_repeated_lines(c: Column) -> Column:
    """Blanks collapsed per line; empty lines, and lines equal to the line kept before, dropped."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " "))), lambda x: x != "")
    # the line kept before is equal to the line before, so neighbours decide
    pairs = F.arrays_zip(lines.alias("line"), F.concat(F.array(F.lit(None).cast("string")), lines).alias("before"))
    kept = F.filter(pairs, lambda x: x["line"].isNotNull() & ~x["line"].eqNullSafe(x["before"]))
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def strip_markup(c: Column) -> Column:
    """Markdown links, emphasis, code and headings removed; list markers turned to bullets."""
    for pattern, by in (
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"`([^`]*)`", "$1"),
        (r"(?m)^#{1,6}[ ]+", ""),
        (r"(?m)^[ ]*[-*][ ]+", "• "),
        (r"[ \t]+", " "),
        (r"\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


def contexts(text: Column, pattern: str, before: int, after: int, groups: int = 0) -> Column:
    """array<struct<i, hit, parts, left, right>>: every match with so many characters before and behind it, whatever stands there.

    parts are the match's first ``groups`` groups.  The text is cut at the matches once, named by a
    lambda, and each context is put together from the pieces around; a null text has no matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.flatten(F.zip_with(F.split(text, pattern, -1), hits, lambda b, h: F.array(b, F.coalesce(h, F.lit("")))))
    parts = F.zip_with(hits, hits, lambda a, _: F.array(*(F.regexp_extract(a, f"^(?:{pattern})", k) for k in range(1, groups + 1))).cast("array<string>"))

    def at(p: Column, i: Column) -> Column:
        near = lambda n: F.lit(2 * n + 1)  # noqa: E731 -- pieces that hold n characters at least: every second one is not empty
        left = F.array_join(F.slice(p, F.greatest(2 * i + 2 - near(before), F.lit(1)), F.least(2 * i + 1, near(before))), "")
        right = F.array_join(F.slice(p, 2 * i + 3, near(after)), "")
        return F.struct(i.alias("i"), p[2 * i + 1].alias("hit"), F.right(left, F.lit(before)).alias("left"), F.left(right, F.lit(after)).alias("right"))

    def found(p: Column) -> Column:
        places = F.when(F.size(p) > 2, F.sequence(F.lit(0), (F.size(p) / 2 - 2).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: at(p, i))

    told = F.transform(F.array(pieces), found)[0]
    return F.when(text.isNotNull(), F.zip_with(told, parts, lambda x, g: F.struct(x["i"].alias("i"), x["hit"].alias("hit"), g.alias("parts"), x["left"].alias("left"), x["right"].alias("right"))))
