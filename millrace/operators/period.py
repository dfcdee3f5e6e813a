"""Periods that texts announce: windows behind labels, scored, and the shapes in which dates stand in the best one.

The windows are found and scored by column expressions within the row; they may overlap, since a
window runs on over the labels behind it.  Only the reading of the best window is Python, in Arrow
batches: what a date leaves out (year, month) comes from the date or the notice before it.
"""

from __future__ import annotations

import re
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What announces a period, what makes it explicit, what names its two ends, and how dates are written.
LABEL = r"(?:신청|모집|접수|지원|등록|제출|납부)(?:\s*(?:기간|기한|일정|마감일?))?\s*[:：]?"
EXPLICIT = ("기간", "기한", "마감", "일정")
RANGE_MARKS = ("~", "부터", "까지")
PAPERS, HANDED_IN = ("지원서", "신청서", "서류"), ("접수", "제출", "지원", "신청")
DATE = r"(?:(20\d{2})\s*[.\-/년]\s*)?(\d{1,2})\s*[.\-/월]\s*(\d{1,2})\s*일?(?:\s*\([^)]+\))?(?:\s*[.]?\s*(오전|오후)?\s*(\d{1,2})(?::|시)\s*(\d{1,2})?\s*분?)?"
SHORT_END = r"\s*[.]?\s*(?:\([^)]+\))?\s*(?:~|[-–—]|부터)\s*(\d{1,2})\s*(?:[.일])?(?:\s*\([^)]+\))?(?:\s*[.]?\s*(오전|오후)?\s*(\d{1,2})(?::|시)\s*(\d{1,2})?\s*분?)?"

#: Characters of a window behind its label, of its head that may hold a range mark, and in front of it; how near a date must stand to a label that is not explicit.
WINDOW, HEAD, FRONT, NEAR = 240, 180, 24, 25

PERIOD = T.StructType([T.StructField("start_at", T.TimestampNTZType()), T.StructField("end_at", T.TimestampNTZType()), T.StructField("shape", T.StringType())])

_DATE, _SHORT = re.compile(DATE), re.compile(SHORT_END)


def _any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def windows(text: Column, label: str = LABEL, date: str = DATE, explicit: tuple[str, ...] = EXPLICIT) -> Column:
    """array<struct<i, label, front, window, dates, explicit, score>>: the windows of a text that may give a period, in order.

    Null and empty texts have none.  A window without a date is none, nor is one whose label is not
    explicit and whose first date stands far off or in another sentence.  Score: one for each date, 4
    for an explicit label, 2 for a range mark near the label, 8 where papers are handed in.
    """
    hits, between = F.regexp_extract_all(text, F.lit(label), F.lit(0)), F.split(text, label, -1)
    # between and hits in turn; what a window needs of it is bounded by its length
    pieces = F.flatten(F.zip_with(between, hits, lambda b, h: F.array(b, F.coalesce(h, F.lit("")))))

    def cut(p: Column, i: Column) -> Column:
        hit = p[2 * i + 1]
        ahead = F.array_join(F.slice(p, F.greatest(2 * i + 2 - 2 * FRONT, F.lit(1)), F.least(2 * i + 1, F.lit(2 * FRONT))), "")
        whole = F.left(F.array_join(F.slice(p, 2 * i + 2, F.lit(2 * WINDOW)), ""), F.length(hit) + WINDOW)
        first = F.regexp_instr(whole, F.lit(date)) - 1
        return F.struct(i.alias("i"), hit.alias("label"), F.right(ahead, F.lit(FRONT)).alias("front"), whole.alias("window"), first.alias("first"))

    def scored(x: Column) -> Column:
        named = _any(x["label"], explicit)
        papers = named & _any(x["front"], PAPERS) & _any(x["label"], HANDED_IN)
        dates = F.regexp_count(x["window"], F.lit(date))
        score = dates + F.when(named, 4).otherwise(0) + F.when(_any(F.left(x["window"], F.lit(HEAD)), RANGE_MARKS), 2).otherwise(0) + F.when(papers, 8).otherwise(0)
        return F.struct(*(x[c].alias(c) for c in ("i", "label", "front", "window")), dates.alias("dates"), named.alias("explicit"), score.alias("score"))

    def usable(x: Column) -> Column:
        before = F.substring(x["window"], F.length(x["label"]) + 1, F.greatest(x["first"] - F.length(x["label"]), F.lit(0)))
        return (x["first"] >= 0) & (_any(x["label"], explicit) | ((x["first"] <= NEAR) & ~before.rlike("[.!?]")))

    def found(p: Column) -> Column:
        places = F.when(F.size(p) > 2, F.sequence(F.lit(0), (F.size(p) / 2 - 2).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(F.transform(places, lambda i: cut(p, i)), usable), scored)

    # the pieces are named by a lambda, so that they are made once and not for each window
    return F.when(text.isNotNull(), F.transform(F.array(pieces), found)[0])


def best_window(found: Column) -> Column:
    """The window with the most points, of equals the last."""
    order = F.transform(found, lambda x: F.struct(x["score"].alias("score"), x["i"].alias("i"), x["label"].alias("label"), x["window"].alias("window")))
    return F.array_max(order)


def _moment(year: int, month: int, day: int, half: str | None, hour: str | None, minute: str | None, end: bool) -> datetime | None:
    """A moment; a day alone is its first minute, or its last where a period ends.  Null if there is none such."""
    h, m = int(hour or (23 if end else 0)), int(minute or (59 if end and not hour else 0))
    if half == "오후" and h < 12:
        h += 12
    elif half == "오전" and h == 12:
        h = 0
    try:
        return datetime(year, month, day, h, m)
    except ValueError:
        return None


def resolve(label: str | None, window: str | None, year: int) -> tuple[datetime | None, datetime | None, str]:
    """(start, end, shape) of a window: ``range``, ``short_end``, ``deadline``, ``start_only`` or ``none``.

    year: that of dates which name none.  Dates that do not exist are left out.
    """
    if not window:
        return None, None, "none"
    label = label or ""

    def at(m: re.Match, end: bool) -> datetime | None:
        return _moment(int(m[1] or year), int(m[2]), int(m[3]), m[4], m[5], m[6], end)

    dates = [m for m in _DATE.finditer(window) if at(m, False)]
    if not dates:
        return None, None, "none"
    first = dates[0]
    prefix, behind = window[len(label) : first.start()], window[first.end() :]
    if "~" in prefix:
        return None, at(first, True), "deadline"
    for a, b in zip(dates, dates[1:]):
        mark = window[a.end() : b.start()]
        if "~" in mark or "부터" in mark:
            start, end = at(a, False), at(b, True)
            if end and end >= start:
                return start, end, "range"
    short = _SHORT.match(behind[:60])
    if short:
        start = at(first, False)
        end = _moment(start.year, start.month, int(short[1]), short[2], short[3], short[4], True)
        if end and end >= start:
            return start, end, "short_end"
    around = f"{label} {window[: first.end() + 20]}"
    if "까지" in around or "마감" in around or behind[:8].lstrip().startswith("한"):
        return None, at(first, True), "deadline"
    return at(first, False), None, "start_only"


@F.pandas_udf(PERIOD)
def resolve_period(label: pd.Series, window: pd.Series, year: pd.Series) -> pd.DataFrame:
    rows = [resolve(a, w, 0 if pd.isna(y) else int(y)) for a, w, y in zip(label, window, year, strict=True)]
    return pd.DataFrame(rows, columns=["start_at", "end_at", "shape"]).astype({"start_at": "datetime64[us]", "end_at": "datetime64[us]"})


def with_period(notices: DataFrame, text: str, published: str, label: str = LABEL, name: str = "period") -> DataFrame:
    """notices with struct<start_at, end_at, shape> of the period that each announces; years left out are that of its publication."""
    best = notices.withColumn("_best", best_window(windows(F.col(text), label)))
    return best.withColumn(name, resolve_period(F.col("_best.label"), F.col("_best.window"), F.year(published))).drop("_best")
