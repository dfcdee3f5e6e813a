"""Grounding against the four spellings of a date, one by one, and the caps of what is refused."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.operators import grounding as G

DAYS = [
    ("접수 2024년 03월 5일", True), ("접수 2024 년3월05일", True), ("2024. 3. 5.", True), ("2024/03/05", True), ("2024-3-5", True), ("3월 5일까지", True), ("03.05(화)", True), (" 3 / 5 ", True),
    ("2023-3-5 그리고 13.5", False), ("2024-3-15", False), ("23.5", False), ("3.50", False), ("2024. 3. 6.", False), ("", False), (None, False),
]


def test_dates_in_four_spellings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DAYS)], "i int, text string")
    got = df.select("i", G.date_grounded(G.date_keys(F.col("text")), F.lit(date(2024, 3, 5))).alias("ok")).orderBy("i").collect()
    assert [r["ok"] for r in got] == [ok for _, ok in DAYS]


@pytest.mark.parametrize(
    ("text", "excerpt", "found"),
    [
        ("Say  a.b\n(c) now", "A.B (C)", "a.b\n(c)"), ("x $1 + y", "$1+y", "$1 + y"), ("äÖ ü", "Äö Ü", "äÖ ü"), ("abc", "d", None), ("abc", "", None), ("abc", "  ", None), (None, "a", None), ("a", None, None),
        ("ab ab", "a b", "ab"), (r"a\b [c]^*", r"\b[c]^*", r"\b [c]^*"), ("한 글", "한글", "한 글"),
    ],
)
def test_places_without_white_space(spark, text, excerpt, found):
    df = spark.createDataFrame([(text, excerpt)], "t string, e string")
    at = df.select(G.place(F.col("t"), F.col("e")).alias("p")).first()["p"]
    assert (at is None) if found is None else text[at["at"] : at["at"] + at["length"]] == found


def test_what_is_refused_is_null_and_caps(spark):
    text = "문의: 홍길동 (02-123-4567), Info@Example.org. 2024. 3. 5. 방문 접수"
    rows = [
        ("방문접수", "body", "2024-03-05", "02-123-4567 내선 3", "info@example.org", "홍 길동 교수", 0.9),
        ("방문 접수", "body", "2024-03-06", "02-123-4567", None, None, 0.9),
        ("없는 글", "body", None, None, None, None, 0.9),
        ("방문", None, None, "4567", "x@y.z", "홍", 0.4),
        ("방문", "body", None, "말 " * 60, None, "교수", 0.9),
    ]
    df = spark.createDataFrame([(i, *r, text) for i, r in enumerate(rows)], "i int, excerpt string, locator string, start string, phone string, email string, person string, confidence double, text string")
    p = {c: F.col(c) for c in ("excerpt", "locator", "phone", "email", "person", "confidence")} | {"start": F.col("start").cast("date"), "end": F.lit(None).cast("date"), "role": F.lit("lead")}
    out = df.select("i", *(c.alias(n) for n, c in G.grounded(p, F.col("text")).items())).orderBy("i").collect()
    told = [(r["excerpt"], str(r["start"]) if r["start"] else None, r["phone"], r["email"], r["person"], r["role"], r["needs_review"], r["confidence"]) for r in out]
    assert told == [
        ("방문접수", "2024-03-05", "02-123-4567", "info@example.org", "홍 길동 교수", "lead", False, 0.9),
        ("방문 접수", None, "02-123-4567", None, None, "lead", True, 0.6),
        (None, None, None, None, None, "lead", True, 0.5),
        ("방문", None, None, None, None, None, True, 0.4),
        ("방문", None, None, None, None, None, True, 0.6),
    ]
    assert out[0]["found"]["at"] == text.index("방문 접수")
