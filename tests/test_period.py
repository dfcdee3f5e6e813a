"""Periods as texts give them: the five shapes, labels against each other, what does not exist."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators.period import windows, with_period

CASES = [
    ("신청기간: 2024. 3. 1. ~ 2024. 3. 20. 18:00", "2024-03-01 00:00", "2024-03-20 18:00", "range"),
    ("접수기간 2024년 3월 1일(금) 오전 9시 ~ 3월 8일(금) 오후 5시 30분", "2024-03-01 09:00", "2024-03-08 17:30", "range"),
    ("모집 기간: 2024.3.5부터 3.9까지", "2024-03-05 00:00", "2024-03-09 23:59", "range"),
    ("신청기간: 2024. 7. 7. ~ 13.", "2024-07-07 00:00", "2024-07-13 23:59", "short_end"),
    ("신청기간: 2024. 7. 7.(일) ~ 13.(토) 오후 6시", "2024-07-07 00:00", "2024-07-13 18:00", "short_end"),
    ("접수: ~ 7. 12.", None, "2024-07-12 23:59", "deadline"),
    ("신청 7월 12일까지", None, "2024-07-12 23:59", "deadline"),
    ("제출 마감일: 2024-02-29", None, "2024-02-29 23:59", "deadline"),
    ("등록 2024-02-01 한", None, "2024-02-01 23:59", "deadline"),
    ("납부: 2024-02-01 오전 12시부터", "2024-02-01 00:00", None, "start_only"),
    ("신청기간: 2023-02-29 ~ 2023-13-01", None, None, "none"),
    ("신청기간: 2023-02-29 그리고 2023-03-01", "2023-03-01 00:00", None, "start_only"),
    ("신청기간: 2024. 3. 20. ~ 2024. 3. 1.", "2024-03-20 00:00", "2024-03-20 23:59", "short_end"),
    ("신청 안내. 행사 2024-05-05", None, None, "none"),  # another sentence
    ("신청 " + "가" * 30 + " 2024-05-05", None, None, "none"),  # too far off
    ("신청기간 " + "가" * 200 + " 2024-05-05까지", None, "2024-05-05 23:59", "deadline"),
    ("신청기간: 2024-05-01 ~ 2024-05-02. 지원서 접수기간: 2024-04-01 ~ 2024-04-02.", "2024-04-01 00:00", "2024-04-02 23:59", "range"),
    ("접수기간: 2024-05-01 ~ 2024-05-02" + "나" * 260 + "접수기간: 2024-06-01 ~ 2024-06-02", "2024-06-01 00:00", "2024-06-02 23:59", "range"),  # of equals the last
    ("행사 2024-05-05", None, None, "none"),
    ("", None, None, "none"),
    (None, None, None, "none"),
]


def test_periods(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    got = with_period(df.withColumn("day", F.lit("2024-09-01").cast("date")), "text", "day", name="p").orderBy("i").collect()
    when = lambda x: datetime.fromisoformat(x) if x else None
    for r, (text, start, end, shape) in zip(got, CASES, strict=True):
        assert (r["p"]["start_at"], r["p"]["end_at"], r["p"]["shape"]) == (when(start), when(end), shape), text


@pytest.mark.parametrize("n", [1, 400])
def test_windows_overlap_and_are_bounded(spark, n):
    text = "신청: 1.2 " * n
    found = spark.createDataFrame([(text,)], "text string").select(windows(F.col("text")).alias("w")).first()["w"]
    assert len(found) == n and [w["i"] for w in found] == [*range(n)]
    at = [i for i in range(len(text)) if text.startswith("신청", i)]
    for w, i in zip(found, at, strict=True):
        assert w["label"] == "신청:" and w["window"] == text[i : i + 3 + 240] and w["front"] == text[max(0, i - 24) : i]
