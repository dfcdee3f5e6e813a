"""Leaky buckets against a slow fold in seconds, and by the limits that they are for."""

import random
from datetime import datetime, timedelta
from fractions import Fraction

import pytest

from millrace.operators import limits

START = datetime(2024, 1, 1)


def slow(times, a_minute, burst):
    """The bucket in requests, as fractions."""
    level, last, out = None, None, []
    for now in times:
        if now is None:
            out.append(True)
            continue
        grown = Fraction(0) if level is None else max(Fraction(0), level - Fraction(int((now - last).total_seconds() * 10**6), 60 * 10**6) * a_minute + 1)
        out.append(grown <= burst)
        if out[-1]:
            level, last = grown, now
    return out


@pytest.mark.parametrize(("a_minute", "burst"), [(12, 5), (30, 10)])
def test_against_a_slow_fold(spark, a_minute, burst):
    rng, rows, want = random.Random(burst), [], {}
    for key in [*range(5), None]:
        at, times = START, [None]
        for _ in range(150):
            at += timedelta(milliseconds=rng.choice([0, 10, 500, 2000, 5000, 40000]))
            times.append(at)
        for i, (t, ok) in enumerate(zip(times, slow(times, a_minute, burst), strict=True)):
            rows.append((key, t, i))
            want[key, i] = ok
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "who int, ts timestamp, n int")
    got = {(r["who"], r["n"]): r["accepted"] for r in limits.limited(df, "who", "ts", "n", 60_000_000 // a_minute, burst).collect()}
    assert got == want and {*want.values()} == {True, False}


def test_burst_at_once_and_what_drains():
    now = 0
    ok, excess, last = limits.admit([now] * 8, None, None, 5_000_000, 5)
    assert ok == [True] * 6 + [False] * 2 and excess == 25_000_000
    # a refused request takes nothing: five seconds later one more fits
    ok, *_ = limits.admit([5_000_000, 5_000_000], excess, last, 5_000_000, 5)
    assert ok == [True, False]
    ok, *_ = limits.admit([10**9] * 7, excess, last, 5_000_000, 5)
    assert ok == [True] * 6 + [False]


def test_pressure_is_the_bucket_that_refuses_nothing(spark):
    rng = random.Random(1)
    times = [START + timedelta(milliseconds=rng.randint(0, 60000)) for _ in range(200)]
    df = spark.createDataFrame([(i % 3, t, i) for i, t in enumerate(times)] + [(0, None, -1)], "k int, ts timestamp, n int")
    got = {r["n"]: r["excess"] for r in limits.pressure(df, "k", "ts", "n", 1_000_000).collect()}
    for k in range(3):
        level, last = 0, None
        for t, n in sorted((t, i) for i, t in enumerate(times) if i % 3 == k):
            level = 0 if last is None else max(0, level - int((t - last).total_seconds() * 10**6 + 0.5) + 1_000_000)
            last = t
            assert got[n] == level
    assert -1 not in got
