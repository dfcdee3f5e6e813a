"""Rate limits as leaky buckets: so many requests a period, and a burst beyond it.

A bucket's excess grows by one interval with each request that is let through and drains with time;
a request that would raise it over ``burst`` intervals is refused and leaves the bucket as it is.  The
first request of a key finds it empty.  All of it is whole microseconds, so batch and stream agree.

Without refusals the excess has a closed form, a running minimum (``pressure``), which windows
compute.  With refusals each decision depends on the one before, so ``limited`` is a fold over the
requests of a key in order of time: a key's requests pass through one task, which holds one number.

Defined results: requests without a time come first, are let through and leave the bucket as it is; a
null key is a key of its own; requests of one time are taken in the order of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pressure(requests: DataFrame, key: str, ts: str, order: str, interval: int) -> DataFrame:
    """requests with ``excess`` (microseconds): how full the bucket of each would be if none were refused."""
    known = requests.where(F.col(ts).isNotNull())
    turns = Window.partitionBy(key).orderBy(ts, order)
    level = F.row_number().over(turns) * F.lit(interval) - F.unix_micros(F.col(ts).cast("timestamp"))
    leveled = known.withColumn("_level", level)
    return leveled.withColumn("excess", F.col("_level") - F.min("_level").over(turns.rowsBetween(Window.unboundedPreceding, 0))).drop("_level")


def admit(times: list[int | None], excess: int | None, last: int | None, interval: int, burst: int) -> tuple[list[bool], int | None, int | None]:
    """What is let through of requests in order, and the bucket after them; a bucket that is None is new."""
    out = []
    for now in times:
        if now is None:
            out.append(True)
            continue
        grown = 0 if excess is None else max(0, excess - (now - last) + interval)
        out.append(ok := grown <= burst * interval)
        if ok:
            excess, last = grown, now
    return out, excess, last


def _micros(column: pd.Series) -> list[int | None]:
    return [None if pd.isna(x) else int(x.value // 1000) for x in column]


def limited(requests: DataFrame, key: str, ts: str, order: str, interval: int, burst: int) -> DataFrame:
    """(key, order, accepted) of all requests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, excess, last = (), None, None
        for pdf in batches:
            starts = [0, *(i for i in range(1, len(pdf)) if _other(pdf["key"].iloc[i], pdf["key"].iloc[i - 1])), len(pdf)]
            ok: list[bool] = []
            for a, b in zip(starts, starts[1:]):
                name = pdf["key"].iloc[a]
                if not held or _other(held[0], name):
                    held, excess, last = (name,), None, None
                part, excess, last = admit(_micros(pdf["ts"].iloc[a:b]), excess, last, interval, burst)
                ok += part
            yield pd.DataFrame({key: pdf["key"], order: pdf["id"], "accepted": ok})

    rows = requests.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(order).alias("id"))
    rows = rows.repartition("key").sortWithinPartitions("key", "ts", "id")
    return rows.mapInPandas(run, T.StructType([T.StructField(key, requests.schema[key].dataType), T.StructField(order, requests.schema[order].dataType), T.StructField("accepted", T.BooleanType())]))


def _other(a: object, b: object) -> bool:
    return not (pd.isna(a) and pd.isna(b)) and a != b
