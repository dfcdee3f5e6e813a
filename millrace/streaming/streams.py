"""Structured Streaming: sources, sinks, and operators with state.

Every stream here reads what there is (availableNow), so the caller decides how often it runs; its
progress is kept in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.limits import admit
from millrace.storage import new_path

IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"

#: Seconds that events may be processed after their time before state may be gone.
LATE = 7 * 86400.0

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, bytes_per_batch: int = 256 << 20) -> DataFrame:
    """A folder or a single file of Parquet as a stream, in its own schema, in the order of the files' times.

    A micro-batch has at most bytes_per_batch (or one file), which bounds what an operator with state
    sees of a hot key at a time.  The stream's path is written as a pattern, because a plain one has
    to be a folder.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, label: str, mode: str = "append", idle: bool = True, rocksdb: bool = False) -> DataFrame:
    """Run the stream over what there is into a Parquet table, and read the table.

    idle False leaves out micro-batches without data, of which state that expires by processing time asks for one after the other.
    rocksdb keeps this stream's state there, as transformWithState demands.  The caller's session is left as it was.
    """
    spark, out = stream.sparkSession, new_path(stream.sparkSession, label)
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", new_path(spark, f"{label}-progress")).trigger(availableNow=True)
    wanted = {IDLE: str(idle).lower()} | ({PROVIDER: ROCKSDB} if rocksdb else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    # a stream keeps the settings of its start
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        running = writer.start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, label: str, apply: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "update") -> DataFrame:
    """Run the stream batch by batch through apply; the table has a column _batch, and a repeated batch replaces itself."""
    spark, out = stream.sparkSession, new_path(stream.sparkSession, label)

    def write(batch: DataFrame, number: int) -> None:
        apply(batch).write.mode("overwrite").parquet(f"{out}/_batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", new_path(spark, f"{label}-progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", out).parquet(out)


CARRIED = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("session", T.LongType()), T.StructField("year", T.IntegerType()), T.StructField("task", T.StringType())])


class SessionCarry(StatefulProcessor):
    """Per session the last year and task; replaced after gap seconds without an event, or by a reset.

    A micro-batch's events of a session are put in order of time first, so they are held together.  A
    session's state leaves the store when it was not written for the gap and ``late`` seconds of
    processing time; late is how far behind their time events may be processed.
    """

    def __init__(self, gap: float, late: float = LATE):
        self.gap, self.keep = gap, int((gap + late) * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("context", "at double, year int, task string", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, year, task = self.state.get() if self.state.exists() else (None, None, None)
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for r in pdf.itertuples():
            now = r.ts.timestamp()
            if r.reset or (at is not None and now - at >= self.gap):
                year = task = None
            at = now
            year = int(r.year) if pd.notna(r.year) else year
            task = r.task if isinstance(r.task, str) else task
            out.append((r.event_id, key[0], year, task))
        self.state.update((at, year, task))
        frame = pd.DataFrame(out, columns=["event_id", "session", "year", "task"])
        yield frame.astype({"year": "Int32"})

    def close(self) -> None:
        pass


class CacheReplay(StatefulProcessor):
    """Per question the time its entry expires; a hit does not move it.

    With ``negative`` rows have a column found, and a miss that found nothing is kept for that many seconds
    instead of ttl.  State leaves the store as in SessionCarry, after the longer of both.
    """

    def __init__(self, ttl: float, negative: float | None = None, late: float = LATE):
        self.ttl, self.negative, self.keep = ttl, negative, int((max(ttl, negative or 0) + late) * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("entry", "expires double", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        expires = self.state.get()[0] if self.state.exists() else None
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out, expires = replay(pdf, expires, self.ttl, self.negative)
        self.state.update((expires,))
        yield pd.DataFrame({"event_id": pdf["event_id"], "outcome": out})

    def close(self) -> None:
        pass


class LeakyBucket(StatefulProcessor):
    """Per key the bucket of a rate limit (see operators.limits): its excess and the time of the last request let through.

    Rows are (key, ts, event_id); what comes out is (key, event_id, accepted).  A bucket that must have
    drained since leaves the store, as in SessionCarry.
    """

    def __init__(self, interval: int, burst: int, late: float = LATE):
        self.interval, self.burst, self.keep = interval, burst, int(((burst + 1) * interval / 1e6 + late) * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "excess long, last long", self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        excess, last = self.state.get() if self.state.exists() else (None, None)
        # times and ids only, in order of time
        pdf = pd.concat([r[["ts", "event_id"]] for r in rows]).sort_values(["ts", "event_id"], na_position="first")
        times = [None if pd.isna(x) else int(x.value // 1000) for x in pdf["ts"]]
        accepted, excess, last = admit(times, excess, last, self.interval, self.burst)
        if excess is not None:
            self.state.update((excess, last))
        yield pd.DataFrame({"key": key[0], "event_id": pdf["event_id"], "accepted": accepted})

    def close(self) -> None:
        pass


def replay(pdf: pd.DataFrame, expires: float | None, ttl: float, negative: float | None = None) -> tuple[list[str], float | None]:
    """Outcomes of requests in order of time, and when the entry expires after them.

    negative is the time to live of what was not found (column found; null is found).
    """
    out = []
    lives = [ttl] * len(pdf) if negative is None else [negative if pd.notna(x) and not x else ttl for x in pdf["found"]]
    for now, live in zip((None if pd.isna(x) else x.timestamp() for x in pdf["ts"]), lives, strict=True):
        hit = expires is not None and now is not None and now < expires
        out.append("hit" if hit else "miss")
        if not hit and now is not None:
            expires = now + live
    return out, expires


def replay_table(requests: DataFrame, ttl: float) -> DataFrame:
    """(event_id, outcome) of requests (question, ts, event_id): a fold in order of time per question.

    Partitions are sorted by question and time and read as batches, so memory holds a batch and one
    expiry, however many requests a question has.  A null question is a question of its own; requests
    without a time come first and are misses that leave nothing behind.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        question, expires = (), None
        for pdf in batches:
            for _, part in pdf.groupby(pdf["question"].isna().astype(str).str.cat(pdf["question"].fillna("").astype(str)), sort=False):
                key = part["question"].iloc[0]
                key = None if pd.isna(key) else key
                out, expires = replay(part, expires if key == question else None, ttl)
                question = key
                yield pd.DataFrame({"event_id": part["event_id"], "outcome": out})

    rows = requests.select("question", F.col("ts").cast("timestamp").alias("ts"), "event_id").repartition("question").sortWithinPartitions("question", "ts", "event_id")
    return rows.mapInPandas(run, "event_id long, outcome string")
