"""What the operators share: the shared folder, written tables, global row positions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the contracts, and a word: a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast by hint only when its counted rows come to fewer bytes than this.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return (folder or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    It cuts the lineage, freezes row numbers and partition ids under task retries, and gives
    Catalyst the real size, so that it broadcasts the table only if the file is small enough.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, row_bytes: int | Column) -> bool:
    """Whether the rows of df, counted or summed by their own size, come to at most BROADCAST_BYTES."""
    total = df.agg(F.coalesce(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)), F.lit(0))).first()[0]
    return total <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """Hint a broadcast only if df fits; otherwise leave the join alone."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes) else df


def with_position(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """df with a long ``position``: 0, 1, 2, ... in the given order over the whole table.

    Rows that tie are told apart by their place in a written copy, so a hot key is spread over
    partitions.  One range shuffle of df's columns, which should be narrow; what is counted
    centrally is one row a partition.
    """
    flat = write_table(df.withColumn("_row", F.monotonically_increasing_id()), f"{label}-rows")
    by = [*order, F.col("_row")]
    dealt = write_table(
        flat.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("_row")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        f"{label}-dealt",
    )
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    # one row a shuffle partition, a number that the session's settings bound
    return (
        dealt.join(F.broadcast(starts), "_part")
        .withColumn("position", F.col("_start") + F.col("_at"))
        .drop("_part", "_at", "_start")
    )
