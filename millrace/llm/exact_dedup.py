"""Exact dedup: a Bloom filter in two passes, so that only rows whose text may repeat are grouped.

Texts are equal when they are identical without white space.  The first pass sets bits: each row's
hash names a block of the filter and PROBES bits of it, and a bit counts if more than one row has
set it.  The second pass looks the rows up: a row with any bit of its own only is unique and passes
straight through; the rest are grouped by the SHA-256 of their text, so false hits cost a shuffle of
one narrow row and never change a result.  DataFrame functions only.

What the first pass moves is the places of the bits, one long for each, counted in the tasks before;
no row moves for it.  (A bitmap of its own for every task would move the size of the filter for every
task, which is more: a task sets few bits of each block.)

Defined results: a null text is empty, like a text of white space only; of equal texts the row with
the most code points stays, then the smallest doc_id (null last), then the first in a written copy,
so one row stays even if rows repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import BROADCAST_BYTES, SPACE, write_table

#: A block is one bitmap of Spark's bitmap functions.
BLOCK_BITS = 32768
BITS_A_ROW = 16
PROBES = 2


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def _bits(blocks: int) -> tuple[Column, Column]:
    """The block of a row, and its bits in the block, from the two halves of its hash."""
    bits = [F.pmod(F.shiftrightunsigned(F.col("_hash"), 16 * i), F.lit(BLOCK_BITS)).cast("long") for i in range(PROBES)]
    return F.pmod(F.xxhash64("_hash"), F.lit(blocks)).alias("_block"), F.array(*bits).alias("_bits")


def repeated_bits(rows: DataFrame, blocks: int) -> DataFrame:
    """First pass: (_block, _bitmap) of the bits that more than one row has set."""
    block, bits = _bits(blocks)
    places = F.transform(bits, lambda bit: block * BLOCK_BITS + bit)
    twice = rows.select(F.explode(places).alias("place")).groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.floor(F.col("place") / BLOCK_BITS).alias("_block")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(BLOCK_BITS))).alias("_bitmap"))


def _has(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1


def maybe_repeated(rows: DataFrame) -> DataFrame:
    """Second pass: rows with boolean ``_maybe``, false only if no other row has the same hash.

    The filter has BITS_A_ROW bits a row; it is broadcast while it is under BROADCAST_BYTES and
    joined by block beyond.
    """
    blocks = max(1, -(-rows.count() * BITS_A_ROW // BLOCK_BITS))
    bitmaps = write_table(repeated_bits(rows, blocks), "bloom")
    if blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES:
        bitmaps = F.broadcast(bitmaps)
    block, bits = _bits(blocks)
    looked_up = rows.withColumns({"_block": block, "_bits": bits}).join(bitmaps, "_block", "left")
    hit = F.col("_bitmap").isNotNull()
    for i in range(PROBES):
        hit = hit & _has(F.col("_bitmap"), F.col("_bits")[i])
    return looked_up.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_block", "_bits", "_bitmap")


def dedup_plan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = write_table(
        docs.select("doc_id", F.sha2(normalized(F.col("text")), 256).alias("text_sha256"), F.coalesce(F.length("text"), F.lit(0)).alias("_length"))
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_hash", F.conv(F.substring("text_sha256", 1, 16), 16, -10).cast("long")),
        "dedup-rows",
    )
    tested = write_table(maybe_repeated(rows).drop("_hash"), "dedup-tested")
    alone = tested.where(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = tested.where("_maybe").drop("_maybe")
    best = F.struct((-F.col("_length")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("_row").alias("d"))
    groups = write_table(maybe.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(best).alias("_best")), "dedup-groups")
    grouped = maybe.join(groups, "text_sha256").select(
        "doc_id", F.col("_best.c").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best.d")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that dedup_plan drops, columns unchanged.

    The choice needs one row of each group; where a doc_id repeats, the row of it with the most code
    points stays.  A row travels as one struct, so its columns may have any names.
    """
    kept = dedup_plan(docs).where("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("kept_sha"))
    rows = docs.select(F.struct("*").alias("row"), F.sha2(normalized(F.col("text")), 256).alias("sha"))
    same = F.col("row.doc_id").eqNullSafe(F.col("keep")) & (F.col("sha") == F.col("kept_sha"))
    found = rows.join(kept, same, "left_semi").select(F.col("row.doc_id").alias("id"), "sha", "row")
    longest = F.max_by("row", F.coalesce(F.length("row.text"), F.lit(0)))
    return found.groupBy("id", "sha").agg(longest.alias("row")).select("row.*")
