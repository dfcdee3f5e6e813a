"""Quality by importance resampling (Xie et al., 2023).

Two generative models over hashed word unigrams and bigrams, one of target text and one of all raw
text, give each document the log of its likelihood ratio.  A Gumbel number drawn from a hash of the
document is added, and the k largest sums are taken: a sample without replacement in proportion to
the ratios.

The raw model counts all documents.  The target model is fitted on at most TARGETS labelled good
documents (by a hash of their doc_id).  k is a share of the documents, by default the share of good
ones (quality 1, not toxic) among all labels.

Defined results: a null or empty text has log-weight 0; rows without doc_id draw by their text; ties
of the sum go by doc_id, then by place; without labels the target is the raw text, so all weights are
0 and the sample is plain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import with_position, write_table
from millrace.llm.textbytes import spaced_words, text_runs
from millrace.llm.xxh import xxh64_slices

BUCKETS = 10_000
TARGETS = 20_000
#: Added to each bucket's count.
SMOOTH = 1.0


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, bucket of each feature) for runs of texts."""
    for first, data, offsets in text_runs(column):
        low, start, end, before = spaced_words(data, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
        one = xxh64_slices(low, start, end) if len(start) else np.zeros(0, np.uint64)
        pair = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ one[1:]
        same = row[:-1] == row[1:]
        hashes = np.concatenate([one, pair[same]])
        yield first, len(offsets) - 1, np.concatenate([row, row[:-1][same]]), (hashes % np.uint64(BUCKETS)).astype(np.int64)


def log_ratio(docs: DataFrame, good: DataFrame | None) -> np.ndarray:
    """log(target / raw) of each bucket; good has the column doc_id, at most TARGETS rows."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if good is None:
        rows = rows.withColumn("_good", F.lit(True))
    else:
        # TARGETS bounds what is broadcast
        rows = rows.join(F.broadcast(good.select("doc_id", F.lit(True).alias("_good"))), "doc_id", "left")
    rows = rows.select("text", F.coalesce("_good", F.lit(False)).alias("_good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good_rows = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, row, bucket in features(batch.column(0)):
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good_rows[first + row]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    # BUCKETS rows come to the driver
    counted = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x in counted:
        raw[x["bucket"]], target[x["bucket"]] = x["raw"], x["target"]
    return np.log((target + SMOOTH) / (target + SMOOTH).sum()) - np.log((raw + SMOOTH) / (raw + SMOOTH).sum())


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, log_weight, gumbel): the draw is from the first 52 bits of the MD5 of doc_id, or of the text without one."""
    digest = F.md5(F.concat(F.lit("gumbel-1:"), F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit(""))))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.zeros(batch.num_rows)
            for first, rows, row, bucket in features(batch.column(2)):
                weight[first : first + rows] += np.bincount(row, ratio[bucket], minlength=rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), batch.column(1)], ["doc_id", "log_weight", "gumbel"])

    rows = docs.select("doc_id", (-F.ln(-F.ln(uniform))).alias("gumbel"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("log_weight", T.DoubleType()), T.StructField("gumbel", T.DoubleType())])
    return rows.mapInArrow(score, schema)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, targets: int = TARGETS) -> DataFrame:
    """One row a document: doc_id, log_weight, sample_key, sample_rank (from 0), selected.

    labels: (doc_id, quality, toxic); good is quality 1 and not toxic.
    """
    is_good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    labelled = labels.agg(F.avg(is_good.cast("double")).alias("share"), F.count_if(is_good).alias("good")).first()
    good = None
    if labelled["good"]:
        good = labels.where(is_good & F.col("doc_id").isNotNull()).select("doc_id").distinct()
        good = write_table(good.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(targets), "quality-targets")
    weights = weigh(docs, log_ratio(docs, good)).select("doc_id", "log_weight", (F.col("log_weight") + F.col("gumbel")).alias("sample_key"))
    ranked = with_position(weights, [F.col("sample_key").desc(), F.col("doc_id").asc_nulls_last()], "quality")
    share = share if share is not None else labelled["share"] if labelled["share"] is not None else 1.0
    k = F.floor(F.lit(share) * F.lit(docs.count()))
    return ranked.withColumnRenamed("position", "sample_rank").withColumn("selected", F.col("sample_rank") < k)
