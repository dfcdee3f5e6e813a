"""SimHash near-dedup with covering locality-sensitive hashing (Pagh, 2016).

A fingerprint is the bitwise majority of the hashes of a text's word shingles.  For radius r there
are 2^(r+1) - 1 tables.  Bit i of the fingerprint has the label i mod 2^(r+1), and the mask of
table v keeps the bits whose label has odd parity with v.  The labels of any r bits leave some v
with which all of them have even parity, so two fingerprints that differ in at most r bits agree
under that mask: every pair within the radius meets in some table.

Only distinct fingerprints are hashed into tables.  Within a bucket no pairs are listed: a search
from fingerprint to fingerprint gives a spanning forest of the exact links, at most one edge a
member.  Buckets over BUCKET members are cut into blocks, and each pair of blocks is a group of its
own, so no task holds more than two blocks.  Links are contracted to components by alternating
large-star and small-star steps.

Defined results: a null text or one without words has fingerprint zero and links like any other;
rows that repeat share fingerprint and component; component_id is the smallest non-null doc_id of
the component (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import broadcast_if_small, write_table
from millrace.llm.textbytes import spaced_words, text_runs
from millrace.llm.xxh import xxh64_slices

RADIUS = 4
SHINGLE = 4
#: Largest bucket that one task searches whole; larger ones go by pairs of blocks of about this size.
BUCKET = 4096
#: Shingles hashed at a time.
HASHED = 1 << 18


def fingerprint_run(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    low, start, end, before = spaced_words(data, offsets)
    words = np.diff(before)
    shingles = np.where(words == 0, 0, np.maximum(1, words - width + 1))
    rows = np.repeat(np.arange(len(words)), shingles)
    firsts = np.cumsum(shingles) - shingles
    left = np.arange(len(rows)) - firsts[rows] + before[:-1][rows]
    right = np.minimum(left + width, before[1:][rows]) - 1
    ones = np.zeros((len(words), 64), np.int64)
    for at in range(0, len(rows), HASHED):
        part = slice(at, at + HASHED)
        hashes = xxh64_slices(low, start[left[part]], end[right[part]])
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.r_[True, np.diff(rows[part]) > 0])
        ones[rows[part][cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp): the hash of the text and its fingerprint, as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint_run(data, offsets) for _, data, offsets in text_runs(batch.column(2))]
            fp = np.concatenate(made) if made else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["doc_id", "h", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("h", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("string")).mapInArrow(run, schema)


def covering_masks(radius: int = RADIUS) -> list[int]:
    labels = [i % (1 << (radius + 1)) for i in range(64)]
    return [sum(1 << i for i in range(64) if (labels[i] & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between distinct fingerprints within the radius."""
    near, left, right = [], [], fps
    while len(right):
        x, right = (near.pop(), right) if near else (right[0], right[1:])
        close = np.bitwise_count(right ^ x) <= radius
        if close.any():
            found = right[close]
            left.append((np.full(len(found), x), found))
            near.extend(found)
            right = right[~close]
    if not left:
        return fps[:0], fps[:0]
    return np.concatenate([a for a, _ in left]), np.concatenate([b for _, b in left])


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.zeros(0, np.uint64), *(p[i] for p in pairs)]).view(np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _search_buckets(radius: int):
    """For batches sorted by bucket, then fingerprint: the forest of each bucket; a bucket may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in _with_end(batches):
            if batch is not None:
                keys = np.concatenate([keys, batch.column(0).to_numpy()])
                fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
                ready = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            else:
                ready = len(keys)
            cuts = np.flatnonzero(np.r_[True, np.diff(keys[:ready]) != 0, True]) if ready else np.zeros(1, np.int64)
            sizes = np.diff(cuts)
            two = cuts[:-1][sizes == 2]
            close = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            pairs = [(fps[close], fps[close + 1])]
            pairs += [_forest(fps[i : i + n], radius) for i, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True)]
            keys, fps = keys[ready:], fps[ready:]
            yield _edges(pairs)

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all pairs within the radius."""
    tables = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("m")) for v, m in enumerate(covering_masks(radius))))
    # table and masked bits make one hash; a collision only makes a bucket larger
    keys = distinct.select("fp", F.explode(tables).alias("t")).select(
        F.xxhash64("t.v", F.col("fp").bitwiseAND(F.col("t.m"))).alias("key"), "fp"
    )
    large = write_table(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "simhash-large")
    small = keys.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key", "fp")
    found = small.mapInArrow(_search_buckets(radius), "a long, b long")

    blocks = F.ceil(F.col("n") / bucket).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        keys.join(large, "key")
        .withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _forest(pdf["fp"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return found.unionByName(dealt.groupBy("key", "i", "j").applyInPandas(search, "a long, b long"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Large-star hangs a node's larger neighbours on its least one, small-star the smaller ones; they
    alternate until the edges stay, in a number of rounds that grows with the logarithm of the
    largest component.  Each step is a sum-like aggregation and an equi-join, whose hot side Spark
    can split; the driver sees a count and a checksum.
    """
    tree = write_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    was, now = None, _state(tree)
    while was != now and now[0]:
        both = tree.union(tree.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        tree = write_table(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        least = tree.groupBy("a").agg(F.min("b").alias("m"))
        hung = tree.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least)
        tree = write_table(hung.distinct(), "small-star")
        was, now = now, _state(tree)
    return tree.toDF("node", "root").union(tree.select("b", "b").distinct())


def _grouped(docs: DataFrame, radius: int, bucket: int) -> DataFrame:
    """(doc_id, h, head): head is the row (doc_id, h) that stands for the component, its smallest id with the smallest hash; fp."""
    prints = write_table(fingerprints(docs), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("h"))
    firsts = write_table(prints.groupBy("fp").agg(F.min(row).alias("first")), "distinct")
    roots = components(links(firsts.select("fp"), radius, bucket))
    linked = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = write_table(linked, "roots")
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    named = write_table(linked.join(heads, "root").select(F.col("fp").alias("_fp"), "head"), "components")
    return prints.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id."""
    return _grouped(docs, radius, bucket).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("head.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id (rows without id come last, then by their text's hash).

    What goes is named by doc_id and hash of the text.  The texts stay where they are while these
    names are few enough to broadcast, and meet them by a shuffle beyond.  Rows that repeat both
    doc_id and text are reduced to one; only these rows are grouped.  A row travels as one struct,
    so its columns may have any names.
    """
    groups = write_table(_grouped(docs, radius, bucket), "near-groups")
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("h") == F.col("head.h"))
    names = groups.groupBy("doc_id", "h").agg(F.bool_or(is_head).alias("stays"), F.count("*").alias("n"))
    names = write_table(names.where("NOT stays OR n > 1"), "near-names")
    gone, twins = (broadcast_if_small(names.where(c).select("doc_id", F.col("h").alias("hash")), 64) for c in ("NOT stays", "stays"))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("h"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("hash"))
    kept = rows.join(gone, same, "left_anti")
    if not names.where("stays").limit(1).count():
        return kept.select("row.*")
    # only rows that repeat doc_id and text meet each other
    once = kept.join(twins, same, "left_semi").select("row", "h", F.col("row.doc_id").alias("id")).groupBy("id", "h").agg(F.first("row").alias("row"))
    return kept.join(twins, same, "left_anti").select("row").unionByName(once.select("row")).select("row.*")
