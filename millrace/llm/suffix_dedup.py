"""Removal of repeated passages: suffix arrays built by blocks with a difference cover.

Every byte goes that is covered by a string of WIDTH bytes that also starts earlier, in a smaller
doc_id or before in the same document.  All matches are found on the input.

1. A pass over the texts gives each window of WIDTH bytes the least hash of its GRAM-byte pieces, so
   windows that are equal have the same.  Consecutive windows that have it from the same place are a
   run, one narrow row for some forty bytes of text: (least hash, hash of the run's bytes, document, start, windows).
2. A sum by least hash tells where one stands alone, or only in runs that are all equal: of these all
   but the first are repeats.  Where different runs share one, equal runs are reduced to their first.
3. What is left, about one run in twenty, differs in part.  These runs' bytes are dealt by least hash,
   and each task orders the suffixes of its blocks of text: ranks of a difference-cover sample first,
   then one bucket of suffixes at a time, with ties longer than the cover's period settled by the
   ranks (Kaerkkaeinen, 2007).  Neighbours in this order that share WIDTH bytes are compared as bytes.
   Least hashes with more than CROWD different runs go window by window instead, as a sum over all
   tasks, so that no frequent piece fills one of them.
4. The spans found are merged for each document and meet the texts.

Equal runs and crowded windows are compared by two 64-bit hashes, all others byte by byte.

Defined results: a null text is empty.  Rows without doc_id come after all others.  Rows that share a
doc_id and differ in text are ordered by the text's hash; rows alike in both are one document, and
get the same result.  Texts under WIDTH bytes stay whole.  Extra columns are ignored.  What is
gathered of a document (runs, spans) is smaller than its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import broadcast_if_small, write_table
from millrace.llm.textbytes import text_runs

WIDTH = 100
GRAM = 24
#: Texts are hashed by pieces of so many bytes, which stay in the processor's cache.
PIECE = 1 << 17
#: Bytes of text that one suffix array orders, and suffixes in one bucket of it.
BLOCK = 4 << 20
BUCKET = 1 << 18
#: Different runs of one least hash that a task takes; more are compared as single windows.
CROWD = 8192
#: A difference cover: all differences of the residues 0 to PERIOD - 1 occur between these.
PERIOD, COVER = 7, (0, 1, 3)
#: SHIFT[a, b]: the least shift that brings the residues a and b into the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])

_A, _B, _C = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x9FB21C651E98DF25))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x ^= b + _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def _words(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), order, padded, strides=(1,))[: len(data)]


def _least_ahead(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the next ``width`` values from each place on."""
    step = 1
    while 2 * step <= width:
        x, step = np.minimum(x[:-step], x[step:]), 2 * step
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def runs_of(data: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """(least hash, hash, first window, windows) of the runs of data; row: which document each byte is of."""
    n = len(data) - WIDTH + 1
    if n < 1:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64))
    words = _words(data)
    two = _mixed(words[:-8], words[8:])
    grams = _mixed(two[: len(data) - GRAM + 1], words[16 : 16 + len(data) - GRAM + 1])
    least = _least_ahead(grams, WIDTH - GRAM + 1)
    # a run ends behind the window that starts with the least piece, so no two windows of a run are equal
    ends = np.empty(n, bool)
    ends[0] = True
    np.not_equal(least[1:], least[:-1], out=ends[1:])
    ends[1:] |= grams[: n - 1] == least[:-1]
    within = row[:n] == row[WIDTH - 1 :]
    ends |= ~within
    ends[1:] |= ~within[:-1]
    cuts = np.flatnonzero(ends)
    size = np.diff(np.r_[cuts, n])[within[cuts]]
    first = cuts[within[cuts]]

    def whole(i: np.ndarray) -> np.ndarray:
        four = lambda j: _mixed(two[j], two[j + 16])
        eight = lambda j: _mixed(four(j), four(j + 32))
        return _mixed(eight(i), eight(i + WIDTH - 64))

    # the first and the last window cover the run
    hashes = _mixed(whole(first), whole(first + size - 1) + size.astype(np.uint64))
    return least[first], hashes, first, size


def _runs(docs: DataFrame) -> DataFrame:
    """(m, h, doc_id, twin, start, n) of all runs of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_runs(batch.column(2)):
                rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
                for at in range(0, max(len(data) - WIDTH + 1, 0), PIECE):
                    row = rows[at : at + PIECE + WIDTH - 1]
                    m, h, start, n = runs_of(data[at : at + PIECE + WIDTH - 1], row)
                    of = row[start]
                    ids = [batch.column(c).take(pa.array(of + first)) for c in (0, 1)]
                    columns = [pa.array(m.view(np.int64)), pa.array(h.view(np.int64)), *ids, pa.array(start + at - offsets[of]), pa.array(n.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    names = ["m", "h", "doc_id", "twin", "start", "n"]
    kinds = [T.LongType(), T.LongType(), docs.schema["doc_id"].dataType, T.LongType(), T.LongType(), T.IntegerType()]
    return docs.mapInArrow(run, T.StructType([T.StructField(c, k) for c, k in zip(names, kinds, strict=True)]))


def cover_ranks(text: np.ndarray) -> np.ndarray:
    """The rank of each suffix that starts in the cover among these; what lies elsewhere is 0."""
    at = np.flatnonzero(np.isin(np.arange(len(text)) % PERIOD, COVER))
    rank = np.zeros(len(text) + 2 * PERIOD, np.int64)
    # seven bytes of each eight, and doubled from there on: a place and that by whole periods on are both in the cover
    distinct, names = np.unique(_words(text, ">u8")[at] >> np.uint64(8), return_inverse=True)
    rank[at], reach = names + 1, PERIOD
    while len(distinct) < len(at) and reach < len(text):
        ahead = np.where(at + reach < len(text), rank[np.minimum(at + reach, len(text))], 0)
        distinct, names = np.unique(rank[at] * (len(at) + 2) + ahead, return_inverse=True)
        rank[at], reach = names + 1, 2 * reach
    return rank


def sorted_bucket(words: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places ``at`` in the order of their suffixes: by eight bytes, then by the cover's ranks.

    Suffixes that tie in eight bytes are ordered for each residue by a rank.  The place of one among
    those of another residue is found by the ranks at the shift that brings both into the cover, and
    its place among all is the sum over the residues.
    """
    at = at[np.argsort(words[at], kind="stable")]
    key = words[at]
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    size = np.bincount(group)
    tied = size[group] > 1
    if not tied.any():
        return at
    part, group_of = at[tied], group[tied]
    wide = np.int64(rank.max() + 1)
    residue = part % PERIOD
    classes = []
    for r in range(PERIOD):
        mine = np.flatnonzero(residue == r)
        classes.append(mine[np.argsort(group_of[mine] * wide + rank[part[mine] + SHIFT[r, r]], kind="stable")])
    place = np.zeros(len(part), np.int64)
    for b, mine in enumerate(classes):
        place[mine] += np.arange(len(mine))
        for a, others in enumerate(classes):
            if a != b and len(others) and len(mine):
                d = SHIFT[a, b]
                keys = [group_of[x] * wide + rank[part[x] + d] for x in (others, mine)]
                place[mine] += np.searchsorted(keys[0], keys[1], "right" if a < b else "left")
    # groups stand in order and ties take their places, so the sums are the places among all that tie
    out = at.copy()
    ordered = np.empty_like(part)
    ordered[place] = part
    out[tied] = ordered
    return out


def repeated_windows(text: np.ndarray, at: np.ndarray, bucket: int = BUCKET) -> np.ndarray:
    """Which of the windows at the places ``at`` (ascending) also starts at an earlier one of them."""
    words, rank = _words(text, ">u8"), cover_ranks(text)
    found = np.zeros(len(at), bool)
    bounds = np.unique(np.sort(words[at])[bucket::bucket]) if len(at) > bucket else np.zeros(0, np.uint64)
    bucket_of = np.searchsorted(bounds, words[at], "right")
    for b in range(len(bounds) + 1):
        order = sorted_bucket(words, rank, at[bucket_of == b])
        if len(order) < 2:
            continue
        alike = np.ones(len(order) - 1, bool)
        for d in (*range(0, WIDTH - 7, 8), WIDTH - 8):
            alike &= words[order[1:] + d] == words[order[:-1] + d]
        starts = np.flatnonzero(np.r_[True, ~alike])
        earliest = np.minimum.reduceat(order, starts)
        later = order != np.repeat(earliest, np.diff(np.r_[starts, len(order)]))
        found[np.searchsorted(at, order[later])] = True
    return found


def _spans(found: np.ndarray, row: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of stretches of found windows; offset: each window's place in its row."""
    hit = np.flatnonzero(found)
    new = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (np.diff(row[hit]) > 0)]) if len(hit) else hit
    last = np.r_[new[1:], len(hit)] - 1 if len(hit) else hit
    return row[hit[new]], offset[hit[new]], offset[hit[last]]


def _ordered_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (m, doc_id, twin, start, bytes) in the order of m, document and start: spans of their repeated windows."""

    def solved(held: pa.Table) -> pa.RecordBatch:
        # rows of documents that are alike stand side by side, and count once
        names = [held.column(c).to_numpy() for c in ("m", "twin", "start")] + [held.column("doc_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()]
        held = held.filter(pa.array(np.r_[True, np.any([x[1:] != x[:-1] for x in names], axis=0)]))
        pieces = [np.frombuffer(x, np.uint8) for x in held.column("bytes").to_pylist()]
        sizes = np.array([len(p) for p in pieces])
        windows = sizes - WIDTH + 1
        row = np.repeat(np.arange(len(pieces)), windows)
        offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        at = (np.cumsum(sizes) - sizes)[row] + offset
        of, first, last = _spans(repeated_windows(np.concatenate(pieces), at), row, offset)
        start = held.column("start").to_numpy()[of]
        ids = [held.column(c).take(pa.array(of)).combine_chunks() for c in ("doc_id", "twin")]
        return pa.RecordBatch.from_arrays([*ids, pa.array(start + first), pa.array(start + last + WIDTH)], ["doc_id", "twin", "start", "stop"])

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.column("bytes").nbytes > BLOCK:
            m = held.column("m").to_numpy()
            whole = int(np.searchsorted(m, m[-1], "left"))  # the last m may go on
            if whole:
                yield solved(held.slice(0, whole))
                held = held.slice(whole)
    if held is not None and len(held):
        yield solved(held)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, twin, text); twin is the hash of the text where a doc_id repeats, and 0 elsewhere."""
    rows = docs.select("doc_id", F.lit(0).cast("long").alias("twin"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    again = write_table(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again")), "repeated-ids")
    if not again.limit(1).count():
        return rows
    known = rows.join(broadcast_if_small(again, 64), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return known.select("doc_id", F.when(F.col("_again"), F.xxhash64("text")).otherwise(F.lit(0)).alias("twin"), "text")


def _at() -> Column:
    """Orders all places of the corpus."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "twin", "start")


def _with_lists(rows: DataFrame, lists: DataFrame, size: int, how: str) -> DataFrame:
    """rows with what ``lists`` has of their document; the lists go to the texts while they are small, and both move beyond."""
    named = lists.withColumnsRenamed({"doc_id": "_id", "twin": "_twin"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("twin") == F.col("_twin"))
    return rows.join(broadcast_if_small(named, F.size("items") * size + 64), same, how).drop("_id", "_twin")


def _run_bytes(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """runs (m, doc_id, twin, start, n) with their bytes, cut from the texts."""
    lists = write_table(runs.groupBy("doc_id", "twin").agg(F.collect_set(F.struct("m", "start", "n")).alias("items")), "run-lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                items = batch.column(3)[i].as_py()
                columns = [pa.array([x["m"] for x in items], pa.int64()), *(batch.column(c).take(pa.array([i] * len(items))) for c in (0, 1))]
                columns += [pa.array([x["start"] for x in items], pa.int64()), pa.array([data[x["start"] : x["start"] + x["n"] + WIDTH - 1] for x in items], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["m", "doc_id", "twin", "start", "bytes"])

    schema = T.StructType([T.StructField("m", T.LongType()), rows.schema["doc_id"], T.StructField("twin", T.LongType()), T.StructField("start", T.LongType()), T.StructField("bytes", T.BinaryType())])
    return _with_lists(rows, lists, 20, "inner").select("doc_id", "twin", "text", "items").mapInArrow(run, schema)


def repeated_spans(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, twin, start, stop): spans of repeated windows, not yet merged."""
    runs = _runs(rows)
    sums = runs.groupBy("m").agg(F.min(_at()).alias("first"), F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("all")).where(F.col("all") > 1)
    shared = write_table(sums.select("m", "first", (F.col("low") < F.col("high")).alias("mixed")), "shared-runs")
    # what is shared grows with the corpus, so no side is broadcast by hint
    met = runs.join(shared, "m").where(F.col("mixed") | (_at() != F.col("first")))
    met = write_table(met.drop("first"), "met-runs")
    mixed = met.where("mixed")
    # written, so that the join below has a plain shuffle on either side, whose hot part Spark can split
    firsts = write_table(mixed.groupBy("m", "h").agg(F.min(_at()).alias("first")), "first-runs")
    told = write_table(mixed.join(firsts, ["m", "h"]).withColumn("leads", _at() == F.col("first")).drop("first", "mixed"), "mixed-runs")
    whole = met.where("NOT mixed").select("doc_id", "twin", "start", "n").unionByName(told.where("NOT leads").select("doc_id", "twin", "start", "n"))
    whole = whole.select("doc_id", "twin", "start", (F.col("start") + F.col("n") + (WIDTH - 1)).alias("stop"))

    leads = told.where("leads").drop("leads", "h")
    crowds = write_table(leads.groupBy("m").agg(F.count("*").alias("all")).where(F.col("all") > crowd).select("m"), "crowds")
    pieces = write_table(_run_bytes(rows, leads), "run-bytes")
    few = pieces.join(broadcast_if_small(crowds, 16), "m", "left_anti").repartition("m").sortWithinPartitions("m", F.col("doc_id").isNull(), "doc_id", "twin", "start")
    span = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("twin", "start", "stop"))])
    ordered = few.mapInArrow(_ordered_blocks, span)

    windows = pieces.join(broadcast_if_small(crowds, 16), "m", "left_semi").select("m", "doc_id", "twin", "start", "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - WIDTH)).alias("i"))
    window = F.substring("bytes", F.col("i") + 1, F.lit(WIDTH))
    windows = windows.select("m", "doc_id", "twin", (F.col("start") + F.col("i")).alias("start"), F.xxhash64(window).alias("x"), F.xxhash64(F.lit("again"), window).alias("y"))
    earliest = windows.groupBy("m", "x", "y").agg(F.min(_at()).alias("first"), F.count("*").alias("all")).where(F.col("all") > 1).drop("all")
    earliest = write_table(earliest, "first-windows")
    crowded = windows.join(earliest, ["m", "x", "y"]).where(_at() != F.col("first")).select("doc_id", "twin", "start", (F.col("start") + WIDTH).alias("stop"))
    return whole.unionByName(ordered).unionByName(crowded)


def _merged(found: DataFrame) -> DataFrame:
    """(doc_id, twin, items): each document's spans, maximal and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for items in batch.column(2):
                x = np.array([(s["start"], s["stop"]) for s in items.as_py()], np.int64)
                x = x[np.argsort(x[:, 0], kind="stable")]
                reach = np.maximum.accumulate(x[:, 1])
                new = np.flatnonzero(np.r_[True, x[1:, 0] > reach[:-1]])
                out.append([{"start": a, "stop": b} for a, b in zip(x[new, 0].tolist(), reach[np.r_[new[1:], len(x)] - 1].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], ["doc_id", "twin", "items"])

    lists = found.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "stop")).alias("items"))
    return lists.mapInArrow(run, lists.schema)


def _kept(rows: DataFrame, spans: DataFrame, report: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, items in zip(batch.column(1), batch.column(2), strict=True):
                data, items, at, left = text.as_py().encode("utf-8", "surrogatepass"), items.as_py() or [], 0, []
                for x in items:
                    left.append(data[at : x["start"]])
                    at = x["stop"]
                kept = b"".join([*left, data[at:]]) if items else data
                out.append((len(data), len(data) - len(kept), len(items), hashlib.sha256(kept).hexdigest()) if report else (kept, items))
            columns = list(zip(*out, strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    if report:
        names, kinds, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 3 + [pa.string()], [T.LongType()] * 3 + [T.StringType()]
    else:
        span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
        names, kinds, types = ["doc_id", "kept", "spans"], [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))], [T.BinaryType(), span]
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, t) for n, t in zip(names[1:], types, strict=True))])
    return _with_lists(rows, spans, 16, "left").select("doc_id", "text", "items").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, crowd: int = CROWD, report: bool = False) -> DataFrame:
    """One row a document: doc_id, kept (what is left, as bytes) and spans (what went)."""
    rows = _keyed(docs)
    return _kept(rows, write_table(_merged(repeated_spans(rows, crowd)), "spans"), report)


def repeat_report(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs, crowd, True)
