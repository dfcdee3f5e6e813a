"""Ranked lexical search: dense blocked multiplication of item tiles with document impact tiles.

Every item (a query text) is ranked against every document by integer impacts.  A term is a run of
ASCII letters and digits and of all characters beyond ASCII, with only A-Z lower-cased.

1. Items are cut into blocks of at most BLOCK_BYTES of text, so what is held of them is bounded; a
   block's vocabulary goes out to the tasks.  One pass over the texts counts each document's terms
   and keeps the counts of those in the vocabulary, written as narrow rows.
2. Counts over all documents (documents with a term, all terms, document frequencies) are sums.
3. Tasks read the narrow rows in tiles of documents.  For each tile of items they fill a dense
   float64 tile of impacts, with the columns of the item tile's own compact vocabulary, and multiply
   it by the dense tile of weights.  Columns are cut so that no partial sum can reach 2^53: products
   and sums are exact integers, and the tiles' sums are added as 64-bit integers.
4. A task keeps the best k documents of each item, with ties at the k-th score settled by doc_id; what
   moves is k rows for each item and task, of which the last step keeps k.

Defined results: a null text has no term, nor has an empty one; documents without terms count
nowhere.  Rows that repeat are documents of their own, and so are rows that share a doc_id; each row
of the items is ranked by itself, so repeated items repeat their results.  A null doc_id comes after
all others at equal score.  doc_id must be an integer.  Extra columns are ignored.  A single item of
more than BLOCK_BYTES is a block of its own, and must fit into a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import write_table

TOP = 10
#: Bytes of item texts whose vocabulary and tiles are out at the tasks at a time.
BLOCK_BYTES = 8 << 20
ITEM_TILE, TERM_TILE, DOC_TILE = 256, 2048, 1024
#: Long texts are cut into words by pieces of about this many bytes.
PIECE = 1 << 20
#: Impacts are at most this, by their formula; a partial sum stays under 2^53.
UNIT = 1_000_000
EXACT = 1 << 53
NO_ID = np.iinfo(np.int64).max

#: One translation lower-cases A-Z and makes every byte that ends a term a blank.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, by pieces of bounded size."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERMS)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document that has a term; terms are those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, ends, terms, tfs = [], [], [0], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                n, found = 0, Counter()
                for piece in terms_of(text.as_py()):
                    n += len(piece)
                    found.update(map(vocabulary.get, piece))
                if n:
                    found.pop(None, None)
                    ids.append(doc_id.as_py())
                    sizes.append(n)
                    terms.extend(found.keys())
                    tfs.extend(found.values())
                    ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary stands; a row for each task and term is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], ["term", "df"])

    df = np.zeros(size, np.int64)
    for r in postings.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r["term"]] = r["df"]
    return df


def term_tiles(wanted: np.ndarray, width: int = TERM_TILE, most: int = EXACT - 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(columns, weights) that add up to wanted (terms x items): in each, no item's weights times UNIT pass ``most``.

    A weight that is too large alone is taken in several parts.
    """
    most //= UNIT
    left = wanted.copy()
    while len(open_terms := np.flatnonzero(left.any(axis=1))):
        room = np.full(left.shape[1], most, np.int64)
        columns, parts = [], []
        for t in open_terms[:width].tolist():
            part = np.minimum(left[t], room)
            if part.any():
                columns.append(t)
                parts.append(part)
                room -= part
        left[columns] -= np.stack(parts)
        yield np.array(columns), np.stack(parts)


def _item_tiles(block: list[tuple[object, Counter]], vocabulary: dict[bytes, int], weight: np.ndarray, most: int) -> list[tuple]:
    """(first item, items, term tiles); a term tile is (its terms, then the place, item and value of each weight)."""
    tiles = []
    for first in range(0, len(block), ITEM_TILE):
        part = [{vocabulary[w]: c for w, c in found.items()} for _, found in block[first : first + ITEM_TILE]]
        own = np.array(sorted(set().union(*part)), np.int64)
        place = {t: i for i, t in enumerate(own.tolist())}
        wanted = np.zeros((len(own), len(part)), np.int64)
        for j, found in enumerate(part):
            for t, c in found.items():
                wanted[place[t], j] = c * weight[t]
        tiles.append((first, len(part), [(own[columns], *np.nonzero(w), w[np.nonzero(w)]) for columns, w in term_tiles(wanted, most=most)]))
    return tiles


class _Best:
    """The k best (score, doc_id) of each item so far."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.floor = k, np.ones(items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: documents x items from the first on; what reaches an item's k-th score, ties too, is compared by doc_id."""
        doc, item = np.nonzero(scores >= self.floor[first : first + scores.shape[1]])
        if not len(doc):
            return
        item, score, doc = np.r_[self.item, item + first], np.r_[self.score, scores[doc, item]], np.r_[self.doc, ids[doc]]
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        place = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        full = place == self.k - 1
        self.floor[item[full]] = score[full]
        kept = place < self.k
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]


def _scores(tile: tuple, docs: int, row: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """Documents x items: for each term tile one multiplication of dense tiles, of the terms that the documents hold."""
    _, items, parts = tile
    total = np.zeros((docs, items), np.int64)
    for own, place, item, value in parts:
        column = np.minimum(np.searchsorted(own, terms), len(own) - 1)
        here = own[column] == terms
        used, column = np.unique(column[here], return_inverse=True)
        if not len(used):
            continue
        impacts = np.zeros((docs, len(used)))
        impacts[row[here], column] = impact[here]
        weights = np.zeros((len(own), items))
        weights[place, item] = value
        total += (impacts @ weights[used]).astype(np.int64)
    return total


def _tile_best(tiles: list[tuple], items: int, scale: tuple[int, int], k: int):
    """The best of the documents of a task; scale: (documents, all their terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(items, k)
        for batch in batches:
            for at in range(0, len(batch), DOC_TILE):
                part = batch.slice(at, DOC_TILE)
                ids, n = part.column(0).fill_null(NO_ID).to_numpy(), part.column(1).to_numpy()
                row = np.repeat(np.arange(len(part)), pc.list_value_length(part.column(2)).to_numpy())
                terms, tfs = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                m = 100 - 75 + (75 * n * scale[0]) // scale[1]
                impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[row])
                for tile in tiles:
                    best.offer(tile[0], _scores(tile, len(part), row, terms, impact), ids)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc), pa.array(best.score)], ["item", "doc_id", "score"])

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Item rows with their counted terms, in blocks of bounded bytes; rows stream to the driver, which holds one block."""
    block, held = [], 0
    for r in items.select("item_id", F.col("text").cast("string")).toLocalIterator():
        found = Counter()
        for piece in terms_of(r["text"]):
            found.update(piece)
        size = sum(map(len, found)) + 64
        if block and held + size > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((r["item_id"], found))
        held += size
    if block:
        yield block


def _ranked_block(docs: DataFrame, items: DataFrame, block: list[tuple[object, Counter]], k: int, most: int) -> DataFrame:
    spark = docs.sparkSession
    words = sorted(set().union(*(found for _, found in block)))
    vocabulary = {w: i for i, w in enumerate(words)}
    postings = write_table(_postings(docs, vocabulary), "postings")
    told = postings.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    count, total = told["docs"], told["terms"]
    df = _frequencies(postings, len(words))
    weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    tiles = _item_tiles(block, vocabulary, weight, most)
    best = postings.mapInArrow(_tile_best(tiles, len(block), (count, max(total, 1)), k), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
    # the block's ids are bounded by BLOCK_BYTES
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", doc_id.alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, most: int = EXACT - 1) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 for each row of items.

    most: the bound that no partial sum of a tile may pass.
    """
    found = [_ranked_block(docs, items, block, k, most) for block in _blocks(items)]
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
