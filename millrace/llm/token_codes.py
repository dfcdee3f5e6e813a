"""Token ids in files of directly addressable codes (Brisaboa, Ladra and Navarro, 2013).

An id is split into chunks of 8 bits, lowest first, without leading zero chunks.  Level k holds the
k-th chunks of all ids that have one, a bitmap that tells which of them continue on level k + 1, and
a rank directory (ones before each BLOCK bits), so the place on the next level is one look-up and a
popcount in a block.  Any token is reached by as many steps as it has chunks; nothing else is decoded.

A file: MAGIC; header (7 longs: documents, tokens, levels, partition, number in it, 0, 0); the
doc_ids (longs; a byte each tells null), the ends of the documents in tokens (longs); per level its
length (long), chunks, bitmap bytes and directory (unsigned 32-bit), each padded to 8 bytes.

Executors write a file under a name of their own per attempt, and return a manifest row for it; only
files in the written manifest are read back, so lost or repeated tasks leave no trace.

Defined results: a null text is empty and encodes to the end id alone; null doc_ids come first;
documents that share a doc_id follow each other; an empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import new_path, write_table

MAGIC = b"DACTOK01"
END_ID = 2
BLOCK = 512
#: A file is closed once it has this many tokens (or with its last document).
FILE_TOKENS = 1 << 21
#: Pieces whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Characters of text encoded at a time.
ENCODED = 1 << 20

#: Characters on which the regular-expression engines of Python and of the tokenizers library surely agree.
_UNSURE = re.compile(r"[^\t\n\r\x20-\x7e\xa0-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-\xffĀ-ɏͰ-ͳΑ-ΡА-я]")
_AT_HOME: dict = {}


def plain_pattern(pattern: str) -> str:
    """The pieces' pattern for Python's re, which has no \\p; the same on all characters but _UNSURE's."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")


class Encoder:
    """The ids of texts by the tokenizers library, which sees each different piece once.

    Byte-level BPE merges within pieces only, so a text's ids are those of its pieces in turn.  Texts
    with a special token's string, or with characters outside the common alphabets, go to the
    library whole.
    """

    def __init__(self, path: str, pattern: str):
        # a task has one core; the library's own threads would wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = re.compile(plain_pattern(pattern)).findall
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [None if _UNSURE.search(t) or any(s in t for s in self.special) else self.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(chain.from_iterable(filter(None, cut))).difference(self.known))
        for piece, x in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[piece] = array("I", x.ids).tobytes()
        look = self.known.__getitem__
        return [self.whole(t) if c is None else b"".join(map(look, c)) for t, c in zip(texts, cut, strict=True)]


def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    if path not in _AT_HOME:
        _AT_HOME[path] = Encoder(path, pattern)
    return _AT_HOME[path]


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def pack(doc_ids: list[int | None], texts: list[np.ndarray], partition: int = 0, number: int = 0) -> bytes:
    """The file of some documents' ids."""
    ids = np.concatenate([np.zeros(0, np.uint32), *texts]).astype(np.uint32)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    levels, rest = [], ids
    while len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little").tobytes()
        ones = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), BLOCK))
        ranks = (np.cumsum(ones) - ones).astype("<u4")
        levels.append(struct.pack("<q", len(rest)) + _padded((rest & 0xFF).astype(np.uint8).tobytes()) + _padded(bits) + _padded(ranks.tobytes()))
        rest = rest[more] >> 8
    nulls = bytes(d is None for d in doc_ids)
    head = struct.pack("<7q", len(texts), len(ids), len(levels), partition, number, 0, 0)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    return b"".join([MAGIC, head, names, _padded(nulls), ends.astype("<i8").tobytes(), *levels])


class Codes:
    """A file's contents, without decoding them."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.documents, self.tokens, levels, self.partition, self.number, _, _ = struct.unpack_from("<7q", data, 8)
        at = 64
        names = np.frombuffer(data, "<i8", self.documents, at)
        at += 8 * self.documents
        nulls = data[at : at + self.documents]
        at += len(_padded(nulls))
        self.doc_ids = [None if n else int(d) for d, n in zip(names, nulls, strict=True)]
        self.ends = np.frombuffer(data, "<i8", self.documents, at)
        at += 8 * self.documents
        self.levels = []
        for _ in range(levels):
            (size,) = struct.unpack_from("<q", data, at)
            at += 8
            parts = []
            for kind, count in ((np.uint8, size), (np.uint8, -(-size // 8)), (np.dtype("<u4"), -(-size // BLOCK))):
                parts.append(np.frombuffer(data, kind, count, at))
                at += -(-count * np.dtype(kind).itemsize // 8) * 8
            self.levels.append(tuple(parts))

    def __getitem__(self, i: int) -> int:
        """Token i, from one chunk a level."""
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            start = i // BLOCK * BLOCK
            before = np.unpackbits(bits[start >> 3 : (i >> 3) + 1], bitorder="little")[: i - start]
            i, shift = int(ranks[i // BLOCK]) + int(before.sum()), shift + 8
        return value

    def all(self) -> np.ndarray:
        values = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            level = chunks.astype(np.uint32)
            level[more] |= values << 8
            values = level
        return values


def _encode_and_write(folder: str, path: str, pattern: str, end_id: int, file_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, tail = encoder(path, pattern), np.array([end_id], "<u4").tobytes()
        partition = TaskContext.get().partitionId()
        store, top = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        number, names, texts, tokens = 0, [], [], 0

        def close() -> pa.RecordBatch:
            name = f"{partition:08d}-{number:06d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{top}/{name}") as out:
                out.write(pack(names, texts, partition, number))
            values = ([name], [partition], [number], [len(names)], [tokens])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["name", "partition", "number", "documents", "tokens"])

        def encoded(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
            waiting, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                waiting.append((doc_id, text.as_py() or ""))
                size += len(waiting[-1][1])
                if size >= ENCODED:
                    yield from zip([d for d, _ in waiting], encode([t for _, t in waiting]), strict=True)
                    waiting, size = [], 0
            yield from zip([d for d, _ in waiting], encode([t for _, t in waiting]), strict=True)

        for batch in batches:
            for doc_id, raw in encoded(batch):
                ids = np.frombuffer(raw + tail, "<u4")
                names.append(doc_id)
                texts.append(ids)
                tokens += len(ids)
                if tokens >= file_tokens:
                    yield close()
                    number, names, texts, tokens = number + 1, [], [], 0
        if names:
            yield close()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, pattern: str, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode docs (doc_id, text), write the files in ascending doc_id order, and return the written manifest.

    tokenizer: a file of the tokenizers library, present on every worker; pattern: how it cuts
    pieces.  The texts are dealt by ranges of doc_id; rows with one doc_id are told apart by their
    place, so they don't have to share a task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_row"))
    dealt = rows.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text")
    schema = "name string, partition int, number long, documents long, tokens long"
    return write_table(dealt.mapInArrow(_encode_and_write(folder, tokenizer, pattern, end_id, file_tokens), schema), "token-manifest")


def file_starts(manifest: DataFrame) -> DataFrame:
    """manifest with ``start``: the ids of all files before.  What is summed in one task is a row a partition."""
    counts = manifest.groupBy("partition").agg(F.sum("tokens").alias("_n"))
    ahead = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select("partition", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_part"))
    inside = Window.partitionBy("partition").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "partition").withColumn("start", F.col("_part") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).drop("_part")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of the manifest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                codes = Codes(content)
                ids = codes.all().astype("<u4")
                begins = np.concatenate([[0], codes.ends[:-1]]).astype(np.int64)
                yield pd.DataFrame({
                    "name": name,
                    "doc_id": pd.array(codes.doc_ids, "Int64"),
                    "_at": begins,
                    "n_tokens": codes.ends - begins,
                    "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), codes.ends.tolist(), strict=True)],
                })

    if not manifest.limit(1).count():
        schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
        return manifest.sparkSession.createDataFrame([], schema)
    files = manifest.sparkSession.read.format("binaryFile").load(f"{folder}/*.dac")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    decoded = named.mapInPandas(run, "name string, doc_id long, _at long, n_tokens long, ids_crc32 long")
    starts = write_table(file_starts(manifest).select("name", "start"), "token-starts")
    return decoded.join(starts, "name").select("doc_id", (F.col("start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def token_report(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    folder = new_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, pattern), folder)
