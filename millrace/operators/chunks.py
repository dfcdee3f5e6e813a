"""Chunks of texts: fixed strides, cuts at blanks, sections."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, OVERLAP, MOST = 1400, 180, 80


def fixed_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """docs' doc_id, chunk_index, chunk: windows of size characters every size - overlap; a short text is one chunk."""
    stride = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - overlap) / F.lit(stride)) - 1).cast("int")
    cuts = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return cuts.select("doc_id", "chunk_index", F.substr("text", F.col("chunk_index") * stride + 1, F.lit(size)).alias("chunk"))


def cut_points(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most size characters; all but the last end after the last blank of their second half, if it has one.

    The blanks are found once; a chunk's end is a search among their places.
    """
    blanks = [m.start() for m in re.finditer(" ", text)]

    def reach(start: int) -> int:
        last = bisect_left(blanks, start + size) - 1
        broken = last >= 0 and blanks[last] >= start + size // 2
        return len(text) if start + size >= len(text) else blanks[last] + 1 if broken else start + size

    spans = [(0, reach(0))] if text else []
    while spans and spans[-1][1] < len(text):
        begin = spans[-1][1] - min(overlap, spans[-1][1] - spans[-1][0] - 1)
        spans.append((begin, reach(begin)))
    return spans


def sentence_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, start, end, chunk): where a chunk starts depends on where the last one ended, so this runs in Python, per text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, a, b, x[a:b]) for d, x in zip(pdf["doc_id"], pdf["text"], strict=True) if x is not None for i, (a, b) in enumerate(cut_points(x, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start", "end", "chunk"])

    kinds = [docs.schema["doc_id"].dataType, T.IntegerType(), T.IntegerType(), T.IntegerType(), T.StringType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(("doc_id", "chunk_index", "start", "end", "chunk"), kinds, strict=True)])
    return docs.select("doc_id", "text").mapInPandas(cut, schema)


def section_chunks(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, chunk_index, title, n): lines are sections; each is cut every size characters, later parts named `` (k)``.

    Indexes run through the whole document.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("line <> ''")
    parts = lines.select("doc_id", "line_no", "line", F.explode(F.sequence(F.lit(0), F.floor((F.length("line") - 1) / F.lit(size)).cast("int"))).alias("part"))


    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "part")) - 1
    title = F.concat(F.substring("line", 1, 30), F.when(F.col("part") > 0, F.concat(F.lit(" ("), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise(""))
    return parts.select("doc_id", index.alias("chunk_index"), title.alias("title"), F.length(F.substr("line", F.col("part") * size + 1, F.lit(size))).alias("n"))
