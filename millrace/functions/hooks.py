"""Extension points: embedding, decoding and judging functions, and chunks as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.chunks import OVERLAP, SIZE, cut_points
from millrace.operators.ranking import blend


def embed(text: Column, fn: Callable[[list[str]], list[list[float]]]) -> Column:
    """Vectors of texts by fn, which gets a batch; a null text has a null vector."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        made = iter(fn(texts.dropna().tolist()))
        return pd.Series([None if pd.isna(t) else next(made) for t in texts], dtype=object)

    return run(text)


def decode(body: Column, fn: Callable[[bytes], str]) -> Column:
    """Texts of bytes by fn; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(fn, na_action="ignore")

    return run(body)


def rerank(ranked: DataFrame, query: str, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ranked (query, score, ...) with the judge's relevance and rejected blended in."""
    return blend(judge(ranked), query)


class Chunks:
    """SELECT * FROM docs, LATERAL chunks(text, size, overlap): the cuts of sentence_chunks."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        for i, (a, b) in enumerate(cut_points(text or "", size, overlap)):
            yield i, a, b, text[a:b]


def register(spark: SparkSession) -> None:
    """Make ``chunks`` known to SQL."""
    spark.udtf.register("chunks", F.udtf(Chunks, returnType="chunk_index int, start int, `end` int, chunk string"))


def lateral_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    register(docs.sparkSession)
    return docs.sparkSession.sql("SELECT d.doc_id, c.chunk_index, c.start, c.end FROM {docs} d, LATERAL chunks(d.text, {size}, {overlap}) c", docs=docs.select("doc_id", "text"), size=size, overlap=overlap)
