"""Language identification by nearest centroid.

A text's vector has the log-scaled counts of its hashed letter trigrams (bytes of the lower-cased
text, anything but letters one blank), times their inverse document frequency, at unit length.
Each language has several centroids, found by spherical k-means on a bounded sample of its labelled
documents; a text gets the language of the centroid with the largest cosine.  A text is rejected if
that cosine is under the bound for its number of different trigrams, learned from documents that the
centroids have not seen.

The document frequencies cover all labelled documents; the sample (SAMPLE documents a language for
the centroids and BOUNDING more for the bounds, by the hash of their doc_id) has no other use.  Where
a language has fewer, every fourth one goes to the bounds; under eight, all serve for both.

Defined results: a text that is null or has no letter is ``und`` with score 0, and rejected; if no
language could be learned, every text is ``und``.  Ties go to the language first by code point.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.textbytes import text_runs

DIMS = 8192
#: Texts whose vectors a task holds at a time.
ROWS = 128
SAMPLE = 400
BOUNDING = 100
CENTROIDS = 4
ROUNDS = 8
#: A text is rejected under this share of the lowest cosine that the bounding texts of its size class have.
SLACK = 0.25
UNKNOWN = "und"

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed trigrams, one row a text; texts are padded by blanks."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    padded = np.full(len(data) + 2 * rows, 0x20, np.uint8)
    inside = np.ones(len(padded), bool)
    inside[offsets[:-1] + 2 * np.arange(rows)] = False
    inside[offsets[1:] + 2 * np.arange(rows) + 1] = False
    padded[inside] = _LETTER[data]
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0x20) | (padded[:-1] != 0x20) | (row[1:] != row[:-1])
    b, row = padded[keep].astype(np.uint32), row[keep]
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
    whole = row[:-2] == row[2:]
    return np.bincount(row[:-2][whole] * DIMS + code[whole], minlength=rows * DIMS).reshape(rows, DIMS)


def batch_counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts) for so many rows at a time; only these are copied, lower-cased and counted."""
    for at in range(0, len(column), ROWS):
        part = pc.utf8_lower(column.slice(at, ROWS).cast(pa.large_string()))
        for first, data, offsets in text_runs(part):
            yield at + first, trigram_counts(data, offsets)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def size_class(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(1, (counts > 0).sum(axis=1))).astype(int)


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    bounds: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine, and whether it is rejected."""
        cosine = unit_vectors(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
        return best, score, score < self.bounds[np.minimum(size_class(counts), len(self.bounds) - 1)]


def spherical_means(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """k-means by cosine; starts from the row nearest to the mean, then the rows farthest from what is chosen."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    means = x[chosen]
    for _ in range(rounds):
        at = (x @ means.T).argmax(axis=1)
        means = np.stack([x[at == i].sum(axis=0) if (at == i).any() else means[i] for i in range(len(means))])
        means = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    return means


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from labelled (doc_id, text, lang); rows without lang or letters are left out."""
    rows = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & has_letter(F.col("text")))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(DIMS, np.int64), Counter()
        for batch in batches:
            texts.update(batch.column(1).to_pylist())
            for _, counts in batch_counts(batch.column(0)):
                total += (counts > 0).sum(axis=0)
        dims, names = [*range(DIMS), *[-1] * len(texts)], [*[None] * DIMS, *texts]
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(names, pa.string()), pa.array([*total.tolist(), *texts.values()], pa.int64())], ["dim", "lang", "n"])

    # one row a dimension and one a language come to the driver
    counted = rows.select("text", "lang").mapInArrow(frequencies, "dim int, lang string, n long").groupBy("dim", "lang").agg(F.sum("n").alias("n")).collect()
    frequency, sizes = np.zeros(DIMS), [(r["lang"], r["n"]) for r in counted if r["dim"] < 0]
    for r in counted:
        if r["dim"] >= 0:
            frequency[r["dim"]] = r["n"]
    idf = (np.log((1 + sum(n for _, n in sizes)) / (1 + frequency)) + 1).astype(np.float32)

    # a hash lets through about twice the sample of each language, so only these few texts move
    most = sample + BOUNDING
    sizes = F.broadcast(labelled.sparkSession.createDataFrame(sizes, "_lang string, _n long"))
    drawn = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = rows.join(sizes, F.col("lang") == F.col("_lang")).withColumn("_drawn", drawn).where(F.col("_drawn") * F.col("_n") < 2 * most + 20)
    turn = Window.partitionBy("lang").orderBy("_drawn", "doc_id", "text")
    sampled = few.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= most).select("lang", "turn", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts in batch_counts(batch.column(2)):
                held = [np.flatnonzero(c) for c in counts]
                columns = [pa.array(held, pa.list_(pa.int32())), pa.array([c[h] for c, h in zip(counts, held, strict=True)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([c.slice(first, len(counts)) for c in batch.columns[:2]] + columns, ["lang", "turn", "dims", "counts"])

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((len(pdf), DIMS), np.int64)
        for i, (dims, n) in enumerate(zip(pdf["dims"], pdf["counts"], strict=True)):
            counts[i, dims] = n
        x, turns = unit_vectors(counts, idf), pdf["turn"].to_numpy()
        bounding = turns > sample if len(pdf) > sample + BOUNDING // 2 else turns % 4 == 0
        fitting = ~bounding
        if len(pdf) < 8:
            bounding = fitting = np.ones(len(pdf), bool)
        means = spherical_means(x[fitting], centroids)
        return pd.DataFrame({
            "lang": pdf["lang"].iloc[0],
            "centroids": [means.astype(np.float32).tobytes()],
            "classes": [size_class(counts[bounding]).tolist()],
            "cosines": [(x[bounding] @ means.T).max(axis=1).astype(float).tolist()],
        })

    # what one task clusters is at most `most` vectors of DIMS places, however long the texts
    vectors = sampled.mapInArrow(count, "lang string, turn int, dims array<int>, counts array<long>")
    learned = vectors.groupBy("lang").applyInPandas(cluster, "lang string, centroids binary, classes array<int>, cosines array<double>").collect()
    learned.sort(key=lambda r: r["lang"])
    means = [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMS) for r in learned]
    names = [r["lang"] for r, m in zip(learned, means, strict=True) for _ in range(len(m))]
    bounds = np.zeros(14)
    for r in learned:
        for c, cosine in zip(r["classes"], r["cosines"], strict=True):
            bounds[c] = cosine if not bounds[c] else min(bounds[c], cosine)
    # a class has the lowest bound of itself and all larger ones; one without samples has the next smaller one's
    seen = np.flatnonzero(bounds)
    for c in range(len(bounds)):
        above = seen[seen >= c]
        bounds[c] = bounds[above].min() if len(above) and (c in seen) else (bounds[c - 1] if c else 0.0)
    return Model(names, np.concatenate(means) if means else np.zeros((0, DIMS), np.float32), idf, SLACK * bounds)


def predict(docs: DataFrame, model: Model, carried: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score, rejected): row is a struct of docs' carried columns (None: of all), whatever their names."""
    text, carried = F.col("text").cast("string"), docs.columns if carried is None else carried
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.when(has_letter(text), text).alias("text"))
    known = pa.array([*model.languages, UNKNOWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            empty = texts.is_null().to_numpy(zero_copy_only=False)
            best, score, out = np.full(len(empty), len(model.languages)), np.zeros(len(empty)), np.ones(len(empty), bool)
            for first, counts in batch_counts(texts) if model.languages else ():
                part = slice(first, first + len(counts))
                best[part], score[part], out[part] = model.predict(counts)
            best[empty], score[empty], out[empty] = len(model.languages), 0.0, True
            yield pa.RecordBatch.from_arrays([batch.column(0), known.take(pa.array(best)), pa.array(score), pa.array(out)], ["row", "lang_pred", "score", "rejected"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in carried])), *added]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def language_report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    # the text is read beside the row, which needs its doc_id only
    named = docs.select("doc_id", "text")
    return predict(named, model, ["doc_id"]).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """docs without what is rejected, columns unchanged; learns from the rows that have a lang."""
    return predict(docs, fit(docs)).where(~F.col("rejected")).select("row.*")
