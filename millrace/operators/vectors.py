"""Vectors: hashed lexical features, fitting, cosine, top-k per query."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import chain, islice

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.batches import pieces
from millrace.functions.text import TOKEN, tokens
from millrace.storage import new_path

DIM = 1536
#: Query vectors that are sent to the executors at a time.
BLOCK = 4096
#: Cosines that a task of top_k holds at a time.
CELLS = 1 << 19
#: Vectors of a block of links(): at most MOST_ROWS, and fewer where that leaves under BLOCKS blocks.
MOST_ROWS, BLOCKS = 16384, 12


def features(text: Column) -> Column:
    """Tokens, and the character trigrams of each token between ^ and $."""
    words = tokens(text)
    marked = F.transform(words, lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    grams = F.flatten(F.transform(marked, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substr(w, i, F.lit(3)))))
    return F.concat(words, grams)


def lexical_vectors(rows: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """(key, idx, weight): sparse unit vectors; a feature's place is the first 4 bytes of its SHA-256 modulo dim.

    Equal features of a text are counted in the task that reads it, before they are hashed; then its
    cells, dim at most, meet in one row for the norm, and stay partitioned by key.
    """
    place = (F.conv(F.substring(F.sha2("f", 256), 1, 8), 16, 10).cast("long") % dim).cast("int")
    counted = rows.select(key, F.explode(features(F.col(text))).alias("f")).groupBy(key, "f").agg(F.count("*").alias("n"))
    cells = counted.groupBy(key, place.alias("idx")).agg(F.sum("n").alias("n"))
    vectors = cells.groupBy(key).agg(F.collect_list(F.struct("idx", "n")).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + x["n"] * x["n"]))
    unit = vectors.select(key, "c", norm.alias("norm"))
    return unit.select(key, "norm", F.inline("c")).select(key, "idx", (F.col("n") / F.col("norm")).alias("weight"))


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is empty or zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once; within a lambda an expression is otherwise worked out again for each element."""
    return F.transform(F.array(value), use)[0]


def fit(v: Column, dim: int) -> Column:
    """Cut or padded to dim, at unit length; zero stays zero."""
    sized = F.slice(F.concat(as_double(v), F.array_repeat(F.lit(0.0), dim)), 1, dim)
    norm = lambda s: F.sqrt(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x * x))
    unit = lambda s, n: F.transform(s, lambda x: F.when(n > 0, x / n).otherwise(0.0))
    return _named(sized, lambda s: _named(norm(s), lambda n: unit(s, n)))


def _in_blocks(queries: DataFrame, key: str) -> Iterator[pd.DataFrame]:
    """queries in blocks of about BLOCK rows, dealt by a hash of the key; one block at a time comes to the driver."""
    parts = max(1, -(-queries.count() // BLOCK))
    mine = F.pmod(F.xxhash64(key), F.lit(parts))
    yield from (block for block in (queries.where(mine == i).toPandas() for i in range(parts)) if len(block))


def _best(said: np.ndarray, k: int | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of the k largest of each query, of those that are at least the bound.

    Rows that tie with the k-th stay, so that a final rank may decide by id.
    """
    keep = min(k or said.shape[1], said.shape[1])
    bound = np.partition(said, -keep, axis=1)[:, -keep][:, None]
    return np.nonzero((said >= bound) & (said >= least))


def _nearest(pdf: pd.DataFrame, names: np.ndarray, matrix: np.ndarray, k: int | None, least: float, same: tuple[str | None, np.ndarray | None]) -> Iterator[pd.DataFrame]:
    """What a batch of vectors adds to the neighbours of queries, CELLS of their product at a time."""
    x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    own, step, (column, kinds) = pdf["vec_id"].to_numpy(), max(1, CELLS // len(pdf)), same
    for at in range(0, len(names), step):
        mine = names[at : at + step]
        said = np.round(matrix[at : at + step] @ x.T, 6)
        said[mine[:, None] == own[None, :]] = -2
        if kinds is not None:
            said[kinds[at : at + step, None] != pdf[column].to_numpy()[None, :]] = -2
        q, v = _best(said, k, max(least, -1))
        yield pd.DataFrame({"query_id": mine[q], "vec_id": own[v], "cosine": said[q, v]})


def top_k(vectors: DataFrame, queries: DataFrame, k: int | None, least: float = -1.0, same: str | None = None) -> DataFrame:
    """(query_id, vec_id, cosine) of the k nearest vectors of each query, itself left out (k None: all over least).

    same names a column that a query and its neighbours must agree in (nulls agree with nothing); it
    is tested before the k best are taken.  Queries go out in blocks of BLOCK vectors; each task
    multiplies matrices, CELLS of the product at a time, and keeps k rows a query and batch; only
    these are shuffled for the final rank.
    """
    parts, columns = [], ["vec_id", "embedding", *([same] if same else [])]
    for block in _in_blocks(queries.select(*columns), "vec_id"):
        names, matrix = block["vec_id"].to_numpy(), np.stack(block["embedding"].to_numpy()).astype(np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        kinds = block[same].to_numpy() if same else None

        def nearest(batches: Iterator[pd.DataFrame], names=names, matrix=matrix, kinds=kinds) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                yield from _nearest(pdf, names, matrix, k, least, (same, kinds))

        parts.append(vectors.select(*columns).mapInPandas(nearest, "query_id long, vec_id long, cosine double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, cosine double, place int")
    found = reduce(DataFrame.unionByName, parts)
    if k is None:
        return found
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def spread(row: np.ndarray, group: np.ndarray, size: np.ndarray, flat: np.ndarray, rows: int, columns: int, times: np.ndarray | None = None) -> np.ndarray:
    """A matrix of counts: each (row, group) adds 1, or its ``times``, at every column of the group, size[g] numbers in flat, group after group."""
    n = size[group]
    start = np.cumsum(size) - size
    at = np.repeat(start[group] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.bincount(np.repeat(row * columns, n) + flat[at], None if times is None else np.repeat(times, n), minlength=rows * columns).reshape(rows, columns)


#: Different words that a worker remembers before it begins anew.
KNOWN = 100_000


class Numbered(dict):
    """Words and their numbers, in order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Words:
    """What each of ``tell`` says of a word, worked out once for each word that a worker meets.

    Each takes a list of new words and gives how many numbers each has, and the numbers of all, one after the other.
    """

    def __init__(self, *tell: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = KNOWN):
        self.tell, self.most = tell, most
        self._forget()

    def _forget(self) -> None:
        self.index = Numbered()
        self.told = [(np.zeros(0, np.int32), np.zeros(0, np.int32)) for _ in self.tell]

    def read(self, texts: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, times): the different words of each of the texts, lists of words; ``told`` has them until the next call."""
        if len(self.index) > self.most:
            self._forget()
        before, coded = len(self.index), texts.flatten().dictionary_encode()
        number = np.fromiter(map(self.index.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        new = list(islice(self.index, before, None))
        for told, tell in zip(self.told, self.tell if new else ()):
            for all_, more in zip(told, tell(new)):
                all_.resize(len(all_) + len(more), refcheck=False)
                all_[len(all_) - len(more) :] = more
        word = number[coded.indices.to_numpy()]
        both = (np.repeat(np.arange(len(texts)), texts.value_lengths().to_numpy()) * len(self.index) + word)[word != self.index.get("", -1)]
        both, times = np.unique(both, return_counts=True)
        row, word = np.divmod(both, max(len(self.index), 1))
        return row, word, times


class Places:
    """The places of words' features in lexical vectors."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        # words share their trigrams
        self._gram = lru_cache(1 << 16)(lambda key: self._place("".join(chr(key >> by & 0x1FFFFF) for by in (42, 21, 0))))
        self.words = Words(self.of)

    def _place(self, feature: str) -> int:
        return int.from_bytes(hashlib.sha256(feature.encode()).digest()[:4], "big") % self.dim

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its own place, then those of its trigrams between ^ and $."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends, begins = np.cumsum(n + 2), np.ones(len(points), bool)
        begins[ends - 1] = begins[ends - 2] = False
        at = np.flatnonzero(begins)
        keys, which = np.unique(points[at] << 42 | points[at + 1] << 21 | points[at + 2], return_inverse=True)
        grams = np.fromiter(map(self._gram, keys.tolist()), np.int64, len(keys))[which]
        out, own = np.empty(len(words) + len(grams), np.int64), np.zeros(len(words) + len(grams), bool)
        own[np.cumsum(n + 1) - (n + 1)] = True
        out[own], out[~own] = np.fromiter(map(self._place, words), np.int64, len(words)), grams
        return n + 1, out

    def vectors(self, texts: list | pa.ListArray) -> np.ndarray:
        """Unit vectors (zero without words) of lists of words, one row each, made HELD at a time."""
        out = np.empty((len(texts), self.dim))
        for at in range(0, len(texts), HELD):
            held = texts[at : at + HELD]
            read = self.words.read(held if isinstance(held, pa.ListArray) else pa.array(held, pa.list_(pa.string())))
            out[at : at + HELD] = self.unit(read, self.words.told[0], len(held))
        return out

    def unit(self, read: tuple[np.ndarray, np.ndarray, np.ndarray], told: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
        """Unit vectors of texts whose different words were read, told the places of their features."""
        row, word, times = read
        out = spread(row, word, *told, rows, self.dim, times)
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


#: Rows whose lexical vectors a task holds at a time, and the bytes of their texts, unless one text alone has more.
HELD, HELD_BYTES = 128, 1 << 19


#: What stands between words.
GAP = f"[^{TOKEN.removeprefix('[')}"


def _words(texts: pa.Array) -> pa.ListArray:
    """The words of each text, and empty strings, which Words leaves out."""
    return pc.split_pattern_regex(texts, GAP)


def _held(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most HELD rows and HELD_BYTES of text, a row at least."""
    yield from (batch.slice(at, n) for at, n in pieces(batch.column("text"), HELD, HELD_BYTES))


def _by_blocks(docs: DataFrame, questions: DataFrame, columns: list[str], work: Callable, schema: T.StructType, vectors: bool = True) -> DataFrame:
    """work(questions, their vectors, Places), called in a task, gives what is made of held rows of docs, a record batch.

    The questions' words go out a block at a time, and each task makes their vectors; without
    ``vectors`` none are made.
    """
    parts = []
    for block in _in_blocks(questions, "item_id"):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            places = Places()
            apply = work(block, places.vectors(_words(pa.array(block["text"], pa.string()))) if vectors else None, places)
            for batch in batches:
                yield from map(apply, _held(batch))

        parts.append(docs.select(*columns).mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def lexical_top(docs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, cosine) of the k documents nearest to each question by lexical vectors.

    docs: (doc_id, text), questions: (item_id, text), texts lower-cased and not null.  A task reads its documents once, multiplies
    their vectors by those of the questions, and passes on k rows a question at most (and ties).
    Documents that share no place with a question are not near it.
    """

    def work(block: pd.DataFrame, matrix: np.ndarray, places: Places) -> Callable:
        def apply(held: pa.RecordBatch) -> pa.RecordBatch:
            vectors = places.vectors(_words(held.column("text")))
            said = np.round(matrix @ vectors.T, 6)
            said[(matrix > 0).astype(np.float32) @ (vectors > 0).astype(np.float32).T == 0] = -1
            q, d = _best(said, k, 0.0)
            columns = [pa.array(block["item_id"].to_numpy()[q]), held.column("doc_id").take(pa.array(d)), pa.array(said[q, d])]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        return apply

    schema = T.StructType([T.StructField("item_id", T.LongType()), docs.schema["doc_id"], T.StructField("cosine", T.DoubleType())])
    near = _by_blocks(docs, questions, ["doc_id", "text"], work, schema)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("cosine"), "doc_id"))
    return near.withColumn("place", place).where(F.col("place") <= k).drop("place")


class Terms:
    """Which of some terms stand within words."""

    def __init__(self, terms: list[str]):
        self.size, self.automaton = np.fromiter(map(len, terms), np.int64, len(terms)), ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.automaton.add_word(term, i)
        self.automaton.make_automaton()

    def within(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many of the terms stand within each word, and their numbers."""
        if not len(self.size):
            return np.zeros(len(words), np.int64), self.size
        n = np.fromiter(map(len, words), np.int64, len(words))
        # the words are read as one text; what ends at the line feed behind a word, or begins before the word, is not within it
        start = np.cumsum(n + 1) - (n + 1)
        end, term = np.fromiter(chain.from_iterable(self.automaton.iter("\n".join(words))), np.int64).reshape(-1, 2).T
        word = np.searchsorted(start, end, "right") - 1
        whole = (end < start[word] + n[word]) & (end - self.size[term] + 1 >= start[word])
        word, term = np.divmod(np.unique(word[whole] * len(self.size) + term[whole]), len(self.size))
        return np.bincount(word, minlength=len(words)), term


def keyword_matches(docs: DataFrame, questions: DataFrame, carry: list[str], vectors: bool = True) -> DataFrame:
    """(item_id, n, hits, title_hits, vector, and the columns carry of docs) of rows and questions that share a keyword.

    docs: (text, title, ...), questions: (item_id, text, keywords), lower-cased and not null.  n is the number of
    keywords, hits and title_hits those that text and title hold, within longer words too; vector is the cosine of the
    lexical vectors, rounded to 6 digits (only with ``vectors``).  One pass over docs, no shuffle: what is to be known of a
    row later is carried along, so that the pairs need not join it.
    """

    def work(block: pd.DataFrame, matrix: np.ndarray | None, places: Places) -> Callable:
        asked: dict[str, list[int]] = {}
        for i, words in enumerate(block["keywords"]):
            for w in words:
                asked.setdefault(w, []).append(i)
        # a keyword is made of the characters of words, so it stands within one word if anywhere
        terms, items, n = Terms(list(asked)), block["item_id"].to_numpy(), block["keywords"].map(len).to_numpy()
        size = np.fromiter(map(len, asked.values()), np.int64, len(asked))
        flat = np.fromiter(chain.from_iterable(asked.values()), np.int64)
        known = Words(terms.within, *([] if matrix is None else [places.of]))

        def counted(read: tuple, rows: int) -> np.ndarray:
            """How many keywords of each question (columns) the texts (rows) hold."""
            row, word, _ = read
            row, term = np.nonzero(spread(row, word, *known.told[0], rows, len(size)))
            return spread(row, term, size, flat, rows, len(items))

        def apply(held: pa.RecordBatch) -> pa.RecordBatch:
            read = known.read(_words(held.column("text")))
            hits = counted(read, len(held))
            x = None if matrix is None else places.unit(read, known.told[1], len(held))
            titled = counted(known.read(_words(held.column("title"))), len(held))
            d, q = np.nonzero(hits)
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(d, minlength=len(held)))].astype(np.int32))
            made = [items[q], n[q], hits[d, q], titled[d, q]] + ([] if x is None else [np.round(x @ matrix.T, 6)[d, q]])
            lists = [pa.ListArray.from_arrays(ends, pa.array(m)) for m in made]
            return pa.RecordBatch.from_arrays([*(held.column(c) for c in carry), *lists], [*carry, *names])

        return apply

    names = ["item_id", "n", "hits", "title_hits", *(["vector"] if vectors else [])]
    lists = [T.StructField(c, T.ArrayType(T.DoubleType() if c == "vector" else T.LongType())) for c in names]
    schema = T.StructType([*(docs.schema[c] for c in carry), *lists])
    found = _by_blocks(docs, questions, list(dict.fromkeys(["text", "title", *carry])), work, schema, vectors)
    # one row a document crosses from Python, with lists of its questions; pairs are made of it here
    return found.select(F.inline(F.arrays_zip(*names)), *carry)


def links(vectors: DataFrame, least: float) -> DataFrame:
    """(query_id, vec_id, cosine, links): every pair of vectors whose cosine is at least the bound.

    Equal vectors are joined through the least id among them.  A row of two such ids stands for
    ``links`` pairs, the product of both numbers of copies; a row of an id with itself for the pairs
    within its copies; a row of an id and a copy of it says where the copy belongs and has no links
    of its own.  So the links add up to the pairs of the whole table, and a vector repeated n times
    makes n rows.  Null and zero vectors are near nothing.

    Vectors are packed into blocks of equal size, each block meets each other once, and a task
    multiplies the matrices of two; no row passes the driver.
    """
    spark = vectors.sparkSession

    def written(df: DataFrame, label: str) -> DataFrame:
        path = new_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    norm = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    whole = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & (norm > 0))
    firsts = written(whole.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "vector-firsts")
    n = firsts.count()
    blocks = max(1, min(BLOCKS, n), -(-n // MOST_ROWS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        said = [pdf["vec_id"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), x]
        return pd.DataFrame([(int(pdf["block"].iloc[0]), *(a.tobytes() for a in said))], columns=["block", "ids", "ns", "x"])

    packed = written(
        firsts.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(pack, "block int, ids binary, ns binary, x binary"), "vector-blocks"
    )

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [(np.frombuffer(r.ids, np.int64), np.frombuffer(r.ns, np.int64), np.frombuffer(r.x).reshape(len(r.ids) // 8, -1)) for r in pdf.itertuples()]
        (a, an, x), (b, bn, y) = sides[0], sides[-1]
        out = []
        for at in range(0, len(a), 256):
            said = x[at : at + 256] @ y.T
            i, j = np.nonzero(said >= least - 1e-6)
            c = np.round(said[i, j], 6)
            i += at
            keep = (c >= least) & ((a[i] < b[j]) if len(sides) == 1 else (a[i] != b[j]))
            i, j, c = i[keep], j[keep], c[keep]
            out.append(pd.DataFrame({"query_id": np.minimum(a[i], b[j]), "vec_id": np.maximum(a[i], b[j]), "cosine": c, "links": an[i] * bn[j]}))
        return pd.concat(out)

    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    met = packed.select("*", other).select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "ids", "ns", "x")
    apart = met.groupBy("low", "high").applyInPandas(near, "query_id long, vec_id long, cosine double, links long")
    many = written(firsts.where("n > 1").select("embedding", F.col("vec_id").alias("query_id"), "n"), "vector-copies")
    within = many.select("query_id", F.col("query_id").alias("vec_id"), F.lit(1.0).alias("cosine"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("links"))
    copies = whole.join(many, "embedding").where("vec_id <> query_id").select("query_id", "vec_id", F.lit(1.0).alias("cosine"), F.lit(0).cast("long").alias("links"))
    return apart.unionByName(within).unionByName(copies)
