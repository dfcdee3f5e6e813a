import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators import vectors as V


def test_fit_works_each_norm_out_once(spark):
    row = spark.createDataFrame([([3.0, 4.0, 12.0],), ([0.0, 0.0, 5.0],)], "v array<double>")
    df = row.select(V.fit(V.fit(F.col("v"), 2), 4).alias("v"))
    assert [r.v for r in df.collect()] == [[0.6, 0.8, 0.0, 0.0], [0.0] * 4]
    # the norm of each of the two fits stands once in the plan, not once for each use of a use
    assert df._jdf.queryExecution().analyzed().toString().count("aggregate(") == 2


def _peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_neighbours_of_a_batch_take_little_memory():
    x = np.random.default_rng(1).normal(size=(6000, 8))
    rows = pd.DataFrame({"vec_id": np.arange(6000), "embedding": list(x), "kind": np.arange(6000) % 2})
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    queries, found = slice(0, 2000), []
    # the whole product would be 96 MB, and copies of it
    assert _peak_mb(lambda: found.extend(V._nearest(rows, np.arange(2000), unit[queries], 5, -1.0, ("kind", np.arange(2000) % 2)))) < 40
    said = np.round(unit[queries] @ unit.T, 6)
    said[(np.arange(2000) % 2)[:, None] != (np.arange(6000) % 2)[None, :]] = -2
    said[np.arange(2000), np.arange(2000)] = -2
    best = pd.concat(found).sort_values(["query_id", "cosine", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(5)
    assert np.array_equal(best["cosine"].to_numpy().reshape(2000, 5), -np.sort(-said, axis=1)[:, :5])


def test_lexical_vectors_take_little_memory():
    texts = [[f"word{i % 50}", f"other{i % 7}"] for i in range(4096)]
    # the matrix itself has 50 MB
    assert _peak_mb(lambda: V.Places().vectors(texts)) < 80


def test_held_rows_are_bounded_in_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(V, "HELD", 3)
    monkeypatch.setattr(V, "HELD_BYTES", 10)
    texts = ["x" * 30, "", "aaaa", "bbbb", "cccc", "d", "e", "f", "g", "y" * 11]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert [b.column("text").to_pylist() for b in V._held(batch)] == [["x" * 30], ["", "aaaa", "bbbb"], ["cccc", "d", "e"], ["f", "g"], ["y" * 11]]
    assert list(V._held(batch.slice(0, 0))) == []


def test_a_repeated_word_is_spread_once():
    texts = [["word"] * 200_000 + ["other"], [], ["word", "x"]]
    got, places = [], V.Places()
    # the places of all words would be a million numbers, and copies of them
    assert _peak_mb(lambda: got.extend(places.vectors(texts))) < 20
    one = {w: np.bincount(places.of([w])[1], minlength=V.DIM) for w in ("word", "other", "x")}
    want = [one["word"] * 200_000.0 + one["other"], one["word"] * 0.0, one["word"] + one["x"] * 1.0]
    assert all(np.allclose(g, w / max(np.linalg.norm(w), 1)) for g, w in zip(got, want))


def test_words_are_told_of_once_and_again_when_forgotten():
    asked = []
    words = V.Words(lambda new: (asked.append(new), (np.fromiter(map(len, new), int), np.concatenate([np.arange(len(w)) for w in new])))[1], most=2)
    for texts, new in ((["b a b", "", " a"], ["b", "a", ""]), (["c"], ["c"]), (["c c a"], ["a"]), (["a"], [])):
        listed = V._words(pa.array(texts))
        row, word, times = words.read(listed)
        names = list(words.index)
        assert [(r, names[w], n) for r, w, n in zip(row, word, times)] == sorted(((r, w, t.split().count(w)) for r, t in enumerate(texts) for w in set(t.split())), key=lambda x: (x[0], names.index(x[1])))
        assert (asked.pop() if new else []) == new and not asked
        size, flat = words.told[0]
        assert size.tolist() == list(map(len, names)) and flat.tolist() == [i for w in names for i in range(len(w))]


def test_terms_within_words():
    terms = V.Terms(["ab", "b", "한글", "a\nb", "b\n", "abc"])
    size, told = terms.within(["xabab", "", "a", "b", "한글이", "abcab"])
    assert size.tolist() == [2, 0, 0, 1, 1, 3] and told.tolist() == [0, 1, 1, 2, 0, 1, 5]
    assert [x.tolist() for x in V.Terms([]).within(["a"])] == [[0], []]


def test_places_are_those_of_the_lexical_vectors(spark):
    texts = ["the cat  sat, the end", "가나다 x 9", "", "a" * 50 + "_" + "b"]
    rows = V.lexical_vectors(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t").collect()
    want = np.zeros((len(texts), V.DIM))
    for r in rows:
        want[r.k, r.idx] = r.weight
    assert np.allclose(V.Places().vectors(V._words(pa.array(texts))), want)
