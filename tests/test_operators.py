from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.nested import strip_nul
from millrace.functions.status import period_status, unit_status
from millrace.operators import cdc, chunks, ranking, vectors
from millrace.operators.blocking import containment
from millrace.sources.files import decode_bytes


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_normalize_decodes_after_stripping_tags(spark):
    assert one(spark, X.normalize, " <p>a\0b</p>\n &lt;b&gt; &amp;amp; ") == "a b <b> &amp;"
    assert one(spark, X.normalize, None) == ""


def test_repeated_lines_compare_with_the_line_kept_before(spark):
    assert one(spark, X.drop_repeated_lines, "a\n\n a \nb\na\n\t\na") == "a\nb\na"


def test_keywords_in_order_without_endings_and_stop_words(spark):
    assert one(spark, lambda c: X.keywords(c, 4), "a The Longest wording the words; words abcd") == ["the", "longest", "wording", "words"]
    # an ending has to leave two characters; the first one of the list that does is cut
    assert one(spark, X.keywords, "수강신청은 언제 하나요 학교에서는 나는 2024학년도") == ["수강신청", "하나", "학교", "나는", "2024학년"]
    assert one(spark, X.keywords, "") == []
    assert len(one(spark, X.keywords, " ".join(f"w{i}" for i in range(40)))) == 15


def test_keyword_matches_within_longer_words(spark):
    docs = spark.createDataFrame([(1, "reapplications close", "close"), (2, "apply", ""), (3, "", ""), (4, "app" * 300_000, "")], "doc_id long, text string, title string")
    questions = spark.createDataFrame([(7, "x", ["applic", "close"]), (8, "y", ["app"]), (9, "z", [])], "item_id long, text string, keywords array<string>")
    got = {(r["item_id"], r["doc_id"]): (r["n"], r["hits"], r["title_hits"]) for r in vectors.keyword_matches(docs, questions, ["doc_id"], vectors=False).collect()}
    assert got == {(7, 1): (2, 2, 1), (8, 1): (1, 1, 0), (8, 2): (1, 1, 0), (8, 4): (1, 1, 0)}
    assert vectors.keyword_matches(docs, questions.where("item_id = 9"), ["doc_id"]).count() == 0


def test_markup(spark):
    assert one(spark, X.strip_markup, "# Title\n- **bold** [link](http://x) `code`") == "Title\n• bold link code"


def test_strip_nul_walks_nested_types(spark):
    df = spark.sql("SELECT named_struct('a', array('x\\0y'), 'm', map('k\\0', 'v\\0')) AS s, 1 AS n, CAST(NULL AS STRING) AS z")
    row = strip_nul(df).first()
    assert row["s"]["a"] == ["x y"] and row["s"]["m"] == {"k ": "v "} and row["n"] == 1 and row["z"] is None


def test_start_only_periods_differ_by_rule(spark):
    now = F.lit(datetime(2024, 7, 1))
    df = spark.createDataFrame([(datetime(2024, 1, 1), None), (None, datetime(2024, 6, 1)), (datetime(2025, 1, 1), None), (None, None)], "s timestamp, e timestamp")
    rows = df.select(period_status(F.col("s"), F.col("e"), now), unit_status(F.col("s"), F.col("e"), now)).collect()
    assert [tuple(r) for r in rows] == [("unknown", "active"), ("expired", "expired"), ("upcoming", "upcoming"), ("unknown", "unknown")]


def test_change_states(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, h string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "id long, h string")
    assert {r["id"]: r["state"] for r in cdc.classify(old, new, "id", "h").collect()} == {1: "missing", 2: "skipped", 3: "updated", 4: "new"}
    assert {r["id"]: (r["h"], r["archived"]) for r in cdc.merged(old, new, "id", ["h"]).collect()} == {1: ("a", True), 2: ("b", False), 3: ("x", False), 4: ("d", False)}


def test_an_empty_listing_archives_nothing(spark):
    old = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r["id"] for r in cdc.missing(old, spark.createDataFrame([(2,)], "id long"), "id").collect()] == [1]
    assert cdc.missing(old, old.where("false"), "id").count() == 0
    assert cdc.missing(old, old, "id", complete=False).count() == 0


def test_chunks_cover_the_text():
    text = "One sentence here. " * 300
    cuts = chunks.cut_points(text, 200, 30)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(b > a and c <= b < d for (a, b), (c, d) in zip(cuts, cuts[1:]))
    assert all(text[b - 1] == " " for _, b in cuts)
    assert chunks.cut_points("") == [] and chunks.cut_points("x" * 500, 200, 30)[0] == (0, 200)


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_containment_of_parts_without_inner_tokens(spark, monkeypatch, bound):
    from millrace.operators import blocking

    monkeypatch.setattr(blocking, "BROADCAST_BYTES", bound)
    said = {1: "one two three four", 2: "😀 smile 😀 ab", 3: "", 4: None, 5: "x" * 1_000_000 + "two", 6: "wo thre"}
    asked = ["wo thre", "two", "o", "😀 smi", "ab", "", None, "xxxx", "two three four", "absent text", "…"]
    texts = spark.createDataFrame(list(said.items()), "i int, t string")
    got = sorted((r["i"], r["p"]) for r in containment(texts, spark.createDataFrame([(x,) for x in asked], "p string"), "t", "p", "i").collect())
    assert got == sorted((i, p) for i, t in said.items() for p in asked if t is not None and p is not None and p in t)


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_containment_with_and_without_blocks(spark, monkeypatch, bound):
    from millrace.operators import blocking

    monkeypatch.setattr(blocking, "BROADCAST_BYTES", bound)
    texts = spark.createDataFrame([(1, "an old red house stands here"), (2, "nothing")], "i long, t string")
    parts = spark.createDataFrame([("a", "old red house"), ("b", "d h"), ("c", "ld red hou"), ("d", "blue red house")], "k string, p string")
    assert sorted((r["i"], r["k"]) for r in containment(texts, parts, "t", "p", "i").collect()) == [(1, "a"), (1, "b"), (1, "c")]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    assert [r[0] for r in df.select(vectors.fit(F.col("a"), 3)).collect()] == [[0.6, 0.8, 0.0], [0.0, 0.0, 0.0], [1.0, 0.0, 0.0]]


def test_top_k_in_blocks_equals_one_block(spark, monkeypatch):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = v.where("vec_id % 50 = 0")
    want = sorted(vectors.top_k(v, q, 4).collect())
    monkeypatch.setattr(vectors, "BLOCK", 3)
    assert sorted(vectors.top_k(v, q, 4).collect()) == want
    assert vectors.top_k(v, q.where("false"), 4).count() == 0


def test_links_are_all_pairs_of_all_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(60, 4)).astype(np.float32)
    rows[[7, 31, 59]] = rows[30]
    rows[11], rows[50] = rows[10], 0
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)] + [(60, None)], "vec_id long, embedding array<float>")
    unit = rows.astype(np.float64) / np.maximum(np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True), 1e-300)
    said = np.round(unit @ unit.T, 6)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if said[i, j] >= 0.45}
    for most in (16384, 7):
        monkeypatch.setattr(vectors, "MOST_ROWS", most)
        got = vectors.links(v, 0.45).collect()
        copies = {r["vec_id"]: r["query_id"] for r in got if r["links"] == 0}
        assert copies == {30: 7, 31: 7, 59: 7, 11: 10} and sum(r["links"] for r in got) == len(want)
        first = lambda i: copies.get(i, i)
        assert {(r["query_id"], r["vec_id"]) for r in got if r["query_id"] != r["vec_id"] and r["links"]} == {tuple(sorted((first(i), first(j)))) for i, j in want if first(i) != first(j)}
        assert any(i % 50 for i, _ in want)
    assert vectors.links(v.where("false"), 0.45).count() == 0


def test_blend_keeps_all_if_all_would_go(spark):
    df = spark.createDataFrame([(1, 0.9, 0.1, False), (1, 0.8, 0.2, True), (2, 0.5, 0.5, False), (2, 0.4, 0.1, False)], "q long, score double, relevance double, rejected boolean")
    assert sorted((r["q"], round(r["score"], 6)) for r in ranking.blend(df, "q").collect()) == [(1, 0.8), (1, 0.9), (2, 0.5)]


def test_decoding_falls_back(spark):
    raw = [(1, "héllo".encode()), (2, "한글".encode("cp949")), (3, "x".encode("utf-16")), (4, b"\xff"), (5, None)]
    got = spark.createDataFrame(raw, "i long, b binary").select("i", decode_bytes("b").alias("t")).collect()
    assert [r["t"] for r in got] == ["héllo", "한글", "x", "", None]


def test_streams_equal_their_batch_twins(spark):
    from millrace.plans.catalog import QUERIES

    for stream, batch in (("stream_session_carry", "session_carry"), ("stream_cache_replay", "cache_replay")):
        a, b = (QUERIES[n](spark, "/root/testdata/sf0.001") for n in (stream, batch))
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def test_records_get_defaults(spark, tmp_path):
    from millrace.sources.records import read_records

    (tmp_path / "r.json").write_text('[{"source_id": "a", "title": "t", "published_at": "2024-01-02T09:00:00+09:00"}, {"source_id": "b", "attachment_names": ["x"], "source_priority": 7}]')
    rows = {r["source_id"]: r for r in read_records(spark, str(tmp_path)).collect()}
    assert rows["a"]["published_at"] == datetime(2024, 1, 2) and rows["a"]["attachment_names"] == [] and rows["a"]["source_priority"] == 50
    assert rows["b"]["attachment_names"] == ["x"] and rows["b"]["source_priority"] == 7 and rows["b"]["source_metadata"] == {}


def test_case_bank_refuses_bad_lines_and_ids(spark, tmp_path):
    from millrace.sources.records import read_case_bank

    def bank(name, text):
        (tmp_path / name).write_text(text)
        return read_case_bank(spark, str(tmp_path / name), "id string, question string")

    assert bank("ok", '# comment\n\n{"id": "1", "question": "q"}\n').count() == 1
    with pytest.raises(ValueError):
        bank("twice", '{"id": "1"}\n{"id": "1"}\n')
    with pytest.raises(Exception):  # noqa: B017  Spark's own error
        bank("bad", "{oops\n").collect()


def test_export_and_upsert(spark, tmp_path):
    from millrace.sources.records import upsert, write_nested

    parents, children = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "id long, n int, c string")
    write_nested(parents, children, "id", ["n"], str(tmp_path / "out"))
    rows = {r["id"]: [x["c"] for x in r["children"]] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert rows == {1: ["x", "y"], 2: []}
    parents.write.parquet(str(tmp_path / "t"))
    after = upsert(spark, str(tmp_path / "t"), spark.createDataFrame([(2, "z"), (3, "c")], "id long, v string"), "id")
    assert {r["id"]: r["v"] for r in after.collect()} == {1: "a", 2: "z", 3: "c"}


def test_hooks(spark):
    from millrace.functions import hooks

    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r[0] for r in df.select(hooks.embed(F.col("t"), lambda xs: [[float(len(x))] for x in xs])).collect()] == [[2.0], None]
    assert [r[0] for r in df.select(hooks.decode(F.encode("t", "UTF-8"), lambda b: b.decode()[::-1])).collect()] == ["ba", None]
    docs = spark.createDataFrame([(1, "One two. " * 60), (2, None), (3, "")], "doc_id long, text string")
    want = chunks.sentence_chunks(docs, 200, 20).drop("chunk").collect()
    assert sorted(hooks.lateral_chunks(docs, 200, 20).collect()) == sorted(want)
    ranked = spark.createDataFrame([(1, 0.9), (1, 0.2)], "q long, score double")
    judge = lambda r: r.withColumn("relevance", F.lit(0.5)).withColumn("rejected", F.col("score") > 0.5)
    assert [round(r["score"], 6) for r in hooks.rerank(ranked, "q", judge).collect()] == [0.29]


def test_replay_keeps_null_questions_and_times(spark):
    import datetime as dt

    from millrace.streaming.streams import replay_table

    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [(None, at(1), 1), (None, at(2), 2), ("a", at(1), 3), ("", at(2), 4), ("a", None, 5), (None, at(30), 6), ("a", at(5), 7)]
    got = {r["event_id"]: r["outcome"] for r in replay_table(spark.createDataFrame(rows, "question string, ts timestamp, event_id long"), 10.0).collect()}
    assert got == {1: "miss", 2: "hit", 3: "miss", 4: "miss", 5: "miss", 6: "miss", 7: "hit"}


def test_top_k_of_the_same_kind(spark):
    import numpy as np

    from millrace.operators import vectors as V

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], i % 7 if i % 11 else None) for i in range(60)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r["query_id"], r["vec_id"]) for r in V.top_k(df, df.where("vec_id % 10 = 3"), 3, same="label").collect()}
    for q in range(3, 60, 10):
        same = [i for i in range(60) if i != q and i % 11 and q % 11 and i % 7 == q % 7]
        assert {v for a, v in got if a == q} == set(sorted(same, key=lambda i: (-round(float(unit[i] @ unit[q]), 6), i))[:3])


def test_lexical_search_against_a_slow_one(spark):
    import hashlib
    import math
    import re

    from millrace.operators import vectors as V

    texts = ["the old house", "a house by the river", "", "river rivers rivered", "xyz", "ein haus am fluss", "a b c d " * 300]
    asked = [(0, "house river", ["house", "river"]), (1, "fluss", ["fluss"]), (2, "q", [])]

    def vector(text):
        v = [0] * V.DIM
        for w in re.findall("[가-힣A-Za-z0-9]+", text):
            for f in [w, *(f"^{w}$"[i : i + 3] for i in range(len(w)))]:
                v[int(hashlib.sha256(f.encode()).hexdigest()[:8], 16) % V.DIM] += 1
        return [x / math.sqrt(sum(y * y for y in v) or 1) for x in v]

    dot = {(q, d): round(sum(a * b for a, b in zip(vector(t), vector(x), strict=True)), 6) for q, t, _ in asked for d, x in enumerate(texts)}
    docs = spark.createDataFrame([(d, x, x[:5]) for d, x in enumerate(texts)], "doc_id long, text string, title string")
    questions = spark.createDataFrame(asked, "item_id long, text string, keywords array<string>")
    want = {(q, d) for q, _, _ in asked for d in sorted((d for d in range(len(texts)) if dot[q, d] > 0), key=lambda d: (-dot[q, d], d))[:2]}
    assert {(r["item_id"], r["doc_id"]) for r in V.lexical_top(docs, questions, 2).collect()} == want
    got = {(r["item_id"], r["doc_id"]): (r["n"], r["hits"], r["title_hits"], r["vector"]) for r in V.keyword_matches(docs, questions, ["doc_id"]).collect()}
    assert got == {(0, 0): (2, 1, 0, dot[0, 0]), (0, 1): (2, 2, 0, dot[0, 1]), (0, 3): (2, 1, 1, dot[0, 3]), (1, 5): (1, 1, 0, dot[1, 5])}
