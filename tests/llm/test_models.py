import math
import re
import zlib

import pytest

from millrace.llm import language, quality
from millrace.llm.xxh import xxh64_slices


def test_language_on_held_out_documents(spark, corpus):
    docs = corpus.selectExpr("*", "'x' as lang_pred", "1 as rejected")
    got = {r["doc_id"]: r for r in language.language_report(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in corpus.collect()}
    assert got.keys() == truth.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and truth[i]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(r["rejected"] for r in got.values()) / len(got) < 0.02


def test_labels_of_held_out_rows_are_never_read(spark, corpus):
    changed = corpus.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'zz', lang) as lang", "source", "n_chars")
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.language_report(d).collect()} for d in (corpus, changed))
    assert a == b


def test_language_edge_cases(spark, documents):
    rows = [(i, "the house and the garden of the old town " * 3, "en") for i in range(6)] + [(10 + i, "der Hund und die Katze sind in dem Haus " * 3, "de") for i in range(6)]
    odd = [(20, None, "en"), (21, "12 34 !!", "en"), (22, "", None), (23, "the garden and the house of the town", None), (None, "die Katze und der Hund in dem Haus", None), (24, "the house " * 30000, None), (25, "Съешь ещё этих мягких французских булок", None)]
    model = language.fit(documents(rows + odd))
    got = {r["row"]["doc_id"]: r for r in language.predict(documents(rows + odd), model).collect()}
    assert [got[i]["lang_pred"] for i in (20, 21, 22)] == ["und"] * 3 and all(got[i]["rejected"] and got[i]["score"] == 0 for i in (20, 21, 22))
    assert (got[23]["lang_pred"], got[None]["lang_pred"], got[24]["lang_pred"]) == ("en", "de", "en")
    assert not got[23]["rejected"] and got[25]["rejected"]
    kept = language.keep_known_languages(documents(rows + odd))
    assert kept.columns == documents(rows).columns and 25 not in {r["doc_id"] for r in kept.collect()}
    assert language.language_report(documents([])).count() == 0
    nothing = language.language_report(documents([(1, "words without a label", None)])).collect()
    assert [(r["lang_pred"], r["rejected"]) for r in nothing] == [("und", True)]


def test_quality_against_a_slow_count(spark, documents):
    import numpy as np

    rows = [(i, "clear calm words in a row" + " and more" * (i % 4)) for i in range(12)] + [(20 + i, "%% || %% || junk" + " || %%" * (i % 5)) for i in range(12)] + [(50, None), (51, ""), (None, "clear words")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(20 + i, 0, 0) for i in range(8)] + [(9, 1, 1), (10, None, None)], "doc_id long, quality int, toxic int")
    docs = documents(rows).selectExpr("*", "1 as gumbel", "2 as selected")
    got = {r["doc_id"]: r for r in quality.resample(docs, labels).collect()}

    def bucket_counts(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        h = []
        for w in words:
            raw = np.frombuffer(w.encode(), np.uint8)
            h.append(int(xxh64_slices(raw, np.array([0]), np.array([len(raw)]))[0]))
        pairs = [((a * 0x9E3779B97F4A7C15) % (1 << 64)) ^ b for a, b in zip(h, h[1:])]
        return [x % quality.BUCKETS for x in h + pairs]

    raw, target = [1.0] * quality.BUCKETS, [1.0] * quality.BUCKETS
    for i, text in rows:
        for b in bucket_counts(text):
            raw[b] += 1
            target[b] += i is not None and i < 8
    for i, text in rows:
        want = sum(math.log(target[b] / sum(target)) - math.log(raw[b] / sum(raw)) for b in bucket_counts(text))
        assert got[i]["log_weight"] == pytest.approx(want, abs=1e-9)
    order = sorted(got.values(), key=lambda r: (-r["sample_key"], r["doc_id"] is None, r["doc_id"]))
    assert [r["sample_rank"] for r in order] == list(range(len(rows)))
    assert sum(r["selected"] for r in got.values()) == int(len(rows) * 8 / 18)
    assert sum(got[i]["selected"] for i in range(12)) > sum(got[20 + i]["selected"] for i in range(12))


def test_quality_prefers_good_labels(spark, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality.resample(corpus, labels).join(labels, "doc_id").collect()
    good = [r["selected"] for r in rows if r["quality"] == 1]
    bad = [r["selected"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.3


def test_quality_without_labels_or_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.resample(documents([(1, "a b"), (1, "a b"), (2, None)]), none).collect()
    assert all(r["log_weight"] == 0 and r["selected"] for r in rows) and len(rows) == 3
    assert quality.resample(documents([]), none).count() == 0
