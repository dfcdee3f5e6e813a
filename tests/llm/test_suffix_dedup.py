import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import suffix_dedup as sd


def slow(docs, width=100):
    """doc -> (bytes, removed, spans, hash) by a dictionary of all windows; docs: (id, text) in order."""
    seen, out = {}, {}
    for k, (i, text) in enumerate(docs):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - width + 1):
            if seen.setdefault(data[p : p + width], (k, p)) != (k, p):
                gone[p : p + width] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[k] = (i, len(data), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=str)


def report(spark, docs, **named):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, start long, twin string")
    return sorted((tuple(r) for r in sd.repeat_report(df, **named).collect()), key=str)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(4)] + ["=" * 300, "ab" * 120, text(18)[:100], text(18)[:99]]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 4)
            parts += [s[a : len(s) - rng.randint(0, len(s) // 4)] if rng.random() < 0.6 else s, text(rng.randint(0, 12))]
        docs.append((i, "".join(parts)))
    docs += [(60 + i, docs[7][1]) for i in range(3)] + [(70, docs[9][1] * 3), (71, None), (72, ""), (73, "z" * 99), (74, "z" * 100), (75, "z" * 1000), (76, "abcdefg" * 25), (77, "0123456789" * 30 + "end")]
    return docs


@pytest.mark.parametrize("crowd", [sd.CROWD, 1])
def test_report_against_all_windows(spark, crowd):
    """With a crowd of one, all windows of shared least hashes go the other way."""
    docs = planted(crowd)
    assert report(spark, docs, crowd=crowd) == slow(docs)


def test_small_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 1)
    docs = planted(5)
    assert report(spark, docs) == slow(docs)


def test_real_documents(spark, corpus):
    rows = sorted((r["doc_id"], r["text"]) for r in corpus.collect())
    got = sorted((tuple(r) for r in sd.repeat_report(corpus).collect()), key=str)
    assert got == slow(rows) and sum(r[2] for r in got) > 0


def test_rows_alike_count_once_and_ids_repeat(spark):
    a, b = "".join(chr(97 + i % 26) + str(i) for i in range(80)), "".join(str(i * i) + "-" for i in range(60))
    docs = [(1, a), (1, a), (2, b), (2, a + b), (None, b), (None, b)]
    got = report(spark, docs)
    assert [r[2] for r in got if r[0] == 1] == [0, 0]
    assert [r[2] for r in got if r[0] is None] == [len(b)] * 2
    two = sorted(r[1:3] for r in got if r[0] == 2)
    # the order of the two texts of document 2 is that of their hashes; the later one loses what both have
    assert two in ([(len(b), 0), (len(a + b), len(a + b))], [(len(b), len(b)), (len(a + b), len(a))])


def test_spans_and_what_is_kept(spark):
    s = "".join(f"{i}," for i in range(50))
    df = spark.createDataFrame([(1, s), (2, "héllo " + s + " end")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sd.without_repeats(df).collect()}
    assert bytes(got[2]["kept"]).decode() == "héllo  end" and [tuple(x) for x in got[2]["spans"]] == [(7, 7 + len(s))]
    assert bytes(got[1]["kept"]).decode() == s and got[1]["spans"] == []


def test_empty_table(spark):
    assert report(spark, []) == []


def test_cover_has_all_differences():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))
    for a in range(sd.PERIOD):
        for b in range(sd.PERIOD):
            d = sd.SHIFT[a, b]
            assert d < sd.PERIOD and {(a + d) % sd.PERIOD, (b + d) % sd.PERIOD} <= set(sd.COVER)


@pytest.mark.parametrize("alphabet", ["ab", "a", "abcdefgh"])
def test_suffixes_in_order(alphabet):
    rng = random.Random(2)
    data = "".join(rng.choice(alphabet) for _ in range(700)) + "abcab" * 60
    text = np.frombuffer((data * 2).encode(), np.uint8)
    whole = bytes(text) + b"\0" * 300
    at = np.arange(len(text) - 150)
    order = sd.sorted_bucket(sd._words(text, ">u8"), sd.cover_ranks(text), at)
    assert sorted(order.tolist()) == at.tolist()
    pieces = [whole[i : i + 100] for i in order]
    assert pieces == sorted(pieces)
    found = sd.repeated_windows(text, at, bucket=50)
    seen, want = set(), []
    for i in at:
        want.append(whole[i : i + 100] in seen)
        seen.add(whole[i : i + 100])
    assert found.tolist() == want


def test_windows_that_are_equal_share_their_run_key():
    rng = random.Random(4)
    s = "".join(rng.choice("abc") for _ in range(400))
    keys = {}
    for text in (s, "x" * 37 + s + "yy", s[120:] + s):
        data = text.encode()
        m, _, start, n = sd.runs_of(np.frombuffer(data, np.uint8), np.zeros(len(data), np.int32))
        assert n.sum() == len(data) - 99 and n.max() <= 77
        for k, a, c in zip(m.tolist(), start.tolist(), n.tolist()):
            for i in range(a, a + c):
                assert keys.setdefault(data[i : i + 100], k) == k
