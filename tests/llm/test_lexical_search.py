import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lexical_search


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def slow(docs, items, k=10):
    """Every item against every document, in whole numbers of any size."""
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            scores.append((-score, doc_id is None, doc_id))
        best = sorted(s for s in scores if s[0] < 0)[:k]
        out += [(item_id, r, s[2], -s[0]) for r, s in enumerate(best, 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **named):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, term int")
    q = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    return sorted((tuple(r) for r in lexical_search.search(d, q, **named).collect()), key=str)


WORDS = ["a", "B", "C3", "Über", "naïve", "x_y", "語", "語彙", "e-mail", "I'm"]


@pytest.mark.parametrize("most", [lexical_search.EXACT - 1, 900_000_000])
def test_search_against_slow(spark, monkeypatch, most):
    """Small bounds cut the columns into many tiles, and single weights into parts."""
    monkeypatch.setattr(lexical_search, "DOC_TILE", 7)
    monkeypatch.setattr(lexical_search, "ITEM_TILE", 3)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = [(i, text(rng.randint(1, 30))) for i in range(60)]
    docs += [(5, docs[5][1]), (7, "a a a"), (None, docs[9][1]), (70, None), (71, ""), (72, "?! -"), (73, "語彙 " * 400)]
    items = [(i, text(rng.randint(1, 12))) for i in range(10)] + [(3, "B"), (3, "B"), (20, None), (21, ""), (22, "nowhere"), (None, "a " * 500)]
    assert found(spark, docs, items, most=most) == slow(docs, items)


def test_ties_over_tiles_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "DOC_TILE", 4)
    docs = [(i, "same words here") for i in range(50, 0, -1)]
    assert [(r[1], r[2]) for r in sorted(found(spark, docs, [(1, "same")]), key=lambda r: r[1])] == [(i, i) for i in range(1, 11)]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = [(i, f"w{i % 5} v{i % 7}") for i in range(40)], [(i, f"w{i} v{i}") for i in range(6)]
    whole = found(spark, docs, items)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 150)
    assert found(spark, docs, items) == whole == slow(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] == found(spark, [(1, "a")], [])


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "ab CD,eÉf " * 300
    whole = [t for p in lexical_search.terms_of(text) for t in p]
    monkeypatch.setattr(lexical_search, "PIECE", 16)
    pieces = [*lexical_search.terms_of(text)]
    assert len(pieces) > 100 and [t for p in pieces for t in p] == whole == [t.encode() for t in terms(text)]


def test_tiles_add_up_and_stay_below_the_bound():
    wanted = np.random.default_rng(1).integers(0, 40, (30, 5)) * 1000
    got, most = np.zeros_like(wanted), 60_000 * lexical_search.UNIT
    for columns, part in lexical_search.term_tiles(wanted, width=8, most=most):
        assert len(columns) <= 8 and (part.sum(axis=0) * lexical_search.UNIT <= most).all()
        got[columns] += part
    assert (got == wanted).all()
