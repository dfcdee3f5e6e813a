import hashlib
import math
import zlib

import numpy as np
import pytest

from millrace.llm import mixing, sharding


def water_fill(sizes, weights, share, ceiling):
    """Deal, cut at the ceiling, reshare, until nothing is above."""
    total, capped = share * sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in capped}
        if not rest:
            return capped
        left = total - sum(capped.values())
        dealt = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: float(ceiling * sizes[s]) for s in rest if dealt[s] > ceiling * sizes[s]}
        if not over:
            return capped | dealt
        capped |= over


def test_targets_match_repeated_resharing(spark, documents):
    rows = [(i, "w " * n, "en", s) for i, (n, s) in enumerate([(100, "a"), (3, "b"), (50, "c"), (7, "d"), (900, "e"), (10, None), (0, "f")])]
    got = {r["source"]: r for r in mixing.mix_plan(documents(rows)).collect()}
    sizes = {s: got[s]["source_size"] for s in got}
    weights = dict(zip(["a", "b", "c", "d", "e", "f", None], [5, 2, 1, 5, 2, 1, 5]))
    want = water_fill(sizes, weights, 1.5, 2)
    for s in want:
        assert got[s]["target"] == pytest.approx(want[s])


def test_mix_nears_targets_and_repeats_itself(spark, corpus):
    first, second = ({r["doc_id"]: r for r in mixing.mix_plan(corpus).collect()} for _ in range(2))
    assert {k: v["taken"] for k, v in first.items()} == {k: v["taken"] for k, v in second.items()}
    assert all(r["taken"] <= 2 * r["size"] for r in first.values())
    check_targets(first.values())


def check_targets(plan):
    """By source: the words taken miss the target by half a document at most, and the copies are those of the sorted draws."""
    by_source = {}
    for r in plan:
        by_source.setdefault(r["source"], []).append(r)
    for rows in by_source.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows) / 2 + 1e-6
        assert {r["copies"] - math.floor(r["rate"]) for r in rows} <= {0, 1}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_is_near_the_target_of_every_source(spark, sf):
    check_targets(mixing.mix_plan(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect())


def test_mix_of_hot_and_long_documents(spark, documents):
    """A source with one document longer than all others, sources of one document, many rows alike, and null in every column."""
    rows = [(i, "w " * (1 + i % 13), "en", "a") for i in range(400)] + [(1000, "long " * 3000, "en", "a"), (1001, "w " * 9, "en", "b"), (None, None, None, None), (None, "x y z", None, None)] + [(2000, "same text", "en", "c")] * 50
    plan = mixing.mix_plan(documents(rows)).collect()
    assert len(plan) == len(rows)
    check_targets([r for r in plan if r["source"] != "c"])
    assert len({r["copies"] for r in plan if r["source"] == "c"}) == 1
    drawn = [(r["source"], r["size"], zlib.crc32(str(r["doc_id"]).encode())) for r in plan]
    sized = spark.createDataFrame(drawn, "source string, size long, draw long")
    rates = mixing.source_rates(sized, None, 1.5, 2).collect()
    for r in rates:
        goal, before, cut = r["target"] - math.floor(r["rate"]) * r["source_size"], 0, -1
        for d in sorted({d for s, _, d in drawn if s == r["source"]}):
            held = sum(n for s, n, x in drawn if s == r["source"] and x == d)
            cut = d if before + held / 2 < goal else cut
            before += held
        # draws between two neighbours cut alike
        assert [d <= r["cut"] for s, _, d in drawn if s == r["source"]] == [d <= cut for s, _, d in drawn if s == r["source"]]


def test_mix_edge_cases(spark, documents):
    docs = documents([(1, None, None, None), (1, "", "en", "a"), (None, "x y", "en", "a"), (None, "x y", "en", "a"), (3, "one\x0btwo three", "en", "b")]).selectExpr("*", "1 as size", "2 as copies")
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == 5
    assert sorted(r["size"] for r in plan) == [0, 0, 2, 2, 2]  # a no-break space is no white space here
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.mix_plan(documents([])).count() == 0 and mixing.mix(documents([])).count() == 0


def test_mix_with_given_weights(spark, documents):
    docs = documents([(i, "a b c", "en", "xy"[i % 2]) for i in range(40)])
    plan = mixing.mix_plan(docs, spark.createDataFrame([("x", 3), ("y", 1)], "source string, weight int"), share=1.0).collect()
    assert {r["source"]: r["target"] for r in plan} == {"x": 90.0, "y": 30.0}


def slow_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    for shards in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, shards).tolist() == [slow_jump(int(k), shards) for k in keys]


def test_shards_against_brute_force(spark, corpus):
    rows = sharding.shard_plan(corpus).collect()
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    assert len(rows) == len(texts)
    slots = {}
    for r in rows:
        key = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:16], 16)
        raw = texts[r["doc_id"]].encode()
        assert (r["shard"], r["grown_shard"]) == (slow_jump(key, 16), slow_jump(key, 17))
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_edge_cases(spark, documents):
    docs = documents([(None, None), (None, None), (5, "same"), (5, "same"), (5, "other"), (6, "")]).selectExpr("*", "'x' as shard", "0 as position", "0 as _row")
    rows = sharding.shard_plan(docs).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in rows)[:3] == [(1, 0), (1, 0), (1, 0)]
    assert len({(r["shard"], r["slot"]) for r in rows}) == 6
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    assert sharding.shard_plan(documents([])).count() == 0
