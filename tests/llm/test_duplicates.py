import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, simhash


def fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=4):
    """Smallest member reachable, by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_groups_against_all_pairs(spark, corpus, bucket):
    got = {r["doc_id"]: r for r in simhash.near_duplicate_groups(corpus, bucket=bucket).collect()}
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in corpus.collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == groups(prints)


@pytest.mark.parametrize("bucket", [64, 3])
def test_links_of_planted_fingerprints(spark, bucket):
    """Chains and clusters around random centres: every pair within the radius is connected."""
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(df, bucket=bucket)).collect()}
    want = groups(dict(enumerate(fps)))
    clusters = {}
    for i, f in enumerate(fps):
        clusters.setdefault(want[i], []).append(f)
    for members in clusters.values():
        if len(members) > 1:
            assert len({roots[f] for f in members}) == 1
        else:
            assert members[0] not in roots
    assert len({r for r in roots.values()}) == sum(len(m) > 1 for m in clusters.values())


def test_masks_cover_every_pair_in_the_radius():
    masks, rng = simhash.covering_masks(4), random.Random(3)
    assert len(masks) == 31 and all(m.bit_count() == 32 for m in masks)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(m & flips == 0 for m in masks)


def test_xxh64_of_all_lengths():
    data = np.random.default_rng(2).integers(0, 256, 4000, dtype=np.uint8)
    from millrace.llm.xxh import xxh64_slices

    starts = np.array([7 * i for i in range(130)])
    ends = starts + np.arange(130)
    want = [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends, strict=True)]
    assert xxh64_slices(data, starts, ends).tolist() == want


def test_near_duplicates_edge_cases(spark, documents):
    long = "lorem ipsum dolor sit amet " * 4000
    rows = [(3, None), (7, ""), (9, " \n "), (4, "A b c"), (4, "a B c"), (5, long), (6, long + "end"), (None, "only one here now and then"), (None, "only one here now and then"), (8, "É\x0bü Ñ x y z")]
    docs = documents(rows).selectExpr("*", "1 as fp", "2 as root")
    got = simhash.near_duplicate_groups(docs).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert by[(3, "0" * 16)] == by[(7, "0" * 16)] == by[(9, "0" * 16)] == 3
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in kept.collect()) == [(False, None), (True, 3), (True, 4), (True, 5), (True, 8)]
    assert simhash.near_duplicate_groups(documents([])).count() == 0 and simhash.drop_near_duplicates(documents([])).count() == 0


def exact(rows):
    found = {}
    for i, (d, t) in enumerate(rows):
        found.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, i))
    return {k: (rows[min(v)[3]][0], len(v)) for k, v in found.items()}


def test_exact_dedup(spark, documents):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (3, "a  b"), (None, "ab\n\n\n\n"), (4, None), (5, ""), (6, " \t\x0b"), (7, "unique"), (8, "a b"), (9, "x" * 50000), (10, "x " * 50000)]
    docs = documents(rows).selectExpr("*", "1 as _row", "2 as kept", "3 as group_size")
    got = exact_dedup.dedup_plan(docs).collect()
    want = exact(rows)
    assert len(got) == len(rows)
    shas = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert all((r["keep_id"], r["group_size"]) == shas[r["text_sha256"]] for r in got)
    assert sum(r["kept"] for r in got) == len(want)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)
    assert exact_dedup.dedup_plan(documents([])).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    rows = spark.range(3000).select((F.col("id") % 2500).alias("k")).select(F.xxhash64("k").alias("_hash"), "k")
    tested = exact_dedup.maybe_repeated(rows)
    assert tested.count() == 3000
    assert tested.where("k < 500 AND NOT _maybe").count() == 0
    assert tested.where("k >= 500 AND _maybe").count() < 100
