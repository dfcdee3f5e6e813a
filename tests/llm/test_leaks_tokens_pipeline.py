import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F

from millrace.llm import decontaminate, exact_dedup, language, token_codes
from tests.llm.test_duplicates import fingerprint, groups

SF = "/root/testdata/sf0.001"


def toks(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def leaked(words, item):
    """Whether some alignment that a mask finds has a window that agrees enough."""
    width = min(decontaminate.WINDOW, len(item))
    for shift in range(-len(item) + 1, len(words)):
        agree = [0 <= shift + k < len(words) and words[shift + k] == w for k, w in enumerate(item)]
        seeds = any(shift + j >= 0 and all(j + i < len(item) and agree[j + i] for i in m) for m in decontaminate.MASKS for j in range(len(item)))
        if seeds and max(sum(agree[a : a + width]) for a in range(len(item) - width + 1)) >= decontaminate.SIMILARITY * width:
            return True
    return False


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def changed(*places):
    w = PASSAGE.split()
    for p in places:
        w[p] = "changed"
    return " ".join(w)


def test_leaks_against_all_alignments(spark, documents):
    texts = [
        PASSAGE, "before " + PASSAGE.upper() + ", after", "x, " + PASSAGE.replace(" ", ", ") + ".", changed(3, 8, 13, 18), changed(4, 9), changed(0, 1, 2), changed(*range(0, 20, 3)), changed(*range(0, 20, 2)),
        PASSAGE[: len(PASSAGE) // 2], " ".join(reversed(PASSAGE.split())), None, "", "alpha beta", "nothing of the kind " * 50, "long " * 20000 + PASSAGE + " end" * 20000,
    ]
    items = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, "one two three four five six seven eight nine ten"), (3, "too short"), (4, None), (None, "a null item id with enough tokens to match")], "item_id long, text string")
    docs = documents([*enumerate(texts), (None, "one two three four five six seven eight nine ten"), (0, PASSAGE)]).selectExpr("*", "1 as seed", "2 as item_id")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    want = {(i, 1) for i, t in enumerate(texts[:-1]) if leaked(toks(t), PASSAGE.split())} | {(len(texts) - 1, 1), (None, 2)}
    assert got == want
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if (i, 1) not in want]
    none = documents([])
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(docs, items.where("false")).count() == 0


def agreements(words, item):
    """The most tokens that agree in any window of any alignment, by looking at all of them."""
    width = min(decontaminate.WINDOW, len(item))
    rows = ([0 <= s + k < len(words) and words[s + k] == w for k, w in enumerate(item)] for s in range(-len(item) + 1, len(words)))
    return max((sum(r[a : a + width]) for r in rows for a in range(len(item) - width + 1)), default=0), width


def test_short_items_against_all_alignments(spark, documents):
    """Every substitution that the rule allows, and one more, in items of 1 to 13 tokens; nothing here looks at seeds."""
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in range(1, 14)} | {20: ["the", "end", "the", "end", "the"]}
    texts = [None, "", "...", "w4x0 w4x1 w4x2", "the end the", "end the end the", "the end of the end the end"]
    for words in items.values():
        n, most = len(words), len(words) - -(-8 * len(words) // 10)
        for k in range(most + 2):
            for places in itertools.combinations(range(n), k) if k <= most else [range(k)]:
                changed = " ".join("other" if i in places else w for i, w in enumerate(words))
                texts.append(f"before it {changed} and after")
        texts += [" ".join(words[1:]), " ".join(words[:-1]), "y " + " ".join(words[: n - most])]
    want = {}
    for d, text in enumerate(texts):
        for i, words in items.items():
            found, width = agreements(toks(text), words)
            if found >= decontaminate.SIMILARITY * width:
                want[d, i] = (found, width)
    bank = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(40, ""), (41, None), (42, "?!")], "item_id long, text string")
    got = decontaminate.leaks(documents(list(enumerate(texts))), bank).collect()
    assert {(r["doc_id"], r["item_id"]): (r["agreeing"], r["compared"]) for r in got} == want and len(got) == len(want)


def test_items_in_scripts_without_blanks(spark, documents):
    items = spark.createDataFrame([(1, "今天的天气非常好我们去公园散步"), (2, "東京タワーは高い"), (3, "北京"), (4, "สวนสาธารณะ")], "item_id long, text string")
    texts = ["他说今天的天气非常好我们去公园散步然后回家", "今天的天气很好", "昨日東京タワーは高いと言った", "我住在北京市", "English only", "今天的天气非常坏我们去公园散步", "ไปสวนสาธารณะกัน"]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents(list(enumerate(texts))), items).collect()}
    assert got == {(0, 1), (2, 2), (3, 3), (5, 1), (6, 4)}
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(documents(list(enumerate(texts))), items).collect()] == [1, 4]


def test_clean_row_that_shares_a_doc_id_stays(spark, documents):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    docs = documents([(1, PASSAGE), (1, "a clean text"), (None, PASSAGE), (None, "another clean text"), (2, None)])
    kept = [(r["doc_id"], r["text"]) for r in decontaminate.drop_contaminated(docs, items).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a clean text"), (None, "another clean text"), (2, None)], key=str)


CLASHES = ("row", "h", "hash", "score", "lang_pred", "rejected", "_text", "_rate", "_source", "_copy", "rate", "draw", "cut", "own", "_doc_id", "_h", "head", "fp", "_leaked", "_key", "leaked", "keep", "sha", "kept_sha", "_sha", "_sha256", "id", "words", "item", "seed")


def test_stages_keep_the_values_of_clashing_columns(spark, corpus):
    """Each stage that keeps rows gives those that it gives without the extra columns, and their values as they were."""
    plain = corpus.where("doc_id < 80 or doc_id % 7 = 0").unionByName(corpus.where("doc_id < 3"))
    wide = plain.selectExpr("*", *(f"concat('{c}', doc_id) as {c}" for c in CLASHES))
    stages = [stage for name, stage in corpus_pipeline.STAGES if name != "sharding"] + [lambda _, docs, __: exact_dedup.drop_duplicates(docs)]
    for stage in stages:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns
        rows = out.collect()
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES)
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in stage(spark, plain, SF).collect())


def test_corpus_leaks_are_whole_passages(spark, corpus):
    items = {r["item_id"]: toks(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(corpus, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    for d in corpus.collect():
        text = " ".join(toks(d["text"]))
        for i, words in items.items():
            if " ".join(words) in text:
                assert (d["doc_id"], i) in got


def test_small_broadcast_bound_changes_nothing(spark, corpus, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(decontaminate.leaks(corpus, items).collect())
    from millrace.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    assert sorted(decontaminate.leaks(corpus, items).collect()) == want


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = [None, "", " ", "<|endoftext|> in text", "x\x1cy", "² m²", "日本 語", "it's  we'll\n\n\n go", "é\x85ü", "🙂 ok", "a_b __ c", "w" * 3000, "A\x00b", "ﬀ Ⅷ"]


def test_token_files_round_trip(spark, documents, corpus, library, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()] + [(5000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (7, "again 7")]
    from millrace.llm.shared import new_path

    docs = documents(rows).selectExpr("*", "1 as start", "2 as name")
    folder = new_path(spark, "tokens")
    manifest = token_codes.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, file_tokens=20_000)
    assert manifest.count() > 5
    got = sorted((r for r in token_codes.read_tokens(manifest, folder).collect()), key=lambda r: r["start"])
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    order = [r["doc_id"] for r in got]
    assert order[0] is None and order[1:] == sorted(d for d, _ in rows if d is not None)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in {(len(x), zlib.crc32(x.tobytes())) for d, t in rows if d == r["doc_id"] for x in [ids(t)]}
    assert len(got) == len(rows)


def test_random_access_in_codes():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 1 << bits, n, dtype=np.uint32) for bits, n in ((8, 700), (16, 3000), (17, 1), (32, 1500), (1, 0))]
    codes = token_codes.Codes(token_codes.pack([3, None, 9, 12, 40], texts, 5, 6))
    flat = np.concatenate(texts)
    assert (codes.all() == flat).all() and codes.tokens == len(flat) and codes.doc_ids == [3, None, 9, 12, 40]
    assert [codes[i] for i in range(len(flat))] == flat.tolist()
    assert (codes.partition, codes.number, codes.ends.tolist()) == (5, 6, np.cumsum([len(t) for t in texts]).tolist())
    empty = token_codes.Codes(token_codes.pack([], []))
    assert empty.tokens == 0 and not len(empty.all())


def test_tokens_of_an_empty_table(spark, documents):
    assert token_codes.token_report(documents([]), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


def test_pipeline_stage_by_stage(spark, corpus):
    """Each stage against a plain computation over what the stage before kept."""
    docs, seen = corpus, {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.write_table(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (docs.collect(), out.collect())
        if name != "sharding":
            assert out.columns == corpus.columns
        docs = out
    before, after = seen["language"]
    model = language.fit(corpus)
    rejected = {r["row"]["doc_id"] for r in language.predict(corpus, model).where("rejected").collect()}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - rejected
    before, after = seen["near_dedup"]
    heads = groups({r["doc_id"]: fingerprint(r["text"]) for r in before})
    assert sorted(r["doc_id"] for r in after) == sorted(set(heads.values()))
    before, after = seen["decontamination"]
    items = [toks(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r["doc_id"] for r in before if any(" ".join(i) in " ".join(toks(r["text"])) for i in items)}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert dirty <= gone and all(any(leaked(toks(r["text"]), i) for i in items) for r in before if r["doc_id"] in gone)
    before, after = seen["mixing"]
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows)
    assert words(after) == pytest.approx(1.5 * words(before), rel=0.01)
    before, after = seen["sharding"]
    assert len(before) == len(after) and len({(r["shard"], r["slot"]) for r in after}) == len(after)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in after)


def test_pipeline_on_odd_rows(spark, documents):
    """Nulls in every column, repeated rows, empty and long texts, extra columns that clash, and no rows at all."""
    words = "the house and the garden of the old town near the river bank "
    rows = [(i, words + f"number {i} " * 30, "en", "a") for i in range(5)] + [(1, words + "number 1 " * 30, "en", "a"), (None, None, None, None), (None, words * 3, None, None), (7, "", "en", None), (8, words * 5000, "en", "b"), (9, "12 34", "de", "b")]
    for docs in (documents(rows).selectExpr("*", "1 as fp", "2 as score", "3 as shard", "4 as size"), documents([])):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.write_table(stage(spark, docs, SF), f"odd-{name}")
            assert name == "sharding" or out.columns == columns, name
            docs = out
        assert docs.count() > 0 or columns == documents([]).columns


def test_items_of_few_tokens_drop_nothing(spark, corpus):
    """They are reported, and longer ones still drop what holds them."""
    words = corpus.where("doc_id = 3").first()["text"].split()
    bank = spark.createDataFrame([(1, "the"), (2, "Der"), (3, "of the der die"), (4, " ".join(words[:30]))], "item_id long, text string")
    kept = decontaminate.drop_contaminated(corpus, bank, least=decontaminate.LEAST)
    gone = {r["doc_id"] for r in corpus.select("doc_id").subtract(kept.select("doc_id")).collect()}
    assert 3 in gone and len(gone) < 20
    assert decontaminate.leaks(corpus, bank).where("item_id < 3").count() > 100


def test_seeds_beyond_the_broadcast(spark, corpus, monkeypatch):
    """The filter loses no leak, and lets few others through."""
    bank = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(90, "one two three four five six"), (91, "the")], "item_id long, text string"))
    want = {tuple(r) for r in decontaminate.leaks(corpus, bank).collect()}
    monkeypatch.setattr(decontaminate, "fits_broadcast", lambda *_: False)
    assert {tuple(r) for r in decontaminate.leaks(corpus, bank).collect()} == want and want
    seeds = spark.range(5000).select(F.xxhash64("id").alias("seed"))
    placed = spark.range(100000).select("id", F.xxhash64("id").alias("seed"))
    passed = {r["id"] for r in decontaminate.may_hit(placed, seeds).select("id").collect()}
    assert passed >= set(range(5000)) and len(passed) < 5000 + 95000 * 0.08
