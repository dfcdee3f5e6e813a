"""Benchmark decontamination by spaced seeds.  DataFrame functions only.

A seed is a mask over token positions: the tokens under its ones are hashed, those between are
ignored, so a substitution there leaves the hash as it is.  The hashes at every position of the
documents meet those of the benchmark items; a hit fixes an alignment of item and document, and the
aligned tokens are compared: an item is leaked if some WINDOW successive tokens of it (all of it, if
it is shorter) agree in at least SIMILARITY of the positions.

The masks find every such alignment of items of WINDOW tokens and more.  A shorter item is cut into
one part more than tokens of it may differ, so that in any alignment that agrees enough one part is
whole; the hashes of these parts are its seeds, and every alignment found is compared in full.

Tokens are runs of letters and digits, lower-cased; in scripts without blanks between words each
character is a token.  Defined results: a null or empty text, or one without tokens, has no leaks;
an item of one to four tokens leaks where all of it stands; rows that repeat a doc_id are compared
one by one and reported under it; a null doc_id is reported as null; items that share an item_id are
looked for one by one and reported under it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import broadcast_if_small, fits_broadcast, write_table

#: Positions that a mask looks at.
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 6, 7, 9), (0, 2, 3, 5, 8, 10))
WINDOW = 13
SIMILARITY = 0.8
#: For the pipeline: no document is dropped for an item of fewer tokens, since a word or two stand in many clean texts.
LEAST = 5
#: Bits of the filter for each seed, and at most (64 MB).
FILTER_BITS, FILTER_MOST = 16, 1 << 29
#: Characters of scripts that put no blanks between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"


#: All of them lie in this range, whose test is cheaper.
_FAR = r"[\x{0E00}-\x{10FFFF}]"


def tokens(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    far = (F.octet_length(text) > F.length(text)) & text.rlike(_FAR)
    apart = F.when(far, F.regexp_replace(text, UNSPACED, " $0 ")).otherwise(text)
    return F.array_remove(F.split(F.lower(apart), r"[^\p{L}\p{N}]+"), "")


def _seeds(words: str, at: str) -> Column:
    """The hashes of all masks laid at a position."""
    return F.array(*(F.xxhash64(F.lit(m), *(F.get(F.col(words), F.col(at) + i) for i in mask)) for m, mask in enumerate(MASKS)))


def _positions(words: str) -> Column:
    last = F.size(words) - (min(mask[-1] for mask in MASKS) + 1)
    return F.when(last >= 0, F.sequence(F.lit(0), last))


def item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, item_words) of items (item_id, text): each pair of id and tokens once, named by a hash."""
    words = items.select("item_id", tokens(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    return words.distinct().select(F.xxhash64("item_id", "item_words").alias("item"), "item_id", "item_words")


def item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, item_at) of items (item, item_words), by the masks."""
    at = items.withColumn("item_at", F.explode(_positions("item_words")))
    return at.select(F.explode(_seeds("item_words", "item_at")).alias("seed"), "item", "item_at")


def _run(words: str, at: Column, length: int) -> Column:
    """The hash of so many successive tokens."""
    return F.xxhash64(F.lit(length), *(F.get(F.col(words), at + i) for i in range(length)))


def short_seeds(items: DataFrame, window: int, similarity: float) -> DataFrame:
    """(seed, item, item_at, length) of items (item, item_words) under window tokens: one row a part."""
    size = F.size("item_words")
    parts = F.least(size, size - F.ceil(size * similarity).cast("int") + 1)
    cut = lambda k: F.floor(k * F.col("size") / F.col("parts")).cast("int")
    words = items.where(size < window).select("item", "item_words", size.alias("size"), parts.alias("parts"))
    cuts = words.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("item_at", cut(F.col("k"))).withColumn("length", cut(F.col("k") + 1) - F.col("item_at"))
    seed = F.coalesce(*(F.when(F.col("length") == n, _run("item_words", F.col("item_at"), n)) for n in range(1, window)))
    return cuts.select(seed.alias("seed"), "item", "item_at", "length")


def _slot(seed: Column, bits: int) -> tuple[Column, Column, Column]:
    """(row, place, bit) of a seed in a filter of so many bits, in rows of 64 longs."""
    at = F.pmod(seed, F.lit(bits))
    return F.shiftright(at, 12), F.shiftright(at, 6).bitwiseAND(63).cast("int"), at.bitwiseAND(63).cast("int")


def seed_filter(seeds: DataFrame, bits: int) -> DataFrame:
    """(row, longs): one bit for each seed, in rows of 64 longs; bits / 8 bytes in all at most."""
    row, place, bit = _slot(F.col("seed"), bits)
    words = seeds.select(row.alias("row"), place.alias("place"), F.expr("1L").alias("one"), bit.alias("bit")).groupBy("row", "place").agg(F.bit_or(F.call_function("shiftleft", "one", "bit")).alias("w"))
    held = words.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("m"))
    return held.select("row", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("longs"))


def may_hit(placed: DataFrame, seeds: DataFrame) -> DataFrame:
    """The rows of placed whose seed may be one of seeds: all that are, and few others while the filter has room."""
    wanted, bits = FILTER_BITS * seeds.count(), 1 << 12
    while bits < min(wanted, FILTER_MOST):
        bits <<= 1
    row, place, bit = _slot(F.col("seed"), bits)
    # bounded by FILTER_MOST
    probed = placed.withColumn("_row", row).join(F.broadcast(seed_filter(seeds, bits)), F.col("_row") == F.col("row"))
    return probed.where(F.call_function("shiftright", F.get("longs", place), bit).bitwiseAND(1) == 1).drop("_row", "row", "longs")


def _meet(texts: DataFrame, placed: DataFrame, seeds: DataFrame, label: str) -> DataFrame:
    """(doc_id, h, words, item, shift) where a seed of placed (texts with seeds and places) is one of seeds.

    While seeds are few they are broadcast, and words stay inside the stage that reads the texts.
    Beyond, a filter of one bit a seed goes to the texts; only seeds and places that it lets through
    are shuffled, and the texts that were hit join back by name.
    """
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    if fits_broadcast(seeds, 64):
        return placed.join(F.broadcast(seeds), "seed").select("doc_id", "h", "words", "item", shift)
    hits = may_hit(placed.select("doc_id", "h", "at", "seed"), seeds).join(seeds, "seed").select(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h"), "item", shift).distinct()
    hits = write_table(hits, label)
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h"))
    held = texts.join(broadcast_if_small(hits.select("_doc_id", "_h").distinct(), 64), same, "left_semi")
    return held.join(broadcast_if_small(hits, 64), same).select("doc_id", "h", "words", "item", "shift")


def _best_window(agree: Column, width: Column) -> Column:
    """The most agreements in any window of the width, as a running count."""
    counts = F.aggregate(
        F.arrays_zip(agree.alias("enters"), F.concat(F.array_repeat(F.lit(0), width), agree).alias("leaves")),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, x: F.struct(
            (acc["now"] + F.coalesce(x["enters"], F.lit(0)) - F.coalesce(x["leaves"], F.lit(0))).alias("now"),
            F.greatest(acc["most"], acc["now"] + F.coalesce(x["enters"], F.lit(0)) - F.coalesce(x["leaves"], F.lit(0))).alias("most"),
        ),
    )
    return counts["most"]


def _found(docs: DataFrame, items: DataFrame, window: int, similarity: float) -> DataFrame:
    """(doc_id, h, item_id, agreeing, compared) for each alignment that agrees enough; h is the hash of the text.

    The texts are read once for each kind of item; their seeds live inside one generated stage
    between scan and join.  Items under the window go by their parts, the others by the masks.
    """
    bank = write_table(item_words(items), "items")
    bank_bytes = F.lit(64) + F.length(F.concat_ws("    ", "item_words")) * 2
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), tokens(F.col("text")).alias("words"))
    size = F.size("item_words")

    long = bank.where(size >= window)
    placed = texts.withColumn("at", F.explode(_positions("words"))).withColumn("seed", F.explode(_seeds("words", "at")))
    met = _meet(texts, placed, write_table(item_seeds(long), "item-seeds"), "item-hits").join(broadcast_if_small(long.select("item", size.alias("item_size")), 32), "item")
    missing, first = F.greatest(F.lit(0), -F.col("shift")), F.greatest(F.lit(0), F.col("shift"))
    aligned = F.concat(F.array_repeat(F.lit(None).cast("string"), missing), F.slice("words", first + 1, F.col("item_size") - missing))
    hits = met.select("doc_id", "h", "item", "shift", aligned.alias("aligned")).groupBy("doc_id", "h", "item", "shift").agg(F.first("aligned").alias("aligned"))
    agree = F.zip_with("aligned", "item_words", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    compared = hits.join(broadcast_if_small(long, bank_bytes), "item").select("doc_id", "h", "item_id", _best_window(agree, F.lit(window)).alias("agreeing"), F.lit(window).alias("compared"))

    seeds = write_table(short_seeds(bank, window, similarity), "short-seeds")
    lengths = sorted(r["length"] for r in seeds.select("length").distinct().collect())  # at most window - 1
    if lengths:
        placed = texts.withColumn("at", F.explode(F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))))
        placed = placed.withColumn("seed", F.explode(F.array(*(_run("words", F.col("at"), n) for n in lengths))))
        met = _meet(texts, placed, seeds.drop("length"), "short-hits").join(broadcast_if_small(bank.where(size < window), bank_bytes), "item")
        # written out, since a lambda would take join and explosion out of the generated stage, and copy each text at each position
        same = lambda k: F.coalesce((F.get("words", F.col("shift") + k) == F.get("item_words", F.lit(k))).cast("int"), F.lit(0))
        agreeing = sum((same(k) for k in range(1, window - 1)), same(0))
        compared = compared.unionByName(met.select("doc_id", "h", "item_id", agreeing.alias("agreeing"), size.alias("compared")))
    return compared.where(F.col("agreeing") >= F.col("compared") * similarity)


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, agreeing, compared): one row for each item that a document contains."""
    found = _found(docs, items, window, similarity)
    return found.groupBy("doc_id", "item_id").agg(F.max("agreeing").alias("agreeing"), F.max("compared").alias("compared"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, least: int = 1) -> DataFrame:
    """docs without those that contain an item of at least so many tokens, columns unchanged.

    What goes is named by doc_id and hash of the text, so a clean row that shares a doc_id stays.  A
    row travels as one struct, so its columns may have any names.
    """
    items = items.where(F.size(tokens(F.col("text"))) >= least)
    found = write_table(_found(docs, items, window, similarity).select("doc_id", F.col("h").alias("hash")).distinct(), "leaked")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("h"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("hash"))
    return rows.join(broadcast_if_small(found, 64), same, "left_anti").select("row.*")
