"""Containment joins by blocking on tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import TOKEN


#: Parts up to this size are broadcast; a row counts its part and ROW_BYTES for its other columns.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 256
#: Characters that block a part without an inner token.
GRAM = 4


def containment(texts: DataFrame, parts: DataFrame, text: str, part: str, key: str = "doc_id") -> DataFrame:
    """All pairs of rows where text contains part, columns of both.

    A part's first and last tokens may be cut by its ends, so its block is the longest token between
    them, which must be a whole token of the text.  A part without such a token is blocked by its first
    GRAM characters, which must stand in the text; one that is shorter still is compared with every text.
    While the parts have under BROADCAST_BYTES they are broadcast and texts are tested where they are.
    Beyond that only (key, token) rows meet the parts, and the texts join the candidates by key; the key
    need not be unique, as each text is tested.
    """
    inner = F.regexp_extract_all(part, F.lit(TOKEN), F.lit(0))
    inner = F.when(F.size(inner) > 2, F.slice(inner, F.lit(2), F.size(inner) - 2))
    block = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    blocked = parts.withColumn("_block", block)
    # a look-ahead takes every place once, in one pass over the text
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    holds = F.col(text).contains(F.col(part))
    small = (parts.agg(F.sum(F.octet_length(part) + ROW_BYTES)).first()[0] or 0) <= BROADCAST_BYTES

    def met(blocked: DataFrame, blocks) -> DataFrame:
        if small:
            return texts.withColumn("_block", F.explode(blocks)).join(F.broadcast(blocked), "_block").where(holds).drop("_block")
        candidates = texts.select(key, F.explode(blocks).alias("_block")).join(blocked, "_block").drop("_block").distinct()
        return candidates.join(texts, key).where(holds).select(*texts.columns, *parts.columns)

    rest = blocked.where("_block is null").drop("_block")
    headed = rest.where(F.length(part) >= GRAM).withColumn("_block", F.substring(part, 1, GRAM))
    bare = rest.where(F.length(part) < GRAM)
    found = met(blocked.where("_block is not null"), words)
    # grams of all texts are cut only where some part needs them
    if not rest.isEmpty():
        found = found.unionByName(met(headed, grams)).unionByName(texts.join(bare, holds))
    return found
