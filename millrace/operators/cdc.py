"""Change data capture on keyed snapshots: digests, classification, merging, children, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "1"


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, one a line; a null part is an empty line."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def classify(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): new, updated, skipped (same digest) or missing (only in old).

    One full outer join of two narrow projections; both sides meet by the key's hash.
    """
    a, b = old.select(F.col(key), F.col(digest).alias("_was")), new.select(F.col(key), F.col(digest).alias("_is"))
    state = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "missing").when(F.col("_was") == F.col("_is"), "skipped").otherwise("updated")
    return a.join(b, key, "full").select(key, state.alias("state"))


def merged(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table after the new snapshot is applied: new values win, rows that are gone stay, archived."""
    a = old.select(F.col(key), F.struct(*columns).alias("_was"))
    b = new.select(F.col(key), F.struct(*columns).alias("_is"))
    value = F.coalesce("_is", "_was")
    return a.join(b, key, "full").select(key, *(value[c].alias(c) for c in columns), F.col("_is").isNull().alias("archived"))


def missing(old: DataFrame, new: DataFrame, key: str, complete: bool = True) -> DataFrame:
    """Keys to archive: in old and not in new, if the listing was complete and not empty."""
    if not complete:
        return old.select(key).where(F.lit(False))
    # an empty listing archives nothing: one row of new is enough to know
    seen = new.select(F.lit(True).alias("_any")).limit(1)
    return old.select(key).join(new.select(key), key, "left_anti").join(F.broadcast(seen)).select(key)


def replace_children(children: DataFrame, fresh: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Children of unchanged parents as they are, those of changed parents from fresh."""
    keys = changed.select(key)
    return children.join(keys, key, "left_anti").unionByName(fresh.join(keys, key, "left_semi"))


def published(old: DataFrame, new: DataFrame, key: str, value: str, verified: str) -> DataFrame:
    """The generation to show: the new one once it is verified, the old one until then."""
    a = old.select(F.col(key), F.col(value).alias("_was"))
    b = new.select(F.col(key), F.col(value).alias("_is"), F.col(verified).alias("_ok"))
    fresh = F.coalesce("_ok", F.lit(False)) & F.col("_is").isNotNull()
    return a.join(b, key, "full").select(
        key, F.when(fresh, F.col("_is")).otherwise(F.col("_was")).alias(value), F.when(fresh, "new").when(F.col("_was").isNotNull(), "old").otherwise("none").alias("generation")
    )


