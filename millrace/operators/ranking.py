"""Ranking: top-k per query, blends, fusion, measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, LIMIT = 0.34, 5
RESCUE = 0.49


def rounded(score: Column, digits: int = 5) -> Column:
    """Half up, by the nearest double of score * 10**digits, so that a sum whose exact value is a tie goes up although its double lies a trifle below."""
    return F.round(score * F.lit(10.0**digits)) / F.lit(10.0**digits)


def top(scored: DataFrame, query: str, order: list[Column], limit: int = LIMIT) -> DataFrame:
    """The first rows of each query with their ``place``; groups are cut in the tasks before the shuffle."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("place") <= limit)


def rescue(rows: DataFrame, supported: Column, cosine: Column, least: float = RESCUE) -> DataFrame:
    """Rows with keyword support, and those without whose cosine is at least the bound."""
    return rows.where(supported | (cosine >= least))


def blend(judged: DataFrame, query: str) -> DataFrame:
    """judged (score, relevance, rejected): 0.7 score + 0.3 relevance; without what is rejected or under 0.3, unless nothing is left."""
    keep = ~F.col("rejected") & (F.col("relevance") >= 0.3)
    some = F.max(keep).over(Window.partitionBy(query))
    rows = judged.withColumn("_keep", keep).withColumn("_some", some).where("_keep OR NOT _some")
    mixed = F.when(F.col("_some"), 0.7 * F.col("score") + 0.3 * F.col("relevance")).otherwise(F.col("score"))
    return rows.withColumn("score", mixed).drop("_keep", "_some")


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, keys: list[str], k: int = 60) -> DataFrame:
    """keys and score: the sum of 1 / (k + r) over both rankings (column r)."""
    part = lambda c: F.coalesce(F.lit(1.0) / (k + F.col(c)), F.lit(0.0))
    both = a.withColumnRenamed("r", "_a").join(b.withColumnRenamed("r", "_b"), keys, "full")
    return both.select(*keys, (part("_a") + part("_b")).alias("score"))


def retrieval_measures(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """hits (query_id, place, hit), relevant (query_id, relevant): recall, mrr, hit and ndcg at k."""
    gain = F.lit(1.0) / F.log2(F.col("place") + 1)
    seen = hits.groupBy("query_id").agg(
        F.count_if("hit").alias("n"), F.min(F.when(F.col("hit"), F.col("place"))).alias("first"), F.bool_or("hit").alias("hit"), F.coalesce(F.sum(F.when(F.col("hit"), gain)), F.lit(0.0)).alias("dcg")
    )
    most = F.least("relevant", F.lit(k))
    ideal = F.aggregate(F.when(most >= 1, F.sequence(F.lit(1), most.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + 1))
    return seen.join(relevant, "query_id").select(
        "query_id", F.round(F.col("n") / F.greatest(most, F.lit(1)), 6).alias("recall"), F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("mrr"), "hit", F.round(F.col("dcg") / F.greatest(ideal, F.lit(1e-9)), 6).alias("ndcg")
    )
