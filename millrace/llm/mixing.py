"""Mixing sources to target weights.

Sizes are counted per source, a target per source gives its repetition rate, and each document is
taken floor(rate) times plus one more time by a draw whose probability is the rate's fraction.  The
draw is a hash of the row; its place among the source's draws, counted in words, is uniform over the
source, and the copy is taken if that place is under the fraction.  So the words taken miss the
target by half a document at most, whatever the sizes.  The place at which a source is cut comes
from two sums over the draws (upper half, then lower half within one value), so nothing is sorted.
DataFrame functions only.

Defined results: a null or empty text has size 0 and adds no words (its copies follow the draw like
any other's); a null source is a source of its own; rows that are equal in doc_id and text draw
alike, so where such rows are many the words taken miss the target by half of them at most; an
empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import WORD, write_table

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2
SEED = "mix-1"


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """The first 32 bits of the MD5 of seed, doc_id and text, as a long."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


def rule_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, ...) with ``weight``: weights dealt in turn, by code point, null last."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))


def targets(sources: DataFrame, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """sources (source, source_size, weight) with ``target`` and ``rate``.

    share x all sizes is dealt by weight; what would pass ceiling x a source's size is reshared
    among the others.  In order of size / weight the sources that reach the ceiling come first, so
    the level of the fill is the largest of (rest of the words) / (rest of the weights).
    The table has one row a source.
    """
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum(F.col("source_size") * ceiling).over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(share) - capped) / F.sum("weight").over(onward)
    cap = (F.col("source_size") * ceiling).cast("double")
    return (
        sources.withColumn("_level", level)
        .withColumn("target", F.least(cap, F.max("_level").over(everything) * F.col("weight")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .drop("_level")
    )


def _last_under(sums: DataFrame, place: str, goal: Column, middle: bool) -> DataFrame:
    """Per source the largest place whose words before it (and half of its own, if middle) come to less than goal, with those words."""
    order = Window.partitionBy("source").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce("_start", F.lit(0)) + F.coalesce(F.sum("_words").over(order), F.lit(0))
    under = sums.withColumn("_before", before).where(F.col("_before") + (F.col("_words") / 2 if middle else F.lit(0)) < goal)
    return under.groupBy("source").agg(F.max_by(F.struct(F.col(place).alias("place"), F.col("_before").alias("before")), place).alias("_last"))


def cuts(sized: DataFrame, rates: DataFrame) -> DataFrame:
    """rates with ``cut``: rows of sized (source, size, draw) whose draw is at most cut get one more copy.

    What is ordered is one row for each source and upper or lower half of a draw (65,536 values).
    """
    upper, lower = F.shiftright("draw", 16), F.col("draw").bitwiseAND(F.lit(0xFFFF))
    goal = F.col("target") - F.floor("rate") * F.col("source_size")
    named = rates.select(F.col("source").alias("_source"), goal.alias("_goal"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    halves = sized.groupBy("source", upper.alias("upper")).agg(F.sum("size").alias("_words")).withColumn("_start", F.lit(0).cast("long"))
    at = _last_under(halves.join(named, same).drop("_source"), "upper", F.col("_goal"), False)
    at = write_table(at.select(F.col("source").alias("_at"), F.col("_last.place").alias("_upper"), F.col("_last.before").alias("_start")), "mix-upper")
    inside = sized.join(at, F.col("source").eqNullSafe(F.col("_at")) & (upper == F.col("_upper")))
    fine = inside.groupBy("source", "_upper", "_start", lower.alias("lower")).agg(F.sum("size").alias("_words"))
    last = _last_under(fine.join(named, same).drop("_source"), "lower", F.col("_goal"), True).select(F.col("source").alias("_l"), F.col("_last.place").alias("_lower"))
    found = at.join(last, F.col("_at").eqNullSafe(F.col("_l")), "left").select("_at", (F.shiftleft("_upper", 16) + F.coalesce("_lower", F.lit(-1))).alias("_cut"))
    return rates.join(found, F.col("source").eqNullSafe(F.col("_at")), "left").select(*rates.columns, F.coalesce("_cut", F.lit(-1)).cast("long").alias("cut"))


def copies(rate: Column, drawn: Column, cut: Column) -> Column:
    return (F.floor(rate) + (drawn <= cut).cast("long")).cast("long")


def _sizes(docs: DataFrame, *columns: str) -> DataFrame:
    text = F.col("text")
    return write_table(docs.select(*columns, "source", text_size(text).alias("size"), draw(F.col("doc_id"), text).alias("draw")), "mix-sizes")


def source_rates(sized: DataFrame, weights: DataFrame | None, share: float, ceiling: int) -> DataFrame:
    """One row a source: source, source_size, weight, target, rate, cut."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = rule_weights(sources)
    else:
        given = weights.select(F.col("source").alias("_source"), F.col("weight"))
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rates = write_table(targets(sources, share, ceiling), "mix-rates")
    return write_table(cuts(sized, rates), "mix-cuts")


def mix_plan(docs: DataFrame, weights: DataFrame | None = None, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, weight, target, rate, copies, taken.

    weights: (source, weight); None deals WEIGHTS by the order of the sources.  The texts are read
    once; sizes and draws are written, and the rates (one row a source) join them by a plan that
    Catalyst chooses from the written sizes.
    """
    sized = _sizes(docs, "doc_id")
    rates = source_rates(sized, weights, share, ceiling).withColumnRenamed("source", "_source")
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    taken = joined.withColumn("copies", copies(F.col("rate"), F.col("draw"), F.col("cut")))
    return taken.withColumn("taken", F.col("size") * F.col("copies")).drop("draw", "cut")


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as the mix takes it, with docs' columns.

    The texts are read twice (to count, to emit) and never shuffled while the table of rates is
    small enough to broadcast.  A row travels as one struct, so its columns may have any names.
    """
    rates = source_rates(_sizes(docs), weights, share, ceiling).select("source", "rate", "cut")
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("own"), draw(F.col("doc_id"), F.col("text")).alias("draw"))
    times = copies(F.col("rate"), F.col("draw"), F.col("cut")).cast("int")
    return rows.join(rates, F.col("own").eqNullSafe(F.col("source"))).select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")
