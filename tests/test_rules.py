"""Compiled rules against a slow reading of the table."""

import random
import tracemalloc

import ahocorasick
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators.rules import _all_bits, compiled

SCHEMA = "rule string, kind string, term string, turn int"


def slow(rows, text):
    """Rules met, in order, by looking for each term on its own."""
    text, out = (text or "").lower(), []
    kinds = {}
    for rule, kind, term, turn in rows:
        if rule and kind and term:
            kinds.setdefault((turn, rule), {}).setdefault(kind, []).append(term.lower())
    for (_, rule), k in sorted(kinds.items(), key=lambda x: x[0]):
        held = {kind: any(t in text for t in terms) for kind, terms in k.items()}
        if all(h if kind.startswith("any") else not h for kind, h in held.items()):
            out.append(rule)
    return out


@pytest.mark.parametrize("n", [3, 150])
def test_many_rules_against_a_slow_reading(spark, n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abÄß ") for _ in range(rng.randint(1, 3)))
    rows = []
    for r in range(n):
        kinds = {f"any{i}" for i in range(rng.randint(0, 3))} | ({"not"} if rng.random() < 0.5 else set()) or {"any"}
        rows += [(f"r{r}", k, word(), r) for k in sorted(kinds) for _ in range(rng.randint(1, 3))]
    texts = ["".join(rng.choice("abÄßA ") for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", None]
    rules = compiled(spark.createDataFrame([*rows, (None, "any", "a", 0), ("r", None, "a", 0), ("r", "any", "", 0), rows[0]], SCHEMA))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", rules.read(F.col("text")).alias("b"))
    got = df.select("i", rules.all(F.col("b")).alias("all"), rules.first(F.col("b")).alias("first")).orderBy("i").collect()
    for r, text in zip(got, texts, strict=True):
        want = slow(rows, text)
        assert (r["all"], r["first"]) == (want, want[0] if want else None)


def test_one_read_for_all_rules(spark):
    rules = compiled(spark.createDataFrame([(f"p.{i}", "any", f"t{i}", i) for i in range(100)], SCHEMA))
    df = spark.createDataFrame([("t7 t70 t99",)], "text string").select(rules.read(F.col("text")).alias("b")).select(rules.all(F.col("b"), "p.").alias("x"), rules.first(F.col("b"), "p."))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert df.first()[0] == ["7", "9", "70", "99"]


def test_too_many_rows_and_an_empty_table(spark):
    with pytest.raises(ValueError):
        compiled(spark.range(20).selectExpr("'r' AS rule", "'any' AS kind", "string(id) AS term", "1 AS turn"), most=10)
    none = compiled(spark.createDataFrame([], SCHEMA))
    df = spark.createDataFrame([("a",)], "text string").select(none.read(F.col("text")).alias("b"))
    assert df.select(none.all(F.col("b")), none.first(F.col("b")), none.has(F.col("b"), "r", "any")).first()[:] == ([], None, False)


def test_a_batch_is_read_a_text_at_a_time():
    """40 MB of texts are no 40 MB of Python objects."""
    automaton = ahocorasick.Automaton()
    automaton.add_word("term", (0, 3))
    automaton.make_automaton()
    texts = pa.array(["no " * 1400, "a term " * 600] * 5000)
    tracemalloc.start()
    try:
        made = _all_bits(automaton, texts, 1)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert made.to_pylist() == [[0], [9]] * 5000 and peak < 4
