import pytest
from pyspark.sql import functions as F

from millrace.functions.text import compact
from millrace.operators import gates as G
from millrace.operators import tasks as K

GROUPS = (("new", ("new student", "freshman")), ("moved", ("transfer",)))


def test_rule_tables(spark):
    rules = spark.createDataFrame([("moved", "transfer"), ("new", "freshman"), ("new", "new student"), ("new", "freshman"), (None, "x"), ("y", None)], "name string, term string")
    assert G.groups_of(rules) == [("moved", ("transfer",)), ("new", ("freshman", "new student"))]
    with pytest.raises(ValueError):
        G.groups_of(rules, most=2)


def test_scope(spark):
    rows = [("for transfer only", "apply", "how to apply"), ("for transfer and all", "apply", "how to apply"), ("all", "transfer day", "how"), ("transfer", "", "as transfer"), (None, None, None), ("", "", "")]
    df = spark.createDataFrame(rows, "text string, title string, q string")
    bits = [G.group_bits(F.col(c), GROUPS) for c in ("text", "title", "q")]
    assert [r[0] for r in df.select(G.scope_rejected(*bits, G.holds(F.col("text"), ("all",)))).collect()] == [True, False, True, False, False, False]


def test_sources(spark):
    df = spark.createDataFrame([("staff", False, False), ("staff", True, False), ("catalogue", False, True), ("catalogue", True, False), (None, True, True)], "s string, contact boolean, procedure boolean")
    rules = (("staff", "needs", "contact"), ("catalogue", "bars", "procedure"))
    asks = {"contact": F.col("contact"), "procedure": F.col("procedure")}
    assert [r[0] for r in df.select(G.source_rejected(F.col("s"), asks, rules)).collect()] == [True, False, True, False, False]


def test_identity(spark):
    df = spark.createDataFrame([(["2024", "spring", "camp", "x", "spring"], "The SPRING-camp!"), (["autumn"], "spring camp"), (["2024", "camp"], "other"), ([], "other")], "k array<string>, title string")
    terms = G.identity_terms(F.col("k"), ("camp",))
    got = [(r[0], r[1]) for r in df.select(terms, G.identity_missed(terms, compact(F.col("title")))).collect()]
    assert got == [(["spring"], False), (["autumn"], True), ([], False), ([], False)]


def test_status_and_first_reason(spark):
    df = spark.createDataFrame([("active", True), ("expired", True), ("expired", False), ("always", False), (None, True)], "s string, now boolean")
    assert [r[0] for r in df.select(G.status_score(F.col("s"), F.col("now"))).collect()] == [0.15, -0.3, 0.0, 0.12, 0.0]
    reason = G.first_reason([("over", F.col("s") == "expired"), ("now", F.col("now"))])
    assert [r[0] for r in df.select(reason).collect()] == ["now", "over", "over", None, "now"]


def test_judged_agrees_with_eligibility_of_own_rules(spark):
    rules = (("a.one", "a", 0, ("alpha",), (("alpha", "beta"),), ("draft",)), ("a.two", "a", 1, ("beta",), (), ()))
    df = spark.createDataFrame([("alpha text", "title", "a.one"), ("beta", "", "a.one"), ("alpha", "draft", "a.one"), ("none", "", "a.one"), ("none", "", "a.two"), ("alpha", "", None)], "text string, title string, task string")
    bonus, reason = K.eligibility(F.col("task"), F.col("title"), F.col("text"), rules)
    got = [(r[0], r[1]) for r in df.select(bonus, reason).collect()]
    assert got == [(0.45, "task"), (0.35, "parent"), (0.0, "excluded_title"), (0.0, "missing_terms"), (0.12, "terms"), (0.0, "no_task")]
