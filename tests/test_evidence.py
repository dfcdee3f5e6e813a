from pyspark.sql import functions as F

from millrace.operators import evidence as E

GOOD = {
    "supported": True, "url": "https://www.example.org/a", "excerpt": "fee is 12,5 by  May", "source_text": "The fee is 12,5 by\nMay 3 in 2024", "title": "Fees", "source_title": " Fees ", "value": "12,5", "answer": "It is 12,5",
    "required": ["fee"], "delivered": ["fee"], "missing": [], "academic_year": "2024", "admission_year": None, "semester": None, "college": None, "department": None,
}
SCHEMA = ", ".join(f"{k} {'boolean' if k == 'supported' else 'array<string>' if k in ('required', 'delivered', 'missing') else 'string'}" for k in GOOD)


def failed(spark, *changes):
    rows = [tuple({**GOOD, **c}[k] for k in GOOD) for c in changes]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    return [r[0] for r in df.select(E.verdict({k: F.col(k) for k in GOOD}, ("example.org",))).collect()]


def test_each_rule_names_its_verdict(spark):
    cases = {
        "unsupported": {"supported": False}, "unapproved_domain": {"url": "https://example.org.evil.net"}, "excerpt_not_in_source": {"excerpt": "other"}, "source_title_mismatch": {"title": "Dues"},
        "fact_number_not_in_evidence": {"value": "13"}, "answer_number_not_in_evidence": {"answer": "room 7"}, "required_fact_unaccounted": {"required": ["fee", "place"]}, "academic_year_mismatch": {"academic_year": "2025"},
        "admission_year_mismatch": {"admission_year": "2020"}, "semester_mismatch": {"semester": "term 2"}, "college_mismatch": {"college": "Arts"}, "department_mismatch": {"department": "Law"}, "unsafe_output": {"answer": "sudo it"},
    }
    assert failed(spark, *cases.values()) == list(cases)
    # the earlier rule wins, named gaps and numbers after letters are no faults
    assert failed(spark, {}, {"supported": False, "title": "x"}, {"required": ["place"], "missing": ["place"]}, {"answer": "A4 paper"}) == [None, "unsupported", None, None]


def test_nulls_have_a_verdict(spark):
    assert failed(spark, {"supported": None}, {"url": None}, {"source_text": None}, {"title": None}, {"value": None, "answer": None, "required": None, "delivered": None, "missing": None}) == ["unsupported", "unapproved_domain", "excerpt_not_in_source", "source_title_mismatch", None]


def test_negative_entries_expire_earlier():
    import datetime as dt

    import pandas as pd

    from millrace.streaming.streams import replay

    at = lambda s: pd.Timestamp(dt.datetime(2024, 1, 1, 0, 0, s))
    pdf = pd.DataFrame({"ts": [at(0), at(4), at(6), at(15), at(30), None], "found": [False, True, True, True, None, True]})
    assert replay(pdf, None, 10.0, 5.0)[0] == ["miss", "hit", "miss", "hit", "miss", "miss"]
    assert replay(pdf, None, 10.0)[0] == ["miss", "hit", "hit", "miss", "miss", "miss"]


def test_drain_leaves_the_setting_alone(spark, tmp_path):
    from millrace.streaming import streams as S

    spark.range(3).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get(S.IDLE)
    assert S.drain(S.source(spark, f"{tmp_path}/in"), "idle-test", idle=False).count() == 3
    assert spark.conf.get(S.IDLE) == before
