from millrace.plans import search_queries as S
from millrace.plans.registry import Tables


def test_a_document_is_lower_cased_once(spark):
    plan = S.candidates(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    # text and title, not once for each rule that looks into them
    assert plan.count("lower(coalesce(") == 2
