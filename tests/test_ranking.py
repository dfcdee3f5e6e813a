from pyspark.sql import functions as F

from millrace.operators import ranking as R


def test_scores_whose_exact_value_is_a_tie_go_up(spark):
    # 0.1725 * 0.05 + 0.2 * 0.32 + 0.28 is 0.352625 exactly; its double is 0.35262499999999997
    rows = spark.createDataFrame([(0.35262499999999997, 0.35263), (0.43627499999999997, 0.43628), (0.352624, 0.35262), (-0.352625, -0.35263), (0.0, 0.0)], "x double, want double")
    assert all(r.got == r.want for r in rows.select(R.rounded(F.col("x")).alias("got"), "want").collect())
