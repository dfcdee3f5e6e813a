from millrace.operators import tasks as K


def test_best_per_task_sorts_no_rows_of_pairs(spark):
    rows = [(1, "a", 2, 9), (1, "a", 3, 8), (1, "a", 3, 7), (1, "b", 1, 5), (2, "a", 3, 8)]
    df = K.best_per_task(spark.createDataFrame(rows, "q int, task string, score long, doc long"), "q", "task", "score", "doc")
    assert sorted((r.q, r.task, r.doc, r.score) for r in df.collect()) == [(1, "a", 7, 3), (1, "b", 5, 1), (2, "a", 8, 3)]
    plan = df._jdf.queryExecution().sparkPlan().toString()
    # the rows themselves meet in a hash table: what is nearest to the scan
    assert [x.split("(")[0].split()[-1] for x in plan.splitlines() if "Aggregate(" in x][-1] == "HashAggregate"
