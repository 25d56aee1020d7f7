from tidemark.operators import relational as R


def test_group_means_need_no_window(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), (None, 1.0), (None, 5.0), ("c", None)], "g string, v double")
    out = R.above_group_mean(df, "g", "v")
    assert sorted(map(str, out.collect())) == sorted(["Row(g='a', v=3.0)", "Row(g=None, v=5.0)"])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
