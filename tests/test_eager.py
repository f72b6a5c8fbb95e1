from pyspark.sql import functions as F

from quillon.operators import eager

PAIRS = "k bigint, x double, x2 string"


def test_matches_the_full_join(spark):
    left = spark.createDataFrame([(1, 2.0, "a")] * 5 + [(1, None, "b"), (2, 7.0, "c"), (None, 1.0, "d"), (3, 4.0, None)], PAIRS)
    right = spark.createDataFrame([(1, 10.0, "r"), (1, 20.0, "s"), (2, None, "t"), (None, 5.0, "u"), (9, 9.0, "v")], PAIRS)
    got = eager.eager_join_aggregate(left, right, F.col("k"), F.col("k"), sums={"total": F.col("x")}, least={"lo": F.col("x")}, right_sums={"rt": F.col("x")}, right_greatest={"hi": F.col("x")}, how="left")
    full = left.alias("l").join(right.alias("r"), F.col("l.k") == F.col("r.k"), "left").filter("l.k is not null").groupBy(F.col("l.k").alias("key")).agg(F.count(F.lit(1)).alias("joined_rows"), F.sum("l.x").alias("total"), F.sum("r.x").alias("rt"), F.min("l.x").alias("lo"), F.max("r.x").alias("hi"))
    cols = ["key", "joined_rows", "total", "rt", "lo", "hi"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, full.select(cols).collect()))
    assert {r.key: r.left_rows for r in got.collect()} == {1: 6, 2: 1, 3: 1}


def test_inner_roll_up_heavy_and_empty(spark):
    left = spark.createDataFrame([(i % 3, float(i), "") for i in range(30)], PAIRS)
    right = spark.createDataFrame([(0, 1.0, ""), (1, 1.0, "")], PAIRS)
    s = eager.eager_join_aggregate(left, right, F.col("k"), F.col("k"), sums={"t": F.col("x")}, how="inner")
    assert eager.roll_up(s, [F.lit(1).alias("all")], sums=["t"]).head().left_rows == 20
    assert {r.key for r in eager.heavy_keys(s, 0.3, left.agg(F.count(F.lit(1)).alias("all_rows"))).collect()} == {0, 1}
    assert {(r.right_rows, r.left_rows) for r in s.collect()} == {(1, 10)}
    plan = eager.heavy_keys(s, 0.3, left.agg(F.count(F.lit(1)).alias("all_rows")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan  # the heavy keys come out of the join of the two states
    empty = left.limit(0)
    assert eager.eager_join_aggregate(empty, right, F.col("k"), F.col("k")).count() == 0
    assert eager.eager_join_aggregate(left, empty, F.col("k"), F.col("k")).count() == 3
