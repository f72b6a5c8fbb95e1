import pytest
from pyspark.sql import functions as F

from quillon.operators import cascade as C
from quillon.operators import evaluate as E


def test_bands_are_disjoint_and_whole(spark):
    df = spark.createDataFrame([(i, (i - 50) / 50) for i in range(101)] + [(200, 0.0), (201, 0.0)], "id bigint, s double")
    b = C.alpha_band(df, "id", "s", 0.05)
    n = {r.bucket: r.n for r in b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n["unc"] == 5 and sum(n.values()) == 103  # rint(5.15)
    assert {r.id for r in b.filter("bucket = 'unc'").collect()} == {49, 50, 51, 200, 201}
    assert {r.id for r in C.topk_band(df, "id", "s", 3).filter("bucket = 'unc'").collect()} == {98, 99, 100}


def test_cascade_and_clusters(spark):
    df = spark.createDataFrame([(1, "pos", False), (2, "unc", True), (3, "unc", False), (4, "neg", True)], "id bigint, bucket string, ok boolean")
    assert {r.id for r in C.cascade(df, "id", "?", C.column_verifier("ok")).positive.collect()} == {1, 2}
    texts = spark.createDataFrame([(1, "unc", "yes"), (2, "unc", "no")], "id bigint, bucket string, t string")
    v = C.batch_verifier(lambda t, p: [x == "yes" for x in t], "id", "t")
    assert {r.id for r in C.cascade(texts, "id", "?", v).positive.collect()} == {1}
    nodes = spark.range(6).withColumnRenamed("id", "k")
    edges = spark.createDataFrame([(1, 0), (1, 2), (4, 5)], "a bigint, b bigint")
    assert {(r.k, r.cluster) for r in C.single_link_clusters(nodes, "k", edges).collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 4)}
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.99, 0.1], 0), (3, [0.0, 1.0], 0)], "id bigint, v array<double>, g int")
    assert {(r.id, r.cluster) for r in C.complete_link_clusters(v, "id", "v", "g", 0.1).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_measures(spark):
    f, t = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(2,), (3,), (4,), (5,)], "k int")
    s = E.set_scores(f, t, ["k"]).head()
    assert (s.precision, s.recall) == (2 / 3, 0.5) and E.set_scores(f.limit(0), t.limit(0), ["k"]).head().f1 == 1
    x = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 5), (5, 4)], "a int, b int")
    assert E.spearman(x, "a", "b").head()[0] == pytest.approx(0.9) and E.kendall(x, "a", "b").head()[0] == pytest.approx(0.8)
    c = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1), (1, 0)], "f int, t int")
    assert E.adjusted_rand(c, "f", "t").head()[0] == pytest.approx(1 / 6)
    assert E.macro_f1(c, "f", "t").head()[0] == pytest.approx(0.8)
    a = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "i int, c int")
    assert E.omega_index(a, a, "i", "c").head()[0] == pytest.approx(1)
    assert E.closeness(None, 3) == 0.5 and E.relative_error(2, 4) == 0.5
    q = spark.createDataFrame([(1, 0.1), (1, 0.5)], "query_id int, score double")
    assert E.boundary_recall(q, spark.createDataFrame([(1, 0.1), (1, 0.2)], "query_id int, score double")).head()[0] == 0.5
