import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import vectors as V


def one(spark, col):
    return spark.range(1).select(col.alias("x")).head().x


def vec(*x):
    return F.array(*[F.lit(float(v)).cast("float") for v in x])


def test_distances(spark):
    a, b = vec(1, 2, 3), vec(4, 6, 3)
    assert one(spark, V.l2_distance(a, b)) == 5 and one(spark, V.inner_product(a, b)) == 25 and one(spark, V.l1_distance(a, b)) == 7
    assert np.isnan(one(spark, V.cosine_distance(vec(0, 0), vec(1, 1))))
    assert one(spark, V.cosine_distance(vec(1, 1), vec(-1, -1))) == pytest.approx(2)
    assert one(spark, V.l2_distance(F.lit(None).cast("array<float>"), b)) is None
    with pytest.raises(Exception, match="different vector dimensions"):
        one(spark, V.l2_distance(a, vec(1)))


def test_text(spark):
    p = lambda t: one(spark, V.parse_vector(F.lit(t)))
    assert p(" [ 1 , -2.5,3e1] ") == [1.0, -2.5, 30.0] and p("[1e-46]") == [0.0]
    for bad, why in (("[]", "at least 1"), ("[1,]", "invalid input"), ("[NaN]", "invalid input"), ("[4e38]", "out of range"), ("[1]x", "invalid input"), ("1,2", "invalid input")):
        with pytest.raises(Exception, match=why):
            p(bad)
    assert one(spark, V.format_vector(vec(1, 2.5))) == "[1,2.5]"
    s = one(spark, V.parse_sparse(F.lit("{3:2,1:1.5,2:0}/4")))
    assert (s.dim, s["indices"], s["values"]) == (4, [0, 2], [1.5, 2.0])
    assert one(spark, V.to_dense(V.parse_sparse(F.lit("{1:1}/3")))) == [1.0, 0.0, 0.0]
    with pytest.raises(Exception, match="out of bounds"):
        one(spark, V.parse_sparse(F.lit("{5:1}/4")))


def test_bits(spark):
    b = lambda t: V.bits_from_text(F.lit(t))
    assert one(spark, V.hamming_distance(b("0110"), b("0011"))) == 2
    assert abs(one(spark, V.jaccard_distance(b("0110"), b("0011"))) - 2 / 3) < 1e-12
    assert one(spark, V.jaccard_distance(b("0000"), b("0000"))) == 1
    with pytest.raises(Exception, match="bit lengths"):
        one(spark, V.hamming_distance(b("01"), b("011")))
    assert one(spark, V.binary_quantize(vec(1, -1, 0.5)))["words"] == [-(2**63) + 2**61]


def test_arithmetic(spark):
    with pytest.raises(Exception, match="overflow"):
        one(spark, V.add(vec(3e38), vec(3e38)))
    with pytest.raises(Exception, match="underflow"):
        one(spark, V.multiply(vec(1e-30), vec(1e-30)))
    assert one(spark, V.subvector(vec(1, 2, 3), 2, 9)) == [2.0, 3.0]
    with pytest.raises(Exception, match="at least 1"):
        one(spark, V.subvector(vec(1, 2), 3, 1))
    assert one(spark, V.l2_normalize(vec(0, 0))) == [0.0, 0.0]
    assert one(spark, V.compare(vec(1, 2), vec(1, 2, 0))) == -1
    assert one(spark, V.to_half(vec(0.1)))[0] == pytest.approx(0.0999755859375)


def test_aggregate_and_score(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (1, None), (2, None)], "k int, v array<float>")
    assert {r.k: r.a for r in V.vec_aggregate(df, ["k"], "v", "a").collect()} == {1: [2.0, 3.0], 2: None}
    got = [r.s for r in df.select(V.score(F.col("v"), [1.0, 2.0]).alias("s")).collect()]
    assert got[0] == 0 and got[2] is None
    with pytest.raises(ValueError):
        V.score(F.col("v"), [1.0], "hellinger")
