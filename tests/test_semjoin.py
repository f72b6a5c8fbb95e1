import numpy as np
import pytest

from quillon.operators import semjoin as S


def tables(spark):
    rng = np.random.default_rng(1)
    m = np.concatenate([rng.normal(0, 0.2, (60, 4)) + s for s in (0, 3, 9)]).round(3)
    left = [(i, [float(x) for x in v], "l") for i, v in enumerate(m[::2])]
    right = [(i, [float(x) for x in v], "r") for i, v in enumerate(m[1::2])]
    bad = [(900, None, "x"), (901, [1.0, 2.0, 3.0], "x"), (902, [1.0] * 5, "x"), (903, [float("nan")] * 4, "x"), (904, [None, 1.0, 1.0, 1.0], "x"), (None, [0.0] * 4, "x"), (905, [], "x")]
    kind = "id bigint, v array<float>, dis string"
    return spark.createDataFrame(left + bad, kind), spark.createDataFrame(right + bad, kind), np.float32(m[::2]), np.float32(m[1::2])


@pytest.mark.parametrize("small", [4096, 7])
def test_ragged_rows_and_bands(spark, monkeypatch, small):
    """With small blocks the norm bands are used; wrong lengths and broken values join nothing."""
    monkeypatch.setattr(S, "SMALL_ROWS", small)
    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    left, right, a, b = tables(spark)
    d = np.sqrt(((a[:, None].astype(float) - b[None]) ** 2).sum(2))
    got = {(r.l_id, r.r_id) for r in S.pairs(left, "id", "v", right, "id", "v", 0.4).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 0.4), strict=True)} and got
    near = {(r.l_id, r.r_id): r["rank"] for r in S.pairs(left, "id", "v", right, "id", "v", 0.4, k=2).collect()}
    want = {(i, int(j)): k + 1 for i in range(len(a)) for k, j in enumerate(np.lexsort((np.arange(len(b)), d[i]))[:2]) if d[i, j] <= 0.4}
    assert near == want
    assert S.pairs(left.limit(0), "id", "v", right, "id", "v", 0.4).count() == 0 == S.pairs(left, "id", "v", right.limit(0), "id", "v", 0.4).count()


def test_bands_leave_out_far_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    left, right, *_ = tables(spark)
    lx, rx = S._usable(left, "id", "v", 4), S._usable(right, "id", "v", 4)
    width, lefts, rights = S._band_plan(lx, rx, 0.4)
    assert width == pytest.approx(0.4) and sum(lefts.values()) >= 90 // 7
    sent = S._spread_bands(lx, True, width, lefts, rights).count()
    assert sent < 0.75 * lx.count() * -(-rx.count() // 7)


def test_chain_and_verified_join(spark):
    x = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1)], "a bigint, b bigint")
    assert sorted(map(tuple, S.chain(x, x).collect())) == [(1, 2, 3), (1, 3, 1), (2, 3, 1), (3, 1, 2), (3, 1, 3)]
    full = S.chain(x, x, x).groupBy("n0").count().collect()
    assert {r.n0: r.n for r in S.chain_counts(x, x, x).collect()} == {r.n0: r["count"] for r in full}
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, t string"), spark.createDataFrame([(7, "A"), (8, "z")], "k bigint, t string")
    ask = lambda p, prompt: p.selectExpr("l_id", "r_id", "upper(l_t) = r_t as verdict")
    every = spark.createDataFrame([(i, j) for i in (1, 2) for j in (7, 8)] * 2, "l_id bigint, r_id bigint")
    out = S.verified_join(left, "id", right, "k", every, "same letter?", ask, "left_outer")
    assert sorted(map(tuple, out.collect())) == [(1, 7), (2, None)]
    assert S.verified_join(left, "id", right, "k", every, "", ask).count() == 1
