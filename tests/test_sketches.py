import numpy as np
import pytest

from quillon.operators import semjoin as S
from quillon.operators import sketches as K

DIM = 256


def rows(rng, n, near=None):
    """Grid vectors of few directions and some noise; some close to those of `near`, some equal, some zero."""
    m = rng.normal(0, 1, (n, 24)) @ np.random.default_rng(5).normal(0, 0.06, (24, DIM)) + rng.normal(0, 0.01, (n, DIM))
    if near is not None:
        m[: n // 4] = near[: n // 4] + rng.normal(0, 0.02, (n // 4, DIM))
        m[n // 4 : n // 3] = near[n // 4 : n // 3]
    m = np.round(m * 64) / 64
    m[-5:] = 0
    return m.astype(np.float32)


def written(spark):
    """Bytes of shuffle files of all stages so far."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(S, "SMALL_ROWS", 50)
    monkeypatch.setattr(S, "BLOCK_ROWS", 40)
    monkeypatch.setattr(K, "MOST_SHARE", 0.02)


def tables(spark):
    rng = np.random.default_rng(3)
    a = rows(rng, 480)
    b = rows(rng, 520, a)
    bad = [(900, None), (901, [1.0, 2.0]), (902, [float("nan")] * DIM), (903, [None] + [0.0] * (DIM - 1)), (None, [0.0] * DIM), (904, [float("inf")] + [0.0] * (DIM - 1))]
    make = lambda m: spark.createDataFrame([(i % 470, [float(x) for x in v]) for i, v in enumerate(m)] + bad, "id bigint, v array<float>")
    return make(a), make(b), a, b


@pytest.mark.parametrize("tau", [0.0, 0.4, 0.6])
def test_long_vectors_are_sent_once(spark, small, tau):
    """All pairs come out, of repeated ids and equal vectors too, and the vectors don't travel with each block."""
    left, right, a, b = tables(spark)
    d = np.sqrt(((a[:, None].astype(float) - b[None]) ** 2).sum(2))
    before = written(spark)
    got = sorted((r.l_id, r.r_id, r.dis) for r in S.pairs(left, "id", "v", right, "id", "v", tau, dim=DIM).collect())
    sent = written(spark) - before
    i, j = np.nonzero(d <= tau)
    assert len(got) > 25 and got == sorted(zip((i % 470).tolist(), (j % 470).tolist(), d[i, j].tolist(), strict=True))
    assert sent < a.nbytes + b.nbytes
    open_end = [r for r in S.pairs(left, "id", "v", right, "id", "v", tau, inclusive=False, dim=DIM).collect()]
    assert len(open_end) == (d < tau).sum()


def test_nearest_and_self_join(spark, small):
    left, right, a, _ = tables(spark)
    d = np.sqrt(((a[:, None].astype(float) - a[None]) ** 2).sum(2))
    one = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(a)], "id bigint, v array<float>")
    got = {(r.l_id, r.r_id) for r in S.pairs(one, "id", "v", one, "id", "v", 0.9, self_join=True).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 0.9), strict=True) if i < j} and got
    near = {(r.l_id, r.r_id): r["rank"] for r in S.pairs(one, "id", "v", one, "id", "v", 0.9, k=2, self_join=True).collect()}
    np.fill_diagonal(d, np.inf)
    assert near == {(i, int(j)): k + 1 for i in range(len(a)) for k, j in enumerate(np.lexsort((np.arange(len(a)), d[i]))[:2]) if d[i, j] <= 0.9}


def test_codes_never_part_near_vectors():
    """Vectors at exactly tau, huge ones, and ones unlike the sample have codes within the bound."""
    rng = np.random.default_rng(8)
    a, b = rows(rng, 400), rows(rng, 400)
    s = K.fit(a, b, 0.5)
    assert s is not None and len(list(K.near(s.codes(a), s.codes(b), s.bound))) < 400
    for size in (1e-3, 1, 1e3, 1e6, 1e12, 1e30):
        x = (rng.normal(0, size, (300, DIM)) + a[:300]).astype(np.float32)
        step = rng.normal(0, 1, (300, DIM)) * rng.choice([0, 1], (300, DIM), p=[0.9, 0.1])
        y = (x + 0.4999 * step / np.sqrt((step**2).sum(1))[:, None]).astype(np.float32)
        ok = np.sqrt(((x.astype(float) - y) ** 2).sum(1)) <= 0.5
        p, q = s.codes(x).astype(int), s.codes(y).astype(int)
        assert (((p - q) ** 2).sum(1)[ok] <= s.bound).all()
    hits = {(int(i), int(j)) for x, y in K.near(s.codes(a), s.codes(b), s.bound) for i, j in zip(x, y, strict=True)}
    gap = ((s.codes(a)[:, None].astype(int) - s.codes(b)[None]) ** 2).sum(2)
    assert hits == {(int(i), int(j)) for i, j in zip(*np.nonzero(gap <= s.bound), strict=True)}


def test_vectors_without_few_directions_have_no_sketch():
    m = np.random.default_rng(2).normal(0, 1, (2, 300, DIM)).astype(np.float32)
    assert K.fit(m[0], m[1], 30.0) is None and K.fit(m[0, :0], m[1], 0.5) is None


def test_pack_is_lossless():
    rng = np.random.default_rng(4)
    m = np.float32([[0, 0, 0], [1, -127, 5], [0.1, 0.2, 0.3], [1 / 64, -7 / 64, 0], [3e38, 1, 0], [1e-45, 0, 0], [128, 1, 0], [127 / 64, 0, 1 / 64], [2**-100, 0, 0]])
    m = np.concatenate([m, rng.normal(0, 1, (20, 3)).astype(np.float32), rows(rng, 30)[:, :3]])
    assert (K.unpack(K.pack(m), 3) == m).all()
