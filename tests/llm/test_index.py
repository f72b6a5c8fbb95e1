import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import index as ix
from quillon.llm import linkage as lk
from quillon.llm.vectors import pack, sound_rows, unpack

DIM = 32


def make(n=600, seed=0):
    """Groups of close vectors, copies, and broken ones, on a grid."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-8, 9, (n // 3, DIM))
    m = np.repeat(base, 3, 0) + rng.integers(-1, 2, (n // 3 * 3, DIM)) * (rng.random((n // 3 * 3, DIM)) < 0.1)
    m[: n // 6] = m[0]  # copies of one vector
    return m / 16.0


@pytest.fixture(scope="module")
def table(spark):
    m = make()
    rows = [(int(i * 7 % 1000), [float(x) for x in v], "x") for i, v in enumerate(m)]
    bad = [(5001, None, "x"), (5002, [0.0] * DIM, "x"), (5003, [1.0] * (DIM - 1), "x"), (5004, [float("nan")] * DIM, "x"), (5005, [None] + [1.0] * (DIM - 1), "x"), (None, [1.0] * DIM, "x")]
    df = spark.createDataFrame(rows + bad, "id bigint, v array<float>, rank string").repartition(4).cache()
    ids = np.array([r[0] for r in rows])
    o = np.argsort(ids)
    return df, ids[o], m[o]


def brute(ids, m, k, limit=None):
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    out = set()
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (d[i, j], ids[j]))[:k]:
            if i != j and (limit is None or d[i, j] <= limit):
                out.add((int(ids[i]), int(ids[j])))
    return out


def test_all_cells_is_exact(spark, table):
    df, ids, m = table
    got = {(r.query_id, r.id) for r in ix.similar_rows(df, "id", "v", DIM, 5, least_share=2.0, least_cells=10**6).collect()}
    assert got == brute(ids, m, 5)


def test_recall_and_close_pairs(spark, table):
    df, ids, m = table
    want = brute(ids, m, 5)
    got = {(r.query_id, r.id) for r in ix.similar_rows(df, "id", "v", DIM, 5, asks=F.col("id") % 5 == 0, least_cells=8, least_share=0.3).collect()}
    asked = {p for p in want if p[0] % 5 == 0}
    assert len(got & asked) >= 0.9 * len(asked) and all(a % 5 == 0 for a, _ in got)
    pairs = {(r.id_a, r.id_b) for r in ix.close_pairs(df, "id", "v", DIM, 5, 0.5).collect()}
    truth = {(min(p), max(p)) for p in brute(ids, m, 5, 0.5)}
    assert pairs <= truth and len(pairs) >= 0.95 * len(truth)


def test_large_cells_are_cut_without_loss(spark, table, monkeypatch):
    df, ids, m = table
    monkeypatch.setattr(ix, "GROUP_ROWS", 20)
    monkeypatch.setattr(ix, "SLICE_ROWS", 10)
    got = {(r.query_id, r.id) for r in ix.similar_rows(df, "id", "v", DIM, 5, least_share=2.0, least_cells=10**6).collect()}
    assert got == brute(ids, m, 5)


def test_no_cell_is_lost_however_small_the_sample(spark, table, monkeypatch):
    """Codebooks of a few rows, queries that are a part of the rows: every cell is known and can be visited."""
    df, ids, m = table
    monkeypatch.setattr(ix, "SAMPLE_ROWS", 30)
    want = {p for p in brute(ids, m, 5) if p[0] % 5 == 0}
    ask = {"asks": F.col("id") % 5 == 0}
    books = ix.fit(df, "id", "v", DIM)
    assert len(books.first) < 20
    got = {(r.query_id, r.id) for r in ix.similar_rows(df, "id", "v", DIM, 5, least_cells=10**6, **ask).collect()}
    assert got == want


def test_cells_come_in_order(spark):
    rng = np.random.default_rng(8)
    for _ in range(20):
        d1, d2, cells = rng.random(9), rng.random(7), rng.integers(0, 3, (9, 7)) * (rng.random((9, 7)) < 0.4)
        cells[3, 2] = 1
        full = [(d1[i] + d2[j], (i, j)) for i, j in zip(*np.nonzero(cells), strict=True) if (i, j) != (3, 2)]
        got = ix.traverse(d1, d2, cells, (3, 2), 10**6, 0)
        assert got == [(3, 2)] + [c for _, c in sorted(full)]
        assert ix.traverse(d1, d2, cells, (3, 2), 4, 0) == got[:4]


def test_equal_links_have_one_order(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(-(2**62), 2**62, 200), rng.integers(0, 2**40, 200)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a bigint, b bigint")
    for r in (0, 3, 1000):
        assert [x.h for x in df.select(lk._order_sql("a", "b", r).alias("h")).collect()] == lk._order(a, b, r).tolist()


def test_crowds_of_ties_merge_alike_in_a_task_and_over_dataframes(spark, monkeypatch):
    """A ring of equal steps: only the order of equal links decides who pairs with whom."""
    turn = np.arange(7) * 2 * np.pi / 7
    m = np.stack([np.cos(turn), np.sin(turn)], 1).astype(np.float32)
    nodes = spark.createDataFrame([(i, 1, p) for i, p in enumerate(pack(m))], "c bigint, n bigint, packed binary")
    links = spark.createDataFrame([(min(a, b), max(a, b), 0.75) for a in range(7) for b in [(a + 1) % 7]], "a bigint, b bigint, d2 double")
    got = []
    for local in (2000, 1):
        monkeypatch.setattr(lk, "LOCAL_NODES", local)
        monkeypatch.setattr(lk, "crowds", lambda states, labels, dim, threshold: states.limit(0))  # else the ring is one cluster at once
        members, _ = lk.link_clusters(nodes, links, 2, 0.9)
        got.append({r.member: r.cluster for r in members.collect()})
    assert got[0] == got[1] and 1 < len(set(got[0].values())) < 7


def test_empty_and_broken(spark, table):
    df = table[0]
    assert ix.similar_rows(df.limit(0), "id", "v", DIM, 5).count() == 0
    assert ix.close_pairs(df.filter("id > 5000"), "id", "v", DIM, 5, 1.0).count() == 0
    rows, _, _ = lk.clusters(df.filter("id > 5000"), "id", "v", DIM, 0.5)
    assert rows.count() == 0


def test_packing_is_lossless():
    rng = np.random.default_rng(2)
    for m in (rng.integers(-9, 9, (5, 8)) / 64, rng.integers(-9000, 9000, (5, 8)) / 64, rng.random((5, 8)), np.vstack([rng.random((1, 8)), np.ones((2, 8))])):
        m = m.astype(np.float32)
        assert (unpack(pack(m), 8) == m).all()
    import pyarrow as pa

    idx, m = sound_rows(pa.array([[1.0, 2.0], None, [0.0, 0.0], [1.0], [float("nan"), 1.0]], pa.list_(pa.float32())), 2)
    assert idx.tolist() == [0] and m.tolist() == [[1.0, 2.0]]


def linkage_brute(ids, m, threshold):
    """Average linkage (mean squared distance) over all pairs, one merge at a time."""
    d = ((m[:, None] - m[None]) ** 2).sum(2)
    groups = [[i] for i in range(len(ids))]
    while True:
        best = min(((d[np.ix_(a, b)].mean(), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y), default=(9, 0, 0))
        if best[0] > threshold**2:
            return {int(ids[i]): int(min(ids[g])) for g in groups for i in g}
        groups[best[1]] += groups.pop(best[2])


@pytest.mark.parametrize("local", [2000, 0])
def test_clusters(spark, monkeypatch, local):
    rng = np.random.default_rng(4)
    sizes = (1, 2, 3, 5, 8, 13, 1, 4, 6) if local else (1, 2, 3, 5)  # rounds over DataFrames take seconds each
    m = np.concatenate([c + rng.integers(-1, 2, (s, 8)) / 32 for c, s in zip(rng.integers(-40, 40, (len(sizes), 8)), sizes, strict=True)])
    ids = rng.permutation(1000)[: len(m)]
    monkeypatch.setattr(lk, "LOCAL_NODES", local or 1)
    df = spark.createDataFrame([(int(i), [float(x) for x in v], 1) for i, v in zip(ids, m, strict=True)] + [(9999, None, 1)], "id bigint, v array<float>, cluster int")
    rows, states, index = lk.clusters(df, "id", "v", 8, 0.6)
    got = {r.id: r.cluster_id for r in rows.collect()}
    assert got == linkage_brute(ids, m, 0.6)
    told = {r.cluster_id: r for r in lk.describe(rows, states, index, 8, 3).collect()}
    for c, r in told.items():
        own = np.flatnonzero([got[int(i)] == c for i in ids])
        far = np.sqrt(((m[own] - m[own].mean(0)) ** 2).sum(1)).round(6)
        assert r["size"] == len(own) and list(r.typical) == [int(ids[own[j]]) for j in sorted(range(len(own)), key=lambda j: (far[j], ids[own[j]]))[:3]]


def _link_clusters(spark, monkeypatch, scale, local):
    """Orthogonal vectors of the lengths `scale`, each linked to its nearest 6, the least: the least is everyone's best partner, so that each round merges one vector."""
    m = np.diag(scale).astype(np.float32)
    pairs = sorted({(a, b) for b in range(1, len(m)) for a in range(min(6, b))})
    nodes = spark.createDataFrame([(i, 1, p) for i, p in enumerate(pack(m))], "c bigint, n bigint, packed binary")
    links = spark.createDataFrame([(a, b, float(((m[a] - m[b]) ** 2).sum())) for a, b in pairs], "a bigint, b bigint, d2 double")
    monkeypatch.setattr(lk, "LOCAL_NODES", local)
    members, states = lk.link_clusters(nodes, links, len(m), 0.6)
    return {r.member: r.cluster for r in members.collect()}, {r.c: r.n for r in states.collect()}


def test_large_crowd_is_merged_whole(spark, monkeypatch):
    got, states = _link_clusters(spark, monkeypatch, np.linspace(0.05, 0.25, 220), 50)  # 219 rounds by mutual choices
    assert set(got.values()) == {0} and len(got) == 220 and states == {0: 220}


def test_large_loose_component_goes_on_in_a_task(spark, monkeypatch):
    scale = np.linspace(0.3, 0.5, 30)  # too wide for the bound of a crowd; the longest stay out
    want = _link_clusters(spark, monkeypatch, scale, 2000)
    assert 1 < len(set(want[0].values())) < 15 and _link_clusters(spark, monkeypatch, scale, 27) == want
