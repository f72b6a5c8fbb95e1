import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import leximin as lx
from quillon.llm import pivots as pv
from quillon.llm import topn


def sets_table(spark, n=250, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            s = [x for x in rows[-1][1] if rng.random() > 0.08] + [int(rng.integers(0, 400))]
        else:
            s = rng.choice(400, rng.integers(8, 40), replace=False).tolist()
        rows.append((i * 3 + 1, [int(x) for x in s], [["A", " b"], ["a"], ["B", "c ", None, " "]][int(rng.integers(3))], "x"))
    rows += [(9001, None, ["a"], "x"), (9002, [], ["a"], "x"), (9003, [1, 2], [" "], "x"), (None, [1, 2], ["a"], "x"), (rows[0][0] + 5000, rows[0][1], rows[0][2], "x")]
    return spark.createDataFrame(rows, "id bigint, s array<bigint>, t array<string>, home string"), rows


def clean(t):
    return {x.strip().lower() for x in t or [] if x and x.strip()}


def truth(a, b, t1, t2):
    j = lambda x, y: len(x & y) / len(x | y)
    out = set()
    for r in a:
        for q in b:
            if None not in (r[0], q[0]) and r[1] and q[1] and clean(r[2]) and clean(q[2]) and j(set(r[1]), set(q[1])) >= t1 and j(clean(r[2]), clean(q[2])) >= t2:
                out.add((r[0], q[0]))
    return out


@pytest.mark.parametrize("t1,t2", [(0.7, 0.5), (0.5, 0.0), (0.9, 1.0)])
def test_all_pairs(spark, t1, t2, monkeypatch):
    monkeypatch.setattr(pv, "SLICE_ROWS", 40)
    df, rows = sets_table(spark)
    also = pv.text_tokens(F.col("t")) if t2 else None
    got = pv.similar_pairs(df, "id", F.col("s"), t1, also, t2)
    want = {p for p in truth(rows, rows, t1, t2) if p[0] < p[1]}
    if not t2:
        want |= {p for p in truth([(r[0], r[1], ["a"]) for r in rows], [(r[0], r[1], ["a"]) for r in rows], t1, 0) if p[0] < p[1]}
    found = [(r.id_a, r.id_b) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_between_tables_and_empty(spark):
    a, ra = sets_table(spark, 80, 3)
    b, rb = sets_table(spark, 90, 3)
    got = pv.similar_pairs(a, "id", F.col("s"), 0.6, pv.text_tokens(F.col("t")), 0.5, b, "id")
    assert {(r.id_a, r.id_b) for r in got.collect()} == truth(ra, rb, 0.6, 0.5)
    assert pv.similar_pairs(a.limit(0), "id", F.col("s"), 0.6).count() == 0


def test_links_and_bits(spark):
    df, rows = sets_table(spark, 60)
    classes, pairs = pv.similar_classes(df, "id", F.col("s"), 0.7)
    out = {r.id: (r.class_id, r.links) for r in pv.classes_with_links(classes, pairs).collect()}
    assert out[rows[0][0]][0] == out[rows[0][0] + 5000][0] == rows[0][0] and len(out) == 60 + 2
    bits = spark.createDataFrame([(1, (128, [-(2**63), 3])), (2, (128, [-(2**63), 3])), (3, (128, [0, 0])), (4, None)], "id int, b struct<nbits:int,words:array<bigint>>")
    assert [(r.id_a, r.id_b) for r in pv.similar_pairs(bits, "id", F.col("b"), 0.9).collect()] == [(1, 2)]


@pytest.mark.parametrize("hot", [10, 10_000])
def test_top_n(spark, hot):
    rng = np.random.default_rng(5)
    rows = [(int(g) if g >= 0 else None, int(i), float(d)) for i, (g, d) in enumerate(zip(rng.choice([-1, 0, 1, 2, 3], 800, p=[0.1, 0.6, 0.2, 0.05, 0.05]), rng.integers(0, 9, 800), strict=True))]
    df = spark.createDataFrame(rows, "g int, i int, d double")
    got = {(r.g, r.rank): r.i for r in topn.top_n(df, ["g"], [F.col("d"), F.col("i")], F.col("d"), 7, hot_rows=hot).collect()}
    want = {}
    for g in (None, 0, 1, 2, 3):
        for k, (_, i) in enumerate(sorted((d, i) for h, i, d in rows if h == g)[:7]):
            want[g, k + 1] = i
    assert got == want
    assert topn.top_n(df.limit(0), ["g"], [F.col("d"), F.col("i")], F.col("d"), 3).count() == 0
    assert topn.top_n(df, ["g"], [F.col("d"), F.col("i")], F.col("d"), 0).count() == 0


def test_latest_of_a_pair(spark):
    rows = [(1, 2, 0.5, "2020-01-01"), (1, 2, 0.9, "2021-01-01"), (1, 2, 0.1, None), (1, 3, 0.7, None), (1, 4, float("nan"), None), (1, 5, -1.0, None), (None, 5, 0.1, None), (1, None, 0.1, None), (1, 6, 0.7, None), (1, 6, 0.7, None), (1, 7, None, None)]
    df = spark.createDataFrame(rows, "id1 bigint, id2 bigint, dis double, at string").withColumn("inserted_at", F.col("at").cast("timestamp"))
    assert [(r.id2, r.dis) for r in topn.least_partners(df, 5).orderBy("rank").collect()] == [(3, 0.7), (6, 0.7), (2, 0.9)]


@pytest.mark.parametrize("crowd", [100_000, 1])
def test_leximin(spark, crowd, monkeypatch):
    monkeypatch.setattr(lx, "CROWD_ROWS", crowd)
    rng = np.random.default_rng(6)
    dim, n = 4, 60
    rows = [(i, float(rng.integers(0, 11)), int(10 ** rng.integers(0, 6)), [float(x) for x in rng.integers(-4, 5, dim)], "x") for i in range(n)]
    rows += [(n + i, *rows[i % 3][1:]) for i in range(12)]  # repeated films
    bad = [(100, None, 5, [1.0] * dim, ""), (101, 11.0, 5, [1.0] * dim, ""), (102, 5.0, -1, [1.0] * dim, ""), (103, 5.0, 5, None, ""), (104, 5.0, 5, [0.0] * dim, ""), (105, float("nan"), 5, [1.0] * dim, "")]
    films = spark.createDataFrame(rows + bad, "id bigint, rating double, num_votes bigint, plot_emb array<float>, n string")
    queries = spark.createDataFrame([(q, 5, [float(x) for x in rng.integers(-4, 5, dim)]) for q in (1, 2)], "query_id bigint, k int, query_emb array<float>")
    got = {}
    for r in lx.rank_films(films, queries, dim).collect():
        got.setdefault(r.query_id, {})[r.position] = r.id
    ok = [r for r in rows if any(r[3])]
    for q in queries.collect():
        d = {r[0]: round(sum((a - b) ** 2 for a, b in zip(r[3], q.query_emb, strict=True)), 9) for r in ok}
        lv = {r[0]: sorted([1 - sum(s[1] > r[1] for s in ok) / len(ok), 1 - sum(s[2] > r[2] for s in ok) / len(ok), 1 - sum(d[s[0]] < d[r[0]] for s in ok) / len(ok)]) for r in ok}
        want = sorted(lv, key=lambda i: ([-x for x in lv[i]], i))
        assert [got[q.query_id][p] for p in sorted(got[q.query_id])] == want
    assert lx.rank_films(films.limit(0), queries, dim).count() == 0
    assert lx.rank_films(films, queries.limit(0), dim).count() == 0
