import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import predicates as P
from quillon.operators import ranks
from quillon.operators import semjoin as S
from quillon.plans import topk as K
from quillon.sources import io


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(-4, 5, (120, 6)).astype(float)
    rows = [(i, [float(x) for x in m[i]], int(i % 5), [f"t{i % 3}", "all"]) for i in range(120)] + [(500, None, 1, None)]
    return spark.createDataFrame(rows, "id bigint, v array<float>, c int, tags array<string>").cache(), m


def test_w1_w2_and_paging(spark, table):
    df, m = table
    q = tuple(m[3])
    d = np.sqrt(((m - m[3]) ** 2).sum(1))
    want = sorted(range(120), key=lambda i: (d[i], i))
    s = K.Signal("semantic", "t", "v", q)
    assert [r.id for r in K.run(K.TopKQuery(10, (s,)), {"t": df}, {"t": "id"}).collect()] == want[:10]
    p = (P.Predicate("T_hnsw", "c", "!=", 3), P.Predicate("t", "tags", "@>", ["t1", "all"]))
    query = K.TopKQuery(10, (s,), predicates=p)
    assert query.workload == "W2"
    assert [r.id for r in K.run(query, {"t": df}, {"t": "id"}).collect()] == [i for i in want if i % 5 != 3 and i % 3 == 1][:10]
    stream = K.ScoreStream(df, s.column())
    assert stream.peek_score() == 0
    assert [r.id for r in stream.fetch_topk(4)] + [r.id for r in stream.fetch_topk(4)] == want[:8]
    assert stream.next().id == want[8]


def test_query_document(spark):
    doc = {"K": 3, "scoring": {"signals": [{"type": "semantic", "table": "a", "field": "v", "query_embed": [1, 2]}, {"type": "join_distance"}], "aggregation": "sum"}, "predicates": [{"table": "a", "attribute": "c", "operator": ">", "value": 1}], "join": {"table_left": "a", "table_right": "b", "distance_threshold": 0.5}}
    q = K.TopKQuery.from_json(doc)
    assert q.workload == "W8" and q.join.distance_threshold == 0.5
    with pytest.raises(ValueError):
        K.TopKQuery.from_json(doc | {"K": 0})
    with pytest.raises(ValueError):
        P.Predicate("a", "c", "~", 1).column()


def test_pairs_blocks_and_index(spark, table, tmp_path, monkeypatch):
    df, m = table
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if d[i, j] <= 6}
    monkeypatch.setattr(S, "SMALL_ROWS", 10)
    monkeypatch.setattr(S, "BLOCK_ROWS", 50)
    got = S.pairs(df, "id", "v", df, "id", "v", 6.0, self_join=True)
    assert {(r.l_id, r.r_id) for r in got.collect()} == want
    knn = S.pairs(df, "id", "v", df, "id", "v", None, k=4, self_join=True)
    by = {}
    for r in knn.orderBy("l_id", "rank").collect():
        by.setdefault(r.l_id, []).append(r.r_id)
    assert by == {i: sorted((j for j in range(120) if j != i), key=lambda j: (d[i, j], j))[:4] for i in range(120)}
    S.write_index(got, str(tmp_path / "ti"), 1.0)
    assert {(r.l_id, r.r_id) for r in S.read_index(spark, str(tmp_path / "ti"), 5.0, 1.0, 6.0).collect()} == {p for p in want if d[p] <= 5}
    with pytest.raises(ValueError):
        S.read_index(spark, "x", 7.0, 1.0, 6.0)
    s = df.select(F.col("id").alias("l_id"), F.col("c").cast("double").alias("s"))
    near = K.progressive_pairs(str(tmp_path / "ti"), spark, s, s.withColumnRenamed("l_id", "r_id"), 5, (1.0, 1.0, 1.0), list(range(7)), 1.0)
    brute = sorted((i % 5 + j % 5 + d[i, j], i, j) for i, j in want)[:5]
    assert [(r.l_id, r.r_id) for r in near.collect()] == [(i, j) for _, i, j in brute]


def test_running_total(spark):
    df = spark.createDataFrame([(g, float(x), 2) for g in (1, 2) for x in range(500)], "g int, x double, w bigint")
    out = ranks.running_total(df, ["g"], "x", "w", "t", buckets=8)
    assert all(r.t == r.x * 2 for r in out.collect()) and out.count() == 1000
    assert ranks.running_total(df.limit(0), ["g"], "x", "w", "t").count() == 0
    assert ranks.running_total(df.limit(0), [], "x", "w", "t").count() == 0


def test_stream_upkeep(spark, table, tmp_path):
    from quillon.streaming.maintain import append_pairs

    df, m = table
    df.filter("id < 20").select("id", "v").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id bigint, v array<float>").parquet(str(tmp_path / "in"))
    append_pairs(s, "id", "v", df.filter("id >= 20"), "id", "v", str(tmp_path / "out"), str(tmp_path / "cp"), 6.0).awaitTermination()
    d = np.sqrt(((m[:20, None] - m[None, 20:]) ** 2).sum(2))
    assert spark.read.parquet(str(tmp_path / "out")).count() == (d <= 6).sum()


def test_sources(spark, tmp_path):
    np.savez(tmp_path / "e.npz", a=np.arange(6.0).reshape(2, 3))
    assert io.npz(spark, str(tmp_path / "e.npz"), "a").collect()[1].embedding == [3.0, 4.0, 5.0]
    b = spark.createDataFrame([(bytearray(b"\x80\x01"),)], "b binary").select(io.bytes_to_bits(F.col("b"), 16).alias("x")).head().x
    assert b.nbits == 16 and b.words == [-(2**63) + (1 << 48)]
    (tmp_path / "p.tsv").write_text("query_id\tneighbor_id\tdist\n1\t2\t0.5\n")
    assert tuple(io.pair_tsv(spark, str(tmp_path / "p.tsv")).head()) == (1, 2, 0.5)
