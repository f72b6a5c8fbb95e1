import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators import cascade as C
from quillon.operators import ivf
from quillon.operators import predicates as P
from quillon.plans import topk as K
from quillon.sources import io


def test_tables_and_pairs_by_round_trip(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("query_id\tneighbor_id\tdist\n1\t2\t0.5\n3\t4\t1.25\n")
    assert [tuple(r) for r in io.pair_tsv(spark, str(tmp_path / "p.tsv")).collect()] == [(1, 2, 0.5), (3, 4, 1.25)]
    io.write_summary(spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, n int"), str(tmp_path / "s"), ["k"], ["n"])
    assert {tuple(r) for r in io.csv(spark, str(tmp_path / "s"), "k string, n bigint").collect()} == {("a", 3), ("b", 5)}
    bits = spark.createDataFrame([(1, bytearray(b"\x80\x01" + bytes(14))), (2, None)], "id int, b binary")
    bits.write.parquet(str(tmp_path / "bits.parquet"))
    got = {r.id: r.b for r in io.parquet(spark, str(tmp_path / "bits.parquet"), {"b": 128}).collect()}
    assert got[2] is None and (got[1].nbits, list(got[1]["words"])) == (128, [-(2**63) + 2**48, 0])
    assert "bits" in io.views(spark, str(tmp_path)) and spark.table("bits").count() == 2


def test_archives_and_media(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.savez(tmp_path / "e.npz", e=m, ids=np.array([7, 8, 9, 10]))
    assert {r.id: r.embedding for r in io.npz(spark, str(tmp_path / "e.npz"), "e", "ids").collect()} == {i: list(v) for i, v in zip((7, 8, 9, 10), m.tolist(), strict=True)}
    (tmp_path / "a.png").write_bytes(b"xyz")
    (tmp_path / "b.wav").write_bytes(b"w")
    assert [(r.length, bytes(r.content)) for r in io.media(spark, str(tmp_path), "*.png").collect()] == [(3, b"xyz")]


def test_workload_results_and_stage(spark, tmp_path):
    query = {"K": 2, "scoring": {"signals": [{"type": "semantic", "table": "e", "field": "v", "query_embed": [0.0, 0.0]}]}, "predicates": [{"table": "e", "attribute": "id", "operator": ">", "value": 1}]}
    (tmp_path / "w.json").write_text(json.dumps({"queries": [query]}))
    (q,) = io.workload(str(tmp_path / "w.json"))
    e = spark.createDataFrame([(i, [float(i), 0.0], "x") for i in range(5)], "id bigint, v array<float>, t string")
    rows = K.run(q, {"e": e}, {"e": "id"})
    io.write_results(str(tmp_path / "r.json"), 1, rows, 0.5, {"scan": 0.1}, {"k": 2})
    told = json.loads((tmp_path / "r.json").read_text())
    assert [r["id"] for r in told["rows"]] == [2, 3] and told["qps"] == 2 and told["setting"] == {"k": 2} and q.workload == "W2"
    assert io.light(e).columns == ["id", "t"] and io.light(e, ["id"]).columns == ["id"]
    kept = io.stage(e, "kept")
    assert spark.table("kept").count() == 5
    kept.unpersist()


def test_predicates_that_cannot_be(spark):
    with pytest.raises(ValueError, match="unsupported"):
        P.Predicate("t", "a", "~", 1).column()
    e = spark.createDataFrame([(i,) for i in range(3000)] + [(None,)], "a bigint")
    assert P.apply(e, [P.Predicate("t", "a", "in", list(range(0, 6000, 2)))]).count() == 1500
    ids = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "i bigint")
    maybe = {r.a for r in P.maybe_in(e, "a", P.bloom(ids, "i", 1 << 16), 1 << 16).collect()}
    assert set(range(0, 300, 3)) <= maybe and len(maybe) < 130 and None not in maybe


def test_limit_spares_the_verifier(spark):
    x = spark.createDataFrame([(i, float(i), i % 2 == 0) for i in range(400)], "id bigint, s double, ok boolean")
    asked = []

    def verify(rows, prompt):
        asked.append(rows.count())
        return rows.select("id", F.col("ok").alias("verdict"))

    assert [r.id for r in C.first_confirmed(x, "id", ["s"], "", verify, 6, 8).collect()] == [0, 2, 4, 6, 8, 10] and sum(asked) == 24
    assert C.first_confirmed(x.filter("not ok"), "id", ["s"], "", verify, 3, 200).count() == 0


def test_complete_linkage_by_brute_force(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(0, 1, (14, 3))
    df = spark.createDataFrame([(i, [float(x) for x in v], "g") for i, v in enumerate(m)], "id bigint, v array<double>, g string")
    got = {r.id: r.cluster for r in C.complete_link_clusters(df, "id", "v", "g", 0.4).collect()}
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - n @ n.T
    groups = [[i] for i in range(14)]
    while len(groups) > 1:
        best = min((max(d[i, j] for i in a for j in b), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y)
        if best[0] > 0.4:
            break
        groups[best[1]] += groups.pop(best[2])
    assert got == {i: min(g) for g in groups for i in g}


def test_recall_of_lists(spark):
    """A third of the lists finds most of the nearest rows; going on finds all that a filter leaves."""
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(c, 0.3, (60, 6)) for c in rng.normal(0, 2, (10, 6))]).astype(np.float32)
    e = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, v array<float>")
    c = ivf.fit(e, "id", "v", 9)
    filed = ivf.assign(e, "v", c).cache()
    hits = 0
    for q in (5, 100, 300, 555):
        want = set(np.argsort(((m - m[q]) ** 2).sum(1), kind="stable")[:10].tolist())
        hits += len(want & {r.id for r in ivf.search(filed, "id", "v", m[q].tolist(), c, 10, 3).collect()})
    assert hits >= 36
    few = filed.filter("id % 60 = 7")
    assert ivf.search_until(few, "id", "v", m[0].tolist(), c, 10, 1).count() == 10


def test_ragged_and_hot_groups_in_vector_sums(spark, monkeypatch):
    monkeypatch.setattr(V, "HELD_GROUPS", 3)
    rows = [(i % 7, [float(i), 1.0]) for i in range(200)] + [(None, [2.0, 2.0]), (8, None)]
    df = spark.createDataFrame(rows, "k int, v array<float>").repartition(5)
    got = {r.k: r.s for r in V.vec_aggregate(df, ["k"], "v", "s", "sum").collect()}
    assert got == {k: [float(sum(i for i in range(200) if i % 7 == k)), float(len([i for i in range(200) if i % 7 == k]))] for k in range(7)} | {None: [2.0, 2.0], 8: None}
    with pytest.raises(Exception, match="different vector dimensions"):
        V.vec_aggregate(spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "k int, v array<float>"), ["k"], "v", "s").collect()
