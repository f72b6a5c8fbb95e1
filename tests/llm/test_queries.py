from quillon.llm import queries


def test_every_query_runs_on_the_smallest_tables(spark, data):
    q = queries.queries()
    assert set(queries.oracle_sql()) <= set(q)
    for n in ("p1_found", "p1_nearest", "p3_found", "p6_found", "p7_found"):
        assert q[n](spark, data).count() >= 0


def test_recall_of_p1_nearest_by_brute_force(spark):
    """With production parameters, against all distances, for each field."""
    import numpy as np

    from quillon.llm.vectors import sound_rows

    folder = "/root/testdata/sf0.01"
    got = {}
    for r in queries.p1_nearest(spark, folder).collect():
        got.setdefault(r.field, set()).add((r.query_id, r.id))
    for field, (table, key, dim) in queries.FIELDS.items():
        t = spark.read.parquet(f"{folder}/{table}.parquet").select(key, field).toArrow()
        at, m = sound_rows(t[field], dim)
        ids, m = t[key].to_numpy()[at].astype(int), m.astype(np.float64)
        want = set()
        for i in np.flatnonzero(ids % 50 == 0):
            d = ((m - m[i]) ** 2).sum(1)
            d[i] = np.inf
            want |= {(int(ids[i]), int(ids[j])) for j in np.lexsort((ids, d))[:5]}
        assert len(got[field] & want) >= 0.9 * len(want) and len(got[field]) == len(want)
