"""Further queries over the operators of sets, cascades, evaluation, joins and vector types, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import cascade as C
from ..operators import evaluate as E
from ..operators import ivf
from ..operators import predicates as P
from ..operators import semjoin as S
from ..plans import topk as K
from ..plans.topk import Signal, TopKQuery
from . import reference as R
from .reference import _e, _entities, _labelled, _q, _r, _t, _ti


def w1_attribute(spark: SparkSession, d: str) -> DataFrame:
    """Ranked by an attribute, descending."""
    return K.run(TopKQuery(15, (Signal("attribute", "e", "price", direction="desc"),)), {"e": _entities(spark, d)}, {"e": "id"})


def w3_least(spark: SparkSession, d: str) -> DataFrame:
    """The least of two scores counts."""
    return R._ranked(K.run(TopKQuery(20, R._signals(spark, d), "min"), {"e": _entities(spark, d)}, {"e": "id"}))


def page_by_offset(spark: SparkSession, d: str) -> DataFrame:
    x = _e(spark, d).select("vec_id", _r(V.score(F.col("embedding"), _q(spark, d))).alias("score"))
    return x.orderBy("score", "vec_id").offset(30).limit(15)


def farthest_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The bottom end of a pair ranking."""
    return _ti(spark, d).withColumn("dis", _r(F.col("dis"))).orderBy(F.desc("dis"), "l_id", "r_id").limit(25)


def knn_within(spark: SparkSession, d: str) -> DataFrame:
    """The 3 nearest of those within tau."""
    e = _e(spark, d)
    return S.pairs(e.filter("vec_id % 2 = 0"), "vec_id", "embedding", e.filter("vec_id % 2 = 1"), "vec_id", "embedding", 1.2, k=3).withColumn("dis", _r(F.col("dis")))


def ti_films(spark: SparkSession, d: str) -> DataFrame:
    """Close titles of two tables whose vectors are partly null, of wrong lengths, or hold NaN."""
    a, b = _t(spark, d, "imdb_t1_hnsw"), _t(spark, d, "imdb_t2_hnsw")
    return S.pairs(a, "id", "actor_director_emb", b, "id", "actor_director_emb", 0.6, dim=1536).withColumn("dis", _r(F.col("dis")))


def pairs_by_ip(spark: SparkSession, d: str) -> DataFrame:
    """An L2 threshold turned into one of the inner product of normalised vectors."""
    e = _e(spark, d).withColumn("embedding", V.l2_normalize(F.col("embedding")))
    x = S.pairs(e.filter("vec_id % 2 = 0"), "vec_id", "embedding", e.filter("vec_id % 2 = 1"), "vec_id", "embedding", S.ip_threshold(1.1), "ip")
    return x.select("l_id", "r_id", _r(F.col("dis"), 4).alias("dis"))


def chain4_counts(spark: SparkSession, d: str) -> DataFrame:
    """In how many 4-way chains each left vector stands."""
    t = _ti(spark, d, 1.15)
    there, back = t.select(F.col("l_id").alias("a"), F.col("r_id").alias("b")), t.select(F.col("r_id").alias("a"), F.col("l_id").alias("b"))
    return S.chain_counts(there, back, there)


def _verified(spark: SparkSession, d: str, how: str) -> DataFrame:
    e = _e(spark, d).select("vec_id", "label")
    ask = lambda p, prompt: p.select("l_id", "r_id", (F.col("l_label") != F.col("r_label")).alias("verdict"))
    return S.verified_join(e.filter("vec_id % 2 = 0"), "vec_id", e.filter("vec_id % 2 = 1"), "vec_id", _ti(spark, d).select("l_id", "r_id"), "are these of two kinds?", ask, how)


def semantic_join(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within tau that a verifier (it reads the labels) calls different."""
    return _verified(spark, d, "inner")


def semantic_left_join(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d, "left_outer").select("l_id", F.coalesce("r_id", F.lit(-1)).alias("r_id"))


def semantic_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first 12 confirmed rows by distance; the verifier is not asked about the rest."""
    x = _e(spark, d).select("vec_id", _r(V.score(F.col("embedding"), _q(spark, d))).alias("score"), (F.col("label") < 3).alias("truth"))
    return C.first_confirmed(x, "vec_id", ["score"], "is it so?", C.column_verifier("truth", "vec_id"), 12, 16).select("vec_id", "score")


def bloom_filter(spark: SparkSession, d: str) -> DataFrame:
    """A Bloom filter in front of the exact test."""
    ids = _t(spark, d, "part").filter("p_size < 15").select((F.col("p_partkey") - 1).alias("i"))
    return P.within_ids(P.maybe_in(_e(spark, d).select("vec_id", "label"), "vec_id", P.bloom(ids, "i")), "vec_id", ids, "i")


def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return P.keep_first(_t(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


def union_intersect(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    a, b, c = (o.filter(x).select("o_custkey") for x in ("o_orderstatus = 'P'", "o_totalprice > 300000", "o_orderpriority = '1-URGENT'"))
    return a.union(b).intersect(c)


def not_in_set(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one kind that have none of another, with a pattern."""
    p = _t(spark, d, "part")
    return p.filter("p_name like '%e%'").select("p_size").subtract(p.filter("p_type not like '%zz%' and p_size < 20").select("p_size"))


def map_values(spark: SparkSession, d: str) -> DataFrame:
    """Counts by a key of a nested text field."""
    m = F.from_json("props", "map<string,string>")
    x = _t(spark, d, "events").select("event_type", F.explode(m).alias("key", "value"))
    return x.groupBy("event_type", "key").agg(F.count("value").alias("n"), F.count_distinct("value").alias("values"))


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Signs of a margin counted for each label."""
    m = R._margins(spark, d).withColumn("margin", _r(F.col("margin")))
    return m.groupBy("label").agg(*[F.count_if(c).alias(n) for n, c in (("positive", F.col("margin") > 0.1), ("neutral", F.abs("margin") <= 0.1), ("negative", F.col("margin") < -0.1))])


def _anchors(spark: SparkSession, d: str) -> list[list[float]]:
    return [_q(spark, d, i) for i in range(4)]


def max_margin(spark: SparkSession, d: str) -> DataFrame:
    a = _anchors(spark, d)
    return _e(spark, d).select("vec_id", _r(C.margin(F.col("embedding"), a[:2], a[2:], "max")).alias("margin"))


def all_margins(spark: SparkSession, d: str) -> DataFrame:
    """Two conditions at once, and a band that may only drop."""
    a = _anchors(spark, d)
    m = C.all_margins([C.margin(F.col("embedding"), a[:1], a[2:3]), C.margin(F.col("embedding"), a[1:2], a[3:])])
    return _e(spark, d).select("vec_id", _r(m).alias("margin")).withColumn("bucket", C.drop_only(F.col("margin"), -0.05))


def half_avg(spark: SparkSession, d: str) -> DataFrame:
    """Averages of 16-bit vectors, to three places."""
    e = _e(spark, d).select("label", V.to_half(F.col("embedding")).alias("h"))
    return V.vec_aggregate(e, ["label"], "h", "v").select("label", F.posexplode("v").alias("pos", "x")).select("label", "pos", _r(F.col("x").cast("double"), 3).alias("x"))


def half_values(spark: SparkSession, d: str) -> DataFrame:
    """Values rounded through 16-bit floats."""
    return _e(spark, d).select("vec_id", F.posexplode(V.to_half(F.slice("embedding", 1, 8))).alias("pos", "x")).select("vec_id", "pos", _r(F.col("x").cast("double"), 8).alias("x"))


def half_sum(spark: SparkSession, d: str) -> DataFrame:
    """Sums of 16-bit vectors, the result a 16-bit vector."""
    e = _e(spark, d).select("label", V.to_half(F.slice("embedding", 1, 4)).alias("h"))
    return V.vec_aggregate(e, ["label"], "h", "v", "sum", half=True).select("label", F.size("v").alias("n"), _r(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 1).alias("total"))


def sql_vector_types(spark: SparkSession, d: str) -> DataFrame:
    """The SQL functions of vectors, bits and sparse vectors."""
    V.register(spark)
    _e(spark, d).createOrReplaceTempView("quillon_embeddings")
    return spark.sql("""
      select vec_id, round(l1_distance(embedding, reverse(embedding)), 5) l1, round(spherical_distance(embedding, reverse(embedding)), 5) sph,
        hamming_distance(binary_quantize(embedding), binary_quantize(reverse(embedding))) hamming, round(jaccard_distance(binary_quantize(embedding), binary_quantize(reverse(embedding))), 6) jaccard,
        vector_cmp(embedding, reverse(embedding)) cmp, vector_dims(vector_concat(embedding, subvector(embedding, 60, 9))) dims,
        round(vector_norm(vector_sub(vector_add(embedding, embedding), embedding)), 5) norm, to_vector(to_sparsevec(embedding)) = embedding same, vector_in(vector_out(embedding)) = embedding text_same,
        round(sparsevec_l2_distance(to_sparsevec(embedding), to_sparsevec(reverse(embedding))), 5) l2
      from quillon_embeddings""")


def sql_aggregates(spark: SparkSession, d: str) -> DataFrame:
    V.register(spark)
    _e(spark, d).createOrReplaceTempView("quillon_embeddings")
    x = spark.sql("select label, vector_avg(embedding) a, vector_sum(embedding) s from quillon_embeddings group by label")
    return x.select("label", F.posexplode("a").alias("pos", "a"), "s").select("label", "pos", _r(F.col("a").cast("double"), 4).alias("a"), _r(F.get("s", F.col("pos")).cast("double"), 3).alias("s"))


def ivf_exhausted(spark: SparkSession, d: str) -> DataFrame:
    """A filtered search that goes on to farther lists until it has k rows."""
    e = _e(spark, d)
    c = ivf.fit(e, "vec_id", "embedding", 10)
    filed = ivf.assign(e, "embedding", c).filter("label = 3")
    return ivf.search_until(filed, "vec_id", "embedding", _q(spark, d), c, 1_000_000, 2).agg(F.count(F.lit(1)).alias("n"))


def eval_kendall(spark: SparkSession, d: str) -> DataFrame:
    return E.kendall(_labelled(spark, d), "found", "truth").select(_r(F.col("kendall")).alias("kendall"))


def eval_omega(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    found, truth = e.select("vec_id", F.explode(F.array(F.col("label") % 3, F.col("vec_id") % 7 + 10)).alias("c")), e.select("vec_id", F.explode(F.array(F.col("label") % 4, F.col("vec_id") % 5 + 10)).alias("c"))
    return E.omega_index(found, truth, "vec_id", "c").select(_r(F.col("omega")).alias("omega"))


def _counts(spark: SparkSession, d: str, col: str) -> DataFrame:
    return _labelled(spark, d).groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def eval_label_error(spark: SparkSession, d: str) -> DataFrame:
    return E.mean_label_error(_counts(spark, d, "found"), _counts(spark, d, "truth"), "label", "n").select(_r(F.col("error")).alias("error"))


def eval_mape(spark: SparkSession, d: str) -> DataFrame:
    return E.mape(_counts(spark, d, "found").filter("label <> 2"), _counts(spark, d, "truth"), ["label"], "n").select(_r(F.col("mape")).alias("mape"))


def eval_values(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values regardless of case and outer space."""
    p = _t(spark, d, "part")
    f, t = p.filter("p_size < 20").select(F.concat(F.lit(" "), F.lower("p_brand")).alias("b")), p.filter("p_size > 10").select(F.col("p_brand").alias("b"))
    return E.value_scores(f, t, "b").select(*[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def eval_pairs(spark: SparkSession, d: str) -> DataFrame:
    """F1 of unordered pairs."""
    t = _ti(spark, d)
    f = t.filter("dis < 1.1").select(E.canonical_pair("r_id", "l_id").alias("p")).select("p.*")
    g = t.filter("l_id % 3 = 0").select(E.canonical_pair("l_id", "r_id").alias("p")).select("p.*")
    return E.set_scores(f, g, ["a", "b"]).select(*[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are found in a truth table."""
    o = _t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return E.matched_rows(o.filter("o_orderkey % 3 = 0"), o.filter("o_orderkey % 2 = 0"), ["o_custkey", "o_orderstatus"]).select("o_orderkey")


def usage_cost(spark: SparkSession, d: str) -> DataFrame:
    u = _t(spark, d, "documents").select(F.coalesce("n_chars", F.lit(0)).alias("input_tokens"), F.lit(10).cast("bigint").alias("output_tokens"))
    return C.cost(u, 1e-6, 2e-6).withColumn("usd", _r(F.col("usd")))


_NAMES = """w1_attribute w3_least page_by_offset farthest_pairs knn_within ti_films pairs_by_ip chain4_counts semantic_join semantic_left_join semantic_limit bloom_filter keep_first union_intersect not_in_set map_values
label_counts max_margin all_margins half_avg half_sum half_values sql_vector_types sql_aggregates ivf_exhausted eval_kendall eval_omega eval_label_error eval_mape eval_values eval_pairs eval_rows usage_cost""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in _NAMES}


def oracle_sql() -> dict[str, str]:
    step = lambda x: f"pow(2, greatest(floor(log2(abs({x}))), -14) - 10)"  # noqa: E731  distance of the 16-bit floats around x
    half = lambda x: f"(case when {x} = 0 then 0 else round_even({x} / {step(x)}, 0) * {step(x)} end)"
    e, ent, eti, marg, lab = R._E, R._ENT, R._ETI, R._MARG, R._LAB
    dist = "list_distance(e.v, q.v)"
    f1 = "select round(h / f, 6) as precision, round(h / t, 6) as recall, round(2 * (h / f) * (h / t) / (h / f + h / t), 6) as f1"
    sound = "len(actor_director_emb) = 1536 and len(list_filter(actor_director_emb, lambda x: x is null or isnan(x) or isinf(x))) = 0"
    diff = eti + ", l0 as (select vec_id from e where vec_id % 2 = 0), y as (select l_id, r_id from ti join e a on a.vec_id = l_id join e b on b.vec_id = r_id where a.label <> b.label)"
    b1, b2 = R._BITS, R._BITS.replace("(v,", "(list_reverse(v),")
    return {
        "w1_attribute": f"{ent} select id, -price as score from x order by price desc, id limit 15",
        "w3_least": f"{ent}, y as (select id, least(list_distance(head, q.v[1:32]), list_distance(tail, q.v[33:64])) s from x, q) select id, round(s, 6) as score from y order by s, id limit 20",
        "page_by_offset": f"{e} select vec_id, round({dist}, 6) as score from e, q order by score, vec_id limit 15 offset 30",
        "farthest_pairs": f"{eti} select l_id, r_id, round(dis, 6) as dis from ti order by 3 desc, 1, 2 limit 25",
        "knn_within": f"{e}{R._TIM.format(tau=1.2)}, y as (select *, row_number() over (partition by l_id order by dis, r_id) rank from ti) select l_id, r_id, round(dis, 6) as dis, rank from y where rank <= 3",
        "ti_films": f"with a as (select id, actor_director_emb::double[] v from imdb_t1_hnsw where {sound}), b as (select id, actor_director_emb::double[] v from imdb_t2_hnsw where {sound}), p as (select a.id l_id, b.id r_id, list_distance(a.v, b.v) dis from a, b) select l_id, r_id, round(dis, 6) as dis from p where dis <= 0.6",
        "pairs_by_ip": f"{e}, n as (select vec_id, v, sqrt(list_inner_product(v, v)) n from e), p as (select a.vec_id l_id, b.vec_id r_id, -list_inner_product(a.v, b.v) / a.n / b.n dis from n a, n b where a.vec_id % 2 = 0 and b.vec_id % 2 = 1) select l_id, r_id, round(dis, 4) as dis from p where dis <= 1.1 * 1.1 / 2 - 1",
        "chain4_counts": f"{e}{R._TIM.format(tau=1.15)}, d as (select r_id, count(*) n from ti group by 1), f as (select l_id, count(*) n from ti group by 1), s as (select u.r_id, sum(f.n) n from ti u join f on f.l_id = u.l_id group by 1) select t.l_id as n0, sum(s.n)::bigint as n from ti t join s using (r_id) group by 1",
        "semantic_join": f"{diff} select * from y",
        "semantic_left_join": f"{diff} select vec_id as l_id, coalesce(r_id, -1) as r_id from l0 left join y on l_id = vec_id",
        "semantic_limit": f"{e} select vec_id, round({dist}, 6) as score from e, q where label < 3 order by score, vec_id limit 12",
        "bloom_filter": "select vec_id, label from embeddings where vec_id in (select p_partkey - 1 from part where p_size < 15)",
        "keep_first": "select o_custkey, o_orderdate, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1",
        "union_intersect": "(select o_custkey from orders where o_orderstatus = 'P' union select o_custkey from orders where o_totalprice > 300000) intersect select o_custkey from orders where o_orderpriority = '1-URGENT'",
        "not_in_set": "select p_size from part where p_name like '%e%' except select p_size from part where p_type not like '%zz%' and p_size < 20",
        "map_values": "with k as (select event_type, props, unnest(json_keys(props)) as key from events) select event_type, key, count(json_extract_string(props, '$.\"' || key || '\"')) as n, count(distinct json_extract_string(props, '$.\"' || key || '\"')) as values from k group by 1, 2",
        "label_counts": f"{marg} select label, count(*) filter (round(margin, 6) > 0.1) as positive, count(*) filter (abs(round(margin, 6)) <= 0.1) as neutral, count(*) filter (round(margin, 6) < -0.1) as negative from m group by 1",
        "max_margin": f"{marg} select vec_id, round(greatest(s[1], s[2]) - greatest(s[3], s[4]), 6) as margin from m",
        "all_margins": f"{marg}, y as (select vec_id, round(least(s[1] - s[3], s[2] - s[4]), 6) g from m) select vec_id, g as margin, case when g < -0.05 then 'neg' else 'unc' end as bucket from y",
        "sql_vector_types": f"{e}, y as (select vec_id, v, list_reverse(v) w, {b1} a, {b2} b from e), z as (select *, list_sum(list_transform(range(1, 65), lambda i: (a[i] <> b[i])::int)) h, list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])) n, list_sum(list_transform(range(1, 65), lambda i: greatest(a[i], b[i]))) u from y) select vec_id, round({R._L1.format(a='v', b='w')}, 5) as l1, round(acos(greatest(-1, least(1, list_inner_product(v, w)))) / pi(), 5) as sph, h::bigint as hamming, round(case when n = 0 then 1 else 1 - n / u end, 6) as jaccard, case when v < w then -1 when v > w then 1 else 0 end as cmp, 69 as dims, round(sqrt(list_inner_product(v, v)), 5) as norm, true as same, true as text_same, round(list_distance(v, w), 5) as l2 from z",
        "sql_aggregates": f"{e} select label, i as pos, round(avg(v[i + 1]), 4) as a, round(sum(v[i + 1]), 3) as s from e, range(64) t(i) group by 1, 2",
        "half_values": f"{e} select vec_id, i as pos, round({half('v[i + 1]')}, 8) as x from e, range(8) t(i)",
        "half_avg": f"{e} select label, i as pos, round(avg({half('v[i + 1]')}), 3) as x from e, range(64) t(i) group by 1, 2",
        "half_sum": f"{e}, y as (select label, i, sum({half('v[i + 1]')}) s from e, range(4) t(i) group by 1, 2) select label, 4 as n, round(sum({half('s')}), 1) as total from y group by 1",
        "ivf_exhausted": "select count(*) as n from embeddings where label = 3",
        "eval_kendall": f"{lab}, p as (select sum(sign(a.found - b.found) * sign(a.truth - b.truth)) s, sum((a.found <> b.found)::int) x, sum((a.truth <> b.truth)::int) y from b a, b b) select round(s / sqrt(x::double * y), 6) as kendall from p",
        "eval_omega": f"{e}, f as (select vec_id i, unnest([label % 3, vec_id % 7 + 10]) c from e), t as (select vec_id i, unnest([label % 4, vec_id % 5 + 10]) c from e), pf as (select a.i x, b.i y, count(*) n from f a join f b on a.c = b.c and a.i < b.i group by 1, 2), pt as (select a.i x, b.i y, count(*) n from t a join t b on a.c = b.c and a.i < b.i group by 1, 2), w as (select a.vec_id x, b.vec_id y from e a, e b where a.vec_id < b.vec_id), j as (select coalesce(pf.n, 0) f, coalesce(pt.n, 0) t from w left join pf using (x, y) left join pt using (x, y)), o as (select avg((f = t)::int) o, count(*) n from j), ex as (select sum(cf * ct) e from (select f k, count(*) cf from j group by 1) join (select t k, count(*) ct from j group by 1) using (k)) select round((o - e / n / n) / (1 - e / n / n), 6) as omega from o, ex",
        "eval_label_error": f"{lab}, f as (select found l, count(*) n from b group by 1), t as (select truth l, count(*) n from b group by 1), j as (select coalesce(f.n, 0) f, coalesce(t.n, 0) t from f full join t using (l)) select round(avg(case when t = 0 then (f > 0)::int else abs(f - t) / t end), 6) as error from j",
        "eval_mape": f"{lab}, f as (select found l, count(*) n from b where found <> 2 group by 1), t as (select truth l, count(*) n from b group by 1) select round(avg(case when f.n is null then 1 else abs(f.n - t.n) / t.n end), 6) as mape from t left join f using (l)",
        "eval_values": f"with f as (select distinct lower(p_brand) b from part where p_size < 20), t as (select distinct lower(p_brand) b from part where p_size > 10), n as (select (select count(*) from f) f, (select count(*) from t) t, (select count(*) from f join t using (b)) h) {f1} from n",
        "eval_pairs": f"{eti}, f as (select * from ti where dis < 1.1), t as (select * from ti where l_id % 3 = 0), n as (select (select count(*) from f) f, (select count(*) from t) t, (select count(*) from f join t using (l_id, r_id)) h) {f1} from n",
        "eval_rows": "select o_orderkey from orders a where o_orderkey % 3 = 0 and exists (select 1 from orders b where b.o_orderkey % 2 = 0 and a.o_custkey = b.o_custkey and a.o_orderstatus = b.o_orderstatus)",
        "usage_cost": "select count(*) as calls, sum(coalesce(n_chars, 0))::bigint as input_tokens, (count(*) * 10)::bigint as output_tokens, round(sum(coalesce(n_chars, 0)) * 1e-6 + count(*) * 10 * 2e-6, 6) as usd from documents",
    }
