"""Queries over the vector, ranking, join, cascade and evaluation operators, with their SQL.

Fixtures are views of the test tables: left = even vec_id, right = odd, a second score from each half
of the vector, attributes from part (p_partkey = vec_id + 1) and documents, verdicts from label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import cascade as C
from ..operators import evaluate as E
from ..operators import ivf
from ..operators import predicates as P
from ..operators import semjoin as S
from ..plans import topk as K
from ..plans.topk import Join, Signal, TopKQuery

TAU = 1.2


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _e(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings")


def _q(spark: SparkSession, d: str, i: int = 0) -> list[float]:
    return [float(x) for x in _e(spark, d).filter(F.col("vec_id") == i).head()["embedding"]]


def _r(c, n: int = 6):  # noqa: ANN001, ANN202
    return F.round(c, n)


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with part attributes: id, label, halves, size, price, tags."""
    e = _e(spark, d).select(F.col("vec_id").alias("id"), "embedding", "label", F.slice("embedding", 1, 32).alias("head"), F.slice("embedding", 33, 32).alias("tail"))
    p = _t(spark, d, "part").select((F.col("p_partkey") - 1).alias("id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.split("p_type", " ").alias("tags"))
    return e.join(p, "id")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _entities(spark, d)
    return e.filter("id % 2 = 0"), e.filter("id % 2 = 1")


def _ti(spark: SparkSession, d: str, tau: float = TAU) -> DataFrame:
    e = _e(spark, d)
    return S.pairs(e.filter("vec_id % 2 = 0"), "vec_id", "embedding", e.filter("vec_id % 2 = 1"), "vec_id", "embedding", tau)


def _scan(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _e(spark, d).select("vec_id", _r(V.score(F.col("embedding"), _q(spark, d), metric)).alias("distance"))

    return run


def l2_function(spark: SparkSession, d: str) -> DataFrame:
    """The scalar function over pairs of columns, next to a rotated copy of the vector."""
    b = F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1))
    a = F.col("embedding")
    return _e(spark, d).select("vec_id", *[_r(f(a, b)).alias(n) for n, f in (("l2", V.l2_distance), ("l2sq", V.l2_squared), ("ip", V.inner_product), ("nip", V.negative_inner_product), ("l1", V.l1_distance), ("cos", V.cosine_distance), ("sph", V.spherical_distance))])


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    V.register(spark)
    _e(spark, d).createOrReplaceTempView("quillon_embeddings")
    return spark.sql("select vec_id, round(l2_distance(embedding, reverse(embedding)), 6) l2, round(cosine_distance(embedding, reverse(embedding)), 6) cos, vector_dims(embedding) n, round(vector_norm(embedding), 6) norm from quillon_embeddings")


def _bits(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).select("vec_id", V.binary_quantize(F.col("embedding")).alias("b"))


def bit_scan(spark: SparkSession, d: str) -> DataFrame:
    q = V.binary_quantize(F.array(*[F.lit(x).cast("float") for x in _q(spark, d)]))
    return _bits(spark, d).select("vec_id", V.hamming_distance(F.col("b"), q).alias("hamming"), _r(V.jaccard_distance(F.col("b"), q)).alias("jaccard"))


def vec_norm(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).select("vec_id", _r(V.norm(F.col("embedding"))).alias("norm"), V.dims(F.col("embedding")).alias("dims"))


def vec_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).select("vec_id", F.posexplode(V.l2_normalize(V.subvector(F.col("embedding"), 5, 8))).alias("pos", "x")).select("vec_id", "pos", _r(F.col("x").cast("double"), 3).alias("x"))


def vec_arith(spark: SparkSession, d: str) -> DataFrame:
    a, b = V.subvector(F.col("embedding"), 1, 4), V.subvector(F.col("embedding"), 5, 4)
    x = _e(spark, d).select("vec_id", F.posexplode(F.arrays_zip(V.add(a, b).alias("s"), V.subtract(a, b).alias("m"), V.multiply(a, b).alias("p"))).alias("pos", "v"))
    return x.select("vec_id", "pos", *[_r(F.col(f"v.{c}").cast("double"), 3).alias(n) for c, n in (("s", "plus"), ("m", "minus"), ("p", "times"))])


def vec_subvector(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("embedding")
    return _e(spark, d).select("vec_id", F.size(V.subvector(a, -1, 5)).alias("clamped"), F.size(V.subvector(a, 60, 50)).alias("end"), F.size(V.concat(V.subvector(a, 1, 3), a)).alias("joined"), _r(V.l1_distance(V.subvector(a, 1, 8), V.subvector(a, 9, 8))).alias("l1"))


def vec_quantize(spark: SparkSession, d: str) -> DataFrame:
    return _bits(spark, d).select("vec_id", F.bit_count(F.col("b.words")[0]).alias("ones"), F.col("b.nbits").alias("nbits"))


def vec_compare(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d).withColumn("next", F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1)))
    return e.select("vec_id", V.compare(F.col("embedding"), F.col("next")).alias("cmp"), V.compare(V.subvector(F.col("embedding"), 1, 3), F.col("embedding")).alias("prefix"))


def vec_text(spark: SparkSession, d: str) -> DataFrame:
    """Text and back, sparse form and back."""
    e = _e(spark, d).withColumn("t", V.format_vector(F.col("embedding")))
    s = V.to_sparse(F.transform("embedding", lambda x: F.when(x > 0, x).otherwise(F.lit(0).cast("float"))))
    return e.select("vec_id", (V.parse_vector(F.col("t"), 64) == F.col("embedding")).alias("same"), (V.to_dense(V.parse_sparse(V.format_sparse(s))) == V.to_dense(s)).alias("sparse_same"), F.size(s["indices"]).alias("nonzero"))


def half_round(spark: SparkSession, d: str) -> DataFrame:
    h = V.to_half(F.col("embedding"))
    return _e(spark, d).withColumn("h", h).select("vec_id", (V.l2_distance(F.col("embedding"), F.col("h")) < 0.001).alias("near"), (V.to_half(F.col("h")) == F.col("h")).alias("stable"))


def sparse_distance(spark: SparkSession, d: str) -> DataFrame:
    keep = lambda c: V.to_sparse(F.transform(c, lambda x: F.when(x > 0, x).otherwise(F.lit(0).cast("float"))))
    a, b = keep(F.slice("embedding", 1, 32)), keep(F.slice("embedding", 33, 32))
    return _e(spark, d).select("vec_id", _r(V.sparse_inner_product(a, b), 5).alias("ip"), _r(V.sparse_l2_distance(a, b), 5).alias("l2"))


def vec_avg(spark: SparkSession, d: str) -> DataFrame:
    return V.vec_aggregate(_e(spark, d), ["label"], "embedding", "v").select("label", F.posexplode("v").alias("pos", "x")).select("label", "pos", _r(F.col("x").cast("double"), 4).alias("x"))


def vec_sum(spark: SparkSession, d: str) -> DataFrame:
    return V.vec_aggregate(_e(spark, d), ["label"], "embedding", "v", "sum").select("label", F.posexplode("v").alias("pos", "x")).select("label", "pos", _r(F.col("x").cast("double"), 3).alias("x"))


def _signals(spark: SparkSession, d: str, table: str = "e", i: int = 0) -> tuple[Signal, Signal]:
    q = _q(spark, d, i)
    return Signal("semantic", table, "head", tuple(q[:32])), Signal("semantic", table, "tail", tuple(q[32:]))


_PREDS = (P.Predicate("e", "size", "<=", 25), P.Predicate("e", "tags", "@>", ["STANDARD"]))


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("score", _r(F.col("score")))


def w1_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(K.run(TopKQuery(20, (Signal("semantic", "e", "embedding", tuple(_q(spark, d))),)), {"e": _entities(spark, d)}, {"e": "id"}))


def w2_filtered(spark: SparkSession, d: str) -> DataFrame:
    q = TopKQuery(20, (Signal("semantic", "e", "embedding", tuple(_q(spark, d))),), predicates=(P.Predicate("e", "size", ">", 10), P.Predicate("e", "label", "in", [1, 2, 3, 4])))
    return _ranked(K.run(q, {"e": _entities(spark, d)}, {"e": "id"}))


def w3_multi(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(K.run(TopKQuery(20, _signals(spark, d), "weighted_sum", (0.7, 0.3)), {"e": _entities(spark, d)}, {"e": "id"}))


def w4_filtered_multi(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(K.run(TopKQuery(20, _signals(spark, d), "max", predicates=(P.Predicate("e", "price", "<", 1500.0),)), {"e": _entities(spark, d)}, {"e": "id"}))


def _join_query(spark: SparkSession, d: str, q: TopKQuery) -> DataFrame:
    left, right = _sides(spark, d)
    x = K.run(q, {"l": left, "r": right}, {"l": "id", "r": "id"}, _ti(spark, d))
    return _ranked(x).withColumn("dis", _r(F.col("dis")))


_JOIN = Join("l", "r", TAU)


def w5_join(spark: SparkSession, d: str) -> DataFrame:
    return _join_query(spark, d, TopKQuery(20, (Signal("semantic", "l", "embedding", tuple(_q(spark, d))),), join=_JOIN))


def w6_filtered_join(spark: SparkSession, d: str) -> DataFrame:
    return _join_query(spark, d, TopKQuery(20, (Signal("semantic", "l", "embedding", tuple(_q(spark, d))),), predicates=(P.Predicate("l", "size", "<=", 40), P.Predicate("r", "size", ">=", 10)), join=_JOIN))


def _two_sided(spark: SparkSession, d: str) -> tuple[Signal, ...]:
    return Signal("semantic", "l", "embedding", tuple(_q(spark, d))), Signal("semantic", "r", "embedding", tuple(_q(spark, d, 1))), Signal("join_distance")


def w7_multi_join(spark: SparkSession, d: str) -> DataFrame:
    return _join_query(spark, d, TopKQuery(20, _two_sided(spark, d), "weighted_sum", (0.5, 0.3, 0.2), join=_JOIN))


def w8_filtered_multi_join(spark: SparkSession, d: str) -> DataFrame:
    return _join_query(spark, d, TopKQuery(20, _two_sided(spark, d), "weighted_sum", (0.5, 0.3, 0.2), (P.Predicate("l", "size", "<=", 40), P.Predicate("r", "price", "<", 1600.0)), _JOIN))


def msa_best_partner(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    ls = left.select(F.col("id").alias("l_id"), V.score(F.col("embedding"), _q(spark, d)).alias("s"))
    rs = right.select(F.col("id").alias("r_id"), V.score(F.col("embedding"), _q(spark, d, 1)).alias("s"))
    return _ranked(K.best_partner_topk(_ti(spark, d), ls, rs, 20, "sum", ())).withColumn("dis", _r(F.col("dis")))


def ti_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _ti(spark, d).withColumn("dis", _r(F.col("dis")))


def ti_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    return S.pairs(e, "vec_id", "embedding", e, "vec_id", "embedding", TAU, self_join=True).withColumn("dis", _r(F.col("dis")))


def ti_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    return S.pairs(e.filter("vec_id % 2 = 0"), "vec_id", "embedding", e.filter("vec_id % 2 = 1"), "vec_id", "embedding", 0.7, "cos").withColumn("dis", _r(F.col("dis")))


def ti_attributes(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return S.with_attributes(_ti(spark, d), left, "id", right, "id", ["size"], ["price"]).withColumn("dis", _r(F.col("dis")))


def knn_join(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    return S.pairs(e.filter("vec_id % 2 = 0"), "vec_id", "embedding", e.filter("vec_id % 2 = 1"), "vec_id", "embedding", None, k=3).withColumn("dis", _r(F.col("dis")))


def jim_seeds(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return S.seeds_with_partner(left, "id", _ti(spark, d), right.filter("size <= 20")).select("id")


def jim_targets(spark: SparkSession, d: str) -> DataFrame:
    left, _ = _sides(spark, d)
    best = w1_topk(spark, d).select("id")
    return S.seeds_with_partner(left, "id", _ti(spark, d), best.filter("id % 2 = 1")).select("id")


def radius(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).select("vec_id", V.score(F.col("embedding"), _q(spark, d)).alias("score")).filter(F.col("score") <= 1.3).withColumn("score", _r(F.col("score")))


def id_filter_topk(spark: SparkSession, d: str) -> DataFrame:
    ids = _t(spark, d, "part").filter("p_size < 15").select((F.col("p_partkey") - 1).alias("i"))
    return _ranked(K.top_k(P.within_ids(_e(spark, d), "vec_id", ids, "i"), V.score(F.col("embedding"), _q(spark, d)), 20, "vec_id"))


def bitmap_filter(spark: SparkSession, d: str) -> DataFrame:
    ids = _t(spark, d, "part").filter("p_size < 15").select((F.col("p_partkey") - 1).alias("i"))
    return P.in_bitmap(_e(spark, d), "vec_id", P.id_bitmap(ids, "i")).select("vec_id", "label")


def contains_all(spark: SparkSession, d: str) -> DataFrame:
    return P.apply(_entities(spark, d), [_PREDS[1], P.Predicate("e", "label", "!=", 3)]).select("id", "label")


def predicate_share(spark: SparkSession, d: str) -> DataFrame:
    return P.selectivity(_entities(spark, d), _PREDS).withColumn("share", _r(F.col("share")))


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return K.page_after(_ti(spark, d).withColumn("dis", _r(F.col("dis"))), ["dis", "l_id", "r_id"], [1.1, 0, 0], 50).select("l_id", "r_id", "dis")


def rerank_quantized(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    b = V.binary_quantize(F.array(*[F.lit(x).cast("float") for x in q]))
    return _ranked(K.rerank(_e(spark, d), V.hamming_distance(V.binary_quantize(F.col("embedding")), b), V.score(F.col("embedding"), q), 10, 5, "vec_id"))


def rerank_subvector(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    return _ranked(K.rerank(_e(spark, d), V.score(F.slice("embedding", 1, 16), q[:16]), V.score(F.col("embedding"), q), 10, 5, "vec_id"))


def batch_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    return K.batch_topk(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5).withColumn("score", _r(F.col("score")))


def ivf_all_lists(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    c = ivf.fit(e, "vec_id", "embedding", 10)
    return _ranked(ivf.search(ivf.assign(e, "embedding", c), "vec_id", "embedding", _q(spark, d), c, 20, probes=len(c)))


def _margins(spark: SparkSession, d: str) -> DataFrame:
    m = C.margin(F.col("embedding"), [_q(spark, d, 0), _q(spark, d, 1)], [_q(spark, d, 2), _q(spark, d, 3)])
    return _e(spark, d).select("vec_id", "label", m.alias("margin"))


def margin_sign(spark: SparkSession, d: str) -> DataFrame:
    return _margins(spark, d).select("vec_id", _r(F.col("margin")).alias("margin"), (F.col("margin") > 0).alias("yes"))


def confidence_argmax(spark: SparkSession, d: str) -> DataFrame:
    cls, gap = C.confidence(F.col("embedding"), {f"c{i}": _q(spark, d, i) for i in range(4)})
    return _e(spark, d).select("vec_id", cls.alias("class"), _r(gap).alias("gap"))


def role_margin(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).select("vec_id", _r(C.role_margin(F.col("embedding"), {f"c{i}": _q(spark, d, i) for i in range(4)}, "c1")).alias("margin"))


def alpha_band(spark: SparkSession, d: str) -> DataFrame:
    m = _margins(spark, d).withColumn("margin", _r(F.col("margin"), 9))
    return C.alpha_band(m, "vec_id", "margin", 0.2).select("vec_id", "bucket")


def absolute_band(spark: SparkSession, d: str) -> DataFrame:
    return _margins(spark, d).select("vec_id", C.absolute_band(_r(F.col("margin")), -0.1, 0.1).alias("bucket"))


def topk_band(spark: SparkSession, d: str) -> DataFrame:
    m = _margins(spark, d).withColumn("margin", _r(F.col("margin"), 9))
    return C.topk_band(m, "vec_id", "margin", 25).select("vec_id", "bucket")


def cascade_filter(spark: SparkSession, d: str) -> DataFrame:
    """Margin, absolute band, and a verifier that reads the label."""
    m = _margins(spark, d).withColumn("bucket", C.absolute_band(_r(F.col("margin")), -0.1, 0.1)).withColumn("truth", F.col("label") < 5)
    return C.cascade(m, "vec_id", "is it so?", C.column_verifier("truth", "vec_id")).positive


def cluster_cascade(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d).select("vec_id", "label", V.score(F.col("embedding"), _q(spark, d)).alias("far")).withColumn("far", _r(F.col("far")))
    return C.cluster_cascade(e, "vec_id", "label", "far", "name it", C.column_verifier("vec_id", "vec_id"))


def gap_filter(spark: SparkSession, d: str) -> DataFrame:
    s = _ti(spark, d, 1.35).select("l_id", "r_id", _r(1 - F.col("dis") * F.col("dis") / 2).alias("sim"))
    return S.gap_pairs(s, "l_id", "sim", 0.05)


def pair_threshold(spark: SparkSession, d: str) -> DataFrame:
    s = _ti(spark, d, 1.35).select("l_id", "r_id", _r(1 - F.col("dis") * F.col("dis") / 2).alias("sim"))
    return S.two_thresholds(s, F.col("sim"), 0.15, 0.35)


def single_link(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    x = S.pairs(e, "vec_id", "embedding", e, "vec_id", "embedding", 1.13, self_join=True).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
    return C.single_link_clusters(e.select("vec_id"), "vec_id", x)


def softmax_rank(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).select("vec_id", _r(C.softmax_rank([C.similarity(F.col("embedding"), _q(spark, d, i)) for i in range(3)], [1.0, 3.0, 5.0], 0.1)).alias("grade"))


def rescaled(spark: SparkSession, d: str) -> DataFrame:
    return C.rescale(_margins(spark, d), "margin", "grade", 1, 5).select("vec_id", _r(F.col("grade"), 5).alias("grade"))


def group_rank(spark: SparkSession, d: str) -> DataFrame:
    g = _margins(spark, d).groupBy("label").agg(_r(F.avg("margin")).alias("mean"), _r(F.avg((F.col("margin") > 0).cast("int"))).alias("ratio"), F.count(F.lit(1)).alias("n"))
    return g


def set_union(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    return o.filter("o_orderpriority = '1-URGENT' and o_totalprice > 300000").select("o_custkey").union(o.filter("o_orderstatus = 'P'").select("o_custkey")).distinct()


def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").intersect(o.filter("o_orderstatus = 'P'").select("o_custkey"))


def set_diff(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("key")).subtract(_t(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("key")))


def modality_xor(spark: SparkSession, d: str) -> DataFrame:
    x = _t(spark, d, "events").select("user_id", (F.col("value") > 50).alias("hit"), "event_type")
    return C.modality_xor(x, "user_id", "hit", "event_type")


def argmax_group(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "c_mktsegment", "c_nationkey").limit(1)


def top1_per_group(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d).withColumn("s", _r(V.score(F.col("embedding"), _q(spark, d))))
    return e.groupBy("label").agg(F.min(F.struct("s", "vec_id")).alias("p")).select("label", F.col("p.vec_id").alias("vec_id"), F.col("p.s").alias("s"))


def top_groups(spark: SparkSession, d: str) -> DataFrame:
    return K.top_per_group(_margins(spark, d).withColumn("margin", _r(F.col("margin"))), ["label"], F.col("margin"), 5, "vec_id")


def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d)
    frames = []
    for s in _signals(spark, d):
        top = K.top_k(e, _r(s.column(), 9), 100)
        frames.append(top.withColumn("rank", F.row_number().over(Window.orderBy("score", "id"))))  # a hundred rows
    return K.rank_fusion(frames, "id", 20).withColumn("score", _r(F.col("score"), 9))


def chain3_join(spark: SparkSession, d: str) -> DataFrame:
    t = _ti(spark, d, 1.15)
    return S.chain(t.select(F.col("l_id").alias("a"), F.col("r_id").alias("b")), t.select(F.col("r_id").alias("a"), F.col("l_id").alias("b"))).toDF("a", "b", "c").filter("a <> c")


def _retrieved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _e(spark, d)
    s = e.select(F.lit(0).alias("query_id"), "vec_id", "label", _r(V.score(F.col("embedding"), _q(spark, d))).alias("score"))
    return s.filter("label < 5").orderBy("score", "vec_id").limit(20), s.orderBy("score", "vec_id").limit(20)


def eval_recall(spark: SparkSession, d: str) -> DataFrame:
    f, t = _retrieved(spark, d)
    return E.boundary_recall(f, t).select(_r(F.col("recall")).alias("recall"))


def eval_f1(spark: SparkSession, d: str) -> DataFrame:
    f, t = _retrieved(spark, d)
    return E.set_scores(f, t, ["vec_id"]).select(*[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return confidence_argmax(spark, d).join(_e(spark, d).select("vec_id", "label"), "vec_id").select("vec_id", F.substring("class", 2, 1).cast("int").alias("found"), (F.col("label") % 4).alias("truth"), "gap")


def eval_ari(spark: SparkSession, d: str) -> DataFrame:
    return E.adjusted_rand(_labelled(spark, d), "found", "truth").select(_r(F.col("ari")).alias("ari"))


def eval_spearman(spark: SparkSession, d: str) -> DataFrame:
    return E.spearman(_labelled(spark, d), "gap", "truth").select(_r(F.col("spearman")).alias("spearman"))


def eval_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return E.macro_f1(_labelled(spark, d), "found", "truth").select(_r(F.col("macro_f1")).alias("macro_f1"))


def price_share(spark: SparkSession, d: str) -> DataFrame:
    """Scalar functions of the scenario queries on parts and customers."""
    p = _t(spark, d, "part")
    return p.select("p_partkey", F.format_string("%s (%s)", "p_name", "p_brand").alias("title"), F.element_at(F.split("p_type", " "), -1).alias("metal"), F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("double").alias("brand_no"), F.char_length("p_name").alias("len"), F.lower("p_type").alias("kind"))


def average_age(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").filter("o_orderstatus = 'F'").agg(_r(F.lit(2026) - F.avg(F.year("o_orderdate")), 4).alias("age"))


_NAMES = """l2_function sql_functions bit_scan vec_norm vec_normalize vec_arith vec_subvector vec_quantize vec_compare vec_text half_round sparse_distance vec_avg vec_sum
w1_topk w2_filtered w3_multi w4_filtered_multi w5_join w6_filtered_join w7_multi_join w8_filtered_multi_join msa_best_partner
ti_pairs ti_selfjoin ti_cosine ti_attributes knn_join jim_seeds jim_targets radius id_filter_topk bitmap_filter contains_all predicate_share keyset_page rerank_quantized rerank_subvector batch_topk ivf_all_lists
margin_sign confidence_argmax role_margin alpha_band absolute_band topk_band cascade_filter cluster_cascade gap_filter pair_threshold single_link softmax_rank rescaled group_rank
set_union set_intersect set_diff modality_xor argmax_group top1_per_group top_groups rank_fusion chain3_join eval_recall eval_f1 eval_ari eval_spearman eval_macro_f1 price_share average_age""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    scans = {f"{n}_scan": _scan(m) for n, m in (("l2", "l2"), ("ip", "ip"), ("cosine", "cos"), ("l1", "l1"))}
    return scans | {n: globals()[n] for n in _NAMES}


# --- the same in SQL

_E = "with e as (select vec_id, embedding::double[] v, label from embeddings), q as (select v from e where vec_id = 0)"
_ENT = _E + ", x as (select vec_id id, v, label, v[1:32] head, v[33:64] tail, p_size size, p_retailprice price, string_split(p_type, ' ') tags from e join part on p_partkey = vec_id + 1)"
_TI = ", l as (select vec_id id, v from e where vec_id % 2 = 0), r as (select vec_id id, v from e where vec_id % 2 = 1), ti as (select l.id l_id, r.id r_id, list_distance(l.v, r.v) dis from l, r where list_distance(l.v, r.v) <= {tau})"
_TIM = _TI.replace("ti as (", "ti as materialized (")
_ETI = _E + _TI.format(tau=TAU)
_XTI = _ENT + _TI.format(tau=TAU)
_L1 = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i] - {b}[i])))"
_DOT = "list_inner_product({a}, {b})"
_COS = "(1 - list_cosine_similarity({a}, {b}))"
_ROT = "(v[2:64] || v[1:1])"
_F32 = "{x}::float::double"
_BITS = "list_transform(v, lambda x: (x > 0)::int)"
_MARG = _E + ", a as (select (select v from e where vec_id = 0) a0, (select v from e where vec_id = 1) a1, (select v from e where vec_id = 2) a2, (select v from e where vec_id = 3) a3), m as (select vec_id, label, (list_cosine_similarity(v, a0) + list_cosine_similarity(v, a1)) / 2 - (list_cosine_similarity(v, a2) + list_cosine_similarity(v, a3)) / 2 margin, [list_cosine_similarity(v, a0), list_cosine_similarity(v, a1), list_cosine_similarity(v, a2), list_cosine_similarity(v, a3)] s from e, a)"
_LAB = _MARG + ", b as (select vec_id, list_position(s, list_max(s)) - 1 found, label % 4 truth, round(list_sort(s, 'DESC')[1] - list_sort(s, 'DESC')[2], 6) gap from m)"
_SIM = _E + _TI.format(tau=1.35) + ", s as (select l_id, r_id, round(1 - dis * dis / 2, 6) sim from ti)"
_RET = _E + ", s as (select vec_id, label, round(list_distance(e.v, q.v), 6) score from e, q), f as (select * from s where label < 5 order by score, vec_id limit 20), t as (select * from s order by score, vec_id limit 20)"
_TWO = _XTI + ", p as (select l_id, r_id, dis, 0.5 * list_distance(a.v, q.v) + 0.3 * list_distance(b.v, q1.v) + 0.2 * dis score from ti join x a on a.id = l_id join x b on b.id = r_id, q, (select v from e where vec_id = 1) q1 {where})"


def oracle_sql() -> dict[str, str]:
    d = lambda a, b: f"list_distance({a}, {b})"
    scan = lambda f: f"{_E} select vec_id, round({f}, 6) as distance from e, q"
    out = {
        "l2_scan": scan(d("e.v", "q.v")),
        "ip_scan": scan("-" + _DOT.format(a="e.v", b="q.v")),
        "cosine_scan": scan(_COS.format(a="e.v", b="q.v")),
        "l1_scan": scan(_L1.format(a="e.v", b="q.v")),
        "l2_function": f"{_E}, y as (select vec_id, v a, {_ROT} b from e) select vec_id, round({d('a', 'b')}, 6) l2, round(pow({d('a', 'b')}, 2), 6) l2sq, round({_DOT.format(a='a', b='b')}, 6) ip, round(-{_DOT.format(a='a', b='b')}, 6) nip, round({_L1.format(a='a', b='b')}, 6) l1, round({_COS.format(a='a', b='b')}, 6) cos, round(acos(greatest(-1, least(1, {_DOT.format(a='a', b='b')}))) / pi(), 6) sph from y",
        "sql_functions": f"{_E} select vec_id, round({d('v', 'list_reverse(v)')}, 6) l2, round({_COS.format(a='v', b='list_reverse(v)')}, 6) cos, len(v) n, round(sqrt({_DOT.format(a='v', b='v')}), 6) norm from e",
        "bit_scan": f"{_E}, b as (select vec_id, {_BITS} b from e), z as (select b q from b where vec_id = 0), y as (select vec_id, list_sum(list_transform(range(1, 65), lambda i: (b[i] <> q[i])::int)) h, list_sum(list_transform(range(1, 65), lambda i: b[i] * q[i])) n, list_sum(list_transform(range(1, 65), lambda i: greatest(b[i], q[i]))) u from b, z) select vec_id, h::bigint as hamming, round(case when n = 0 then 1 else 1 - n / u end, 6) as jaccard from y",
        "vec_norm": f"{_E} select vec_id, round(sqrt({_DOT.format(a='v', b='v')}), 6) as norm, len(v) as dims from e",
        "vec_normalize": f"{_E}, y as (select vec_id, v[5:12] s from e) select vec_id, i as pos, round(s[i + 1] / sqrt({_DOT.format(a='s', b='s')}), 3) as x from y, range(8) t(i)",
        "vec_arith": f"{_E} select vec_id, i as pos, round((v[i + 1]::float + v[i + 5]::float)::double, 3) as plus, round((v[i + 1]::float - v[i + 5]::float)::double, 3) as minus, round((v[i + 1]::float * v[i + 5]::float)::double, 3) as times from e, range(4) t(i)",
        "vec_subvector": f"{_E} select vec_id, 3 as clamped, 5 as end, 67 as joined, round({_L1.format(a='v[1:8]', b='v[9:16]')}, 6) as l1 from e",
        "vec_quantize": f"{_E} select vec_id, list_sum({_BITS})::bigint as ones, len(v) as nbits from e",
        "vec_compare": f"{_E} select vec_id, case when v < {_ROT} then -1 when v > {_ROT} then 1 else 0 end as cmp, -1 as prefix from e",
        "vec_text": f"{_E} select vec_id, true as same, true as sparse_same, len(list_filter(v, lambda x: x > 0)) as nonzero from e",
        "half_round": f"{_E} select vec_id, true as near, true as stable from e",
        "sparse_distance": f"{_E}, y as (select vec_id, list_transform(v[1:32], lambda x: greatest(x, 0)) a, list_transform(v[33:64], lambda x: greatest(x, 0)) b from e) select vec_id, round({_DOT.format(a='a', b='b')}, 5) as ip, round({d('a', 'b')}, 5) as l2 from y",
        "vec_avg": f"{_E} select label, i as pos, round(avg(v[i + 1]), 4) as x from e, range(64) t(i) group by 1, 2",
        "vec_sum": f"{_E} select label, i as pos, round(sum(v[i + 1]), 3) as x from e, range(64) t(i) group by 1, 2",
        "w1_topk": f"{_ENT} select id, round({d('x.v', 'q.v')}, 6) as score from x, q order by {d('x.v', 'q.v')}, id limit 20",
        "w2_filtered": f"{_ENT} select id, round({d('x.v', 'q.v')}, 6) as score from x, q where size > 10 and label in (1, 2, 3, 4) order by {d('x.v', 'q.v')}, id limit 20",
        "w3_multi": f"{_ENT}, y as (select id, 0.7 * {d('head', 'q.v[1:32]')} + 0.3 * {d('tail', 'q.v[33:64]')} s from x, q) select id, round(s, 6) as score from y order by s, id limit 20",
        "w4_filtered_multi": f"{_ENT}, y as (select id, greatest({d('head', 'q.v[1:32]')}, {d('tail', 'q.v[33:64]')}) s from x, q where price < 1500) select id, round(s, 6) as score from y order by s, id limit 20",
        "w5_join": f"{_XTI}, p as (select l_id, min(row(dis, r_id)) p from ti where l_id in (select id from x) and r_id in (select id from r) group by 1) select l_id, p[2] as r_id, round(p[1], 6) as dis, round({d('x.v', 'q.v')}, 6) as score from p join x on id = l_id, q order by {d('x.v', 'q.v')}, l_id limit 20",
        "w6_filtered_join": f"{_XTI}, p as (select l_id, min(row(dis, r_id)) p from ti join x b on b.id = r_id and b.size >= 10 join x a on a.id = l_id and a.size <= 40 group by 1) select l_id, p[2] as r_id, round(p[1], 6) as dis, round({d('x.v', 'q.v')}, 6) as score from p join x on id = l_id, q order by {d('x.v', 'q.v')}, l_id limit 20",
        "w7_multi_join": _TWO.format(where="") + " select l_id, r_id, round(dis, 6) as dis, round(score, 6) as score from p order by p.score, l_id, r_id limit 20",
        "w8_filtered_multi_join": _TWO.format(where="where a.size <= 40 and b.price < 1600") + " select l_id, r_id, round(dis, 6) as dis, round(score, 6) as score from p order by p.score, l_id, r_id limit 20",
        "msa_best_partner": f"{_XTI}, p as (select l_id, min(row(dis, r_id)) p from ti group by 1), y as (select l_id, p[2] r_id, p[1] dis, {d('a.v', 'q.v')} + {d('b.v', 'q1.v')} + p[1] s from p join x a on a.id = l_id join x b on b.id = p[2], q, (select v from e where vec_id = 1) q1) select l_id, r_id, round(dis, 6) as dis, round(s, 6) as score from y order by s, l_id limit 20",
        "ti_pairs": f"{_ETI} select l_id, r_id, round(dis, 6) as dis from ti",
        "ti_selfjoin": f"{_E} select a.vec_id as l_id, b.vec_id as r_id, round({d('a.v', 'b.v')}, 6) as dis from e a join e b on a.vec_id < b.vec_id where {d('a.v', 'b.v')} <= {TAU}",
        "ti_cosine": f"{_E} select a.vec_id as l_id, b.vec_id as r_id, round({_COS.format(a='a.v', b='b.v')}, 6) as dis from e a, e b where a.vec_id % 2 = 0 and b.vec_id % 2 = 1 and {_COS.format(a='a.v', b='b.v')} <= 0.7",
        "ti_attributes": f"{_XTI} select l_id, r_id, round(dis, 6) as dis, a.size as l_size, b.price as r_price from ti join x a on a.id = l_id join x b on b.id = r_id",
        "knn_join": f"{_E}, y as (select a.vec_id l_id, b.vec_id r_id, {d('a.v', 'b.v')} dis, row_number() over (partition by a.vec_id order by {d('a.v', 'b.v')}, b.vec_id) rank from e a, e b where a.vec_id % 2 = 0 and b.vec_id % 2 = 1) select l_id, r_id, round(dis, 6) as dis, rank from y where rank <= 3",
        "jim_seeds": f"{_XTI} select distinct l_id as id from ti join x b on b.id = r_id and b.size <= 20 join x a on a.id = l_id",
        "jim_targets": f"{_XTI}, t as (select id from x, q order by {d('x.v', 'q.v')}, id limit 20) select distinct l_id as id from ti join t on t.id = r_id and t.id % 2 = 1 join x a on a.id = l_id",
        "radius": f"{_E} select vec_id, round({d('e.v', 'q.v')}, 6) as score from e, q where {d('e.v', 'q.v')} <= 1.3",
        "id_filter_topk": f"{_E} select vec_id, round({d('e.v', 'q.v')}, 6) as score from e, q where vec_id in (select p_partkey - 1 from part where p_size < 15) order by {d('e.v', 'q.v')}, vec_id limit 20",
        "bitmap_filter": "select vec_id, label from embeddings where vec_id in (select p_partkey - 1 from part where p_size < 15)",
        "contains_all": f"{_ENT} select id, label from x where list_contains(tags, 'STANDARD') and label <> 3",
        "predicate_share": f"{_ENT} select count(*) as rows, count(*) filter (size <= 25 and list_contains(tags, 'STANDARD')) as passing, round(avg((size <= 25 and list_contains(tags, 'STANDARD'))::int), 6) as share from x",
        "keyset_page": f"{_ETI}, y as (select l_id, r_id, round(dis, 6) dis from ti) select * from y where row(dis, l_id, r_id) > row(1.1, 0, 0) order by dis, l_id, r_id limit 50",
        "rerank_quantized": f"{_E}, b as (select vec_id, v, {_BITS} b from e), z as (select b q from b where vec_id = 0), y as (select vec_id, v from b, z order by list_sum(list_transform(range(1, 65), lambda i: (b[i] <> z.q[i])::int)), vec_id limit 50) select vec_id, round({d('y.v', 'q.v')}, 6) as score from y, q order by {d('y.v', 'q.v')}, vec_id limit 10",
        "rerank_subvector": f"{_E}, y as (select vec_id, e.v from e, q order by {d('e.v[1:16]', 'q.v[1:16]')}, vec_id limit 50) select vec_id, round({d('y.v', 'q.v')}, 6) as score from y, q order by {d('y.v', 'q.v')}, vec_id limit 10",
        "batch_topk": f"{_E}, y as (select a.vec_id query_id, b.vec_id id, {d('a.v', 'b.v')} s, row_number() over (partition by a.vec_id order by {d('a.v', 'b.v')}, b.vec_id) rank from e a, e b where a.vec_id % 50 = 0) select query_id, id, round(s, 6) as score, rank from y where rank <= 5",
        "ivf_all_lists": f"{_E} select vec_id, round({d('e.v', 'q.v')}, 6) as score from e, q order by {d('e.v', 'q.v')}, vec_id limit 20",
        "margin_sign": f"{_MARG} select vec_id, round(margin, 6) as margin, margin > 0 as yes from m",
        "confidence_argmax": f"{_MARG} select vec_id, 'c' || (list_position(s, list_max(s)) - 1) as class, round(list_sort(s, 'DESC')[1] - list_sort(s, 'DESC')[2], 6) as gap from m",
        "role_margin": f"{_MARG} select vec_id, round(s[2] - (s[1] + s[3] + s[4]) / 3, 6) as margin from m",
        "alpha_band": f"{_MARG}, y as (select vec_id, round(margin, 9) g, row_number() over (order by abs(round(margin, 9)), vec_id) rn, count(*) over () n from m) select vec_id, case when rn <= round_even(0.2 * n, 0) then 'unc' when g > 0 then 'pos' else 'neg' end as bucket from y",
        "absolute_band": f"{_MARG} select vec_id, case when round(margin, 6) > 0.1 then 'pos' when round(margin, 6) < -0.1 then 'neg' else 'unc' end as bucket from m",
        "topk_band": f"{_MARG}, y as (select vec_id, row_number() over (order by round(margin, 9) desc, vec_id) rn from m) select vec_id, case when rn <= 25 then 'unc' else 'neg' end as bucket from y",
        "cascade_filter": f"{_MARG} select vec_id from m where round(margin, 6) > 0.1 or (round(margin, 6) >= -0.1 and label < 5)",
        "cluster_cascade": f"{_E}, y as (select vec_id, label, round({d('e.v', 'q.v')}, 6) far from e, q), z as (select label, min(row(far, vec_id)) p from y group by 1) select vec_id, p[2]::varchar as answer from y join z using (label)",
        "gap_filter": f"{_SIM}, y as (select *, max(sim) over (partition by l_id) b from s) select l_id, r_id, sim from y where sim >= b - 0.05",
        "pair_threshold": f"{_SIM} select l_id, r_id, sim, case when sim >= 0.35 then 'pos' else 'unc' end as bucket from s where sim > 0.15",
        "single_link": f"with recursive e as (select vec_id, embedding::double[] v from embeddings), p as (select a.vec_id x, b.vec_id y from e a join e b on a.vec_id <> b.vec_id where {d('a.v', 'b.v')} <= 1.13), c as (select vec_id, vec_id r from e union select c.vec_id, p.y from c join p on p.x = c.r) select vec_id, min(r) as cluster from c group by 1",
        "softmax_rank": f"{_MARG} select vec_id, round((exp(s[1] / 0.1) + 3 * exp(s[2] / 0.1) + 5 * exp(s[3] / 0.1)) / (exp(s[1] / 0.1) + exp(s[2] / 0.1) + exp(s[3] / 0.1)), 6) as grade from m",
        "rescaled": f"{_MARG} select vec_id, round(1 + (margin - min(margin) over ()) * 4 / (max(margin) over () - min(margin) over ()), 5) as grade from m",
        "group_rank": f"{_MARG} select label, round(avg(margin), 6) as mean, round(avg((margin > 0)::int), 6) as ratio, count(*) as n from m group by 1",
        "set_union": "select o_custkey from orders where o_orderpriority = '1-URGENT' and o_totalprice > 300000 union select o_custkey from orders where o_orderstatus = 'P'",
        "set_intersect": "select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'P'",
        "set_diff": "select c_custkey as key from customer except select o_custkey from orders where o_totalprice > 300000",
        "modality_xor": "select user_id from events group by 1 having max((value > 50)::int) = 1 and min((value > 50)::int) = 0 and count(distinct event_type) > 1",
        "argmax_group": "select c_mktsegment, c_nationkey, count(*) as n from customer group by 1, 2 order by n desc, 1, 2 limit 1",
        "top1_per_group": f"{_E}, y as (select label, min(row(round({d('e.v', 'q.v')}, 6), vec_id)) p from e, q group by 1) select label, p[2] as vec_id, p[1] as s from y",
        "top_groups": f"{_MARG} select label, min(round(margin, 6)) as score from m group by 1 order by score, label limit 5",
        "rank_fusion": f"{_ENT}, a as (select id, row_number() over (order by round({d('head', 'q.v[1:32]')}, 9), id) rank from x, q), b as (select id, row_number() over (order by round({d('tail', 'q.v[33:64]')}, 9), id) rank from x, q), u as (select * from a where rank <= 100 union all select * from b where rank <= 100) select id, round(sum(1.0 / (60 + rank)), 9) as score from u group by 1 order by sum(1.0 / (60 + rank)) desc, id limit 20",
        "chain3_join": f"{_E}{_TIM.format(tau=1.15)} select t.l_id as a, t.r_id as b, u.l_id as c from ti t join ti u on t.r_id = u.r_id where t.l_id <> u.l_id",
        "eval_recall": f"{_RET} select round(count(*) filter (f.score <= (select max(score) from t) + 1e-6) / 20, 6) as recall from f",
        "eval_f1": f"{_RET}, h as (select count(*) h from f where vec_id in (select vec_id from t)) select round(h / 20, 6) as precision, round(h / 20, 6) as recall, round(h / 20, 6) as f1 from h",
        "eval_ari": f"{_LAB}, c as (select found, truth, count(*) n from b group by 1, 2), ci as (select sum(n * (n - 1) / 2) i from c), cf as (select sum(n * (n - 1) / 2) f from (select found, sum(n) n from c group by 1)), ct as (select sum(n * (n - 1) / 2) t from (select truth, sum(n) n from c group by 1)), k as (select count(*) * (count(*) - 1) / 2 k from b) select round((i - f * t / k) / ((f + t) / 2 - f * t / k), 6) as ari from ci, cf, ct, k",
        "eval_spearman": f"{_LAB}, y as (select rank() over (order by gap) + (count(*) over (partition by gap) - 1) / 2 rx, rank() over (order by truth) + (count(*) over (partition by truth) - 1) / 2 ry from b) select round(corr(rx, ry), 6) as spearman from y",
        "eval_macro_f1": f"{_LAB}, l as (select found as l from b union select truth from b), f as (select l, 2 * count(*) filter (found = l and truth = l) / (count(*) filter (found = l) + count(*) filter (truth = l)) f from l, b group by 1) select round(avg(f), 6) as macro_f1 from f",
        "price_share": "select p_partkey, p_name || ' (' || p_brand || ')' as title, string_split(p_type, ' ')[-1] as metal, try_cast(split_part(p_brand, '#', 2) as double) as brand_no, length(p_name) as len, lower(p_type) as kind from part",
        "average_age": "select round(2026 - avg(year(o_orderdate)), 4) as age from orders where o_orderstatus = 'F'",
    }
    return out
