"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import index as ix
from . import leximin as lx
from . import linkage as lk
from . import mixing as mx
from . import pivots as pv
from . import tokens as tk
from . import topn
from . import truncation as tr


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: field, table, key, vector length
FIELDS = {"plot_emb": ("imdb_t1_hnsw", "id", 1536), "title_emb": ("imdb_t1_hnsw", "id", 1536), "chemberta_768": ("molecule", "mol_id", 768)}


def _fields(spark: SparkSession, d: str, one: Callable[[DataFrame, str, str, int], DataFrame], names: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    out = None
    for f in names:
        table, key, dim = FIELDS[f]
        x = one(_t(spark, d, table), key, f, dim)
        x = x.select(F.lit(f).alias("field"), *x.columns)
        out = x if out is None else out.unionByName(x)
    return out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d, lambda t, key, f, dim: ix.close_pairs(t, key, f, dim, 5, 0.6))


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest rows, however far, of every row whose id is divisible by 50: each sees a tenth of the entries, at least 1000."""
    return _fields(spark, d, lambda t, key, f, dim: ix.similar_rows(t, key, f, dim, 5, asks=F.col(key) % 50 == 0, least_cells=8, least_entries=1000, least_share=0.1))


def p2_rank(spark: SparkSession, d: str) -> DataFrame:
    """The first k films of each query's leximin order (k is the query's own)."""
    q = _t(spark, d, "rank_queries")
    r = lx.rank_films(_t(spark, d, "imdb_t1_hnsw"), q)
    k = q.select(F.col("query_id").cast("bigint").alias("query_id"), "k")
    return r.join(k, "query_id").filter(F.col("position") <= F.col("k")).select("query_id", "id", "position", "better_rating", "better_votes", "better_distance")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lx.best_on_all(lx.rank_films(_t(spark, d, "imdb_t1_hnsw"), _t(spark, d, "rank_queries"))).select("query_id", "id")


def _molecules(spark: SparkSession, d: str) -> dict:
    t = _t(spark, d, "molecule")
    return {"left": t, "key": "mol_id", "main": F.col("ecfp_1024"), "threshold": 0.7, "also": pv.text_tokens(F.col("therapeutic_area")), "also_threshold": 0.5}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pv.similar_pairs(**_molecules(spark, d)).select(F.col("id_a").alias("mol_id_a"), F.col("id_b").alias("mol_id_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every molecule with its class of equal records and the number of similar classes."""
    return pv.classes_with_links(*pv.similar_classes(**_molecules(spark, d))).withColumnRenamed("id", "mol_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _fields(spark, d, lambda t, key, f, dim: lk.large_clusters(lk.clusters(t, key, f, dim, 0.6)[0], 3).select("id", "cluster_id"), ("plot_emb", "chemberta_768"))


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster of three or more rows with its size and its three most typical members."""
    return _fields(spark, d, lambda t, key, f, dim: lk.describe(*lk.clusters(t, key, f, dim, 0.6), dim, 3), ("plot_emb", "chemberta_768"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.least_partners(_t(spark, d, "ti_imdb_t1_imdb_t2"), 5).select("id1", "id2")


def p7_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.least_partners(_t(spark, d, "ti_imdb_t1_imdb_t2"), 5)


#: The folder of the public vocabularies.
TOKENIZERS = os.environ.get("QUILLON_TOKENIZERS", "/opt/tokenizers")


def vocabulary() -> tk.Vocabulary:
    return tk.Vocabulary(os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tk.encode(_t(spark, d, "documents"), "doc_id", "text", vocabulary())


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text after encoding and decoding: the text itself, empty for null."""
    v = vocabulary()
    return p8_ids(spark, d).select("doc_id", tk.decode(F.col("ids"), v).alias("text"), F.size("ids").alias("tokens"))


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    return cut(mx.weighted_documents(docs, tk.token_counts(docs, "doc_id", "text", vocabulary())))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each plan uses each document."""
    return mx.mix(_weighted(spark, d), _t(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The target and reached shares of each plan and source."""
    return mx.report(_weighted(spark, d), _t(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return tr.truncated(_t(spark, d, "documents"), "doc_id", "text", "source")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return tr.truncation_report(_t(spark, d, "documents"), "doc_id", "text", "source")


_SOUND = "(len({v}) = {n} and len(list_filter({v}, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter({v}, lambda x: x <> 0)) > 0)"
_P1 = f"""
with v as (select 'plot_emb' field, id, plot_emb::double[] v from imdb_t1_hnsw where {_SOUND.format(v="plot_emb", n=1536)}
  union all select 'title_emb', id, title_emb::double[] from imdb_t1_hnsw where {_SOUND.format(v="title_emb", n=1536)}
  union all select 'chemberta_768', mol_id::bigint, chemberta_768::double[] from molecule where {_SOUND.format(v="chemberta_768", n=768)}),
dd as (select x.field, x.id a, y.id b, list_distance(x.v, y.v) d from v x join v y on x.field = y.field and x.id <> y.id),
r as (select *, row_number() over (partition by field, a order by d, b) rk from dd where d <= 0.6)
"""
_P6 = _P1 + """, near as (select field, a, min(b) lo, count(*) n from dd where d <= 0.6 group by 1, 2) select field, a as id, least(a, lo) as cluster_id from near where n >= 2"""
_P2 = f"""
with ok as (select id, rating, num_votes, plot_emb::double[] v from imdb_t1_hnsw where rating between 0 and 10 and not isnan(rating) and num_votes >= 0 and {_SOUND.format(v="plot_emb", n=1536)}),
own as (select id, rank() over (order by rating desc) - 1 br, rank() over (order by num_votes desc) - 1 bv, count(*) over () n, v from ok),
x as (select q.query_id, q.k, o.id, br, bv, n, rank() over (partition by q.query_id order by round(list_distance(o.v, q.query_emb::double[]), 9)) - 1 bd from own o, rank_queries q),
y as (select *, list_sort([1.0::double - br / n, 1.0::double - bv / n, 1.0::double - bd / n]) lv from x),
z as (select *, row_number() over (partition by query_id order by lv desc, id) pos from y)
"""
_P3 = """
with m as (select mol_id::bigint id, list_sort(list_filter(list_transform(range(1024), lambda b: case when (ecfp_1024.words[b // 64 + 1] >> (63 - b % 64)) & 1 = 1 then b end), lambda x: x is not null)) bits,
  list_sort(list_distinct(list_filter(list_transform(therapeutic_area, lambda a: lower(regexp_replace(a, '^\\s+|\\s+$', '', 'g'))), lambda a: a is not null and a <> ''))) areas from molecule where ecfp_1024.words is not null),
c as (select * from m where len(bits) > 0 and len(areas) > 0),
p as (select x.id a, y.id b from c x join c y on x.id < y.id and least(len(x.bits), len(y.bits)) >= 0.7 * greatest(len(x.bits), len(y.bits))
  where len(list_intersect(x.areas, y.areas)) / len(list_distinct(x.areas || y.areas)) >= 0.5 and len(list_intersect(x.bits, y.bits)) / len(list_distinct(x.bits || y.bits)) >= 0.7)
"""
_P7 = """
with latest as (select id1, id2, -arg_max(m, row(coalesce(inserted_at, timestamptz '0001-01-01'), m)) dis from (select *, -dis m from ti_imdb_t1_imdb_t2 where id1 is not null and id2 is not null and dis >= 0 and not isnan(dis)) group by 1, 2),
r as (select *, row_number() over (partition by id1 order by dis, id2) rk from latest)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_nearest, p2_found, p2_rank, p3_found, p3_classes, p6_found, p6_clusters, p7_found, p7_ranked, p8_ids, p8_decoded, p9_mix, p9_shares, p10_found, p10_sources)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "select distinct field, least(a, b) id_a, greatest(a, b) id_b from r where rk <= 5 and d <= 0.6",
        "p2_found": _P2 + "select query_id, id from z where greatest(br, bv, bd) * 20 < n",
        "p2_rank": _P2 + "select query_id, id, pos as position, br as better_rating, bv as better_votes, bd as better_distance from z where pos <= k",
        "p3_found": _P3 + "select a as mol_id_a, b as mol_id_b from p",
        "p6_found": _P6 + " and field <> 'title_emb'",
        "p7_found": _P7 + "select id1, id2 from r where rk <= 5",
        "p7_ranked": _P7 + "select id1, id2, dis, rk as rank from r where rk <= 5",
    }
