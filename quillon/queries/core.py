"""Queries of the core operators for skewed keys and packed fields, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eager, packed


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each genre and each name of the packed fields; a person has at least two words."""
    return packed.split_packed(_t(spark, d, "imdb_t1_hnsw"), "id", {"genre": 1, "actor_director": 2})


def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """How often each value occurs in its field."""
    return p4_found(spark, d).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def _side(spark: SparkSession, d: str, side: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs, the entities of one side (titles and hubs), and the state of every key of that side."""
    i = {"id1": "t1", "id2": "t2"}[side]
    pairs = _t(spark, d, "ti_imdb_t1_imdb_t2")
    titles = _t(spark, d, f"imdb_{i}_hnsw").select("id", "tconst", "rating")
    hubs = _t(spark, d, "ti_hubs").filter(F.col("side") == i).select("id", "tconst", F.lit(None).cast("double").alias("rating"))
    dis = F.when(~F.isnan("dis") & (F.col("dis") >= 0), F.col("dis"))
    states = eager.eager_join_aggregate(
        pairs, titles.unionByName(hubs), F.col(side), F.col("id"),
        sums={"sound_dis": F.when(dis.isNotNull(), 1).otherwise(0)}, right_sums={"rating_sum": F.col("rating")}, least={"least_dis": dis}, greatest={"greatest_dis": dis, "last_batch": F.col("batch_no")}, right_greatest={"rating": F.col("rating")},
    )
    return pairs, titles, states


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that hold at least 4 % of all rows of the pair table, for either side."""
    out = None
    for side in ("id1", "id2"):
        pairs, _, states = _side(spark, d, side)
        one = eager.heavy_keys(states, 0.04, pairs.agg(F.count(F.lit(1)).alias("all_rows"))).select(F.lit(side).alias("side"), F.col("key").cast("bigint").alias("key_id"))
        out = one if out is None else out.unionByName(one)
    return out


def p5_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every key of either side: its pairs, the rows of its join with the titles, its least and greatest dis."""
    out = None
    for side in ("id1", "id2"):
        s = _side(spark, d, side)[2].select(F.lit(side).alias("side"), F.col("key").alias("key_id"), "left_rows", "joined_rows", "sound_dis", F.round("rating_sum", 4).alias("rating_sum"), "least_dis", "greatest_dis", "last_batch", "rating")
        out = s if out is None else out.unionByName(s)
    return out


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    """The key states rolled up to the last batch of their key: how many keys and joined rows, and the sums over them."""
    out = None
    for side in ("id1", "id2"):
        s = eager.roll_up(_side(spark, d, side)[2], [F.col("last_batch")], sums=["sound_dis"], least=["least_dis"], greatest=["greatest_dis"])
        s = s.select(F.lit(side).alias("side"), *s.columns)
        out = s if out is None else out.unionByName(s)
    return out


_P5 = """
with e as (select id, rating, 't1' s from imdb_t1_hnsw union all select id, rating, 't2' from imdb_t2_hnsw union all select id, null, side from ti_hubs),
p as (select 'id1' side, 't1' s, id1 key_id, dis, batch_no from ti_imdb_t1_imdb_t2 union all select 'id2', 't2', id2, dis, batch_no from ti_imdb_t1_imdb_t2)
"""


_P5_STATES = _P5 + """, l as (select side, s, key_id, count(*) left_rows, count(*) filter (not isnan(dis) and dis >= 0) sound_dis, min(dis) filter (not isnan(dis) and dis >= 0) least_dis, max(dis) filter (not isnan(dis) and dis >= 0) greatest_dis, max(batch_no) last_batch from p where key_id is not null group by 1, 2, 3),
r as (select s, id, count(*) n, max(rating) rating, sum(rating) rs from e group by 1, 2),
j as (select l.*, r.n, r.rating, r.rs from l left join r on l.s = r.s and l.key_id = r.id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p4_found, p4_frequencies, p5_found, p5_keys, p5_batches)}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _P5 + "select side, key_id from p where key_id is not null group by 1, 2 having count(*) >= 0.04 * (select count(*) from ti_imdb_t1_imdb_t2)",
        "p5_keys": _P5_STATES + "select side, key_id, left_rows, left_rows * coalesce(n, 1) as joined_rows, sound_dis * coalesce(n, 1) as sound_dis, round(rs * left_rows, 4) as rating_sum, least_dis, greatest_dis, last_batch, rating from j",
        "p5_batches": _P5_STATES + "select side, last_batch, count(*) as keys, sum(left_rows)::bigint as left_rows, sum(left_rows * coalesce(n, 1))::bigint as joined_rows, sum(sound_dis * coalesce(n, 1))::bigint as sound_dis, min(least_dis) as least_dis, max(greatest_dis) as greatest_dis from j group by 1, 2",
    }
