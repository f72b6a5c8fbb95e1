"""Ranked queries: classes W1 to W8 = {filter} x {several scores} x {semantic join}, compiled to one DataFrame plan.

Lower is better. Results are exact and ordered by score, then ids. Filters come before scores and
top-k is a plain ORDER BY ... LIMIT, so Catalyst pushes the first into the scan and plans the second
as a top-k of each partition.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import predicates as P
from ..operators import semjoin as S

AGGREGATIONS = ("weighted_sum", "sum", "min", "max")


@dataclass(frozen=True)
class Signal:
    """A score: "semantic" (distance of `field` to `query_embed`), "attribute" or "relational" (a column, `direction` asc or desc), "join_distance"."""

    type: str
    table: str = ""
    field: str = ""
    query_embed: tuple[float, ...] = ()
    metric: str = "l2"
    direction: str = "asc"

    def column(self) -> Column:
        if self.type == "semantic":
            return V.score(F.col(self.field), list(self.query_embed), self.metric)
        if self.type in ("attribute", "relational"):
            c = F.col(self.field).cast("double")
            return c if self.direction == "asc" else -c
        raise ValueError(f"unknown signal type {self.type}")


@dataclass(frozen=True)
class Join:
    table_left: str
    table_right: str
    distance_threshold: float
    embed_left: str = ""
    embed_right: str = ""
    metric: str = "l2"


@dataclass(frozen=True)
class TopKQuery:
    k: int
    signals: tuple[Signal, ...]
    aggregation: str = "weighted_sum"
    weights: tuple[float, ...] = ()
    predicates: tuple[P.Predicate, ...] = ()
    join: Join | None = None
    seed: str = ""

    def __post_init__(self) -> None:
        if self.k < 1:
            raise ValueError("K must be positive")
        if not self.signals:
            raise ValueError("a query needs a signal")
        if self.aggregation not in AGGREGATIONS:
            raise ValueError(f"unknown aggregation {self.aggregation}")
        if self.aggregation == "weighted_sum" and self.weights and len(self.weights) != len(self.signals):
            raise ValueError("one weight for each signal")

    @property
    def workload(self) -> str:
        """Its class, W1 to W8."""
        several = len(self.signals) > 1
        return f"W{1 + bool(self.predicates) + 2 * several + 4 * (self.join is not None)}"

    @classmethod
    def from_json(cls, doc: str | dict[str, Any]) -> TopKQuery:
        q = json.loads(doc) if isinstance(doc, str) else doc
        s = q.get("scoring", {})
        signals = tuple(Signal(x["type"], x.get("table", ""), x.get("field", ""), tuple(x.get("query_embed", ())), x.get("metric", "l2"), x.get("direction", "asc")) for x in s.get("signals", []))
        preds = tuple(P.Predicate(p["table"], p["attribute"], p["operator"], p["value"]) for p in q.get("predicates", []))
        j = q.get("join")
        join = Join(j["table_left"], j["table_right"], j["distance_threshold"], j.get("embed_left", ""), j.get("embed_right", ""), j.get("metric", "l2")) if j else None
        return cls(q["K"], signals, s.get("aggregation", "weighted_sum"), tuple(s.get("weights", ())), preds, join)


def combine(scores: list[Column], aggregation: str, weights: tuple[float, ...] = ()) -> Column:
    """One score of several; null where one of them is null."""
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {aggregation}")
    if len(scores) == 1 and aggregation != "weighted_sum":
        return scores[0]
    if aggregation in ("sum", "weighted_sum"):
        w = weights if aggregation == "weighted_sum" and weights else (1.0,) * len(scores)
        out = scores[0] * F.lit(float(w[0]))
        for x, y in zip(scores[1:], w[1:], strict=True):
            out = out + x * F.lit(float(y))
        return out
    any_null = scores[0].isNull()
    for x in scores[1:]:
        any_null = any_null | x.isNull()
    return F.when(~any_null, (F.least if aggregation == "min" else F.greatest)(*scores))


def top_k(df: DataFrame, score: Column, k: int, key: str = "id", keep: list[str] | None = None) -> DataFrame:
    """The k rows of least score, ties by key; rows without a score are left out. Columns: key, kept ones, score."""
    x = df.select(key, *(keep or []), score.alias("score")).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return x.orderBy("score", key).limit(k)


def scored(df: DataFrame, signals: list[Signal], key: str, prefix: str = "s") -> DataFrame:
    """key and one column for each signal."""
    return df.select(key, *[s.column().alias(f"{prefix}{i}") for i, s in enumerate(signals)])


def run(query: TopKQuery, tables: dict[str, DataFrame], keys: dict[str, str], ti: DataFrame | None = None) -> DataFrame:
    """Answer a query over named tables. Join queries use the pair index `ti` (l_id, r_id, dis) or join on the fly.

    W1-W4: (key, score). W5, W6: (l_id, r_id, dis, score), the best seeds (the left table) with their
    nearest partner. W7, W8: (l_id, r_id, dis, score), the best pairs.
    """
    names = {P.table_name(n): n for n in tables}
    resolve = lambda n: names[P.table_name(n)]
    if query.join is None:
        n = resolve(query.signals[0].table) if query.signals[0].table else next(iter(tables))
        df = P.apply(tables[n], P.of_table(query.predicates, n) if query.signals[0].table else query.predicates)
        return top_k(df, combine([s.column() for s in query.signals], query.aggregation, query.weights), query.k, keys[n])
    j = query.join
    ln, rn = resolve(j.table_left), resolve(j.table_right)
    lk, rk = keys[ln], keys[rn]
    left, right = tables[ln], tables[rn]
    if ti is None:
        ti = S.pairs(left, lk, j.embed_left, right, rk, j.embed_right, j.distance_threshold, j.metric)
    near = ti.filter(F.col("dis") <= j.distance_threshold).select("l_id", "r_id", "dis")
    lp, rp = P.of_table(query.predicates, ln), P.of_table(query.predicates, rn)
    if lp:
        near = near.join(P.apply(left, lp).select(F.col(lk).alias("l_id")), "l_id", "left_semi")
    if rp:
        near = near.join(P.apply(right, rp).select(F.col(rk).alias("r_id")), "r_id", "left_semi")
    ls = [s for s in query.signals if s.type != "join_distance" and P.table_name(s.table) == P.table_name(ln)]
    rs = [s for s in query.signals if s.type != "join_distance" and P.table_name(s.table) != P.table_name(ln)]
    if len(query.signals) == 1 and ls:
        seeds = scored(left.join(near.select(F.col("l_id").alias(lk)), lk, "left_semi"), ls, lk).withColumnRenamed(lk, "l_id")
        best = seeds.filter(F.col("s0").isNotNull()).orderBy("s0", "l_id").limit(query.k)
        return S.nearest_partner(near.join(best, "l_id", "left_semi")).join(best, "l_id").select("l_id", "r_id", "dis", F.col("s0").alias("score")).orderBy("score", "l_id")
    x = near
    if ls:
        x = x.join(scored(left, ls, lk, "l").withColumnRenamed(lk, "l_id"), "l_id")
    if rs:
        x = x.join(scored(right, rs, rk, "r").withColumnRenamed(rk, "r_id"), "r_id")
    cols, li, ri = [], iter(range(len(ls))), iter(range(len(rs)))
    for s in query.signals:
        cols.append(F.col("dis") if s.type == "join_distance" else F.col(f"l{next(li)}") if P.table_name(s.table) == P.table_name(ln) else F.col(f"r{next(ri)}"))
    x = x.withColumn("score", combine(cols, query.aggregation, query.weights)).filter(F.col("score").isNotNull())
    return x.orderBy("score", "l_id", "r_id").limit(query.k).select("l_id", "r_id", "dis", "score")


def best_partner_topk(near: DataFrame, left_scores: DataFrame, right_scores: DataFrame, k: int, aggregation: str, weights: tuple[float, ...]) -> DataFrame:
    """The k best seeds, each with its nearest partner only: (l_id, r_id, dis, score). Scores are (l_id, s) and (r_id, s)."""
    p = S.nearest_partner(near).join(left_scores.withColumnRenamed("s", "ls"), "l_id").join(right_scores.withColumnRenamed("s", "rs"), "r_id")
    return p.withColumn("score", combine([F.col("ls"), F.col("rs"), F.col("dis")], aggregation, weights)).orderBy("score", "l_id").limit(k).select("l_id", "r_id", "dis", "score")


def batch_topk(items: DataFrame, key: str, vec: str, queries: DataFrame, query_key: str, query_vec: str, k: int, metric: str = "l2") -> DataFrame:
    """Many queries in one job: (query_id, id, score, rank)."""
    p = S.pairs(queries, query_key, query_vec, items, key, vec, None, metric, k)
    return p.select(F.col("l_id").alias("query_id"), F.col("r_id").alias("id"), F.col("dis").alias("score"), "rank")


def rerank(df: DataFrame, coarse: Column, exact: Column, k: int, factor: int, key: str = "id") -> DataFrame:
    """The `factor` * k rows of least coarse score, reordered by the exact one."""
    first = df.withColumn("__c", coarse).orderBy("__c", key).limit(factor * k)
    return top_k(first, exact, k, key)


def page_after(df: DataFrame, order: list[str], last: list[Any] | None, k: int) -> DataFrame:
    """The next k rows in the order of `order` after the row with values `last` (keyset paging)."""
    x = df
    if last is not None:
        x = x.filter(F.struct(*order) > F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, last, strict=True)]))
    return x.orderBy(*order).limit(k)


class ScoreStream:
    """Rows by ascending score, k at a time: `next`, `peek_score`, `fetch_topk`. Each call is one bounded job."""

    def __init__(self, df: DataFrame, score: Column, key: str = "id") -> None:
        self.rows = df.withColumn("score", score).filter(F.col("score").isNotNull() & ~F.isnan("score"))
        self.key, self.last = key, None

    def fetch_topk(self, k: int) -> list:
        out = page_after(self.rows, ["score", self.key], self.last, k).collect()
        if out:
            self.last = [out[-1]["score"], out[-1][self.key]]
        return out

    def next(self):  # noqa: ANN201
        return next(iter(self.fetch_topk(1)), None)

    def peek_score(self) -> float | None:
        r = page_after(self.rows, ["score", self.key], self.last, 1).collect()
        return r[0]["score"] if r else None


def progressive_pairs(ti_path: str, spark, scored_left: DataFrame, scored_right: DataFrame, k: int, weights: tuple[float, float, float], buckets: list[int], width: float = 0.1) -> DataFrame:  # noqa: ANN001
    """W7 by distance buckets in ascending order, stopping once no farther pair can enter the k best (weighted sum).

    Scores are (l_id, s) and (r_id, s). The bound takes the least left and right scores of all rows, so the result is exact.
    """
    lo = (scored_left.agg(F.min("s")).head()[0], scored_right.agg(F.min("s")).head()[0])
    best: DataFrame | None = None
    for b in sorted(buckets):
        part = spark.read.parquet(ti_path).filter(F.col("dis_bucket") == b).drop("dis_bucket")
        x = part.join(scored_left.withColumnRenamed("s", "ls"), "l_id").join(scored_right.withColumnRenamed("s", "rs"), "r_id")
        x = x.withColumn("score", F.col("ls") * weights[0] + F.col("rs") * weights[1] + F.col("dis") * weights[2]).select("l_id", "r_id", "dis", "score")
        best = (x if best is None else best.unionByName(x)).orderBy("score", "l_id", "r_id").limit(k)
        rows = best.collect()  # k rows
        best = spark.createDataFrame(rows, "l_id bigint, r_id bigint, dis double, score double")
        if None in lo or (len(rows) == k and rows[-1]["score"] <= lo[0] * weights[0] + lo[1] * weights[1] + (b + 1) * width * weights[2]):
            break
    return best


def top_per_group(df: DataFrame, group: list[str], score: Column, n: int, key: str, best: str = "least") -> DataFrame:
    """One row a group by its best score, then the first n groups."""
    agg = (F.min if best == "least" else F.max)(score).alias("score")
    return df.groupBy(*group).agg(agg).orderBy(F.col("score").asc() if best == "least" else F.col("score").desc(), *group).limit(n)


def rank_fusion(ranked: list[DataFrame], key: str, k: int, damping: int = 60) -> DataFrame:
    """Sum of 1 / (damping + rank) over ranked frames (key, rank); rows missing in one add nothing there."""
    x = ranked[0].select(key, "rank")
    for r in ranked[1:]:
        x = x.unionByName(r.select(key, "rank"))
    return x.groupBy(key).agg(F.sum(1.0 / (damping + F.col("rank"))).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


