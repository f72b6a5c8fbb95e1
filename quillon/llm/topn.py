"""Top N items within every group, by a hot-cold split.

Exact counts send groups of more than `hot_rows` rows to salted range sorting: approximate
quantiles of the score (a sketch of fixed size a group) cut a hot group into ranges, only the
leading ranges that hold the first N rows go on, and these are spread over salts, ranked within
each salt and merged. All other groups go through an ordinary window. The union is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def top_n(df: DataFrame, group: list[str], order: list[Column], score: Column, n: int, hot_rows: int = 10_000, ranges: int = 32, salts: int = 16) -> DataFrame:
    """The first `n` rows of each group by `order`, with their `rank` from 1.

    `order` must end in a key that makes it total, and its first key must sort as `score`
    ascending (`score` is cast to double for the ranges only, and may not be null); then equal
    scores are ordered alike in every run. Repeated rows each take a rank. A null group is a group
    of its own, as in GROUP BY. Empty tables give an empty result; other columns pass through.
    `n` below 1 gives no rows.
    """
    if n < 1:
        return df.withColumn("rank", F.lit(1)).limit(0)
    same = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group]
    ranked = lambda d, by: d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)
    x = df.withColumn("__s", score.cast("double"))
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows"))
    hot = counts.filter(F.col("__rows") > hot_rows)
    cold = x.alias("x").join(hot.alias("h"), same("x", "h"), "left_anti").select("x.*").drop("__s")

    warm = x.alias("x").join(hot.alias("h"), same("x", "h"), "inner").select("x.*")
    cuts = warm.groupBy(*group).agg(F.percentile_approx("__s", [i / ranges for i in range(1, ranges)], 2000).alias("__cuts"))
    placed = warm.alias("x").join(cuts.alias("h"), same("x", "h")).select("x.*", "h.__cuts").withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("__s")))).drop("__cuts", "__s")
    sizes = placed.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = sizes.withColumn("__ahead", ahead).filter(F.col("__ahead") < n).groupBy(*group).agg(F.max("__range").alias("__last"))  # ranges after these hold no row of the first n
    kept = placed.alias("x").join(lead.alias("h"), [*same("x", "h"), F.col("x.__range") <= F.col("h.__last")]).select("x.*")
    salted = kept.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in df.columns if not _nested(df, c)]), F.lit(salts)))
    part = ranked(salted, [*group, "__range", "__salt"]).drop("rank")
    first = ranked(part, group).drop("__range", "__salt")  # at most n rows of each range and salt
    return ranked(cold, group).unionByName(first)


def _nested(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant")


def least_partners(pairs: DataFrame, n: int = 5, hot_rows: int = 10_000) -> DataFrame:
    """For every id1 the `n` id2 with the least dis, ties by smaller id2: (id1, id2, dis, rank).

    Rows lacking an id and rows whose dis is null, NaN or negative do not count. Of several rows of
    a pair the latest inserted_at counts (null is earliest; of several latest the least dis).
    """
    ok = F.col("id1").isNotNull() & F.col("id2").isNotNull() & F.col("dis").isNotNull() & ~F.isnan("dis") & (F.col("dis") >= 0)
    latest = (
        pairs.select("id1", "id2", "dis", "inserted_at").filter(ok)
        .groupBy("id1", "id2").agg(F.max(F.struct("inserted_at", (-F.col("dis")).alias("m"))).alias("l"))
        .select("id1", "id2", (-F.col("l.m")).alias("dis"))
    )
    latest = cut(latest)  # counts, ranges and both branches read it
    return top_n(latest, ["id1"], [F.col("dis"), F.col("id2")], F.col("dis"), n, hot_rows)
