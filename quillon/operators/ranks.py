"""Ranks and running totals over whole tables without a single-partition window.

Values are first counted per distinct value, then spread over buckets by approximate quantiles
(a sketch of fixed size per group); a running total inside each bucket plus the total of the
buckets before it gives the exact figure. The buckets only balance the work: a poor quantile
makes a bucket larger, never a result wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: list[str], order: str, weight: str, out: str, buckets: int = 64) -> DataFrame:
    """Add `out`: the sum of `weight` over the rows of the group with a smaller `order`.

    `order` must be numeric, not null and distinct within its group (count equal values first).
    Empty tables give empty results. Groups of any number and size: no group is held by one task.
    """
    qs = [i / buckets for i in range(1, buckets)]
    b, s = "__bucket", "__splits"
    splits = df.groupBy(*group).agg(F.percentile_approx(order, qs, 2000).alias(s)) if group else df.agg(F.percentile_approx(order, qs, 2000).alias(s))
    if group:
        placed = df.join(splits, group)
    else:
        row = splits.head()  # one row of `buckets` numbers
        placed = df.withColumn(s, F.array(*[F.lit(x) for x in (row[0] or [])]) if row and row[0] else F.array().cast("array<double>"))
    placed = placed.withColumn(b, F.size(F.filter(F.col(s), lambda x: x < F.col(order)))).drop(s)
    totals = placed.groupBy(*group, b).agg(F.sum(weight).alias("__t"))
    w = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1) if group else Window.partitionBy(F.lit(1)).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("__earlier", F.coalesce(F.sum("__t").over(w), F.lit(0))).drop("__t")  # at most `buckets` rows a group
    inside = Window.partitionBy(*group, b).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(before, [*group, b]).withColumn(out, F.col("__earlier") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop(b, "__earlier")


def count_better(df: DataFrame, group: list[str], value: Column, out: str, higher_is_better: bool = True, buckets: int = 64) -> DataFrame:
    """The distinct values (`__v`) of each group with `out`: how many rows of the group have a strictly better value.

    Null and NaN values are left out. Join the result back on the group and the value.
    """
    key = (-value if higher_is_better else value).cast("double")
    counts = df.select(*group, key.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v")).groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__n"))
    return running_total(counts, group, "__v", "__n", out, buckets).drop("__n")
