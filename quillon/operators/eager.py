"""Results for each key of a skewed table: eager aggregation through a join.

Both inputs are reduced to one compact state a key before they meet (map-side first, so a key
that holds a third of all rows leaves each task as one row), the states are joined one to one,
and the figures of the full join follow by algebra: counts multiply, a sum is multiplied by the
other side's count, least and greatest stay. The join of all rows is never formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

L, R = "__l_rows", "__r_rows"


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    left_key: Column,
    right_key: Column,
    sums: dict[str, Column] | None = None,
    least: dict[str, Column] | None = None,
    greatest: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
    right_least: dict[str, Column] | None = None,
    right_greatest: dict[str, Column] | None = None,
    how: str = "left",
    key: str = "key",
) -> DataFrame:
    """One row for each key of `left ⨝ right on left_key = right_key`.

    Columns: `key`, `left_rows` and `right_rows` (rows of either table), `joined_rows` (rows the full
    join would have), then the named figures over the joined rows. `how` is "inner" or "left"; under
    "left" a key without a partner counts once, as an outer join would. A sum of the left side is
    multiplied by the rows of the right, one of the right side by the rows of the left.

    Nulls: a null key joins nothing and gives no row, like SQL equality; null values are skipped by
    sums, least and greatest, and a figure without any value is null. NaN is a value (greatest of all).
    Repeated rows count as often as they occur. Empty tables give an empty result. Only the named
    expressions are read, so other columns may clash freely.
    """
    sums, least, greatest = sums or {}, least or {}, greatest or {}
    right_sums, right_least, right_greatest = right_sums or {}, right_least or {}, right_greatest or {}
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    lk = left.select(left_key.alias(key), *[c.alias(f"__s_{n}") for n, c in sums.items()], *[c.alias(f"__a_{n}") for n, c in least.items()], *[c.alias(f"__z_{n}") for n, c in greatest.items()]).filter(F.col(key).isNotNull())
    rk = right.select(right_key.alias(key), *[c.alias(f"__rs_{n}") for n, c in right_sums.items()], *[c.alias(f"__ra_{n}") for n, c in right_least.items()], *[c.alias(f"__rz_{n}") for n, c in right_greatest.items()]).filter(F.col(key).isNotNull())
    ls = lk.groupBy(key).agg(F.count(F.lit(1)).alias(L), *[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums], *[F.min(f"__a_{n}").alias(n) for n in least], *[F.max(f"__z_{n}").alias(n) for n in greatest])
    rs = rk.groupBy(key).agg(F.count(F.lit(1)).alias(R), *[F.sum(f"__rs_{n}").alias(f"__rs_{n}") for n in right_sums], *[F.min(f"__ra_{n}").alias(n) for n in right_least], *[F.max(f"__rz_{n}").alias(n) for n in right_greatest])
    j = ls.join(rs, key, how)
    times = F.coalesce(F.col(R), F.lit(1))
    return j.select(
        key,
        F.col(L).alias("left_rows"),
        F.coalesce(F.col(R), F.lit(0)).alias("right_rows"),
        (F.col(L) * times).alias("joined_rows"),
        *[(F.col(f"__s_{n}") * times).alias(n) for n in sums],
        *[(F.col(f"__rs_{n}") * F.col(L)).alias(n) for n in right_sums],
        *[F.col(n) for n in (*least, *greatest, *right_least, *right_greatest)],
    )


def roll_up(states: DataFrame, by: list[Column], sums: list[str] = (), least: list[str] = (), greatest: list[str] = ()) -> DataFrame:
    """Roll key states of `eager_join_aggregate` up to coarser groups: counts and sums add, least and greatest fold."""
    return states.groupBy(*by).agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("left_rows").alias("left_rows"),
        F.sum("joined_rows").alias("joined_rows"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.min(c).alias(c) for c in least],
        *[F.max(c).alias(c) for c in greatest],
    )


def heavy_keys(states: DataFrame, share: float, total: DataFrame, key: str = "key") -> DataFrame:
    """The keys whose joined rows come from at least `share` of the left rows: (key, left_rows).

    `left_rows` is taken from the join: joined_rows divided by the rows the key has on the right
    (one, where it has none). `total` is a frame of one row with the column `all_rows` (null keys count in it).
    """
    rows = F.col("joined_rows") / F.greatest(F.col("right_rows"), F.lit(1))
    return states.select(key, rows.cast("bigint").alias("left_rows")).filter(F.col("left_rows") >= total.select("all_rows").scalar() * share)
