"""One ranking from several differently scaled scores, by leximin ordering.

Each score becomes a percentile (the share of items that are not strictly better), so range and
shape no longer matter; each item's own percentiles are sorted ascending and items are compared
by these arrays: first by their weakest score, then by the next. A weak score cannot be masked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import count_better, running_total
from ..session import cut
from .vectors import sound_rows

#: Rows of equal leading levels that one task may order.
CROWD_ROWS = 100_000
#: Query vectors held by a task at once; more queries are worked off in blocks of this many.
QUERY_BLOCK = 256


def better_counts(df: DataFrame, group: list[str], key: list[str], scores: dict[str, tuple[Column, bool]]) -> DataFrame:
    """`group`, `key` and for each score `better_<name>`: how many items of the group are strictly better.

    `scores` maps a name to its column and whether high is better. Items lacking one of the scores
    (null or NaN) must be filtered out by the caller or get a null count. Ties share a count.
    """
    out = df.select(*group, *key, *[(-c if high else c).cast("double").alias(f"__v_{s}") for s, (c, high) in scores.items()])
    for s in scores:
        ranks = count_better(out, group, F.col(f"__v_{s}"), f"better_{s}", higher_is_better=False)
        out = out.join(ranks.withColumnRenamed("__v", f"__v_{s}"), [*group, f"__v_{s}"], "left").drop(f"__v_{s}")
    return out


def leximin(df: DataFrame, group: list[str], key: list[str], better: list[str], total: Column) -> DataFrame:
    """Order the items of each group: adds `levels` (percentiles ascending) and `position` (from 1).

    The greatest array comes first; equal arrays are ordered by `key`, so the order is total and
    repeatable. Positions come from counts per level, not from one big sort: the weakest level places
    a row, up to CROWD_ROWS rows that share it are ordered by a window, and larger crowds are placed by
    the next level, at last by the key. Only rows of one array and one first key stay together.
    """
    levels = F.array_sort(F.array(*[F.lit(1.0) - F.col(b) / total for b in better]))
    rest = cut(df.withColumn("levels", levels)).withColumn("__ahead", F.lit(0).cast("bigint"))
    keep, by, out = [c for c in rest.columns if c != "__ahead"], list(group), None
    for i in range(len(better) + 1):  # level by level, and at last by key; only what is still crowded goes on
        step = f"__l{i}"
        rest = rest.withColumn(step, -F.col("levels")[i] if i < len(better) else F.col(key[0]))
        sizes = rest.groupBy(*by, step).agg(F.count(F.lit(1)).alias("__n"))
        placed = running_total(sizes, by, step, "__n", "__before")
        rest = rest.join(placed, [*by, step]).withColumn("__ahead", F.col("__ahead") + F.col("__before")).drop("__before")
        by = [*by, step]
        w = _window(by, [F.col("levels").desc(), *[F.col(k) for k in key]])
        few = rest if i == len(better) else rest.filter(F.col("__n") <= CROWD_ROWS)
        few = few.withColumn("position", F.col("__ahead") + F.row_number().over(w)).select(*keep, "position")
        out = few if out is None else out.unionByName(few)
        if i == len(better):
            return out
        crowded = sizes.filter(F.col("__n") > CROWD_ROWS)
        if crowded.isEmpty():
            return out
        rest = cut(rest.filter(F.col("__n") > CROWD_ROWS).drop("__n"))
    return out


def _window(by: list[str], order: list[Column]):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*order)


def query_distances(items: DataFrame, key: str, vec: str, dim: int, queries: DataFrame, query_key: str, query_vec: str) -> DataFrame:
    """(query_id, id, distance): L2 distance of every sound item vector to every sound query vector.

    Queries are read in blocks of QUERY_BLOCK rows, each block one pass over the items; the block
    is all that a task holds. Distances are computed in double. Unsound vectors give no row.
    """
    rows = queries.select(F.col(query_key).cast("bigint").alias("q"), F.col(query_vec).alias("v")).filter(F.col("q").isNotNull())
    blocks = -(-rows.count() // QUERY_BLOCK)
    out = None
    for i in range(max(1, blocks)):
        part = rows if blocks < 2 else rows.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)
        held = part.toArrow()
        idx, m = sound_rows(held["v"], dim)
        ids, m = held["q"].to_numpy()[idx], m.astype(np.float64)
        here = items.select(F.col(key).cast("bigint").alias("id"), vec).mapInArrow(_distances(ids, m, dim), "query_id bigint, id bigint, distance double")
        out = here if out is None else out.unionByName(here)
    return out


def _distances(ids: np.ndarray, queries: np.ndarray, dim: int):  # noqa: ANN202
    q2 = (queries * queries).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, m = sound_rows(b.column(1), dim)
            keys = b.column(0).to_numpy(zero_copy_only=False)[idx]
            for lo in range(0, len(m), 1024):
                x = m[lo : lo + 1024].astype(np.float64)
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + q2[None] - 2 * x @ queries.T, 0))
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, n)), pa.array(np.repeat(keys[lo : lo + 1024], len(ids)).astype(np.int64)), pa.array(d.ravel())], ["query_id", "id", "distance"])

    return run


def rank_films(films: DataFrame, queries: DataFrame, dim: int = 1536) -> DataFrame:
    """For each query, every film in one order that respects rating, votes and nearness alike.

    (query_id, id, n, better_rating, better_votes, better_distance, levels, position). Films count
    whose rating lies in 0..10, whose num_votes is 0 or more and whose plot_emb is sound; null and
    NaN in one of them leaves the film out. Ties share a percentile and are ordered by id.
    Empty films or queries give an empty result. Other columns are not read.
    """
    ok = films.select(F.col("id").cast("bigint").alias("id"), "rating", "num_votes", "plot_emb").filter(
        F.col("id").isNotNull() & F.col("rating").between(0, 10) & ~F.isnan("rating") & (F.col("num_votes") >= 0)
    )
    near = cut(query_distances(ok, "id", "plot_emb", dim, queries, "query_id", "query_emb"))  # the vectors are read once
    sound = cut(ok.select("id", "rating", "num_votes").join(near.select("id").distinct(), "id", "left_semi"))
    n = sound.count()
    own = better_counts(sound, [], ["id"], {"rating": (F.col("rating"), True), "votes": (F.col("num_votes"), True)})
    each = better_counts(near, ["query_id"], ["id"], {"distance": (F.col("distance"), False)})
    x = each.join(own, "id").withColumn("n", F.lit(n).cast("bigint"))
    return leximin(x, ["query_id"], ["id"], ["better_rating", "better_votes", "better_distance"], F.col("n"))


def best_on_all(ranked: DataFrame, parts: int = 20) -> DataFrame:
    """The ranked rows whose weakest level is in the best 1/`parts`: fewer than n/parts are better on every score."""
    most = F.greatest("better_rating", "better_votes", "better_distance")
    return ranked.filter(most * parts < F.col("n"))
