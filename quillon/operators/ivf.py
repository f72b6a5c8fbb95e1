"""Inverted-file search: rows are filed under their nearest centroid, a query reads the nearest lists only.

Centroids are fitted on a bounded sample; every row is filed. With `probes` = the number of lists the result is exact.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.topk import top_k

SAMPLE_ROWS = 10_000


def fit(df: DataFrame, key: str, vec: str, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids by k-means on at most about max(50 * lists, SAMPLE_ROWS) rows, with spread-out (k-means++) starts."""
    want = max(50 * lists, SAMPLE_ROWS)
    n = df.count()
    x = df.select(key, vec).filter(F.col(vec).isNotNull())
    if n > want:
        x = x.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * want / n))
    m = np.array(x.select(vec).toArrow()[vec].to_pylist(), dtype=np.float32)
    if not len(m):
        return np.empty((0, 0), np.float32)
    rng = np.random.default_rng(seed)
    c = [m[rng.integers(len(m))]]
    d = ((m - c[0]) ** 2).sum(1)
    while len(c) < min(lists, len(m)) and d.sum() > 0:
        c.append(m[rng.choice(len(m), p=d / d.sum())])
        d = np.minimum(d, ((m - c[-1]) ** 2).sum(1))
    c = np.array(c)
    for _ in range(rounds):
        a = ((m * m).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * m @ c.T).argmin(1)
        for i in range(len(c)):
            if (a == i).any():
                c[i] = m[a == i].mean(0)
    return c


def assign(df: DataFrame, vec: str, centroids: np.ndarray) -> DataFrame:
    """Add `list_id`; null vectors get none. Write partitioned by it to prune files at search."""

    @F.arrow_udf("int")
    def nearest(col: pa.Array) -> pa.Array:
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        out = np.zeros(len(col), np.int32)
        ok = col.is_valid().to_numpy(zero_copy_only=False)
        idx = np.flatnonzero(ok)
        if len(idx):
            offs = col.offsets.to_numpy()
            m = col.values.to_numpy(zero_copy_only=False)[offs[idx][:, None] + np.arange(centroids.shape[1])].astype(np.float32)
            out[idx] = ((centroids * centroids).sum(1)[None] - 2 * m @ centroids.T).argmin(1)
        return pa.array(out, mask=~ok)

    return df.withColumn("list_id", nearest(F.col(vec)))


def search(filed: DataFrame, key: str, vec: str, query: list[float], centroids: np.ndarray, k: int, probes: int = 1) -> DataFrame:
    """(key, score): the k nearest among the rows of the `probes` nearest lists."""
    d = ((centroids - np.asarray(query, np.float32)) ** 2).sum(1)
    near = [int(i) for i in np.argsort(d, kind="stable")[:probes]]
    return top_k(filed.filter(F.col("list_id").isin(near)), V.score(F.col(vec), list(query)), k, key)


def search_until(filed: DataFrame, key: str, vec: str, query: list[float], centroids: np.ndarray, k: int, probes: int = 1) -> DataFrame:
    """`search` that goes on to farther lists, twice as many each time, until it has k rows or has read every list.

    For filtered tables, whose near lists may hold too few rows. Each round counts the rows of its lists only.
    """
    while probes < len(centroids):
        if search(filed, key, vec, query, centroids, k, probes).count() >= k:
            break
        probes *= 2
    return search(filed, key, vec, query, centroids, k, probes)
