"""Semantic predicates by cascade: a cheap embedding signal settles most rows, a verifier only the uncertain ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import ranks

Verifier = Callable[[DataFrame, str], DataFrame]
"""verify(rows, prompt) -> (id, verdict)."""


def similarity(vec: Column, anchor: list[float]) -> Column:
    return F.lit(1.0) - V.score(vec, anchor, "cos")


def _mean(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out / F.lit(float(len(cols)))


def margin(vec: Column, positive: list[list[float]], negative: list[list[float]], how: str = "mean") -> Column:
    """Mean (or greatest) similarity to the positive anchors less that to the negative ones."""
    pos, neg = [similarity(vec, a) for a in positive], [similarity(vec, a) for a in negative]
    best = lambda c: c[0] if len(c) == 1 else F.greatest(*c)
    return _mean(pos) - _mean(neg) if how == "mean" else best(pos) - best(neg)


def all_margins(margins: list[Column]) -> Column:
    """One score of several conditions that must all hold: the least margin; null where one is null."""
    null = margins[0].isNull()
    for m in margins[1:]:
        null = null | m.isNull()
    return F.when(~null, F.least(*margins) if len(margins) > 1 else margins[0])


def drop_only(score: Column, low: float) -> Column:
    """The band of a filter that may only drop: neg below `low`, unc from it on, nothing sure."""
    return F.when(score < low, "neg").otherwise("unc")


def role_margin(vec: Column, anchors: dict[str, list[float]], role: str) -> Column:
    """Similarity to the role's anchor less the mean over the other roles."""
    others = [similarity(vec, a) for r, a in anchors.items() if r != role]
    return similarity(vec, anchors[role]) - _mean(others)


def confidence(vec: Column, anchors: dict[str, list[float]]) -> tuple[Column, Column]:
    """The most similar class (ties: the first named) and the gap between the best and the second best."""
    sims = F.array(*[similarity(vec, a) for a in anchors.values()])
    names = F.array(*[F.lit(c) for c in anchors])
    order = F.sort_array(sims, asc=False)
    return F.get(names, F.array_position(sims, F.array_max(sims)).cast("int") - 1), F.get(order, 0) - F.coalesce(F.get(order, 1), F.lit(0.0))


def absolute_band(score: Column, low: float, high: float) -> Column:
    """pos above `high`, neg below `low`, unc between; a null score is uncertain."""
    return F.when(score > high, "pos").when(score < low, "neg").otherwise("unc")


def alpha_band(df: DataFrame, key: str, score: str, alpha: float) -> DataFrame:
    """Add `bucket`: the round(alpha * n) rows of least absolute score are uncertain, the rest go by sign (0 is neg).

    Halves round to even. The rank comes from counts per value and bucket, not from one sorted partition.
    """
    n = df.count()
    want = int(np.rint(alpha * n))
    return _least(df.withColumn("__a", F.abs(score)), key, "__a", want, F.when(F.col(score) > 0, "pos").otherwise("neg")).drop("__a")


def topk_band(df: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """Add `bucket`: the k greatest scores are uncertain, all others neg."""
    return _least(df.withColumn("__a", -F.col(score)), key, "__a", k, F.lit("neg")).drop("__a")


def _least(df: DataFrame, key: str, value: str, k: int, rest: Column) -> DataFrame:
    counts = df.groupBy(F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__v").isNotNull())
    before = ranks.running_total(counts, [], "__v", "__n", "__before")
    edge = before.filter((F.col("__before") < k) & (F.col("__before") + F.col("__n") > k)).select(F.col("__v").alias("__edge"), (k - F.col("__before")).alias("__left")).head()
    x = df.join(before.select("__v", "__before", "__n"), F.col(value).cast("double") == F.col("__v"), "left")
    inside = F.col("__before") + F.col("__n") <= k
    if edge is not None:  # rows tied at the edge: the smallest ids
        last = x.filter(F.col("__v") == edge[0]).select(key).orderBy(key).limit(int(edge[1])).withColumn("__hit", F.lit(True))
        x = x.join(last, key, "left")
        inside = inside | F.col("__hit").isNotNull()
    else:
        x = x.withColumn("__hit", F.lit(None).cast("boolean"))
    return x.withColumn("bucket", F.when(inside, "unc").otherwise(rest)).drop("__v", "__before", "__n", "__hit")


@dataclass(frozen=True)
class CascadeResult:
    positive: DataFrame
    banded: DataFrame


def cascade(banded: DataFrame, key: str, prompt: str, verify: Verifier) -> CascadeResult:
    """The ids in pos, and those of the uncertain rows that the verifier confirms; nothing else reaches it."""
    sure = banded.filter("bucket = 'pos'").select(key)
    asked = verify(banded.filter("bucket = 'unc'"), prompt).filter(F.col("verdict").cast("boolean")).select(F.col("id").alias(key))
    return CascadeResult(sure.unionByName(asked).distinct(), banded)


def column_verifier(column: str, key: str = "id") -> Verifier:
    """A verifier that reads its verdict from a column: for tests and for recorded answers."""
    return lambda rows, prompt: rows.select(F.col(key).alias("id"), F.col(column).alias("verdict"))


def batch_verifier(answer: Callable[[list, str], list], key: str, text: str, kind: str = "boolean") -> Verifier:
    """A verifier that gives Arrow batches of texts to a function (a model client) on the executors."""

    def verify(rows: DataFrame, prompt: str) -> DataFrame:
        def run(batches):  # noqa: ANN001, ANN202
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_pydict({"id": b.column(0), "verdict": answer(b.column(1).to_pylist(), prompt)})

        return rows.select(F.col(key).cast("bigint").alias("id"), text).mapInArrow(run, f"id bigint, verdict {kind}")

    return verify


def first_confirmed(rows: DataFrame, key: str, order: list[str], prompt: str, verify: Verifier, n: int, batch: int = 256) -> DataFrame:
    """The first `n` rows by `order` that the verifier confirms. Rows are asked in batches of growing size, so
    that a LIMIT spares most of the calls; each batch is one bounded job."""
    from ..plans.topk import page_after

    found, last, spark = [], None, rows.sparkSession
    while len(found) < n:
        page = page_after(rows, [*order, key], last, batch).collect()  # `batch` rows
        if not page:
            break
        asked = spark.createDataFrame(page, rows.schema)
        yes = {r["id"] for r in verify(asked, prompt).filter(F.col("verdict").cast("boolean")).select("id").collect()}
        found += [r for r in page if r[key] in yes]
        last, batch = [page[-1][c] for c in (*order, key)], batch * 2
    return spark.createDataFrame(found[:n], rows.schema)


def cluster_cascade(clustered: DataFrame, key: str, cluster: str, to_centre: str, prompt: str, generate: Verifier) -> DataFrame:
    """(key, answer): one representative a cluster (least distance to the centre, ties by id) is asked, its answer goes to all; none is UNKNOWN."""
    rep = clustered.groupBy(cluster).agg(F.min(F.struct(to_centre, key)).alias("p")).select(cluster, F.col(f"p.{key}").alias("__rep"))
    asked = clustered.join(rep.select(F.col("__rep").alias(key)), key, "left_semi")
    said = generate(asked, prompt).select(F.col("id").alias("__rep"), F.col("verdict").cast("string").alias("answer"))
    return clustered.join(rep, cluster).join(said, "__rep", "left").select(key, F.coalesce("answer", F.lit("UNKNOWN")).alias("answer"))


def single_link_clusters(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """(key, cluster): connected components of an undirected edge table (a, b); the least id names a cluster."""
    from ..session import cut

    both = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    label = cut(nodes.select(F.col(key).alias("x"), F.col(key).alias("cluster")))
    while True:
        near = both.join(label.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("cluster").alias("near"))
        low = label.join(near, "x", "left").select("x", "cluster", F.least("cluster", F.coalesce("near", "cluster")).alias("low"))
        hop = label.select(F.col("x").alias("low"), F.col("cluster").alias("hop"))
        new = cut(low.join(hop, "low", "left").select("x", F.least("low", F.coalesce("hop", "low")).alias("cluster"), F.col("cluster").alias("old")))
        label = new.select("x", "cluster")
        if new.filter("cluster < old").isEmpty():
            return label.withColumnRenamed("x", key)


def complete_link_clusters(df: DataFrame, key: str, vec: str, group: str, threshold: float, most: int = 2000) -> DataFrame:
    """(key, cluster) by complete linkage under cosine distance within each group of at most `most` rows; larger groups are an error."""

    def run(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        if len(pdf) > most:
            raise ValueError(f"complete linkage takes at most {most} rows a group")
        pdf = pdf.sort_values("id")
        m = np.stack(pdf["v"].to_list()).astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        d = 1 - m @ m.T
        np.fill_diagonal(d, np.inf)
        ids, into = pdf["id"].to_numpy(), np.arange(len(pdf))
        live = np.ones(len(pdf), bool)
        while live.sum() > 1:
            i, j = np.unravel_index(np.argmin(d), d.shape)
            if d[i, j] > threshold:
                break
            i, j = min(i, j), max(i, j)
            d[i] = np.maximum(d[i], d[j])
            d[:, i] = d[i]
            d[i, i] = np.inf
            d[j], d[:, j] = np.inf, np.inf
            live[j] = False
            into[into == j] = i
        return pd.DataFrame({"id": ids, "cluster": ids[into]})

    return df.select(F.col(key).cast("bigint").alias("id"), F.col(vec).alias("v"), group).groupBy(group).applyInPandas(run, "id bigint, cluster bigint").withColumnRenamed("id", key)


def softmax_rank(sims: list[Column], grades: list[float], temperature: float = 1.0) -> Column:
    """The mean grade weighted by the softmax of similarities."""
    e = [F.exp(s / F.lit(temperature)) for s in sims]
    num, den = e[0] * grades[0], e[0]
    for x, g in zip(e[1:], grades[1:], strict=True):
        num, den = num + x * g, den + x
    return num / den


def rescale(df: DataFrame, col: str, out: str, low: float, high: float) -> DataFrame:
    """Min-max over all rows to [low, high]; a constant column becomes `low`."""
    lo, hi = df.agg(F.min(col), F.max(col)).head()
    if lo is None or hi == lo:
        return df.withColumn(out, F.when(F.col(col).isNotNull(), F.lit(float(low))))
    return df.withColumn(out, F.lit(float(low)) + (F.col(col) - F.lit(lo)) * F.lit((high - low) / (hi - lo)))


def modality_xor(flags: DataFrame, key: str, damaged: str, modality: str) -> DataFrame:
    """Keys seen in several modalities of which some and not all are damaged."""
    g = flags.groupBy(key).agg(F.max(F.col(damaged).cast("int")).alias("hi"), F.min(F.col(damaged).cast("int")).alias("lo"), F.count_distinct(modality).alias("m"))
    return g.filter("hi = 1 and lo = 0 and m > 1").select(key)


def cost(usage: DataFrame, per_input: float, per_output: float) -> DataFrame:
    """(calls, input_tokens, output_tokens, usd) of a usage table."""
    return usage.agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")).withColumn("usd", F.col("input_tokens") * per_input + F.col("output_tokens") * per_output)


