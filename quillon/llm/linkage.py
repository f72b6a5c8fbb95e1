"""Clusters of mutually similar records, by reciprocal-nearest-neighbour average linkage.

On a sparse graph (for each distinct vector its nearest links within the threshold and the link to
the least id within it) every cluster picks its best partner; all pairs that pick each other merge
at once; links are redrawn between the merged clusters; this repeats until no link is under the
threshold. The linkage of two clusters is the root of the mean squared distance over all their
pairs of records, which follows exactly from each cluster's size, vector sum and mean squared norm,
so no pair of records is ever formed. A link over the threshold can go: the mean of two that are
over it stays over it, and one under it keeps the merged link alive.

The links fall into connected components, and no cluster reaches beyond its component. Components
of up to `LOCAL_NODES` vectors are dealt to tasks in bundles of about that size, each task running
the rounds of its bundle in memory; larger ones run the same rounds over DataFrames, so no task
holds an unbounded component, until no link is left or `LOCAL_NODES` clusters or fewer are live and
go to a task. The rounds of a crowd grow with its size, so a component whose clusters lie so near
its mean that every two unions of them are within the threshold becomes one cluster at once. Equal partners are ordered by a hash of the pair, so that a crowd of equal distances pairs off all
over at once and does not queue at its least member. States and links are cut each round in the
shared checkpoint folder; clusters without links leave the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import index as ix
from .vectors import pack, unpack

#: Vectors of a component that one task may hold, and of a bundle of components.
LOCAL_NODES = 2000

_STATE = "c bigint, n bigint, sq double, total binary"
_BUNDLED = "member bigint, cluster bigint, n bigint, sq double, total binary"


def _first_states(dim: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                x = b.slice(lo, 512)
                m = unpack(x.column(2).to_pylist(), dim).astype(np.float64)
                n = x.column(1).to_numpy(zero_copy_only=False)
                yield _states(x.column(0), n, (m * m).sum(1), m * n[:, None])

    return run


def _states(c: pa.Array, n: np.ndarray, sq: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c, pa.array(n, pa.int64()), pa.array(sq, pa.float64()), pa.array(pack(total.astype(np.float32)), pa.binary())], ["c", "n", "sq", "total"])


def _merge(dim: int):  # noqa: ANN202
    """Rows (a, n, sq, total, n2, sq2, total2) -> the state of the union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                x = b.slice(lo, 512)
                n1, s1, n2, s2 = (x.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 4, 5))
                t1, t2 = (unpack(x.column(i).to_pylist(), dim).astype(np.float64) for i in (3, 6))
                yield _states(x.column(0), n1 + n2, (s1 * n1 + s2 * n2) / (n1 + n2), t1 + t2)

    return run


def _linkage(dim: int, threshold: float):  # noqa: ANN202
    """Rows (a, b, n, sq, total, n2, sq2, total2) -> (a, b, d2) where the mean squared distance is within the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                x = b.slice(lo, 512)
                n1, s1, n2, s2 = (x.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 5, 6))
                t1, t2 = (unpack(x.column(i).to_pylist(), dim).astype(np.float64) for i in (4, 7))
                d2 = np.maximum(0, s1 + s2 - 2 * np.einsum("ij,ij->i", t1, t2) / (n1 * n2))
                keep = np.flatnonzero(d2 <= threshold * threshold + 1e-6)
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(keep)), x.column(1).take(pa.array(keep)), pa.array(d2[keep])], ["a", "b", "d2"])

    return run


def _moments(dim: int):  # noqa: ANN202
    """Rows (comp, n, sq, total) -> (c, n, sq, total) of each component's rows in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                x = b.slice(lo, 512)
                comp, n, sq = (x.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
                total = unpack(x.column(3).to_pylist(), dim).astype(np.float64)
                for c in np.unique(comp).tolist():
                    own, at = comp == c, seen.setdefault(c, [0, 0.0, np.zeros(dim)])
                    at[0], at[1], at[2] = at[0] + int(n[own].sum()), at[1] + float((n[own] * sq[own]).sum()), at[2] + total[own].sum(0)
        for c, (n, sq, total) in seen.items():
            yield _states(pa.array([c], pa.int64()), np.array([n]), np.array([sq / n]), total[None])

    return run


def _union(dim: int):  # noqa: ANN202
    def run(parts: pa.Table) -> pa.Table:
        n, sq, total = parts["n"].to_numpy(), parts["sq"].to_numpy(), unpack(parts["total"].to_pylist(), dim).astype(np.float64)
        return pa.Table.from_batches([_states(pa.array([parts["c"][0].as_py()], pa.int64()), np.array([n.sum()]), np.array([(n * sq).sum() / n.sum()]), total.sum(0)[None])])

    return run


def _spread(dim: int):  # noqa: ANN202
    """Rows (comp, n, sq, total, n2, total2) -> (comp, far, off): the mean squared distance of the first
    cluster's records from the mean of the second, and the squared distance of the means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                x = b.slice(lo, 512)
                n1, sq, n2 = (x.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 4))
                m1, m2 = (unpack(x.column(i).to_pylist(), dim).astype(np.float64) / n[:, None] for i, n in ((3, n1), (5, n2)))
                off = ((m1 - m2) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(np.maximum(0, sq - (m1 * m1).sum(1)) + off), pa.array(off)], ["comp", "far", "off"])

    return run


def crowds(states: DataFrame, labels: DataFrame, dim: int, threshold: float) -> DataFrame:
    """States (c, n, sq, total) of the components (c, comp) that end as one cluster in whatever order they merge.

    The mean squared distance of two unions A and B of clusters is far(A) + far(B) less twice the
    product of their means, all from the component's mean; so 2 max far + 2 max off bounds it.
    Only components of more than LOCAL_NODES clusters are asked, so their means are few.
    """
    large = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("nodes")).filter(F.col("nodes") > LOCAL_NODES).select("comp")
    x = states.join(labels, "c").join(large, "comp").select("comp", "n", "sq", "total")
    whole = cut(x.mapInArrow(_moments(dim), _STATE).groupBy("c").applyInArrow(_union(dim), _STATE))
    mean = whole.select(F.col("c").alias("comp"), F.col("n").alias("n2"), F.col("total").alias("total2"))
    spread = x.join(F.broadcast(mean), "comp").select("comp", "n", "sq", "total", "n2", "total2").mapInArrow(_spread(dim), "comp bigint, far double, off double")
    near = spread.groupBy("comp").agg((2 * F.max("far") + 2 * F.max("off")).alias("most")).filter(F.col("most") <= threshold * threshold)
    return cut(whole.join(near.select(F.col("comp").alias("c")), "c", "left_semi"))


def _moved(members: DataFrame, into: DataFrame) -> DataFrame:
    """(member, cluster) after the clusters of `into` (cluster, into) became others."""
    return members.join(into, "cluster", "left").select("member", F.coalesce("into", "cluster").alias("cluster"))


def merge_rounds(states: DataFrame, links: DataFrame, dim: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Merge until no link is within the threshold: (member, cluster) of every linked node, and the clusters' final states.

    `states` (c, n, sq, total) are the linked nodes, `links` (a, b, d2), a < b, their squared distances.
    The least link is always a mutual choice, so every round merges and the rounds come to an end.
    Components are told anew at rounds 0, 1, 2, 4, 8 and so on, at least every 32.
    """
    links, states = cut(links), cut(states)
    members = states.select(F.col("c").alias("member"), F.col("c").alias("cluster"))
    done = [states.limit(0)]
    for r in count():
        if r & (r - 1) == 0 or r % 32 == 0:
            labels = components(links)
            one = crowds(states, labels, dim, threshold)
            if not one.isEmpty():
                inside = labels.join(one.select(F.col("c").alias("comp")), "comp").select(F.col("c").alias("cluster"), F.col("comp").alias("into"))
                members, done = _moved(members, inside), [*done, one]
                states = cut(states.join(inside.select(F.col("cluster").alias("c")), "c", "left_anti"))
                links = cut(links.join(inside.select(F.col("cluster").alias("a")), "a", "left_anti"))
        # components that fit a task by now
        live = states.join(labels, "c")
        small = live.groupBy("comp").agg(F.count(F.lit(1)).alias("nodes")).filter(F.col("nodes") <= LOCAL_NODES)
        fits = small.agg(F.sum("nodes")).first()[0]
        if fits:
            part = cut(live.join(small.select("comp"), "comp").withColumn("bundle", F.pmod(F.xxhash64("comp"), F.lit(max(1, fits // LOCAL_NODES)))).drop("comp"))
            tied = cut(links.join(part.select(F.col("c").alias("a"), "bundle"), "a"))
            out = cut(part.groupBy("bundle").cogroup(tied.groupBy("bundle")).applyInArrow(_bundle(dim, threshold, merged=True), _BUNDLED))
            members = _moved(members, out.select(F.col("member").alias("cluster"), F.col("cluster").alias("into")))
            done.append(out.filter("total is not null").select(F.col("cluster").alias("c"), "n", "sq", "total"))
            states = cut(states.join(part.select("c"), "c", "left_anti"))
            links = cut(links.join(part.select(F.col("c").alias("a")), "a", "left_anti"))
        both = links.select(F.col("a").alias("x"), "a", "b", "d2").unionByName(links.select(F.col("b").alias("x"), "a", "b", "d2"))
        best = both.groupBy("x").agg(F.min(F.struct("d2", _order_sql("a", "b", r).alias("h"), "a", "b")).alias("p"))
        pairs = cut(best.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("votes")).filter("votes = 2").select("a", "b"))
        if pairs.isEmpty():
            break
        members = _moved(members, pairs.select(F.col("b").alias("cluster"), F.col("a").alias("into")))
        touched = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c")))
        other = states.toDF("b", "n2", "sq2", "total2")
        merged = pairs.join(states.withColumnRenamed("c", "a"), "a").join(other, "b").select("a", "n", "sq", "total", "n2", "sq2", "total2").mapInArrow(_merge(dim), _STATE)
        states = states.join(touched, "c", "left_anti").unionByName(merged)
        into = pairs.select(F.col("b").alias("c"), F.col("a").alias("into"))
        for end in ("a", "b"):
            links = links.join(touched.withColumnsRenamed({"c": end}).withColumn(f"hit_{end}", F.lit(True)), end, "left").join(into.withColumnsRenamed({"c": end, "into": f"to_{end}"}), end, "left")
        moved = links.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), "d2", (F.col("hit_a").isNotNull() | F.col("hit_b").isNotNull()).alias("new")).filter("a <> b")
        moved = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d2").alias("d2"), F.max("new").alias("new"))
        states, moved = cut(states), cut(moved)
        redo = moved.filter("new").select("a", "b").join(states.withColumnRenamed("c", "a"), "a").join(states.toDF("b", "n2", "sq2", "total2"), "b")
        redone = redo.select("a", "b", "n", "sq", "total", "n2", "sq2", "total2").mapInArrow(_linkage(dim, threshold), "a bigint, b bigint, d2 double")
        links = cut(moved.filter("not new").select("a", "b", "d2").unionByName(redone))
        live = links.select(F.col("a").alias("c")).unionByName(links.select(F.col("b").alias("c"))).distinct()
        done.append(states.join(live, "c", "left_anti"))
        states = states.join(live, "c", "left_semi")
        if r % 8 == 7:  # plans stay short however many rounds there are
            members, done = cut(members), [cut(reduce(DataFrame.unionByName, done))]
    return members, reduce(DataFrame.unionByName, [*done, states])


def components(links: DataFrame) -> DataFrame:
    """(c, comp): the least node that each node of `links` (a, b) is connected with.

    Nodes take the least label around them and then that label's label, until nothing changes: few
    rounds even for long chains, and two or three where nodes share a link to their least member.
    """
    both = cut(links.select(F.col("a").alias("c"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("c"), F.col("a").alias("o"))))
    labels = cut(both.groupBy("c").agg(F.least(F.col("c"), F.min("o")).alias("comp")))
    while True:
        seen = both.join(labels.withColumnRenamed("c", "o"), "o").groupBy("c").agg(F.min("comp").alias("around"))
        near = labels.join(seen, "c").select("c", "comp", F.least("comp", "around").alias("low"))
        jump = labels.select(F.col("c").alias("low"), F.col("comp").alias("far"))
        new = cut(near.join(jump, "low", "left").select("c", F.least("low", "far").alias("comp"), F.col("comp").alias("old")))
        labels = new.select("c", "comp")
        if new.filter("comp < old").isEmpty():
            return labels


#: Multipliers of the order of equal links, small enough that no product leaves 64 bits.
_P, _X, _Y, _Z = 2147483647, 1103515245, 1566083941, 1812433253


def _order(a: np.ndarray, b: np.ndarray, r: int) -> np.ndarray:
    """A scrambled number below 2**31 for each pair of ids in round r; `_order_sql` gives the same in Spark."""
    x = (a.astype(np.int64) % _P * _X + b.astype(np.int64) % _P) % _P
    x = (x * _Y + r) % _P
    return (x ^ (x >> 15)) * _Z % _P


def _order_sql(a: str, b: str, r: int) -> Column:
    p = F.lit(_P).cast("bigint")
    x = F.pmod(F.pmod(F.col(a), p) * F.lit(_X).cast("bigint") + F.pmod(F.col(b), p), p)
    x = F.pmod(x * F.lit(_Y).cast("bigint") + F.lit(r).cast("bigint"), p)
    return F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(_Z).cast("bigint"), p)


def agglomerate(ids: np.ndarray, n: np.ndarray, sq: np.ndarray, total: np.ndarray, a: np.ndarray, b: np.ndarray, d2: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rounds in memory. Nodes 0..N-1 with ids ascending, links a < b; gives (cluster of each node, n, sq, total)."""
    n, sq, total, into = n.astype(np.int64).copy(), sq.copy(), total.copy(), np.arange(len(ids))
    most, r = threshold * threshold + 1e-6, 0
    while len(a):
        o = np.lexsort((ids[b], ids[a], _order(ids[a], ids[b], r), d2))
        a, b, d2, r = a[o], b[o], d2[o], r + 1
        best = np.full(len(ids), len(a))
        np.minimum.at(best, a, np.arange(len(a)))
        np.minimum.at(best, b, np.arange(len(a)))
        m = np.flatnonzero((best[a] == best[b]) & (best[a] == np.arange(len(a))))
        x, y = a[m], b[m]
        sq[x] = (sq[x] * n[x] + sq[y] * n[y]) / (n[x] + n[y])
        n[x] += n[y]
        total[x] += total[y]
        move, hit = np.arange(len(ids)), np.zeros(len(ids), bool)
        move[y], hit[x], hit[y] = x, True, True
        into = move[into]
        fresh = hit[a] | hit[b]
        p, q = move[a], move[b]
        a, b = np.minimum(p, q), np.maximum(p, q)
        keep = a != b
        a, b, d2, fresh = a[keep], b[keep], d2[keep], fresh[keep]
        _, first = np.unique(a * len(ids) + b, return_index=True)
        a, b, d2, fresh = a[first], b[first], d2[first], fresh[first]
        f = np.flatnonzero(fresh)
        for lo in range(0, len(f), 1024):
            g = f[lo : lo + 1024]
            p, q = a[g], b[g]
            d2[g] = np.maximum(0, sq[p] + sq[q] - 2 * np.einsum("ij,ij->i", total[p], total[q]) / (n[p] * n[q]))
        keep = d2 <= most
        a, b, d2 = a[keep], b[keep], d2[keep]
    return into, n, sq, total


def _bundle(dim: int, threshold: float, merged: bool = False):  # noqa: ANN202
    """Nodes are distinct vectors (c, n, packed) or, if `merged`, clusters' states."""

    def run(nodes: pa.Table, links: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("c").combine_chunks()
        ids = nodes["c"].to_numpy()
        m = unpack(nodes["total" if merged else "packed"].to_pylist(), dim).astype(np.float64)
        n = nodes["n"].to_numpy()
        sq, total = (nodes["sq"].to_numpy(), m) if merged else ((m * m).sum(1), m * n[:, None])
        a, b = np.searchsorted(ids, links["a"].to_numpy()), np.searchsorted(ids, links["b"].to_numpy())
        into, n, sq, total = agglomerate(ids, n, sq, total, a, b, links["d2"].to_numpy(), threshold)
        head = into == np.arange(len(ids))
        packed = np.full(len(ids), None, object)
        packed[head] = pack(total[head].astype(np.float32))
        return pa.table({"member": pa.array(ids), "cluster": pa.array(ids[into]), "n": pa.array(n), "sq": pa.array(sq), "total": pa.array(list(packed), pa.binary())})

    return run


def link_clusters(nodes: DataFrame, links: DataFrame, dim: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(member, cluster) of every linked node and the final states of their clusters: small components in bundles, large ones in rounds.

    `nodes` (c, n, packed) are distinct vectors with their row counts, `links` (a, b, d2) their squared distances, a < b.
    """
    labels = components(links)
    sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("nodes"))
    bundles = max(1, labels.count() // LOCAL_NODES)
    place = labels.join(sizes, "comp").select("c", F.when(F.col("nodes") <= LOCAL_NODES, F.pmod(F.xxhash64("comp"), F.lit(bundles))).otherwise(-1).alias("bundle"))
    placed = cut(nodes.join(place, "c"))
    tied = cut(links.join(place.withColumnRenamed("c", "a"), "a"))
    out = cut(
        placed.filter("bundle >= 0").groupBy("bundle").cogroup(tied.filter("bundle >= 0").groupBy("bundle"))
        .applyInArrow(_bundle(dim, threshold), _BUNDLED)
    )
    members, final = out.select("member", "cluster"), out.filter("total is not null").select(F.col("cluster").alias("c"), "n", "sq", "total")
    large = placed.filter("bundle < 0")
    if not large.isEmpty():
        more, states = merge_rounds(large.select("c", "n", "packed").mapInArrow(_first_states(dim), _STATE), tied.filter("bundle < 0").select("a", "b", "d2"), dim, threshold)
        members, final = members.unionByName(more), final.unionByName(states)
    return members, final


def clusters(df: DataFrame, key: str, vec: str, dim: int, threshold: float, k: int = 6, least_cells: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, cluster_id) of every sound row; the final states of the clusters of more than one distinct vector; the index.

    Rows whose vector is null, of another length, all zero or holds null, NaN or infinity are in no
    cluster. cluster_id is the least id of the cluster; a row without a partner is its own cluster.
    Equal vectors always share a cluster. Empty tables give empty results; other columns are not read.
    """
    spark = df.sparkSession
    index, books, placed = ix.build(df, key, vec, dim, None, least_cells)
    if books is None:
        empty = spark.createDataFrame([], "id bigint, cluster_id bigint")
        return empty, spark.createDataFrame([], _STATE), spark.createDataFrame([], ix._ENTRY)
    near = ix.links(placed, books, k, threshold, anchors=True)
    links = cut(near.select(F.least("qid", "eid").alias("a"), F.greatest("qid", "eid").alias("b"), (F.col("d") * F.col("d")).alias("d2")).groupBy("a", "b").agg(F.min("d2").alias("d2")))
    named = index.groupBy("h").agg(F.min(F.array_min("ids")).alias("c"), F.sum(F.size("ids")).alias("n"), F.first("packed").alias("packed"))
    members, final = link_clusters(named.select("c", "n", "packed"), links, dim, threshold)
    rows = index.join(named.select("h", "c"), "h").join(members.withColumnRenamed("member", "c"), "c", "left")
    return rows.select(F.explode("ids").alias("id"), F.coalesce("cluster", "c").alias("cluster_id")), final, index


def large_clusters(rows: DataFrame, least: int) -> DataFrame:
    """The rows of clusters of at least `least` rows."""
    big = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    return rows.join(big.select("cluster_id"), "cluster_id")


def _typicality(dim: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                x = b.slice(lo, 512)
                m = unpack(x.column(2).to_pylist(), dim).astype(np.float64)
                n = x.column(3).to_numpy(zero_copy_only=False)
                d = m - unpack(x.column(4).to_pylist(), dim) / n[:, None]
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(np.sqrt((d * d).sum(1)).round(6))], ["cluster_id", "ids", "distance"])

    return run


def describe(rows: DataFrame, states: DataFrame, index: DataFrame, dim: int, least: int, typical: int = 3) -> DataFrame:
    """(cluster_id, size, typical): each cluster of at least `least` rows with the ids of the rows nearest its mean vector (distances rounded to six places, ties by id)."""
    sizes = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    named = index.select(F.array_min("ids").alias("id"), F.slice("ids", 1, typical).alias("ids"), "packed").join(rows, "id")
    far = named.join(states.withColumnRenamed("c", "cluster_id"), "cluster_id").select("cluster_id", "ids", "packed", "n", "total").mapInArrow(_typicality(dim), "cluster_id bigint, ids array<bigint>, distance double")
    alone = named.join(states.withColumnRenamed("c", "cluster_id"), "cluster_id", "left_anti").select("cluster_id", "ids", F.lit(0.0).alias("distance"))
    each = far.unionByName(alone).select("cluster_id", F.explode("ids").alias("id"), "distance").join(sizes, "cluster_id")
    w = Window.partitionBy("cluster_id").orderBy("distance", "id")
    top = each.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= typical)
    return top.groupBy("cluster_id", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"))
