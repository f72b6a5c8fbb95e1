"""Semantic joins: pairs of two tables whose vectors lie within a distance, and the pair index built from them.

The left table is cut into blocks by a hash of its id, and so is the right; every pair of blocks is
one group, in which distances come from a matrix product. A block holds about `BLOCK_ROWS` vectors,
whatever the size of the tables, so nothing is broadcast and no task grows; each side is sent once
for each block of the other. A right side of at most `SMALL_ROWS` rows is one block. Distances of
the pairs kept are recomputed by differences in double, so they agree with the scalar functions.

A join within an L2 distance is pruned first: vectors are banded by their norm, and two of them can
only meet where the norms differ by no more than tau, so blocks of far bands never meet. Long vectors
do not travel with each block at all where a short code of each (see `sketches`) tells nearly all pairs
apart: blocks of codes meet, each distinct vector once, and the whole vectors are only joined to the
pairs whose codes are near. Vectors that are null, of another length than `dim` (that of most right
rows, if not given) or hold null, NaN or infinity are in no pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut
from . import sketches

BLOCK_ROWS, SMALL_ROWS = 4096, 4096
#: Bands of norms, at most.
MOST_BANDS = 1000
#: Rows of each side from which a sketch is fitted, the most codes in a block, and the blocks a side has below that.
SAMPLE_ROWS, SKETCH_ROWS, SKETCH_BLOCKS = 1500, 131072, 8

METRICS = ("l2", "cos", "ip")


def ip_threshold(tau: float) -> float:
    """The negated inner product that equals an L2 distance of tau between unit vectors."""
    return tau * tau / 2 - 1


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    a = col.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    m = a.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    if len(m) != len(a) * dim:
        raise ValueError(f"vectors of another length than {dim}")
    return m.reshape(len(a), dim)


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of equally many rows, in double."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    if metric == "l2":
        return np.sqrt(((a - b) ** 2).sum(1))
    ip = np.einsum("ij,ij->i", a, b)
    if metric == "ip":
        return -ip
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - np.clip(ip / np.sqrt((a * a).sum(1) * (b * b).sum(1)), -1, 1)


def _join(dim: int, metric: str, tau: float | None, k: int | None, inclusive: bool, self_join: bool):  # noqa: ANN202
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        li, ri = left["id"].to_numpy(), right["id"].to_numpy()
        out_l, out_r, out_d = [], [], []
        if len(li) and len(ri):
            lm, rm = _matrix(left["v"], dim), _matrix(right["v"], dim)
            if metric == "cos":
                with np.errstate(invalid="ignore", divide="ignore"):
                    ln, rn = lm / np.linalg.norm(lm, axis=1, keepdims=True), rm / np.linalg.norm(rm, axis=1, keepdims=True)
            else:
                ln, rn = lm, rm
            tile = max(1, 4_000_000 // len(ri))
            for lo in range(0, len(li), tile):
                x = ln[lo : lo + tile]
                d = (x * x).sum(1)[:, None] + (rn * rn).sum(1)[None] - 2 * x @ rn.T if metric == "l2" else (1 - x @ rn.T if metric == "cos" else -(x @ rn.T))
                ok = ~np.isnan(d)
                if self_join:
                    ok &= li[lo : lo + tile, None] != ri[None] if k else li[lo : lo + tile, None] < ri[None]
                if tau is not None:
                    ok &= d <= (tau * tau if metric == "l2" else tau) + 1e-4
                if k is not None:
                    d = np.where(ok, d, np.inf)
                    if k < len(ri):
                        ok &= d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] + 1e-4
                i, j = np.nonzero(ok)
                e = _distances(lm[lo + i], rm[j], metric)
                keep = np.ones(len(e), bool) if tau is None else (e <= tau if inclusive else e < tau)
                out_l.append(li[lo + i[keep]]), out_r.append(ri[j[keep]]), out_d.append(e[keep])
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0, t))
        return pa.table({"l_id": cat(out_l, np.int64), "r_id": cat(out_r, np.int64), "dis": cat(out_d, np.float64)})

    return run


def usual_dim(df: DataFrame, vec: str) -> int:
    """The length that most vectors of a table have, the greater of equally frequent ones; 0 if there is none."""
    r = df.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).groupBy(F.size(vec).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).head()
    return r["d"] if r else 0


def _sized(df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(vec).alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dim))


def _usable(df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    return _sized(df, key, vec, dim).filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def _spread(x: DataFrame, own: str, blocks: int, other: str, others: int, key: str = "id") -> DataFrame:
    """Each row to its own block, and that to every block of the other side."""
    return x.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))))


def _band_plan(lx: DataFrame, rx: DataFrame, tau: float) -> tuple[float, dict[int, int], dict[int, int]] | None:
    """Width of the norm bands and the blocks of each band on either side; None where bands would not tell rows apart.

    A band is a tau wide, wider where that gave more than MOST_BANDS of them. The counts are exact.
    """
    top = lx.unionByName(rx).agg(F.max(V.norm(F.col("v"))).alias("t")).head()["t"]
    if not top or tau <= 0 or top < 2 * tau:
        return None
    width = max(tau, top / MOST_BANDS)
    count = lambda x: {r["b"]: -(-r["n"] // BLOCK_ROWS) for r in x.groupBy(_band(width).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # noqa: E731  at most MOST_BANDS rows
    return width, count(lx), count(rx)


def _band(width: float) -> Column:
    return F.floor(V.norm(F.col("v")) / F.lit(width)).cast("bigint")


def _spread_bands(x: DataFrame, left: bool, width: float, lefts: dict[int, int], rights: dict[int, int]) -> DataFrame:
    """(id, v, lb, rb, band, near): each row meets the blocks of its own and the two neighbouring bands of the other side."""
    mine, theirs = (lefts, rights) if left else (rights, lefts)
    table = lambda d: F.create_map(*[F.lit(int(z)) for kv in d.items() for z in kv]).cast("map<bigint,bigint>") if d else F.create_map().cast("map<bigint,bigint>")
    x = x.withColumn("band", _band(width)).withColumn("own", F.pmod(F.xxhash64("id"), F.coalesce(F.try_element_at(table(mine), F.col("band")), F.lit(1))))
    x = x.withColumn("near", F.explode(F.array(*[F.col("band") + F.lit(d).cast("bigint") for d in (-1, 0, 1)]))).withColumn("n", F.try_element_at(table(theirs), F.col("near"))).filter("n is not null")
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    lb, rb, lband, rband = ("own", "other", "band", "near") if left else ("other", "own", "near", "band")
    return x.select("id", "v", F.struct(F.col(lband).alias("a"), F.col(lb).alias("b")).alias("lb"), F.struct(F.col(rband).alias("a"), F.col(rb).alias("b")).alias("rb"))


def _fit(left: DataFrame, right: DataFrame, ln: int, rn: int, dim: int, tau: float) -> sketches.Sketch | None:
    if dim < 4 * min(sketches.WIDTHS):
        return None
    sample = lambda x, n: _matrix(x.select("v").sample(fraction=min(1.0, SAMPLE_ROWS / n), seed=7).toArrow()["v"], dim)
    return sketches.fit(sample(left, ln), sample(right, rn), tau)


def _by_sketch(left: DataFrame, right: DataFrame, ln: int, rn: int, sketch: sketches.Sketch, dim: int, tau: float, inclusive: bool) -> DataFrame:
    """(l_id, r_id, dis) of the rows (id, v) within tau: distinct vectors meet by their codes, are measured, and rows join them by key."""
    rows = min(SKETCH_ROWS, max(BLOCK_ROWS, -(-max(ln, rn) // SKETCH_BLOCKS)))
    lb, rb = -(-ln // rows), -(-rn // rows)
    lk, rk = (cut(x.mapInArrow(sketches.sketched(sketch, dim), "id bigint, key binary, code binary")) for x in (left, right))
    lc, rc = (x.select("key", "code").dropDuplicates(["key"]) for x in (lk, rk))
    lc, rc = _spread(lc, "lb", lb, "rb", rb, "key"), _spread(rc, "rb", rb, "lb", lb, "key")
    found = lc.groupBy("lb", "rb").cogroup(rc.groupBy("lb", "rb")).applyInArrow(sketches.candidates(sketch.bound, sketch.basis.shape[1] + 1), "lk binary, rk binary")
    lv, rv = (x.mapInArrow(sketches.packed(dim), "key binary, v binary").dropDuplicates(["key"]).select(F.col("key").alias(f"{s}k"), F.col("v").alias(f"{s}v")) for x, s in ((left, "l"), (right, "r")))
    near = found.join(lv, "lk").join(rv, "rk").select("lk", "rk", "lv", "rv").mapInArrow(sketches.measured(_distances, dim, tau, inclusive), "lk binary, rk binary, dis double")
    li, ri = (x.select(F.col("key").alias(f"{s}k"), F.col("id").alias(f"{s}_id")) for x, s in ((lk, "l"), (rk, "r")))
    return near.join(li, "lk").join(ri, "rk").select("l_id", "r_id", "dis")


def pairs(left: DataFrame, left_key: str, left_vec: str, right: DataFrame, right_key: str, right_vec: str, tau: float | None, metric: str = "l2", k: int | None = None, inclusive: bool = True, self_join: bool = False, dim: int | None = None) -> DataFrame:
    """(l_id, r_id, dis): pairs within `tau`; with `k` only the k nearest right rows of each left row, ties by id.

    Null ids are in no pair, nor are broken vectors: null, not of `dim` values (by default the length
    most right vectors have), or holding null, NaN or infinity. Cosine distances of zero vectors are NaN: no pair. With `self_join` a row is no partner of itself, and
    without `k` each pair comes once, l_id < r_id. Repeated rows pair as often as they occur.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if tau is None and k is None:
        raise ValueError("either tau or k is needed")
    dim = usual_dim(right, right_vec) if dim is None else dim
    lx, rx = _usable(left, left_key, left_vec, dim), _usable(right, right_key, right_vec, dim)
    ln, rn = left.count(), right.count()
    within = metric == "l2" and tau is not None
    ls, rs = _sized(left, left_key, left_vec, dim), _sized(right, right_key, right_vec, dim)
    sketch = _fit(ls, rs, ln, rn, dim, tau) if within and tau >= 0 and min(ln, rn) > SMALL_ROWS else None
    plan = _band_plan(lx, rx, tau) if within and not sketch and max(ln, rn) > SMALL_ROWS else None
    if sketch:
        found = _by_sketch(ls, rs, ln, rn, sketch, dim, tau, inclusive)
        if self_join:
            found = found.filter("l_id <> r_id" if k else "l_id < r_id")
    else:
        if plan:
            lx, rx = _spread_bands(lx, True, *plan), _spread_bands(rx, False, *plan)
        else:
            lb, rb = (1 if n <= SMALL_ROWS else -(-n // BLOCK_ROWS) for n in (ln, rn))
            lx, rx = _spread(lx, "lb", lb, "rb", rb), _spread(rx, "rb", rb, "lb", lb)
        found = lx.groupBy("lb", "rb").cogroup(rx.groupBy("lb", "rb")).applyInArrow(_join(dim, metric, tau, k, inclusive, self_join), "l_id bigint, r_id bigint, dis double")
    if k is None:
        return found
    w = Window.partitionBy("l_id").orderBy("dis", "r_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def with_attributes(ti: DataFrame, left: DataFrame, left_key: str, right: DataFrame, right_key: str, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """Pairs with attributes of both sides as l_* and r_*; a pair whose row is missing is dropped."""
    l = left.select(F.col(left_key).alias("l_id"), *[F.col(c).alias(f"l_{c}") for c in left_cols])  # noqa: E741
    r = right.select(F.col(right_key).alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in right_cols])
    return ti.join(l, "l_id").join(r, "r_id")


def write_index(ti: DataFrame, path: str, width: float = 0.1) -> None:
    """Store pairs by distance bucket, sorted by distance, so that a read within tau skips the farther files."""
    ti.withColumn("dis_bucket", F.floor(F.col("dis") / width).cast("int")).repartition("dis_bucket", F.pmod(F.xxhash64("l_id"), F.lit(16))).sortWithinPartitions("dis", "l_id", "r_id").write.partitionBy("dis_bucket").mode("overwrite").parquet(path)


def read_index(spark, path: str, tau: float, width: float = 0.1, built_tau: float | None = None) -> DataFrame:  # noqa: ANN001
    """Pairs within `tau`: only the buckets up to it are read. A tau beyond that of the build is an error."""
    if built_tau is not None and tau > built_tau:
        raise ValueError(f"the index holds pairs within {built_tau}, not {tau}")
    return spark.read.parquet(path).filter((F.col("dis_bucket") <= int(np.floor(tau / width))) & (F.col("dis") <= tau)).drop("dis_bucket")


def nearest_partner(ti: DataFrame, seed: str = "l_id", partner: str = "r_id") -> DataFrame:
    """The least distant partner of every seed, ties by id."""
    return ti.groupBy(seed).agg(F.min(F.struct("dis", partner)).alias("p")).select(seed, F.col(f"p.{partner}").alias(partner), F.col("p.dis").alias("dis"))


def seeds_with_partner(seeds: DataFrame, key: str, ti: DataFrame, partner_ok: DataFrame | None = None, partner_key: str = "id") -> DataFrame:
    """Seeds that have a partner, optionally one of `partner_ok`."""
    if partner_ok is not None:
        ti = ti.join(partner_ok.select(F.col(partner_key).alias("r_id")), "r_id", "left_semi")
    return seeds.join(ti.select(F.col("l_id").alias(key)), key, "left_semi")


def verified_join(left: DataFrame, left_key: str, right: DataFrame, right_key: str, candidates: DataFrame, prompt: str, verify, how: str = "inner") -> DataFrame:  # noqa: ANN001
    """(l_id, r_id): candidate pairs (l_id, r_id) that a verifier confirms; "left_outer" keeps left ids without a pair with r_id null.

    `verify(pairs, prompt)` gets (l_id, r_id) and the columns of both rows as l_* and r_*, and gives
    (l_id, r_id, verdict). Candidates come from a proxy (`pairs` within a distance, `two_thresholds`), so
    the verifier never sees all pairs. Repeated candidates are asked once; those of missing rows are dropped.
    """
    if how not in ("inner", "left_outer"):
        raise ValueError("how must be inner or left_outer")
    l = left.select(F.col(left_key).alias("l_id"), *[F.col(c).alias(f"l_{c}") for c in left.columns if c != left_key])  # noqa: E741
    r = right.select(F.col(right_key).alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != right_key])
    asked = candidates.select("l_id", "r_id").distinct().join(l, "l_id").join(r, "r_id")
    yes = verify(asked, prompt).filter(F.col("verdict").cast("boolean")).select("l_id", "r_id")
    return yes if how == "inner" else l.select("l_id").distinct().join(yes, "l_id", "left")


def gap_pairs(sims: DataFrame, anchor: str, sim: str, gap: float) -> DataFrame:
    """Pairs whose similarity is within `gap` of their anchor's best."""
    best = sims.groupBy(anchor).agg(F.max(sim).alias("__best"))  # map-side, so a heavy anchor is no single task's work
    return sims.join(best, anchor).filter(F.col(sim) >= F.col("__best") - gap).drop("__best")


def two_thresholds(sims: DataFrame, sim: Column, low: float, high: float) -> DataFrame:
    """`bucket`: pos from `high`, dropped up to `low`, unc between."""
    return sims.withColumn("bucket", F.when(sim >= high, "pos").when(sim <= low, "drop").otherwise("unc")).filter("bucket <> 'drop'")


def chain(*links: DataFrame) -> DataFrame:
    """(n0, n1, n2, ...): tuples whose neighbours are pairs (a, b) of the links in turn."""
    out = links[0].select(F.col("a").alias("n0"), F.col("b").alias("n1"))
    for i, x in enumerate(links[1:], 1):
        out = out.join(x.select(F.col("a").alias(f"n{i}"), F.col("b").alias(f"n{i + 1}")), f"n{i}")
    return out.select(*[f"n{i}" for i in range(len(links) + 1)])


def chain_counts(*links: DataFrame) -> DataFrame:
    """(n0, n): in how many tuples of `chain` each first member stands, counted from the end link by
    link, so that the tuples are never formed and a shared member of many pairs is one row."""
    n = None
    for x in reversed(links):
        step = x if n is None else x.join(n, "b")
        n = step.groupBy(F.col("a").alias("b")).agg(F.sum(F.lit(1) if n is None else F.col("n")).alias("n"))
    return n.select(F.col("b").alias("n0"), "n")
