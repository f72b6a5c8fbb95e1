"""All similar pairs between set-valued records, by metric pivot partitioning.

Every record goes to its nearest pivot under Jaccard distance; a cell is a pivot with a narrow
range of overlap with it and of set size. A record is also sent to each other cell that may hold
a partner: by the triangle inequality of the symmetric difference, |x n y| can be no more than
min(|x n p|, |y n p|) + min(|x - p|, |y - p|), and where that leaves the Jaccard similarity below
the threshold no partner can be there. (The plain Jaccard bound d(y,p) <= d(x,p) + r is weaker: at
a similarity of 0.7 it sends nearly every record to every cell.) Cells are joined exactly.

Records with little overlap with any pivot ("far") are beyond what distances to pivots can tell
apart: no such bound excludes two of them. Two far records are brought together by size band and
by the leading values of their second set (of the set itself if there is none) in order of
sampled rarity: two sets that reach the threshold share one of each other's leading values.

Pivots come from a bounded sample; they only steer the work, the result is exact. Equal records
are one class with a list of ids. Cells are counted exactly first, and large ones are cut into
slices that all their visitors see, so no task holds an unbounded cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Pivots at most, records they are drawn from at most, and records of a slice of a cell.
MOST_PIVOTS, SAMPLE_ROWS, SLICE_ROWS = 512, 4096, 3000
#: Width of a cell's range of overlaps with its pivot.
OVERLAP_STEP = 4


def text_tokens(col: Column) -> Column:
    """Array of strings -> sorted distinct 64-bit hashes, without outer space, regardless of case, blanks and nulls dropped."""
    clean = F.filter(F.transform(col, lambda s: F.lower(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))), lambda s: s.isNotNull() & (s != ""))
    return F.array_sort(F.array_distinct(F.transform(clean, lambda s: F.xxhash64(s))))


def _tokens(col: pa.Array) -> list[np.ndarray]:
    """Sorted distinct int64 tokens of each row; none for null. Bit sets are structs of nbits and words (bit 0 highest)."""
    if pa.types.is_struct(col.type):
        bits, words = col.field("nbits").to_pylist(), col.field("words").to_pylist()
        live = col.is_valid().to_pylist()
        out = []
        for n, w, ok in zip(bits, words, live, strict=True):
            raw = np.array([0 if v is None else v for v in w or ()], ">i8") if ok else np.empty(0, ">i8")
            t = np.flatnonzero(np.unpackbits(raw.view(np.uint8)))
            out.append(t[t < n].astype(np.int64) if n is not None else t.astype(np.int64))
        return out
    return [np.empty(0, np.int64) if v is None else np.unique(np.array([x for x in v if x is not None], np.int64)) for v in col.to_pylist()]


class Pivots:
    """Pivot sets, and what the overlap of a record with each of them tells."""

    def __init__(self, sets: list[np.ndarray], threshold: float) -> None:
        self.t, self.sizes = threshold, np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        o = np.argsort(flat, kind="stable")
        self.tokens, start = np.unique(flat[o], return_index=True)
        self.owner, self.start = owner[o], np.append(start, len(flat))

    def overlaps(self, rows: list[np.ndarray]) -> np.ndarray:
        """(rows, pivots): sizes of the intersections."""
        flat, n = np.concatenate(rows), np.array([len(r) for r in rows])
        at = np.searchsorted(self.tokens, flat)
        at[at == len(self.tokens)] = 0
        hit = self.tokens[at] == flat
        row, at = np.repeat(np.arange(len(rows)), n)[hit], at[hit]
        many = self.start[at + 1] - self.start[at]
        idx = np.repeat(self.start[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        key = np.repeat(row, many) * len(self.sizes) + self.owner[idx]
        return np.bincount(key, minlength=len(rows) * len(self.sizes)).reshape(len(rows), -1)

    def band(self, size: np.ndarray) -> np.ndarray:
        """Size bands whose bounds grow by 1/threshold: partners lie in the same or a neighbouring band."""
        return np.floor(np.log(np.maximum(size, 1)) / -np.log(min(self.t, 0.95)) + 1e-9).astype(int)

    def home(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, overlaps, and the home cell (pivot, overlap range, size band) of each record."""
        size, ov = np.array([len(r) for r in rows]), self.overlaps(rows)
        p = (ov / (size[:, None] + self.sizes[None] - ov)).argmax(1)
        return size, ov, np.stack([p, ov[np.arange(len(rows)), p] // OVERLAP_STEP, self.band(size)], 1)

    def far(self, home: np.ndarray) -> np.ndarray:
        """Whether a home cell's overlap is so small that its bound excludes nothing of that size."""
        base = 1 / min(self.t, 0.95)
        return home[:, 1] * OVERLAP_STEP <= (1 - self.t) * np.floor(base ** (home[:, 2] + 1) + 1e-6)

    def may_hold(self, size: np.ndarray, ov: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """(rows, cells): whether a record of the cell can reach the threshold with the row."""
        base = 1 / min(self.t, 0.95)
        p, low = cells[:, 0], cells[:, 1] * OVERLAP_STEP
        s_low, s_high = np.ceil(base ** cells[:, 2] - 1e-6), np.floor(base ** (cells[:, 2] + 1) + 1e-6)
        y, s = ov[:, p], size[:, None]
        most = np.minimum(low + OVERLAP_STEP - 1, y) + np.minimum(s_high - low, s - y)
        most = np.minimum(most, np.minimum(s_high, s))
        return most / (np.maximum(s_low, most) + s - most) >= self.t - 1e-9


def _read(df: DataFrame, key: str, main: Column, also: Column | None, side: int) -> DataFrame:
    also = F.array(F.lit(0).cast("bigint")) if also is None else also
    return df.select(F.col(key).cast("bigint").alias("id"), F.lit(side).alias("side"), main.alias("main"), also.alias("also")).filter(F.col("id").isNotNull() & F.col("main").isNotNull() & F.col("also").isNotNull())


_CLASSES = "h binary, left_ids array<bigint>, right_ids array<bigint>, main binary, also binary"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal records of a partition become one row with the ids of either side."""
    ids: dict[bytes, tuple[list[int], list[int]]] = {}
    sets: dict[bytes, tuple[bytes, bytes]] = {}
    for b in batches:
        for i, s, m, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _tokens(b.column(2)), _tokens(b.column(3)), strict=True):
            if not len(m) or not len(a):
                continue
            mb, ab = m.tobytes(), a.tobytes()
            h = hashlib.blake2b(len(mb).to_bytes(8, "little") + mb + ab, digest_size=16).digest()
            if h not in ids:
                ids[h], sets[h] = ([], []), (mb, ab)
            ids[h][s].append(i)
    rows = list(ids)
    for lo in range(0, len(rows), 1024):
        part = rows[lo : lo + 1024]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.binary()), pa.array([sorted(ids[h][0]) for h in part], pa.list_(pa.int64())), pa.array([sorted(ids[h][1]) for h in part], pa.list_(pa.int64())), pa.array([sets[h][0] for h in part], pa.binary()), pa.array([sets[h][1] for h in part], pa.binary())],
            ["h", "left_ids", "right_ids", "main", "also"],
        )


def _sets(col: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in col.to_pylist()]


def _count_cells(pivots: Pivots):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, _, home = pivots.home(_sets(b.column(0)))
                home = home[~pivots.far(home)]
                u, n = np.unique(home, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(u[:, i], pa.int32()) for i in range(3)), pa.array(n, pa.int64())], ["p", "o", "b", "n"])

    return run


class Leading:
    """The leading values of a set: as many of its rarest (by a bounded sample) as leave no room for a partner without one of them."""

    def __init__(self, sample: list[np.ndarray], rows: int, threshold: float) -> None:
        self.t = threshold
        u, n = np.unique(np.concatenate(sample) if sample else np.empty(0, np.int64), return_counts=True)
        self.count = dict(zip(u.tolist(), n.tolist(), strict=True))
        self.slices = {v: s for v, k in self.count.items() if (s := -int(-k * rows / max(1, len(sample)) // SLICE_ROWS)) > 1}

    def of(self, s: np.ndarray) -> list[int]:
        most = max(1, len(s) - int(np.ceil(self.t * len(s) - 1e-9)) + 1)
        return sorted(s.tolist(), key=lambda v: (self.count.get(v, 0), v))[:most]


def _assign(pivots: Pivots, cells: np.ndarray, counts: np.ndarray, leading: Leading, by_also: bool):  # noqa: ANN202
    """Rows (cell, part, home, ...). Of two near cells the one with fewer records visits the other; far
    records visit near cells, and meet each other in cells -1 - band, one part for each leading value."""
    order = {tuple(c): i for i, c in enumerate(cells.tolist())}
    slices = np.maximum(1, -(-counts // SLICE_ROWS))
    rank = np.lexsort((np.arange(len(cells)), counts)).argsort()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                x = b.slice(lo, 512)
                rows = _sets(x.column(3))
                size, ov, home = pivots.home(rows)
                far = pivots.far(home)
                own = np.array([-1 if f else order[tuple(h)] for h, f in zip(home.tolist(), far, strict=True)])
                row_rank = np.where(own < 0, -1, rank[own]) if len(cells) else own
                go = pivots.may_hold(size, ov, cells) & (rank[None] > row_rank[:, None])
                r, c = np.nonzero(go)
                near = np.flatnonzero(~far)
                r, c = np.concatenate([near, r]), np.concatenate([own[near], c])
                many = slices[c] if len(cells) else np.empty(0, int)
                at = np.repeat(np.arange(len(r)), many)
                part = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                r, c = r[at], c[at]
                salt = np.array([int.from_bytes(h[:4], "little") for h in x.column(0).to_pylist()])
                mine = (c == own[r]) & (part == salt[r] % slices[c]) if len(cells) else np.empty(0, bool)
                keys = _sets(x.column(4)) if by_also else rows
                extra = []
                for i in np.flatnonzero(far):
                    for v in leading.of(keys[i]):
                        n = leading.slices.get(v, 1)
                        for k in range(n):  # slices of a common value: at home in one, a visitor to the others
                            q = (v + k * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63
                            extra += [(i, -1 - home[i, 2], q, k == salt[i] % n), (i, -2 - home[i, 2], q, False)]
                if extra:
                    i, cell, q, at_home = zip(*extra, strict=True)
                    r, c, part, mine = np.append(r, i).astype(int), np.append(c, cell).astype(int), np.concatenate([part, np.array(q, np.int64)]), np.append(mine, at_home).astype(bool)
                least = np.array([min(a + z) for a, z in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32()), pa.array(part, pa.int64()), pa.array(mine), x.column(0).take(pa.array(r)), pa.array(least[r], pa.int64()), x.column(3).take(pa.array(r)), x.column(4).take(pa.array(r))],
                    ["cell", "part", "home", "h", "id", "main", "also"],
                )

    return run


def _flat(col: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated tokens of sets and the row of each."""
    n = np.array([len(x) // 8 for x in col])
    return np.frombuffer(b"".join(col), np.int64), np.repeat(np.arange(len(col)), n)


def _bitmaps(tokens: np.ndarray, rows: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    """Rows as 64-bit words over the sorted tokens `known`; other tokens are left out."""
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    hit = known[at] == tokens
    bits = np.zeros((n, -(-len(known) // 64) * 64), np.uint8)
    bits[rows[hit], at[hit]] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _overlaps(main: list[bytes], inside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, rows x inside overlaps) of tiles of the rows with the sets `inside`: by bitmaps over a small
    vocabulary of these, else by their postings."""
    tokens, rows = _flat([main[i] for i in inside])
    known = np.unique(tokens)
    if len(known) <= 8192:
        home = _bitmaps(tokens, rows, len(inside), known)
        tile = max(16, 4_000_000 // (len(inside) * home.shape[1]))
        for lo in range(0, len(main), tile):
            t, r = _flat(main[lo : lo + tile])
            n = min(tile, len(main) - lo)
            own = _bitmaps(t, r, n, known)
            ov = np.zeros((n, len(inside)), np.int64)
            for w in range(own.shape[1]):
                ov += np.bitwise_count(own[:, w, None] & home[None, :, w])
            yield np.arange(lo, lo + n), ov
        return
    o = np.argsort(tokens, kind="stable")
    start, owner = np.append(np.searchsorted(tokens[o], known), len(tokens)), rows[o]
    for y, m in enumerate(main):
        s = np.frombuffer(m, np.int64)
        k = np.searchsorted(known, s)
        k = k[(k < len(known)) & (known[np.minimum(k, len(known) - 1)] == s)]
        if len(k):
            yield np.array([y]), np.bincount(np.concatenate([owner[start[j] : start[j + 1]] for j in k]), minlength=len(inside))[None]


def _join(threshold: float, also_threshold: float):  # noqa: ANN202
    def run(group: pa.Table) -> pa.Table:
        hs, ids, home, main, also = (group[c].to_pylist() for c in ("h", "id", "home", "main", "also"))
        at: dict[bytes, int] = {}
        name: list[int] = []
        first: list[int] = []
        here: list[bool] = []
        for i, h in enumerate(hs):
            if h in at:
                name[at[h]] = min(name[at[h]], ids[i])
                here[at[h]] |= home[i]
            else:
                at[h] = len(name)
                name.append(ids[i]), first.append(i), here.append(home[i])
        sets, names, at_home = [main[i] for i in first], np.array(name), np.array(here)
        size = np.array([len(m) // 8 for m in sets])
        inside = np.flatnonzero(at_home)
        a_out, b_out, s_out = [], [], []
        for rows, ov in _overlaps(sets, inside) if len(inside) else ():
            sim = ov / (size[rows][:, None] + size[inside][None] - ov)
            # a pair of two that are at home here is met twice: keep it once
            ok = (sim >= threshold) & (inside[None] != rows[:, None]) & ((inside[None] > rows[:, None]) | ~at_home[rows][:, None])
            for i, j in zip(*np.nonzero(ok), strict=True):
                x, y = int(inside[j]), int(rows[i])
                p, q = (np.frombuffer(also[first[z]], np.int64) for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both >= also_threshold * (len(p) + len(q) - both) - 1e-12:
                    a_out.append(min(names[x], names[y])), b_out.append(max(names[x], names[y])), s_out.append(sim[i, j])
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64()), "similarity": pa.array(s_out, pa.float64())})

    return run


def similar_classes(left: DataFrame, key: str, main: Column, threshold: float, also: Column | None = None, also_threshold: float = 0.0, right: DataFrame | None = None, right_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The classes of equal records (class_id, left_ids, right_ids) and the similar pairs of classes (a, b, similarity).

    See `similar_pairs`. A class is named by its least id; pairs have a < b. A class has a row for
    each task of the first pass that met it, so that its ids never are one array.
    """
    spark = left.sparkSession
    rows = _read(left, key, main, also, 0)
    if right is not None:
        rows = rows.unionByName(_read(right, right_key or key, main, also, 1))
    if right is not None:  # ids of two tables may coincide: keep classes apart by odd and even names
        rows = rows.withColumn("id", F.col("id") * 2 + F.col("side"))
    found = cut(rows.mapInArrow(_classes, _CLASSES))
    n = found.count()
    sample = found.select("h", "main", "also").filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_ROWS / max(1, n)))).toArrow()
    drawn = sorted(dict(zip(sample["h"].to_pylist(), zip(sample["main"].to_pylist(), sample["also"].to_pylist(), strict=True), strict=True)).values())
    names = found.groupBy("h").agg(F.min(F.array_min(F.concat("left_ids", "right_ids"))).alias("class_id"))
    classes = found.select("h", "left_ids", "right_ids").join(names, "h").drop("h")
    if not drawn:
        return classes, spark.createDataFrame([], "a bigint, b bigint, similarity double")
    take = max(1, min(MOST_PIVOTS, int(np.sqrt(n)), len(drawn)))
    rng = np.random.default_rng(7)
    pivots = Pivots([np.frombuffer(drawn[i][0], np.int64) for i in rng.choice(len(drawn), take, replace=False)], threshold)
    by_also = also is not None and also_threshold > 0
    leading = Leading([np.frombuffer(m[by_also], np.int64) for m in drawn], n, also_threshold if by_also else threshold)
    counted = found.select("main").mapInArrow(_count_cells(pivots), "p int, o int, b int, n bigint").groupBy("p", "o", "b").agg(F.sum("n").alias("n")).toArrow()  # bounded by pivots x overlaps x bands
    cells = np.stack([counted[c].to_numpy() for c in ("p", "o", "b")], 1).astype(int).reshape(-1, 3)
    o = np.lexsort((cells[:, 2], cells[:, 1], cells[:, 0]))
    placed = found.mapInArrow(_assign(pivots, cells[o], counted["n"].to_numpy()[o], leading, by_also), "cell int, part bigint, home boolean, h binary, id bigint, main binary, also binary")
    pairs = placed.groupBy("cell", "part").applyInArrow(_join(threshold, also_threshold), "a bigint, b bigint, similarity double")
    return classes, pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def similar_pairs(left: DataFrame, key: str, main: Column, threshold: float, also: Column | None = None, also_threshold: float = 0.0, right: DataFrame | None = None, right_key: str | None = None) -> DataFrame:
    """All pairs of records whose sets have shared/united of at least `threshold`: (id_a, id_b, similarity).

    `main` and `also` are arrays of 64-bit tokens (see `text_tokens`) or bit sets (nbits, words);
    `also_threshold` is a second condition on `also`. Within one table id_a < id_b, each pair once;
    with `right`, id_a is of the left and id_b of the right table. Records that are null or empty
    in a set are in no pair, nor are those with a null id. Repeated values in a set count once;
    equal records are pairs of similarity 1. Empty tables give an empty result. Only the named
    columns are read. Every pair comes out: the result itself may be large.
    """
    classes, pairs = similar_classes(left, key, main, threshold, also, also_threshold, right, right_key)
    one = right is None
    size = lambda c: F.sum(F.size(c))
    several = classes.groupBy("class_id").agg(size("left_ids").alias("l"), size("right_ids").alias("r")).filter("l > 1" if one else "l > 0 and r > 0").select("class_id")
    mine, theirs = ("left_ids", "left_ids") if one else ("left_ids", "right_ids")
    own = classes.join(several, "class_id")
    own = own.select("class_id", F.col(mine).alias("p")).join(own.select("class_id", F.col(theirs).alias("q")), "class_id").select("p", "q", F.lit(1.0).alias("similarity"), F.lit(True).alias("own"))
    a, b = (classes.select(F.col("class_id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("left_ids", "right_ids")]) for c in ("a", "b"))
    far = pairs.join(a, "a").join(b, "b")
    met = own.unionByName(far.select(F.col(f"a_{mine}").alias("p"), F.col(f"b_{theirs}").alias("q"), "similarity", F.lit(False).alias("own")))
    if not one:
        met = met.unionByName(far.select(F.col("b_left_ids").alias("p"), F.col("a_right_ids").alias("q"), "similarity", F.lit(False).alias("own")))
    met = met.filter((F.size("p") > 0) & (F.size("q") > 0)).repartition(F.xxhash64("p"), F.xxhash64("q"))  # parts of a large class spread before their ids are paired
    met = met.select(F.explode("p").alias("x"), "q", "similarity", "own").select("x", F.explode("q").alias("y"), "similarity", "own")
    if one:
        met = met.filter("not own or x < y")  # a pair of one class is met from either end
    if one:
        return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    half = lambda c: F.shiftright(c, 1)
    return met.select(half("x").alias("id_a"), half("y").alias("id_b"), "similarity")


def classes_with_links(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, links): each record with its class of equal records and how many other classes are similar to it."""
    n = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return classes.join(n, "class_id", "left").select(F.explode("left_ids").alias("id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))
