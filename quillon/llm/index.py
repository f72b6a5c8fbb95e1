"""Most similar vectors for every vector, by an inverted multi-index.

Each vector is cut into two halves, each half has its own small codebook, and the pair of nearest
codewords is the vector's cell. A query visits the occupied cells in the order of summed squared
codeword distance, taken from a heap, until it has seen enough cells and entries; the entries of
the visited cells are reranked by exact distance.

The codebooks are fitted on a bounded sample (`SAMPLE_ROWS`); every row is indexed. The table of
cells is exact: entries are filed first, cells are counted over all of them, and only then do
queries travel, so no cell is unknown, however small. The table has at most MOST_CODES ** 2 counts
of four bytes. Equal vectors of a batch are one entry with a list of ids, so a vector that a third
of all rows share costs one entry a batch. Entries are shuffled once, in compact lossless form, to
the group of their first codeword; a large group is split by its second codeword, and a cell that
is large by itself is cut into slices all of which its visitors see. No group is unbounded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .vectors import digests, exact_distances, pack, sound_rows, square_distances, unpack

#: Rows the codebooks are fitted on, at most about this many.
SAMPLE_ROWS = 8192
#: Codewords of a half, at most.
MOST_CODES = 1024
#: Entries of a group and of a slice of one cell, about.
GROUP_ROWS, SLICE_ROWS = 2000, 4000


@dataclass(frozen=True)
class Codebooks:
    """Two codebooks of at most MOST_CODES codewords each."""

    dim: int
    first: np.ndarray
    second: np.ndarray

    def distances(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves of each row to the codewords of either book."""
        h = self.dim // 2
        return square_distances(m[:, :h], self.first), square_distances(m[:, h:], self.second)


def groups(cells: np.ndarray) -> np.ndarray:
    """Into how many groups the entries of each first codeword are split."""
    return np.maximum(1, np.ceil(cells.sum(1) / GROUP_ROWS).astype(int))


def slices(cells: np.ndarray) -> np.ndarray:
    """Into how many slices each cell is cut."""
    return np.maximum(1, np.ceil(cells / SLICE_ROWS).astype(int))


def _lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means from randomly drawn rows: codewords follow the density, so crowded regions get many."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = square_distances(x, c).argmin(1)
        n = np.bincount(a, minlength=k)
        s = np.zeros_like(c, dtype=np.float64)
        order = np.argsort(a, kind="stable")
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = np.flatnonzero(n)
        s[full] = np.add.reduceat(x[order].astype(np.float64), starts[full], axis=0)
        c[full] = (s[full] / n[full, None]).astype(np.float32)
    return c


def fit(df: DataFrame, key: str, vec: str, dim: int, rows: int | None = None, codes: int | None = None, sample_rows: int | None = None, rounds: int = 6) -> Codebooks | None:
    """Codebooks from a sample of about `sample_rows` sound rows (SAMPLE_ROWS by default), chosen by a hash of the key; None if no vector is sound.

    `codes` defaults to a power of two near half the root of the row count, so that cells keep
    their size while the table grows, up to MOST_CODES.
    """
    n, sample_rows = df.count() if rows is None else rows, sample_rows or SAMPLE_ROWS
    x = df.select(key, vec)
    if n > sample_rows:
        x = x.filter(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    packed = x.mapInArrow(_pack_all(dim), "h binary, packed binary").toArrow()
    if not packed.num_rows:
        return None
    _, at = np.unique(np.array(packed["h"].to_pylist(), dtype=object).astype("S16"), return_index=True)
    p = packed["packed"].to_pylist()
    m = unpack([p[i] for i in sorted(at)], dim)
    k = codes or 2 ** int(round(np.log2(max(8, np.sqrt(n) / 2))))
    k = max(1, min(k, MOST_CODES, len(m) // 2 or 1))
    rng = np.random.default_rng(7)
    h = dim // 2
    return Codebooks(dim, _lloyd(m[:, :h], k, rounds, rng), _lloyd(m[:, h:], k, rounds, rng))


def _pack_all(dim: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, m = sound_rows(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array(digests(m), pa.binary()), pa.array(pack(m), pa.binary())], ["h", "packed"])

    return run


def traverse(d1: np.ndarray, d2: np.ndarray, cells: np.ndarray, home: tuple[int, int], least_cells: int, least_entries: int) -> list[tuple[int, int]]:
    """Occupied cells of one query by increasing d1[i] + d2[j], from a heap.

    The heap holds the next occupied cell of each opened first codeword; a further codeword is
    opened once it may hold a nearer cell than the heap's top. Goes on until `least_cells` cells
    and `least_entries` entries were visited, or no cell is left. The query's own cell comes first.
    """
    order, by_second = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    one, two, nearest = d1[order].tolist(), d2[by_second], float(d2[by_second[0]])
    rows: list[tuple[list[int], list[float]]] = []
    heap: list[tuple[float, int, int]] = []
    out, n = [home], int(cells[home])
    while len(out) < least_cells or n < least_entries:
        while len(rows) < len(one) and (not heap or one[len(rows)] + nearest < heap[0][0]):
            held = cells[order[len(rows)], by_second] > 0
            rows.append((by_second[held].tolist(), two[held].tolist()))
            if rows[-1][0]:
                heapq.heappush(heap, (one[len(rows) - 1] + rows[-1][1][0], len(rows) - 1, 0))
        if not heap:
            break
        _, r, at = heapq.heappop(heap)
        seconds, far = rows[r]
        if at + 1 < len(seconds):
            heapq.heappush(heap, (one[r] + far[at + 1], r, at + 1))
        cell = (int(order[r]), seconds[at])
        if cell != home:
            out.append(cell)
            n += int(cells[cell])
    return out


_ENTRY = "h binary, ids array<bigint>, askers array<bigint>, packed binary, c1 int, c2 int"
_PLACE = "h binary, id bigint, asks boolean, packed binary, places array<struct<grp:int,part:int,home:int,visits:array<int>>>"


def entries(df: DataFrame, key: Column, vec: str, books: Codebooks, asks: Column | None = None) -> DataFrame:
    """One row for each distinct sound vector of each batch, with its cell (c1, c2), written to the checkpoint folder.

    `ids` are its rows in the batch, `askers` those that are queries (all by default).
    """
    x = df.select(key.cast("bigint").alias("id"), (F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))).alias("asks"), F.col(vec)).filter(F.col("id").isNotNull())
    return cut(x.mapInArrow(_file(books), _ENTRY))


def _file(books: Codebooks):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, m = sound_rows(b.column(2), books.dim)
            if not len(idx):
                continue
            keys, asks = b.column(0).to_numpy(zero_copy_only=False)[idx], b.column(1).to_numpy(zero_copy_only=False)[idx]
            ids: dict[bytes, list[int]] = {}
            asked: dict[bytes, list[int]] = {}
            first = []
            for i, (h, k, a) in enumerate(zip(digests(m), keys.tolist(), asks.tolist(), strict=True)):
                if h not in ids:
                    ids[h], asked[h] = [], []
                    first.append(i)
                ids[h].append(k)
                if a:
                    asked[h].append(k)
            d1, d2 = books.distances(m[first])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(ids), pa.binary()), pa.array([sorted(x) for x in ids.values()], pa.list_(pa.int64())), pa.array([sorted(x) for x in asked.values()], pa.list_(pa.int64())),
                    pa.array(pack(m[first]), pa.binary()), pa.array(d1.argmin(1).astype(np.int32)), pa.array(d2.argmin(1).astype(np.int32)),
                ],
                ["h", "ids", "askers", "packed", "c1", "c2"],
            )

    return run


def count_cells(index: DataFrame, books: Codebooks) -> np.ndarray:
    """(first, second) codewords: how many entries each cell holds, counted over all of them."""
    cells = np.zeros((len(books.first), len(books.second)), np.int32)
    told = index.groupBy("c1", "c2").agg(F.count(F.lit(1)).cast("int").alias("n")).toArrow()  # a row an occupied cell, at most MOST_CODES ** 2
    cells[told["c1"].to_numpy(), told["c2"].to_numpy()] = told["n"].to_numpy()
    return cells


def place(index: DataFrame, books: Codebooks, cells: np.ndarray, least_cells: int, least_entries: int) -> DataFrame:
    """(h, id, asks, packed, places): the groups each entry goes to, with `home` its second codeword in its own
    group (-1 elsewhere) and `visits` the second codewords it visits there."""
    x = index.select("h", F.array_min("ids").alias("id"), (F.size("askers") > 0).alias("asks"), "packed", "c1", "c2")
    return x.mapInArrow(_travel(books, cells, least_cells, least_entries), _PLACE)


def _place(groups: list[int], slices: np.ndarray, codes: int, home: tuple[int, int], visits: list[tuple[int, int]], salt: int) -> list[dict]:
    """Where an entry goes. A group is a first codeword, a part of it holds the second codewords c2
    with c2 % groups == part; slice s > 0 of a large cell is a part of its own, numbered on from the rest."""
    at: dict[tuple[int, int], dict] = {}

    def parts(c1: int, c2: int) -> list[int]:
        g = groups[c1]
        return [c2 % g] + [g + c2 + codes * (s - 1) for s in range(1, int(slices[c1, c2]))]

    def row(c1: int, part: int) -> dict:
        return at.setdefault((c1, part), {"grp": c1, "part": part, "home": -1, "visits": []})

    for c1, c2 in visits:
        for part in parts(c1, c2):
            row(c1, part)["visits"].append(c2)
    own = parts(*home)
    row(home[0], own[salt % len(own)])["home"] = home[1]
    return list(at.values())


def _travel(books: Codebooks, cells: np.ndarray, least_cells: int, least_entries: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, cuts = groups(cells).tolist(), slices(cells)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                x = b.slice(lo, 512)
                asks = x.column(2).to_pylist()
                asking = [i for i, a in enumerate(asks) if a]
                at = {i: n for n, i in enumerate(asking)}
                packed = x.column(3).take(pa.array(asking, pa.int64())).to_pylist()
                d1, d2 = books.distances(unpack(packed, books.dim)) if asking else (None, None)
                out = []
                for i, (h, c1, c2) in enumerate(zip(x.column(0).to_pylist(), x.column(4).to_pylist(), x.column(5).to_pylist(), strict=True)):
                    visits = traverse(d1[at[i]], d2[at[i]], cells, (c1, c2), least_cells, least_entries) if i in at else []
                    out.append(_place(parts, cuts, len(books.second), (c1, c2), visits, int.from_bytes(h[:4], "little")))
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2), x.column(3), pa.array(out, _PLACES)], ["h", "id", "asks", "packed", "places"])

    return run


_PLACES = pa.list_(pa.struct([("grp", pa.int32()), ("part", pa.int32()), ("home", pa.int32()), ("visits", pa.list_(pa.int32()))]))


def links(placed: DataFrame, books: Codebooks, k: int, max_distance: float | None = None, both_ways: bool = True, anchors: bool = False) -> DataFrame:
    """(qh, qid, eid, d): the nearest entries seen by each asking vector qh; entries are named by their least id.

    At least the k nearest of what was seen, with all ties of the k-th; further ones may appear.
    With `both_ways` a pair counts for either end that asks. Vectors equal to the asking one are
    left out: they are the same entry. With `anchors` each asking vector also keeps its link to the
    least id within `max_distance`, so that a large group stays one piece however near its k nearest are.
    qid is the least id of the asking rows of qh (of all its rows, where all ask).
    """
    x = placed.select("h", "id", "asks", "packed", F.explode("places").alias("p"))
    x = x.select("h", "id", "asks", "packed", "p.grp", "p.part", "p.home", "p.visits")
    near = x.groupBy("grp", "part").applyInArrow(_rerank(books.dim, k, max_distance, both_ways, anchors), "qh binary, qid bigint, eid bigint, d double")
    w = Window.partitionBy("qh").orderBy("d", "eid")
    near = near.groupBy("qh", "eid").agg(F.min("d").alias("d"), F.min("qid").alias("qid")).withColumn("r", F.row_number().over(w))
    if anchors:
        near = near.withColumn("anchor", F.min("eid").over(Window.partitionBy("qh"))).filter((F.col("r") <= k) | (F.col("eid") == F.col("anchor")))
    else:
        near = near.filter(F.col("r") <= k)
    return near.select("qh", "qid", "eid", "d")


def _rerank(dim: int, k: int, limit: float | None, both_ways: bool, anchors: bool):  # noqa: ANN202
    def run(group: pa.Table) -> pa.Table:
        hs, ids = group["h"].to_pylist(), group["id"].to_pylist()
        homes, asks, visits, packed = group["home"].to_pylist(), group["asks"].to_pylist(), group["visits"].to_pylist(), group["packed"].to_pylist()
        at: dict[bytes, int] = {}
        first: list[int] = []
        name: list[int] = []
        for i, h in enumerate(hs):  # one row for each distinct vector, named by its least id
            if h not in at:
                at[h] = len(first)
                first.append(i)
                name.append(ids[i])
            else:
                name[at[h]] = min(name[at[h]], ids[i])
        names, home = np.array(name, np.int64), np.array([homes[i] for i in first])
        asking = np.array([asks[i] for i in first])
        for i, h in enumerate(hs):
            asking[at[h]] |= asks[i]
        by_cell: dict[int, list[int]] = {}
        for n, i in enumerate(first):
            for c in visits[i] or ():
                by_cell.setdefault(c, []).append(n)
        m = unpack([packed[i] for i in first], dim)
        qs: list[np.ndarray] = []
        es: list[np.ndarray] = []
        for c in np.unique(home[home >= 0]):
            e = np.flatnonzero(home == c)
            q_all = np.array(by_cell.get(int(c), []), np.int64)
            for lo in range(0, len(q_all), 512):
                q = q_all[lo : lo + 512]
                d = square_distances(m[q], m[e])
                d[q[:, None] == e[None]] = np.inf
                if len(e) > k:
                    most = np.partition(d, k - 1, axis=1)[:, k - 1 : k] + 1e-4  # room for rounding; ties stay
                else:
                    most = np.full((len(q), 1), 3e38)
                if limit is not None:
                    most = np.minimum(most, limit * limit + 1e-4)
                i, j = np.nonzero(d <= most)
                qs.append(q[i])
                es.append(e[j])
                if anchors and limit is not None:
                    o = np.argsort(names[e], kind="stable")
                    j = (d[:, o] <= limit * limit - 1e-5).argmax(1)
                    i = np.flatnonzero(d[np.arange(len(q)), o[j]] <= limit * limit - 1e-5)
                    qs.append(q[i])
                    es.append(e[o[j[i]]])
        q, e = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (qs, es))
        d = np.concatenate([exact_distances(m[q[i : i + 2048]], m[e[i : i + 2048]]) for i in range(0, len(q), 2048)] or [np.empty(0)])
        if limit is not None:
            q, e, d = q[d <= limit], e[d <= limit], d[d <= limit]
        if both_ways:
            back = asking[e]
            q, e, d = np.concatenate([q, e[back]]), np.concatenate([e, q[back]]), np.concatenate([d, d[back]])
        o = np.lexsort((names[e], d, q))  # the k nearest of each asking vector in this group
        q, e, d = q[o], e[o], d[o]
        new = np.r_[True, (q[1:] != q[:-1]) | (e[1:] != e[:-1])] if len(q) else np.empty(0, bool)
        q, e, d = q[new], e[new], d[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        if anchors and len(q):
            starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            keep |= names[e] == np.repeat(np.minimum.reduceat(names[e], starts), np.diff(np.append(starts, len(q))))
        digest = pa.array([hs[i] for i in first], pa.binary())
        return pa.table({"qh": digest.take(pa.array(q[keep])), "qid": names[q[keep]], "eid": names[e[keep]], "d": d[keep]})

    return run


def neighbours(index: DataFrame, near: DataFrame, k: int, salts: int = 16) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of every asking row, ties by smaller id.

    `near` holds the links between distinct vectors. Rows with an equal vector stand at distance 0
    and come first, then the rows of the linked vectors by distance and id. Of a vector that many
    rows share only the k + 1 smallest ids can be anyone's neighbours, so copies multiply nothing.
    """
    least = index.groupBy("h").agg(
        F.sum(F.size("ids")).alias("m"), F.min(F.array_min("ids")).alias("cid"), F.slice(F.array_sort(F.flatten(F.collect_list(F.slice("ids", 1, k + 1)))), 1, k + 1).alias("first")
    )
    shared = least.filter("m > 1")
    asking = index.filter(F.size("askers") > 0).select("h", F.explode("askers").alias("query_id")).withColumn("salt", F.pmod("query_id", F.lit(salts)))
    spread = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    asking = asking.join(spread, ["h", "salt"], "left")
    own = (
        asking.filter("m > 1")
        .select("query_id", F.posexplode(F.slice(F.filter("first", lambda i: i != F.col("query_id")), 1, k)).alias("r", "id"))
        .select("query_id", "id", F.lit(0.0).alias("distance"), (F.col("r") + 1).alias("rank"))
    )
    far = near.join(shared.select(F.col("h").alias("qh"), "m"), "qh", "left").withColumn("room", k + 1 - F.coalesce("m", F.lit(1))).filter("room > 0").select("qh", "eid", "d", "room")
    members = F.coalesce("first", F.array("eid"))
    far = far.join(shared.select(F.col("cid").alias("eid"), "first"), "eid", "left").select("qh", "d", "room", F.explode(members).alias("id"))
    far = far.withColumn("r", F.row_number().over(Window.partitionBy("qh").orderBy("d", "id"))).filter("r <= room")
    few = asking.filter(F.coalesce("m", F.lit(1)) <= k).select(F.col("h").alias("qh"), "query_id")  # vectors of more rows have no room left
    far = far.join(few, "qh").select("query_id", "id", F.col("d").alias("distance"), (k - F.col("room") + F.col("r")).alias("rank"))
    return own.unionByName(far)


def similar_rows(df: DataFrame, key: str, vec: str, dim: int, k: int, max_distance: float | None = None, asks: Column | None = None, least_cells: int = 4, least_entries: int = 0, least_share: float = 0.0) -> DataFrame:
    """The k most similar other rows of every asking row by L2 distance: (query_id, id, distance, rank).

    Rows whose vector is null, of another length, all zero or holds null, NaN or infinity neither
    ask nor answer; a null key leaves the row out. Ties go to the smaller id; repeated vectors are
    neighbours at distance 0. `asks` selects the asking rows (default all). `max_distance` drops
    farther ones. Approximate: a query visits at least `least_cells` cells, `least_entries` entries and
    `least_share` of all entries. Empty tables give an empty result; other columns are not read.
    """
    index, books, placed = build(df, key, vec, dim, asks, least_cells, least_entries, least_share)
    if books is None:
        return df.sparkSession.createDataFrame([], "query_id bigint, id bigint, distance double, rank bigint")
    near = links(placed, books, k, max_distance, both_ways=asks is None)
    return neighbours(index, near, k).withColumn("rank", F.col("rank").cast("bigint"))


def build(df: DataFrame, key: str, vec: str, dim: int, asks: Column | None = None, least_cells: int = 4, least_entries: int = 0, least_share: float = 0.0) -> tuple[DataFrame | None, Codebooks | None, DataFrame | None]:
    """The filed entries, the codebooks and the placed entries; all None if no vector is sound."""
    books = fit(df, key, vec, dim)
    if books is None:
        return None, None, None
    index = entries(df, F.col(key), vec, books, asks)
    cells = count_cells(index, books)
    return index, books, place(index, books, cells, least_cells, max(least_entries, int(least_share * cells.sum())))


def close_pairs(df: DataFrame, key: str, vec: str, dim: int, k: int, max_distance: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs within `max_distance` of which one is among the k nearest of the other."""
    n = similar_rows(df, key, vec, dim, k, max_distance)
    return n.select(F.least("query_id", "id").alias("id_a"), F.greatest("query_id", "id").alias("id_b")).distinct()
