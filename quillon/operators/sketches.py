"""Sketches: short codes of long vectors that never say two vectors are farther apart than they are.

A vector is projected on the directions of most variance in a sample, the length of what is left over is
one more coordinate, and each is cut off and rounded to a small integer. None of these steps but the
rounding brings two vectors farther apart, and the rounding does so by a known amount, so two vectors
within tau always have codes within `Sketch.bound`. The sample decides how many others have too, not
whether a pair is found.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Directions to choose from. Up to 259 coordinates, float32 holds the squared distance of two codes exactly.
WIDTHS = (32, 48, 64, 96, 128, 192, 256)
#: Vectors whose codes are near are compared in full, which is dear: a greater share of all pairs is not worth it.
MOST_SHARE = 5e-4
#: Seconds for a coordinate of a pair of codes, and for a pair in full.
CODE_S, PAIR_S = 2.6e-11, 1e-4
CHUNK, LEFT_TILE, RIGHT_TILE = 1024, 512, 4096


@dataclass
class Sketch:
    center: np.ndarray
    basis: np.ndarray
    rest: float
    step: float
    bound: int

    def coordinates(self, m: np.ndarray) -> np.ndarray:
        x = m.astype(np.float64) - self.center
        # Into a ball, as rounding errors of very long vectors would exceed a step.
        x *= np.minimum(1, 1e4 * self.step / np.maximum(np.sqrt((x * x).sum(1)), 1e-300))[:, None]
        p = x @ self.basis
        return np.column_stack([p, np.sqrt(np.maximum((x * x).sum(1) - (p * p).sum(1), 0)) - self.rest])

    def codes(self, m: np.ndarray) -> np.ndarray:
        return np.rint(np.clip(self.coordinates(m) / self.step, -127, 127)).astype(np.int8)


def _directions(x: np.ndarray, most: int) -> np.ndarray:
    """Orthonormal columns, those of most variance first."""
    if x.shape[1] <= len(x):
        return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :most]
    return np.linalg.qr(x.T @ np.linalg.eigh(x @ x.T)[1][:, ::-1][:, :most])[0]


def fit(left: np.ndarray, right: np.ndarray, tau: float) -> Sketch | None:
    """The cheapest sketch by samples of both sides; None where none tells most pairs apart with a quarter of the coordinates."""
    left, right = (np.unique(x[np.isfinite(x).all(1)], axis=0) for x in (left, right))
    dim = left.shape[1]
    widths = [w for w in WIDTHS if 4 * w <= dim and w <= len(left) + len(right)]
    if not widths or not len(left) or not len(right):
        return None
    both = np.concatenate([left, right]).astype(np.float64)
    center = np.median(both, axis=0)
    both -= center
    # A few very long vectors are not to say what the directions are.
    n = np.sqrt((both * both).sum(1))
    both *= np.minimum(1, 4 * np.median(n) / np.maximum(n, 1e-300))[:, None]
    basis, best = _directions(both, max(widths)), None
    for w in widths:
        p = both @ basis[:, :w]
        rest = np.sqrt(np.maximum((both * both).sum(1) - (p * p).sum(1), 0))
        step = float(np.quantile(np.abs(np.column_stack([p, rest - np.median(rest)])), 0.999)) / 127
        if not step > 0:
            continue
        # Each code is within half a step of its coordinate, and a hundredth for the floats.
        s = Sketch(center, np.ascontiguousarray(basis[:, :w]), float(np.median(rest)), step, int((tau / step + 1.02 * np.sqrt(w + 1)) ** 2))
        share = sum(len(i) for i, _ in near(s.codes(left), s.codes(right), s.bound)) / len(left) / len(right)
        cost = CODE_S * w + PAIR_S * share
        if share <= MOST_SHARE and (best is None or cost < best[0]):
            best = cost, s
    return best[1] if best else None


def near(a: np.ndarray, b: np.ndarray, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the codes whose squared distance is at most `bound`, tile by tile.

    Both sides are ordered by the coordinate that differs most, so tiles too far apart in it are left out.
    """
    if not len(a) or not len(b):
        return
    w = int(np.argmax(b[:: -(-len(b) // RIGHT_TILE)].astype(np.float32).var(0)))
    i, j = np.argsort(a[:, w], kind="stable"), np.argsort(b[:, w], kind="stable")
    x, y = a[i].astype(np.float32), b[j].astype(np.float32)
    one = lambda z: np.ones((len(z), 1), np.float32)
    square = lambda z: (z * z).sum(1)[:, None]
    at, reach = np.ascontiguousarray(y[:, w]), np.sqrt(bound) + 1
    x, y = np.hstack([-2 * x, square(x), one(x)]), np.hstack([y, one(y), square(y)])
    for lo in range(0, len(x), LEFT_TILE):
        tile = x[lo : lo + LEFT_TILE]
        first, last = np.searchsorted(at, tile[0, w] / -2 - reach), np.searchsorted(at, tile[-1, w] / -2 + reach, "right")
        for r in range(first, last, RIGHT_TILE):
            d = tile @ y[r : min(r + RIGHT_TILE, last)].T
            hit = np.flatnonzero(d <= bound)
            if len(hit):
                yield i[lo + hit // d.shape[1]], j[r + hit % d.shape[1]]


def pack(m: np.ndarray) -> list[bytes]:
    """Float32 rows as deflated bytes without loss: small integers and a power of two where that gives the same values."""
    top = np.abs(m).max(1).astype(np.float64)
    e = np.clip(np.floor(np.log2(127 / np.where(top > 0, top, 127))), -126, 126)
    x = m * np.exp2(e)[:, None]
    whole = (x == np.rint(x)).all(1)
    small = x.astype(np.int8, casting="unsafe") if whole.all() else np.where(whole[:, None], x, 0).astype(np.int8)
    return [zlib.compress(bytes([int(k) + 128]) + s.tobytes() if ok else b"\xff" + v.tobytes(), 1) for k, s, v, ok in zip(e, small, m, whole, strict=True)]


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(packed), dim), np.float32)
    for i, p in enumerate(packed):
        raw = zlib.decompress(p)
        out[i] = np.frombuffer(raw, np.float32, offset=1) if raw[0] == 255 else np.frombuffer(raw, np.int8, offset=1) * np.float32(2.0 ** (128 - raw[0]))
    return out


def _chunks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of the rows without null, NaN or infinity; all have `dim` values."""
    for lo in range(0, batch.num_rows, CHUNK):
        part = batch.slice(lo, CHUNK)
        with np.errstate(over="ignore"):
            m = part["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(part.num_rows, dim)
        ok = np.isfinite(m).all(1)
        if ok.any():
            yield part["id"].filter(pa.array(ok)), m[ok]


def _keys(packed: list[bytes]) -> pa.Array:
    return pa.array([hashlib.md5(p, usedforsecurity=False).digest() for p in packed], pa.binary())


def sketched(sketch: Sketch, dim: int) -> Callable:
    """(id, v) -> (id, key, code); equal vectors have one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, m in _chunks(batch, dim):
                yield pa.record_batch({"id": ids, "key": _keys(pack(m)), "code": pa.array([c.tobytes() for c in sketch.codes(m)], pa.binary())})

    return run


def packed(dim: int) -> Callable:
    """(id, v) -> (key, v): packed vectors by the keys of `sketched`, each once a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, m in _chunks(batch, dim):
                p = list(dict.fromkeys(pack(m)))
                yield pa.record_batch({"key": _keys(p), "v": pa.array(p, pa.binary())})

    return run


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.int8).reshape(-1, width)


def candidates(bound: int, width: int) -> Callable:
    """Two blocks of (key, code) -> (lk, rk) whose codes are near."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(near(_matrix(left["code"], width), _matrix(right["code"], width), bound))
        take = lambda t, k: t["key"].combine_chunks().take(pa.array(np.concatenate([f[k] for f in found]))) if found else pa.array([], pa.binary())
        return pa.table({"lk": take(left, 0), "rk": take(right, 1)})

    return run


def measured(distances: Callable, dim: int, tau: float, inclusive: bool) -> Callable:
    """(lk, rk, lv, rv) -> (lk, rk, dis) within tau, from the whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                d = distances(unpack(part["lv"].to_pylist(), dim), unpack(part["rv"].to_pylist(), dim), "l2")
                ok = pa.array(d <= tau if inclusive else d < tau)
                yield pa.record_batch({"lk": part["lk"].filter(ok), "rk": part["rk"].filter(ok), "dis": pa.array(d).filter(ok)})

    return run
