"""Vectors between Spark and numpy: soundness, a compact lossless form, exact distances."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa

_RAW, _I8, _I16 = 0, 1, 2


def sound_rows(col: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the sound vectors of a list column, and their float32 matrix.

    Sound: not null, `dim` values, none null, NaN or infinite, not all zero.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.empty(0, np.int64), np.empty((0, dim), np.float32)
    offs = col.offsets.to_numpy()
    vals = col.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    ok = col.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offs) == dim)
    idx = np.flatnonzero(ok)
    if not len(idx):
        return idx, np.empty((0, dim), np.float32)
    m = vals[offs[idx][:, None] + np.arange(dim)]
    good = np.isfinite(m).all(1) & m.any(1)
    return idx[good], m[good] + np.float32(0)  # + 0 makes -0.0 plain


def pack(m: np.ndarray) -> list[bytes]:
    """Each row losslessly as bytes: small integers times a power of two where that is exact, else float32; deflated."""
    out: list[bytes] = []
    if not len(m):
        return out
    for kind, dt, top in ((_I8, np.int8, 127), (_I16, np.int16, 32767)):
        big = float(np.abs(m).max())
        for s in range(0, 15):
            if big * 2**s > top:
                break
            q = m * np.float32(2**s)
            if (q == np.rint(q)).all():
                q = q.astype(dt)
                return [bytes((kind, s)) + zlib.compress(r.tobytes(), 1) for r in q]
    if len(m) > 1:  # one odd row must not spoil the others
        for r in m:
            out += pack(r[None])
        return out
    return [bytes((_RAW, 0)) + zlib.compress(m[0].astype(np.float32).tobytes(), 1)]


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    """The float32 matrix of packed rows."""
    m = np.empty((len(rows), dim), np.float32)
    for i, b in enumerate(rows):
        raw = zlib.decompress(b[2:])
        if b[0] == _I8:
            m[i] = np.frombuffer(raw, np.int8) * np.float32(2.0 ** -b[1])
        elif b[0] == _I16:
            m[i] = np.frombuffer(raw, np.int16) * np.float32(2.0 ** -b[1])
        else:
            m[i] = np.frombuffer(raw, np.float32)
    return m


def digests(m: np.ndarray) -> list[bytes]:
    """A 16-byte digest of each row: equal rows, equal digests."""
    return [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in np.ascontiguousarray(m, np.float32)]


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared L2 distances between the rows of two float32 matrices, in float32 (error near 1e-6 of the norms)."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L2 distances of the rows of two equally long matrices, by differences in double."""
    d = a.astype(np.float64) - b.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", d, d))
