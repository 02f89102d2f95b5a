"""Vectorised text primitives over Arrow string buffers.

A text column arrives as one contiguous UTF-8 buffer with row offsets.  The
functions here find the words of many rows at once and give each a 64-bit hash,
without building a Python string per word:

* a word is a maximal run of "word bytes" (which bytes those are is a parameter);
* its hash is a polynomial in the odd base ``P`` modulo 2**64, read off a running
  sum (``(S[end] - S[start]) * P**-start``), then mixed by a finaliser;
* rows are worked in slices of about ``SLICE`` bytes so that temporaries stay in
  cache; a longer row is a slice of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
P = 0x9E3779B97F4A7C15 | 1
P_INV = pow(P, -1, 1 << 64)
U64 = np.uint64
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)

_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n, kept up to the largest n of ordinary slices."""
    have = _pow.get("p")
    if have is not None and len(have) >= n:
        return _pow["p"], _pow["q"]
    size = max(n, SLICE + 1)
    out = []
    for base in (P, P_INV):
        a = np.full(size, base, dtype=U64)
        a[0] = 1
        out.append(np.multiply.accumulate(a, dtype=U64))
    if size <= 4 * SLICE:
        _pow["p"], _pow["q"] = out
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (in place on a fresh array)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def byte_class(keep: str) -> np.ndarray:
    """Lookup table of word bytes.  ``alnum``: ASCII letters and digits and every
    byte of a multi-byte character; ``nospace``: all but ASCII white space."""
    t = np.zeros(256, dtype=bool)
    if keep == "alnum":
        for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
            t[a:b] = True
    else:
        t[:] = True
        t[[9, 10, 11, 12, 13, 32, 28, 29, 30, 31]] = False
    return t


ALNUM = byte_class("alnum")
NOSPACE = byte_class("nospace")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows [lo, hi) of at most ``limit`` bytes together, one row at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of rows [lo, hi): hash, row (from 0), byte span within ``data``; ``sums`` and
    ``inverse`` let the hash of any byte span be taken."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def words(col, keep: np.ndarray = ALNUM, fold: np.ndarray = LOWER, limit: int = SLICE) -> Iterator[Words]:
    data, offsets = buffers(col)
    for lo, hi in slices(offsets, limit):
        bounds = offsets[lo : hi + 1] - offsets[lo]
        raw = data[offsets[lo] : offsets[hi]]
        n = len(raw)
        d = fold[raw]
        p, q = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((d.astype(U64) + U64(1)) * p[:n], out=sums[1:])
        w = np.zeros(n + 2, dtype=bool)
        w[1:-1] = keep[raw]
        first = np.zeros(n + 1, dtype=bool)
        first[bounds] = True
        start = np.flatnonzero(w[1:-1] & (~w[:-2] | first[:-1]))
        end = np.flatnonzero(w[1:-1] & (~w[2:] | first[1:])) + 1
        row = np.searchsorted(bounds, start, side="right") - 1
        yield Words(lo, hi, d, bounds, mix((sums[end] - sums[start]) * q[start]), row, start, end, sums, q)


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words within a row: (hash, row, index of the first word).
    A row of fewer than k words but at least one gives one shingle of all its words."""
    n = len(h)
    if n == 0:
        return h, row, np.zeros(0, np.int64)
    m = n - k + 1
    parts, rows, at = [], [], []
    if m > 0:
        ok = np.flatnonzero(row[:m] == row[k - 1 :])
        s = np.zeros(m, dtype=U64)
        for j in range(k):
            s = s * U64(0xD6E8FEB86659FD93) + h[j : j + m]
        parts.append(mix(s[ok]))
        rows.append(row[ok])
        at.append(ok)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, n])
    short = count < k
    if short.any():
        f, c = first[short], count[short]
        s = np.zeros(len(f), dtype=U64)
        for j in range(k - 1):
            live = c > j
            s[live] = s[live] * U64(0xD6E8FEB86659FD93) + h[f[live] + j]
        parts.append(mix(s + c.astype(U64)))
        rows.append(row[f])
        at.append(f)
    if not parts:
        return h[:0], row[:0], np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(rows), np.concatenate(at)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (doubling: log2(w) passes)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    cur, span = x, 1
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    if span < w:
        cur = np.minimum(cur[: len(x) - w + 1], cur[w - span : w - span + n])
    return cur[:n]
