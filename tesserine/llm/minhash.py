"""MinHash near-duplicate detection with one-permutation hashing.

1. Each text becomes the set of its ``shingle``-word shingles (words: runs of ASCII letters
   and digits and of non-ASCII characters, ASCII case folded).  One hash per shingle fills
   one of ``bands * rows`` bins with its minimum (one permutation).
2. Empty bins are filled by optimal densification: bin i copies the first non-empty bin of a
   random probe sequence that depends on i alone, so all documents probe alike.
3. Documents with one and the same signature collapse first, in a partial aggregation: hot
   texts never reach a bucket more than once.
4. The rest meet in banded buckets.  A bucket of n members gives a star of n - 1 candidate
   edges, never n**2 pairs.  The centre is the member of least hash under one of
   ``centres`` seeds (the band chooses), so members of one group meet several centres and a
   poor one does no harm.
5. Candidates are verified on the full signatures; verified edges are joined to groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from ._store import cut, drop, text_rows
from .graph import components

BANDS, ROWS, SHINGLE, THRESHOLD, CENTRES = 64, 3, 5, 0.4, 4
_EMPTY = np.uint32(0xFFFFFFFF)


def signature_block(col, bins: int, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, uint32 signatures, rows that have at least one word) for slices of a text column."""
    for w in V.words(col):
        h, row, _ = V.shingles(w.hash, w.row, shingle)
        n = w.hi - w.lo
        bin_of = ((h >> V.U64(32)) * V.U64(bins) >> V.U64(32)).astype(np.int64)
        value = (h & V.U64(0xFFFFFFFE)).astype(np.uint32)
        sig = np.full(n * bins, _EMPTY, dtype=np.uint32)
        np.minimum.at(sig, row * bins + bin_of, value)
        sig = sig.reshape(n, bins)
        yield w.lo, w.hi, densify(sig), np.bincount(row, minlength=n) > 0


def densify(sig: np.ndarray) -> np.ndarray:
    """Fill empty bins; a row without any value stays empty."""
    bins = sig.shape[1]
    source = sig.copy()
    live = np.flatnonzero((sig != _EMPTY).any(axis=1))
    r, c = np.nonzero(sig[live] == _EMPTY)
    r = live[r]
    attempt = 1
    while len(r):
        probe = V.mix((c.astype(np.uint64) << V.U64(32)) + V.U64(attempt)) % V.U64(bins)
        got = source[r, probe.astype(np.int64)]
        ok = got != _EMPTY
        sig[r[ok], c[ok]] = got[ok]
        r, c = r[~ok], c[~ok]
        attempt += 1
    return sig


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    for j in range(rows):
        h = V.mix(h * V.U64(V.P) + s[:, :, j] + V.U64(1))
    return h


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, shingle: int) -> DataFrame:
    """(_id, sig): rows with a null id or without a word give none."""
    bins = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, sig, has in signature_block(b.column(1), bins, shingle):
                keep = np.flatnonzero(has)
                if len(keep):
                    rows_ = sig[keep]
                    off = pa.py_buffer((np.arange(len(keep) + 1) * bins * 4).astype(np.int32))
                    blob = pa.BinaryArray.from_buffers(pa.binary(), len(keep), [None, off, pa.py_buffer(rows_.tobytes())])
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(keep)), blob], ["_id", "sig"])

    return text_rows(docs, id_col, text_col).where("_id is not null").mapInArrow(run, "_id long, sig binary")


def _buckets(reps: DataFrame, bands: int, rows: int, centres: int) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            data, _ = V.buffers(b.column(1))
            n, off = b.num_rows, V.buffers(b.column(1))[1]
            sig = np.frombuffer(data[off[0] : off[-1]].tobytes(), np.uint32).reshape(n, bands * rows)
            key = band_hashes(sig, bands, rows).ravel().view(np.int64)
            ids = np.repeat(np.asarray(b.column(0)), bands)
            seed = np.tile(np.arange(bands, dtype=np.uint64) % V.U64(centres), n)
            order = V.mix(V.mix(ids.astype(np.uint64)) + seed * V.U64(V.P)) >> V.U64(1)
            for i in range(0, len(ids), 1 << 17):
                j = i + (1 << 17)
                yield pa.RecordBatch.from_arrays([pa.array(key[i:j]), pa.array(order[i:j].view(np.int64)), pa.array(ids[i:j])], ["key", "rank", "_id"])

    return reps.mapInArrow(run, "key long, rank long, _id long")


def _agreement(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            x, xo = V.buffers(b.column(2))
            y, yo = V.buffers(b.column(3))
            n = b.num_rows
            sx = np.frombuffer(x[xo[0] : xo[-1]].tobytes(), np.uint32).reshape(n, -1)
            sy = np.frombuffer(y[yo[0] : yo[-1]].tobytes(), np.uint32).reshape(n, -1)
            score = (sx == sy).mean(axis=1)
            ok = pa.array(score >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["a", "b", "similarity"]).filter(ok)

    return pairs.mapInArrow(run, "a long, b long, similarity double")


def edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, centres: int = CENTRES) -> DataFrame:
    """Verified star edges (a, b, similarity), the estimate being the share of equal signature bins."""
    sigs = cut(signatures(docs, id_col, text_col, bands, rows, shingle), "signatures")
    same = sigs.groupBy(F.xxhash64("sig").alias("h1"), F.hash("sig").alias("h2")).agg(F.min("_id").alias("rep"))
    tagged = sigs.select("_id", F.xxhash64("sig").alias("g1"), F.hash("sig").alias("g2")).join(same, (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2")))
    exact = tagged.where("_id <> rep").select(F.col("rep").alias("a"), F.col("_id").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    lead = same.select(F.col("rep").alias("_id"), "h1", "h2")  # an id may stand for several signatures, if its rows have several texts
    reps = cut(sigs.select("_id", "sig", F.xxhash64("sig").alias("h1"), F.hash("sig").alias("h2")).join(lead, ["_id", "h1", "h2"], "left_semi").dropDuplicates(["_id", "h1", "h2"]).select("_id", "sig"), "representatives")
    keyed = _buckets(reps, bands, rows, centres)
    best = keyed.groupBy("key").agg(F.min(F.struct("rank", "_id")).alias("c"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), F.col("c._id").alias("centre"))
    star = keyed.join(best, F.col("key") == F.col("k")).where("_id <> centre").select(F.least("_id", "centre").alias("a"), F.greatest("_id", "centre").alias("b")).distinct()
    left = star.join(reps.select(F.col("_id").alias("a"), F.col("sig").alias("sa")), "a")
    pairs = left.join(reps.select(F.col("_id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    out = cut(_agreement(pairs, threshold).unionAll(exact), "verified")
    drop(sigs)
    drop(reps)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, duplicate_of): every document that is a near copy, with the least id of its group.

    Ids are integers.  Null, empty and word-free texts are in no group; rows with a null id are in
    none.  Rows that repeat an id are one document, linked to all that any of its texts is near.  A group is the transitive closure of verified edges,
    its survivor the least id, so ties can't arise.  Long texts are used whole.  An empty
    table gives no rows; other columns are never looked at.
    """
    found = edges(docs, id_col, text_col, **settings)
    groups = components(found, "a", "b")
    return groups.where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without the near copies; all columns, under whatever names, and all other rows (null ids,
    null and empty texts) stay.  Of an id that repeats all rows stay or go."""
    gone = near_duplicates(docs, id_col, text_col, **settings).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
