"""Cosine similarity of vectors: to one in the JVM, of all with all as products of blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most rows of a block; rows and columns of one matrix product; pairs whose exact score is taken at a time.
BLOCK, SLICE, TILE, PAIRS = 65536, 512, 4096, 65536
#: Half a unit of the last digit of a score, and what float32 may be off a number near 1, twice over.
HALF, SLACK = 0.5e-5, 4e-7


def cosine(a: Column, b: Column) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    square = lambda x: F.transform(x, lambda v: v.cast("double") * v.cast("double"))
    dot = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return total(dot) / F.sqrt(total(square(a)) * total(square(b)))


def most_similar(vecs: DataFrame, one: DataFrame, k: int, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """The k vectors closest to the single row of ``one``; ties by id."""
    q = one.select(F.col(col).alias("_q"))
    scored = vecs.crossJoin(F.broadcast(q)).select(id_col, F.round(cosine(F.col(col), F.col("_q")), 5).alias("score"))  # one: a single vector
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def _unit(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids in order, unit vectors), without vectors that have a null or no number in them."""
    ids, col = t.column(0).to_numpy(), t.column(1).combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = col.value_lengths().to_numpy()
    if len(ids) and (size != size[0]).any():
        raise ValueError("vectors differ in length")
    v = flat.reshape(len(ids), -1)
    with np.errstate(invalid="ignore"):
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
    order = np.argsort(ids, kind="stable")
    order = order[np.isfinite(v[order]).all(axis=1)]
    return ids[order], v[order]


def _top(row: np.ndarray, near: np.ndarray, score: np.ndarray, k: int, repeated: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, and the place of each among them.  repeated: a row may have a neighbour twice."""
    if repeated:
        order = np.lexsort((-score, near, row))
        row, near, score = row[order], near[order], score[order]
        first = np.r_[True, (row[1:] != row[:-1]) | (near[1:] != near[:-1])]
        row, near, score = row[first], near[first], score[first]
    order = np.lexsort((near, -score, row))
    row, near, score = row[order], near[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], near[keep], score[keep], place[keep]


def nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, score) of the k rows of ``y`` closest to each row of ``x``; both are unit vectors in order of id.

    Products of float32 only tell which pairs may be among the best: those not below a floor by more than
    their error.  These get their score in float64.  The floor is the k-th best so far; a later column,
    whose id is higher, must be better than that.
    """
    off = 1.1 * (x.shape[1] + 8) * 2.0**-24  # of a product of unit vectors in float32, in whatever order it is summed
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    repeated = len(np.unique(others)) < len(others)
    out = []
    for s in range(0, len(ids), SLICE):
        own = ids[s : s + SLICE]
        lo, hi = np.searchsorted(others, own, "left"), np.searchsorted(others, own, "right")
        who = np.repeat(np.arange(len(own)), hi - lo)
        same = np.arange(len(who)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)  # columns of the row's own id
        floor, last = np.full(len(own), -2, np.float32), np.full(len(own), -np.inf)
        row, near, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for c in range(0, len(others), TILE):
            got = x32[s : s + SLICE] @ y32[c : c + TILE].T
            mine = (same >= c) & (same < c + TILE)
            got[who[mine], same[mine] - c] = -np.inf
            if c == 0:
                one = np.maximum.reduceat(got, np.unique(others[:TILE], return_index=True)[1], axis=1) if repeated else got
                if one.shape[1] > k:
                    floor = np.maximum(floor, np.partition(one, -k, axis=1)[:, -k] - np.float32(2 * off + 2 * HALF + SLACK))
            r, j = np.divmod(np.flatnonzero(got >= floor[:, None]), got.shape[1])
            if not len(r):
                continue
            exact = np.round(np.concatenate([np.einsum("ij,ij->i", x[s + r[p : p + PAIRS]], y[c + j[p : p + PAIRS]]) for p in range(0, len(r), PAIRS)]), 5)
            better = exact > last[r]
            row, near, score, place = _top(np.r_[row, r[better]], np.r_[near, others[c + j[better]]], np.r_[score, exact[better]], k, repeated)
            full = place == k - 1
            last[row[full]] = score[full]
            floor[row[full]] = score[full] + (HALF - off - SLACK)
        out.append((own[row], near, score))
    who, near, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if len(np.unique(ids)) < len(ids):
        who, near, score, _ = _top(who, near, score, k, True)
    return who, near, score


def _blocks(rows: int, block: int, cores: int) -> int:
    """Enough that no block is larger than ``block`` and all cores have pairs of blocks to work at, but no more:
    every row moves as often as there are blocks, and is in as many lists of neighbours."""
    return max(1, -(-rows // block), min(math.ceil(4 * math.sqrt(cores)), -(-rows // TILE)))


def all_most_similar(vecs: DataFrame, k: int, id_col: str = "vec_id", col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, neighbour, score): the k vectors closest to each, by score rounded to 5 digits, ties by id.

    Every row is a query.  Null ids, null, empty and zero vectors have no neighbours and are none; rows of
    one id are one vector with the best of their scores.  Ids are cut into blocks, each pair
    of which is a matrix product that keeps k neighbours a query; these are merged at the end.
    """
    kind = vecs.schema[col].dataType.simpleString()
    rows = vecs.select(F.col(id_col).cast("long").alias("_id"), F.col(col).cast(kind if kind == "array<float>" else "array<double>").alias("_v")).where("_id is not null and exists(_v, x -> x <> 0)")
    blocks = _blocks(rows.count(), block, vecs.sparkSession.sparkContext.defaultParallelism)
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("_id"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = rows.select("_id", "_v", F.col("_own").alias("_a"), every.alias("_b"))
    right = rows.select("_id", "_v", every.alias("_a"), F.col("_own").alias("_b"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        found = nearest(*_unit(a), *_unit(b), k) if a.num_rows and b.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table(dict(zip(("_id", "_near", "_score"), found)))

    pairs = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(best, "_id long, _near long, _score double")
    order = Window.partitionBy("_id").orderBy(F.desc("_score"), "_near")
    return pairs.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k).select(F.col("_id").alias(id_col), F.col("_near").alias("neighbour"), F.col("_score").alias("score"))
