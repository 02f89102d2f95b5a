"""Embedding near-duplicates by a forest of random-projection trees.

1. Equal vectors collapse first: one of each goes on.
2. Trees split recursively at the median of a random projection.  Vectors whose projection lies
   within ``spill`` of the median, as a share of the node's rows, go to both sides, so that
   close pairs seldom part, and a child has 0.5 + spill of its parent's rows however dense or wide
   the vectors are.  While nodes are larger than ``node_rows``, a level is a pass over the data:
   quantiles of the projections come from mergeable sketches, a group per node.  Those of the
   first ``SENT_LEVELS`` levels are sent to all tasks, three numbers a node; vectors beyond are
   placed in their nodes, and deeper quantiles are joined to them by node.
   Smaller nodes are one group each, split further in memory down to ``leaf_rows``.
3. In a leaf every vector is compared with every other.  Verified pairs are joined to a
   spanning forest at once, so a leaf of n copies gives n - 1 edges, not n**2.
4. The edges of all trees are united to groups.

The trees go in rounds of ``trees_at_once``, each written as a table of the shared folder,
so that no more than that many copies of the vectors are in a shuffle at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from ._store import cut, drop
from .graph import components

THRESHOLD, TREES, SPILL, LEAF_ROWS, NODE_ROWS, TREES_AT_ONCE, SENT_LEVELS = 0.9, 12, 0.06, 256, 20_000, 4, 13
_EXACT = 10_000  # accuracy of the quantile sketches: a ten-thousandth of a node's rows


def vectors(docs: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, vec): unit vectors as packed float32; nulls, nulls within, non-finite values and zero vectors left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            ok = np.asarray(pc.fill_null(pc.greater(pc.list_value_length(col), 0), False))
            ids, out = [], []
            flat, off = np.asarray(pc.cast(col.values, pa.float32())), np.asarray(col.offsets)
            for i in np.flatnonzero(ok).tolist():
                v = flat[off[i] : off[i + 1]].astype(np.float64)
                norm = np.sqrt(v @ v)
                if np.isfinite(norm) and norm > 0:
                    ids.append(i)
                    out.append((v / norm).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(out, pa.binary())], ["_id", "vec"])

    rows = docs.select(docs[id_col].cast("long").alias("_id"), docs[vector_col].cast("array<float>").alias("_v"))
    return rows.where("_id is not null and _v is not null").mapInArrow(run, "_id long, vec binary")


def direction(tree: int, node: int, dim: int) -> np.ndarray:
    v = np.random.default_rng([tree, node, dim, 77]).standard_normal(dim)
    return v / np.sqrt(v @ v)


def route(x: np.ndarray, tree: int, cuts: dict[tuple[int, int, int], tuple[float, float]]) -> list[tuple[int, np.ndarray]]:
    """(node, rows) of the nodes of one tree without a cut: the root is 1, children of n are 2n and 2n + 1."""
    done, todo = [], [(1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        cut_ = cuts.get((tree, x.shape[1], node))
        if cut_ is None:
            done.append((node, rows))
            continue
        p = project(x[rows], tree, node)
        for child, own in ((2 * node, rows[p <= cut_[1]]), (2 * node + 1, rows[p >= cut_[0]])):
            if len(own):
                todo.append((child, own))
    return done


def project(x: np.ndarray, tree: int, node: int) -> np.ndarray:
    return x.astype(np.float64) @ direction(tree, node, x.shape[1])


def _by_dim(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, matrix): vectors of unlike lengths are never compared."""
    data, off = V.buffers(b.column(column))
    size = np.diff(off)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        at = off[rows][:, None] + np.arange(n)
        yield int(n) // 4, rows, np.ascontiguousarray(data[at]).view(np.float32)


def split_tree(x: np.ndarray, leaf: int, spill: float, seed: list[int]) -> Iterator[np.ndarray]:
    """Leaves (row numbers) of one tree over the rows of ``x``.  A node that four splits can't
    shrink (its projections tie) is a leaf, whatever its size; leaves are compared in blocks."""
    rng, todo = np.random.default_rng(seed), [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            yield rows
            continue
        for _ in range(4):
            p = x[rows].astype(np.float64) @ rng.standard_normal(x.shape[1])
            low, high = np.quantile(p, [0.5 - spill, 0.5 + spill])
            left, right = rows[p <= high], rows[p >= low]
            if max(len(left), len(right)) <= 0.9 * len(rows):
                todo += [left, right]
                break
        else:
            yield rows


def forest_edges(x: np.ndarray, leaves: Iterator[np.ndarray], threshold: float, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs at or above the threshold within the leaves."""
    parent = np.arange(len(x))
    out: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    for rows in leaves:
        y = x[rows]
        for i in range(0, len(rows), block):
            for j in range(i, len(rows), block):
                a, b = np.nonzero(y[i : i + block] @ y[j : j + block].T >= threshold)
                later = b + j > a + i
                a, b = rows[a[later] + i], rows[b[later] + j]
                if len(a) > len(rows):  # only pairs that aren't yet joined
                    flat = np.array([root(int(r)) for r in rows])
                    look = np.empty(len(x), np.int64)
                    look[rows] = flat
                    new = look[a] != look[b]
                    pairs = np.unique(np.stack([look[a[new]], look[b[new]]]), axis=1)
                    a, b = pairs[0], pairs[1]
                for p, q in zip(a.tolist(), b.tolist()):
                    r, s = root(p), root(q)
                    if r != s:
                        parent[max(r, s)] = min(r, s)
                        out.append((p, q))
    e = np.array(out, np.int64).reshape(-1, 2)
    return e[:, 0], e[:, 1]


def _quantiles(projected: DataFrame, spill: float, node_rows: int) -> DataFrame:
    """(tree, dim, node, low, high) of the nodes of more than ``node_rows`` vectors that a cut divides."""
    ends = F.percentile_approx("p", F.array(F.lit(0.5 - spill), F.lit(0.5 + spill)), _EXACT)
    big = projected.groupBy("tree", "dim", "node").agg(F.count("*").alias("total"), ends.alias("q"), F.min("p").alias("least"), F.max("p").alias("most")).where(F.col("total") > node_rows)
    cuts = big.select("tree", "dim", "node", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "least", "most")
    return cuts.where("low > least and high < most").drop("least", "most")  # else one side would have all rows


def _cuts(vecs: DataFrame, trees: range, spill: float, node_rows: int, levels: int) -> dict[tuple[int, int, int], tuple[float, float]]:
    """Cuts of all nodes of more than ``node_rows`` vectors, a level a pass, ``levels`` at most: a number
    of cuts that doesn't grow with the data beyond 2**levels a tree."""
    spark, cuts = vecs.sparkSession, {}
    for level in range(levels):
        sent = spark.sparkContext.broadcast(cuts)

        def tell(batches: Iterator[pa.RecordBatch], level=level, sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for dim, _, x in _by_dim(b, 1):
                    for tree in trees:
                        for node, rows in route(x, tree, sent.value):
                            if node >> level:  # a node of a higher level was left uncut for good
                                n = len(rows)
                                yield pa.RecordBatch.from_arrays([pa.array([v] * n, pa.int64()) for v in (tree, dim, node)] + [pa.array(project(x[rows], tree, node))], ["tree", "dim", "node", "p"])

        fresh = {(r.tree, r.dim, r.node): (r.low, r.high) for r in _quantiles(vecs.mapInArrow(tell, "tree long, dim long, node long, p double"), spill, node_rows).toLocalIterator()}
        sent.unpersist()
        if not fresh:
            break
        cuts = cuts | fresh
    return cuts


def _deeper(placed: DataFrame, spill: float, node_rows: int) -> DataFrame:
    """``placed`` with all nodes cut that can be, a level a pass, quantiles joined by node."""
    schema = "tree long, dim long, node long, _id long, vec binary"

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, tree, dim, node, x in _by_node(b):
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(rows), pa.int64()) for v in (tree, dim, node)] + [pa.array(project(x, tree, node))], ["tree", "dim", "node", "p"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high = (np.asarray(b.column(b.schema.get_field_index(c)).fill_null(float("nan"))) for c in ("low", "high"))
            for rows, tree, dim, node, x in _by_node(b):
                p = project(x, tree, node)
                for child, own in ((node, rows[np.isnan(low[rows])]), (2 * node, rows[p <= high[rows]]), (2 * node + 1, rows[p >= low[rows]])):
                    at = pa.array(own)
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(own), pa.int64()) for v in (tree, dim, child)] + [b.column(b.schema.get_field_index(c)).take(at) for c in ("_id", "vec")], ["tree", "dim", "node", "_id", "vec"])

    now = cut(placed, "placed")
    while True:
        found = cut(_quantiles(now.mapInArrow(tell, "tree long, dim long, node long, p double"), spill, node_rows), "quantiles")
        if not found.head(1):
            drop(found)
            return now
        after = cut(now.join(found, ["tree", "dim", "node"], "left").mapInArrow(split, schema), "placed")
        drop(now)
        drop(found)
        now = after


def _by_node(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, int, int, np.ndarray]]:
    """(rows, tree, dimension, node, matrix) of the nodes in a batch."""
    tree, node = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("tree", "node"))
    for dim, rows, x in _by_dim(b, b.schema.get_field_index("vec")):
        order = np.lexsort((node[rows], tree[rows]))
        t, n = tree[rows][order], node[rows][order]
        starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (n[1:] != n[:-1])])
        for lo, hi in zip(starts, np.r_[starts[1:], len(order)]):
            yield rows[order[lo:hi]], int(t[lo]), dim, int(n[lo]), x[order[lo:hi]]


def edges(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = THRESHOLD, trees: int = TREES, spill: float = SPILL, leaf_rows: int = LEAF_ROWS, node_rows: int = NODE_ROWS, trees_at_once: int = TREES_AT_ONCE, sent_levels: int = SENT_LEVELS) -> DataFrame:
    """Edges (a, b) of near-duplicate vectors that join each group found."""
    spark = docs.sparkSession
    vecs = cut(vectors(docs, id_col, vector_col), "vectors")
    keyed = vecs.select("_id", F.xxhash64("vec").alias("g1"), F.hash("vec").alias("g2"))
    same = vecs.groupBy(F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2")).agg(F.min("_id").alias("rep"), F.min_by("vec", "_id").alias("vec"))
    one = cut(same.select(F.col("rep").alias("_id"), "vec", "h1", "h2"), "distinct-vectors")
    out = cut(keyed.join(one, (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2"))).select(one["_id"].alias("a"), keyed["_id"].alias("b")).where("a <> b"), "equal-vectors")
    drop(vecs)
    parts = [out]
    for t in range(0, trees, trees_at_once):
        own = range(t, min(trees, t + trees_at_once))
        found = _cuts(one, own, spill, node_rows, sent_levels)
        cuts = spark.sparkContext.broadcast(found)

        def place(batches: Iterator[pa.RecordBatch], own=own, cuts=cuts) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for dim, rows, x in _by_dim(b, 1):
                    for tree in own:
                        for node, some in route(x, tree, cuts.value):
                            n, at = len(some), pa.array(rows[some])
                            yield pa.RecordBatch.from_arrays([pa.array([v] * n, pa.int64()) for v in (tree, dim, node)] + [b.column(0).take(at), b.column(1).take(at)], ["tree", "dim", "node", "_id", "vec"])

        def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, dim, node = (k.as_py() for k in key)
            ids, xs = [], []
            for b in batches:
                ids.append(np.asarray(b.column("_id")))
                xs += [x for _, _, x in _by_dim(b, b.schema.get_field_index("vec"))]
            ids, x = np.concatenate(ids), np.concatenate(xs)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            a, b = forest_edges(x, split_tree(x, leaf_rows, spill, [tree, dim, node]), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

        placed = one.select("_id", "vec").mapInArrow(place, "tree long, dim long, node long, _id long, vec binary")
        if any(node >> (sent_levels - 1) for _, _, node in found):  # the last level sent was cut: there may be large nodes below
            placed = _deeper(placed, spill, node_rows)
        parts.append(cut(placed.groupBy("tree", "dim", "node").applyInArrow(compare, "a long, b long"), "forest-edges"))
        drop(placed)
    drop(one)
    for x in parts[1:]:
        out = out.unionAll(x)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **settings) -> DataFrame:
    """(vec_id, duplicate_of): every vector whose cosine similarity links it to others, with the
    least id of its group.

    Ids are integers.  Null vectors, vectors with a null, NaN or infinite entry, empty and zero vectors are in no
    group; rows with a null id are in none.  Vectors of unlike lengths are never compared.
    Rows that repeat an id are one vector.  A group is the transitive closure of verified
    pairs, so ties can't arise.  An empty table gives no rows; other columns are never looked at.
    """
    groups = components(edges(docs, id_col, vector_col, **settings), "a", "b")
    return groups.where("node <> root").select(F.col("node").alias("vec_id"), F.col("root").alias("duplicate_of"))
