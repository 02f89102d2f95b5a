"""Hierarchical multi-length packing.

Documents go to the smallest context tier that holds them; those longer than the largest are
cut into pieces of it.  Only ids and lengths move: packing is done in shards of about
``shard_tokens`` tokens, pieces being spread by a hash, equal pieces one by one over all shards.
In a shard, tiers are packed from the longest down:

* best-fit decreasing into windows of the tier's size;
* gaps of the long windows are filled with the longest pieces of the shorter tiers that fit;
* windows of a tier are dealt into step groups of equal token budget, evenly in number and by
  longest processing time on the attention cost (sum of squared lengths).
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import cut

TIERS = (2048, 8192, 32768)
STEP_TOKENS = 4 * 32768
SHARD_TOKENS = 16_000_000
BYTES_PER_TOKEN = 4


def estimated_tokens(text: Column) -> Column:
    """Bytes / 4, rounded up: the length used where the caller has no exact count."""
    return F.ceil(F.octet_length(text) / F.lit(BYTES_PER_TOKEN)).cast("long")


def best_fit(pieces: list[tuple], capacity: int) -> list[list[tuple]]:
    """Best-fit decreasing; ``pieces`` come longest first and are (tokens, ...)."""
    windows: list[list[tuple]] = []
    gaps: list[tuple[int, int]] = []
    for p in pieces:
        at = bisect_left(gaps, (p[0], -1))
        if at < len(gaps):
            gap, w = gaps.pop(at)
        else:
            gap, w = capacity, len(windows)
            windows.append([])
        windows[w].append(p)
        if gap > p[0]:
            insort(gaps, (gap - p[0], w))
    return windows


def fill(windows: list[list[tuple]], capacity: int, shorter: list[tuple]) -> list[tuple]:
    """Put pieces of ``shorter`` (ascending) into the gaps, longest fitting first, widest gap
    first; returns what is left of it."""
    sizes = [p[0] for p in shorter]
    order = sorted(range(len(windows)), key=lambda i: (-(capacity - sum(p[0] for p in windows[i])), i))
    for i in order:
        gap = capacity - sum(p[0] for p in windows[i])
        while sizes and sizes[0] <= gap:
            at = bisect_right(sizes, gap) - 1
            windows[i].append(shorter.pop(at))
            gap -= sizes.pop(at)
    return shorter


def groups(windows: list[list[tuple]], per_step: int) -> list[int]:
    """Step group of each window: sizes differ by one at most, costs are levelled."""
    n = len(windows)
    many = -(-n // per_step)
    room = [n // many + (g < n % many) for g in range(many)]
    heap = [(0, g) for g in range(many)]
    cost = [sum(p[0] ** 2 for p in w) for w in windows]
    out = [0] * n
    for i in sorted(range(n), key=lambda i: (-cost[i], i)):
        c, g = heapq.heappop(heap)
        out[i] = g
        room[g] -= 1
        if room[g]:
            heapq.heappush(heap, (c + cost[i], g))
    return out


def pack_shard(pieces: list[tuple], tiers=TIERS, step_tokens: int = STEP_TOKENS) -> list[tuple]:
    """pieces: (tokens, id, start).  Rows (capacity, step, window, [pieces])."""
    pieces = sorted(pieces, key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2]))
    by = {t: [] for t in tiers}
    for p in pieces:
        by[min(t for t in tiers if t >= p[0])].append(p)
    out = []
    for k in range(len(tiers) - 1, -1, -1):
        t = tiers[k]
        windows = best_fit(by[t], t)
        if k and windows:
            shorter = [p for s in tiers[:k] for p in reversed(by[s])]
            left = fill(windows, t, shorter)
            for s in tiers[:k]:
                by[s] = []
            for p in reversed(left):
                by[min(x for x in tiers if x >= p[0])].append(p)
        if windows:
            step = groups(windows, max(1, step_tokens // t))
            out += [(t, step[i], i, w) for i, w in enumerate(windows)]
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokens: Column | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row a window: shard, capacity, step, window, tokens, and the lists doc_ids, starts and
    lengths (in tokens) of its pieces in order.

    ``tokens`` gives each document's length (bytes / 4 where none is given).  Ids are integers.  Null
    and empty texts have no tokens and are in no window.  A null id is packed and listed as null.
    Repeated rows are packed each for itself, spread over the shards.  Ties are broken by id and start.  An empty
    table gives no rows; other columns are never looked at.
    """
    tiers = tuple(sorted(tiers))
    length = estimated_tokens(docs[text_col]) if tokens is None else tokens.cast("long")
    sized = cut(docs.select(docs[id_col].cast("long").alias("_id"), length.alias("_n")).where("_n > 0"), "lengths")
    total = sized.agg(F.sum("_n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    top = F.lit(tiers[-1]).cast("long")
    pieces = sized.select("_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / top).cast("long"))).alias("_p"))
    # rows that nothing tells apart (repeated ones, null ids of one length) are counted before they move, and dealt evenly to the shards
    alike = pieces.groupBy("_id", "_n", "_p").agg(F.count("*").alias("_c"))
    spread = alike.select("*", F.least("_c", F.lit(shards).cast("long")).alias("_m")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("_k"))
    pieces = spread.select(
        F.pmod(F.xxhash64("_id", "_n", "_p") + F.col("_k"), F.lit(shards)).cast("int").alias("shard"), "_id", (F.col("_p") * top).alias("_start"), F.least(top, F.col("_n") - F.col("_p") * top).alias("_tokens"),
        (F.floor(F.col("_c") / F.col("_m")) + F.when(F.col("_k") < F.col("_c") % F.col("_m"), 1).otherwise(0)).cast("long").alias("_copies"),
    )
    schema = "shard int, capacity int, step int, window int, tokens long, doc_ids array<long>, starts array<long>, lengths array<long>"

    def run(key, table):
        rows = zip(table["_tokens"].to_pylist(), table["_id"].to_pylist(), table["_start"].to_pylist(), table["_copies"].to_pylist())
        got = pack_shard([p[:3] for p in rows for _ in range(p[3])], tiers, step_tokens)
        n, big = len(got), pa.list_(pa.int64())
        return pa.Table.from_arrays(
            [
                pa.array([key[0].as_py()] * n, pa.int32()), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32()),
                pa.array([sum(p[0] for p in g[3]) for g in got], pa.int64()), pa.array([[p[1] for p in g[3]] for g in got], big), pa.array([[p[2] for p in g[3]] for g in got], big), pa.array([[p[0] for p in g[3]] for g in got], big),
            ],
            names=["shard", "capacity", "step", "window", "tokens", "doc_ids", "starts", "lengths"],
        )

    return pieces.groupBy("shard").applyInArrow(run, schema)
