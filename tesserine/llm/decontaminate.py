"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared in folded form: ASCII case folded, every run of other bytes than ASCII
letters, digits and multi-byte characters turned into one space.  A benchmark item is cut
into overlapping passages of ``PASSAGE`` bytes every ``STRIDE`` (a shorter item is one passage).  A
passage of length L may occur with ``e = floor(rate * L)`` edits (less where the lemma could say
nothing).  So an unchanged excerpt of an item is found if it has PASSAGE + STRIDE - 1 - e = 74
folded bytes, wherever it begins; a shorter one if it happens to hold all but e bytes of a passage.

* Filter: a copy with at most e edits keeps ``T = L + 1 - q * (e + 1)`` of the passage's
  q-grams, all on diagonals (text position - passage position) at most e apart.  Diagonals
  are counted in blocks of e + 1; two neighbouring blocks form a band, and bands overlap by
  one block, so every copy lies in one.  Bands with T shared q-grams are kept: nothing
  within the edit budget is lost.
* Verify: the passage is aligned with the band's stretch of text by banded dynamic
  programming, free of charge at both ends of the text; at most e edits make a match.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V

Q, RATE, PASSAGE, STRIDE, CHUNK_BYTES = 10, 0.08, 64, 16, 16 << 20
_C = V.U64(0x9FB21C651E98DF25)
_BITS = 21


def fold(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, position of each in ``raw``, bounds of the rows in the folded bytes)."""
    word = V.ALNUM[raw]
    before = np.r_[False, word[:-1]] if len(raw) else word
    if len(raw):
        before[bounds[:-1][bounds[:-1] < len(raw)]] = False
    at = np.flatnonzero(word | before)
    d = V.LOWER[raw[at]]
    d[~word[at]] = 32
    return d, at, np.searchsorted(at, bounds)


def gram_hashes(d: np.ndarray, q: int) -> np.ndarray:
    n = len(d)
    if n < q:
        return np.zeros(0, np.uint64)
    p, inv = V._powers(n + 1)
    s = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((d.astype(np.uint64) + V.U64(1)) * p[:n], out=s[1:])
    return (s[q:] - s[: n - q + 1]) * inv[: n - q + 1] * _C


@dataclass
class Index:
    grams: np.ndarray  # sorted, distinct
    first: np.ndarray  # CSR: places of gram i are first[i]:first[i + 1]
    passage: np.ndarray
    place: np.ndarray
    item: np.ndarray  # by passage
    offset: np.ndarray  # of the passage in its folded item
    text: list[bytes]
    edits: np.ndarray
    need: np.ndarray
    q: int

    def table(self) -> np.ndarray:
        t = np.zeros(1 << _BITS, dtype=bool)
        t[(self.grams >> V.U64(64 - _BITS)).astype(np.int64)] = True
        return t


def build(items: list[tuple[int, str | None]], q: int = Q, rate: float = RATE, passage: int = PASSAGE, stride: int = STRIDE) -> Index | None:
    """Index of the passages.  Items without q folded bytes (null and empty ones too) are too
    short to be told from chance and are left out; None if nothing remains."""
    item, offset, text = [], [], []
    for i, t in sorted(((i, t) for i, t in items if i is not None and t), key=lambda x: (x[0], x[1])):
        raw = np.frombuffer(t.encode(), np.uint8)
        d = fold(raw, np.array([0, len(raw)]))[0].tobytes().rstrip(b" ")
        starts = [0] if len(d) <= passage else [*range(0, len(d) - passage, stride), len(d) - passage]
        for s in starts:
            if len(d[s : s + passage]) >= q:
                item.append(i)
                offset.append(s)
                text.append(d[s : s + passage])
    if not text:
        return None
    length = np.array([len(t) for t in text])
    edits = np.minimum((rate * length).astype(np.int64), (length - q) // q)
    need = length + 1 - q * (edits + 1)
    grams = [gram_hashes(np.frombuffer(t, np.uint8), q) for t in text]
    owner = np.repeat(np.arange(len(text)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams])
    h = np.concatenate(grams)
    order = np.argsort(h, kind="stable")
    g, first = np.unique(h[order], return_index=True)
    return Index(g, np.r_[first, len(h)], owner[order], place[order], np.array(item, np.int64), np.array(offset), text, edits, need, q)


def align(d: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, patterns: list[bytes], edits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Banded alignment of many patterns at once.  Pattern i is sought in ``d[low[i]:high[i]]``
    from diagonal ``at[i]`` over the two blocks of a band, widened by the edits on either
    side; both ends of the text are free.  Returns (distance, start, end): the least
    distance, of these the shortest; a distance above the edits means none."""
    out = [np.empty(len(patterns), np.int64) for _ in range(3)]
    one = np.int64(1 << 12)
    for c in range(0, len(patterns), 2048):
        some = patterns[c : c + 2048]
        e, a = edits[c : c + 2048], at[c : c + 2048]
        length = np.array([len(p) for p in some])
        top, width = int(length.max()), int(4 * e.max() + 3)
        pat = np.zeros((len(some), top), np.uint8)
        for i, p in enumerate(some):
            pat[i, : len(p)] = np.frombuffer(p, np.uint8)
        pos = (a - e)[:, None] + np.arange(top + width)
        inside = (pos >= low[c : c + 2048, None]) & (pos < high[c : c + 2048, None])
        text = np.where(inside, d[np.clip(pos, 0, len(d) - 1)], 0)
        col = np.arange(width) * one
        cur = np.broadcast_to(width - np.arange(width), (len(some), width)).astype(np.int64)
        for i in range(1, top + 1):
            step = cur + np.where(text[:, i - 1 : i - 1 + width] == pat[:, i - 1, None], 0, one)
            step[:, :-1] = np.minimum(step[:, :-1], cur[:, 1:] + one)
            cur = np.minimum.accumulate(step - col, axis=1) + col
            done = np.flatnonzero(length == i)
            if len(done):
                best = cur[done].argmin(axis=1)
                value = cur[done, best]
                out[0][c + done] = value >> 12
                out[1][c + done] = pos[done, 0] + width - (value & (one - 1))
                out[2][c + done] = pos[done, 0] + i + best
    return out[0], out[1], out[2]


def search(col, index: Index, table: np.ndarray):
    """Yields (row, item, distance, start byte, end byte) of the matches in a text column, one for
    each stretch of text and item (overlapping stretches count once: the least distance, then the first)."""
    data, offsets = V.buffers(col)
    q, width = index.q, index.edits + 1
    for lo, hi in V.slices(offsets):
        raw = data[offsets[lo] : offsets[hi]]
        d, at, bounds = fold(raw, offsets[lo : hi + 1] - offsets[lo])
        h = gram_hashes(d, q)
        near = np.flatnonzero(table[(h >> V.U64(64 - _BITS)).astype(np.int64)])
        g = np.minimum(np.searchsorted(index.grams, h[near]), len(index.grams) - 1)
        ok = index.grams[g] == h[near]
        near, g = near[ok], g[ok]
        if not len(near):
            continue
        count = index.first[g + 1] - index.first[g]
        pos = np.repeat(near, count)
        k = np.repeat(index.first[g], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        who = index.passage[k]
        row = np.searchsorted(bounds, pos, side="right") - 1
        block = (pos - index.place[k] + PASSAGE * 4) // width[who]
        key = ((row * len(index.text) + who) << 24) + block
        spot = np.unique(np.stack([key, index.place[k]]), axis=1)  # a q-gram of the passage counts once a block
        u, n = np.unique(spot[0], return_counts=True)
        nxt = np.searchsorted(u, u + 1)
        more = np.where((nxt < len(u)) & (u[np.minimum(nxt, len(u) - 1)] == u + 1), n[np.minimum(nxt, len(u) - 1)], 0)
        prv = np.r_[False, u[1:] == u[:-1] + 1]
        r, w = np.divmod(u >> 24, len(index.text))
        cand = np.flatnonzero((n + more >= index.need[w]) | (~prv & (n >= index.need[w])))
        if not len(cand):
            continue
        row, who = r[cand], w[cand]
        diagonal = (u[cand] & ((1 << 24) - 1)) * width[who] - PASSAGE * 4
        dist, start, end = align(d, bounds[row], bounds[row + 1], diagonal, [index.text[x] for x in who], index.edits[who])
        start, end = np.maximum(start, bounds[row]), np.minimum(end, bounds[row + 1])
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for j in np.flatnonzero(dist <= index.edits[who]):
            found.setdefault((int(row[j]), int(index.item[who[j]])), []).append((int(dist[j]), int(start[j]), int(end[j])))
        for (i, item), hits in sorted(found.items()):
            merged: list[list[int]] = []
            for dist, s, e in sorted(hits, key=lambda v: (v[1], v[2], v[0])):
                if merged and s < merged[-1][2]:
                    merged[-1] = [min(merged[-1][0], dist), merged[-1][1], max(merged[-1][2], e)]
                else:
                    merged.append([dist, s, e])
            base = offsets[lo + i] - offsets[lo]
            for dist, s, e in merged:
                yield lo + i, item, dist, int(at[s] - base), int(at[e - 1] + 1 - base)


def indexes(benchmark: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES, **settings) -> list[Index]:
    """Indexes of the benchmark, each of at most about ``chunk_bytes`` of item text: what is sent
    to the executors at once is bounded, and a larger benchmark takes more passes."""
    out, chunk, size = [], [], 0
    rows = benchmark.select(benchmark[id_col].cast("long").alias("_id"), benchmark[text_col].cast("string").alias("_text")).where("_id is not null and _text is not null").distinct()
    for r in rows.toLocalIterator():
        if chunk and size + len(r._text) > chunk_bytes:
            out.append(build(chunk, **settings))
            chunk, size = [], 0
        chunk.append((r._id, r._text))
        size += len(r._text)
    out.append(build(chunk, **settings))
    return [x for x in out if x is not None]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **settings) -> DataFrame:
    """(doc_id, item_id, distance, start_byte, end_byte) of every benchmark passage found.

    Ids are integers.  Null and empty texts match nothing; a null doc_id is reported as null; repeated rows are
    reported repeatedly; an empty documents or benchmark table gives no rows; further
    columns are never looked at.  Texts are searched whole.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("_text"))
    schema = "doc_id long, item_id long, distance int, start_byte long, end_byte long"
    out = None
    for index in indexes(benchmark, item_col, item_text, **settings):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            index = sent.value
            table = index.table()
            for b in batches:
                got = list(search(b.column(1), index, table))
                if got:
                    r, item, dist, s, e = zip(*got)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(item, pa.int64()), pa.array(dist, pa.int32()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["doc_id", "item_id", "distance", "start_byte", "end_byte"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else rows.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("distance"), F.lit(0).cast("long").alias("start_byte"), F.lit(0).cast("long").alias("end_byte")).where("false")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark passage; every column passes through,
    whatever its name.  Null and empty texts stay; repeated rows stay or go together; texts are
    searched whole; an empty documents or benchmark table takes nothing away."""
    at = docs.columns.index(text_col)
    schema = docs.schema
    for index in indexes(benchmark, item_col, item_text, **settings):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            index = sent.value
            table = index.table()
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[x[0] for x in search(b.column(at), index, table)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
