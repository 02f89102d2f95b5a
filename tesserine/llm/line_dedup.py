"""Line deduplication by an exact set-similarity self-join.

A line is the set of its words.  A line is removed when an earlier one (by document id, then
line number) has a Jaccard similarity of at least ``threshold`` with it.

1. Rarity.  Lines per token are counted over all documents into a table of fixed size, one
   cell per hash class, which every worker gets.  Tokens are ordered by cell count, ties by
   hash: one total order for the whole corpus, rarest first.  The result doesn't depend on
   the order, only the number of candidates does, so the table need not grow with the data.
2. Prefixes.  Two sets at or above the threshold share a token among the first
   ``n - ceil(t n) + 1`` of each.  Those tokens go, with the line's place, to the token's
   bucket; a token that the table knows to be in one line only is left out.  Equal sets
   collapse within a task first, so a line that is everywhere reaches its buckets once a task.
3. Filters.  In a bucket, equal sets give removals at once.  Others must pass the length
   filter, the positional filter (tokens left after the shared one) and a bound on the symmetric
   difference from bitmaps of 128 bits (each unlike token flips one bit); all three are exact.
4. Verification.  A line needs one proof, so its likeliest partner (nearest by the bitmaps,
   then the earliest) is tried first and the others only if that fails.  The lines of all
   pairs are fetched from the texts once, as token sets, and the Jaccard index of both computed;
   texts themselves never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from ._store import cut, drop, text_rows

THRESHOLD = Fraction(4, 5)
CELLS, SLICES = 1 << 22, 64
POSTINGS_PER_BUCKET, FLUSH = 700_000, 1_000_000
_ONCE = 8  # level of a cell that counted one line
MOST_MARKS = 27  # log2 of the bits of the bitmap of wanted lines: 16 MB at most


def line_sets(col):
    """Yields (row, line, first, tokens) for slices of a text column: the lines that have a word,
    their row and number, and the sorted distinct tokens of line i at first[i]:first[i + 1]."""
    data, offsets = V.buffers(col)
    for w in V.words(col):
        if not len(w.hash):
            continue
        raw = data[offsets[w.lo] : offsets[w.hi]]
        ends = np.flatnonzero(raw == 10)
        at = np.searchsorted(ends, w.start)
        order = np.lexsort((w.hash, at + w.row))
        h, g, r, at = w.hash[order], (at + w.row)[order], w.row[order], at[order]
        fresh = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])]
        h, g, r, at = h[fresh], g[fresh], r[fresh], at[fresh]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        row = r[first]
        line = at[first] - np.searchsorted(ends, w.bounds[row])
        yield w.lo + row, line, np.r_[first, len(h)], h


def cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> V.U64(42)).astype(np.int64)


def _count(rows: DataFrame) -> tuple[np.ndarray, int]:
    """(level of each cell, tokens in all).  Level 8 * log2(1 + lines), so 8 is exactly one line."""
    part = CELLS // SLICES

    def tally(batches):
        n, held = np.zeros(CELLS, np.int64), []
        for b in batches:
            for _, _, _, tokens in line_sets(b.column(1)):
                held.append(cell(tokens))
                if sum(map(len, held)) > CELLS:
                    n += np.bincount(np.concatenate(held), minlength=CELLS)
                    held.clear()
        if held:
            n += np.bincount(np.concatenate(held), minlength=CELLS)
        pack = zstandard.ZstdCompressor(level=1)
        for s in range(SLICES):
            own = n[s * part : (s + 1) * part]
            if own.any():
                big = np.flatnonzero(own >= 255)
                blob = np.minimum(own, 255).astype(np.uint8).tobytes() + np.stack([big, own[big]]).astype(np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pack.compress(blob)], pa.binary())], ["slice", "blob"])

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(part, np.int64)
        for b in batches:
            for blob in b.column("blob").to_pylist():
                raw = zstandard.ZstdDecompressor().decompress(blob)
                own = np.frombuffer(raw[:part], np.uint8).astype(np.int64)
                at, v = np.frombuffer(raw[part:], np.int64).reshape(2, -1)
                own[at] = v
                n += own
        level = np.minimum(255, np.floor(8 * np.log2(1 + n))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([int(n.sum())], pa.int64())], ["slice", "level", "tokens"])

    got = rows.mapInArrow(tally, "slice int, blob binary").groupBy("slice").applyInArrow(total, "slice int, level binary, tokens long").collect()
    levels, tokens = np.zeros(CELLS, np.uint8), 0
    for r in got:
        levels[r.slice * part : (r.slice + 1) * part] = np.frombuffer(r.level, np.uint8)
        tokens += r.tokens
    return levels, tokens


_FIELDS = (("token", np.uint64), ("set", np.uint64), ("bits", np.uint64), ("more", np.uint64), ("doc", np.int64), ("line", np.int32), ("size", np.int32), ("pos", np.int32))


def prefixes(ids: np.ndarray, col, levels: np.ndarray, t: Fraction) -> dict[str, np.ndarray]:
    """Postings of a batch: one for each prefix token of each line."""
    out: dict[str, list[np.ndarray]] = {k: [] for k, _ in _FIELDS}
    for row, line, first, tokens in line_sets(col):
        size = np.diff(first)
        owner = np.repeat(np.arange(len(size)), size)
        level = levels[cell(tokens)]
        mixed = V.mix(tokens ^ V.U64(0x5851F42D4C957F2D))
        sets = np.add.reduceat(mixed, first[:-1])
        # a bitmap of 128 bits in two words: each unlike token of two sets flips one bit of one of them
        flip, high = V.U64(1) << (mixed >> V.U64(58)), (mixed >> V.U64(57)) & V.U64(1)
        bits = np.bitwise_xor.reduceat(flip * (V.U64(1) - high), first[:-1])
        more = np.bitwise_xor.reduceat(flip * high, first[:-1])
        order = np.lexsort((tokens, level, owner))
        pos = np.arange(len(tokens)) - first[owner]
        length = size - (t.numerator * size + t.denominator - 1) // t.denominator + 1
        use = (pos < length[owner]) & (level[order] != _ONCE)
        o = owner[use]
        for k, v in (("token", tokens[order][use]), ("set", sets[o]), ("bits", bits[o]), ("more", more[o]), ("doc", ids[row[o]]), ("line", line[o]), ("size", size[o]), ("pos", pos[use])):
            out[k].append(v)
    return {k: np.concatenate(out[k]).astype(d) if out[k] else np.zeros(0, d) for k, d in _FIELDS}


def _collapse(p: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Postings sorted by token and set, only the earliest line of each; (doc, line) of the others."""
    order = np.lexsort((p["line"], p["doc"], p["set"], p["token"]))
    p = {k: v[order] for k, v in p.items()}
    n = len(order)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (p["token"][1:] != p["token"][:-1]) | (p["set"][1:] != p["set"][:-1]) | (p["size"][1:] != p["size"][:-1])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    # equal sets share all postings: told once, where they share the first one
    gone = ~fresh & (p["pos"] == 0) & ((p["doc"] != p["doc"][head]) | (p["line"] != p["line"][head]))
    pairs = np.unique(np.stack([p["doc"][gone], p["line"][gone].astype(np.int64)]), axis=1) if gone.any() else np.zeros((2, 0), np.int64)
    return {k: v[fresh] for k, v in p.items()}, pairs[0], pairs[1]


def _pack(p: dict[str, np.ndarray], fields=_FIELDS) -> bytes:
    """Columns as planes of bytes, compressed: high bytes hardly differ and go for nothing."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(p[k], dtype=d).view(np.uint8).reshape(-1, np.dtype(d).itemsize).T).tobytes() for k, d in fields]
    return zstandard.ZstdCompressor(level=1).compress(len(p[fields[0][0]]).to_bytes(8, "little") + b"".join(planes))


def _unpack(blob: bytes, fields=_FIELDS) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, {}
    for k, d in fields:
        size = np.dtype(d).itemsize
        out[k] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(d).ravel()
        at += n * size
    return out


_PLACE = (("doc", np.int64), ("line", np.int32))
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _popcount(x: np.ndarray) -> np.ndarray:
    return sum(_POP[((x >> V.U64(s)) & V.U64(0xFFFF)).astype(np.int64)].astype(np.int64) for s in (0, 16, 32, 48))


def candidates(p: dict[str, np.ndarray], t: Fraction, limit: int = 1 << 19):
    """Index pairs of collapsed postings that share a token and pass length, position and bitmaps, and
    how far apart the bitmaps are, in thousandths of both sizes."""
    n = len(p["token"])
    order = np.lexsort((p["size"], p["token"]))
    token, size = p["token"][order], p["size"][order].astype(np.int64)
    run = np.cumsum(np.r_[True, token[1:] != token[:-1]]) if n else np.zeros(0, np.int64)
    # sizes ascend in a run: partners of i are those after it up to size[i] / t
    reach = np.searchsorted(run * (1 << 32) + size, run * (1 << 32) + size * t.denominator // t.numerator, side="right")
    count = reach - np.arange(n) - 1
    total, lo = np.cumsum(count), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, side="right")))
        i = np.repeat(np.arange(lo, hi), count[lo:hi])
        base = total[lo - 1] if lo else 0
        j = i + 1 + np.arange(len(i)) - np.repeat(total[lo:hi] - count[lo:hi] - base, count[lo:hi])
        a, b = order[i], order[j]
        both = p["size"][a].astype(np.int64) + p["size"][b]
        need = -(-t.numerator * both // (t.numerator + t.denominator))
        most = 1 + np.minimum(p["size"][a] - p["pos"][a], p["size"][b] - p["pos"][b]) - 1
        ok = np.flatnonzero(most >= need)
        a, b, both, need = a[ok], b[ok], both[ok], need[ok]
        apart = _popcount(p["bits"][a] ^ p["bits"][b]) + _popcount(p["more"][a] ^ p["more"][b])
        ok = (apart <= both - 2 * need) & ((p["set"][a] != p["set"][b]) | (p["size"][a] != p["size"][b]))
        yield a[ok], b[ok], (1000 * apart[ok] // both[ok]).astype(np.int32)
        lo = hi


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, line_no) of every line that an earlier line matches; lines count from 0 and end at
    a line feed.

    Ids are integers.  Words are runs of ASCII letters and digits and of non-ASCII characters, ASCII case folded.
    Lines without a word (blank ones, rules) match nothing.  Null texts have no lines.  Rows
    with a null id can't be ordered and are left alone.  Rows that repeat an id are one
    document, a line of it never matching itself; should their texts differ, the least token
    set of a line (as packed hashes) stands for it in verification.  Lines and texts of any length are used
    whole; an empty table gives no rows; other columns are never looked at.
    """
    spark = docs.sparkSession
    t = Fraction(threshold)
    rows = text_rows(docs, id_col, text_col).where("_id is not null and _text is not null")
    levels, tokens = _count(rows)
    sent = spark.sparkContext.broadcast(levels)
    many = int(max(12, tokens // POSTINGS_PER_BUCKET))

    def post(batches):
        held: list[dict[str, np.ndarray]] = []

        def out():
            p, doc, line = _collapse({k: np.concatenate([h[k] for h in held]) for k, _ in _FIELDS})
            held.clear()
            where = (V.mix(p["token"]) % V.U64(many)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(many + 1))
            for k in range(many):
                at = order[cuts[k] : cuts[k + 1]]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack({f: v[at] for f, v in p.items()})], pa.binary()), pa.array([False])], ["bucket", "blob", "gone"])
            if len(doc):  # settled here: any bucket passes them on
                blob = _pack({"doc": doc, "line": line.astype(np.int32)}, _PLACE)
                yield pa.RecordBatch.from_arrays([pa.array([int(doc[0] % many)], pa.int32()), pa.array([blob], pa.binary()), pa.array([True])], ["bucket", "blob", "gone"])

        for b in batches:
            if b.num_rows:
                held.append(prefixes(np.asarray(b.column(0)), b.column(1), sent.value, t))
                if sum(len(h["token"]) for h in held) >= FLUSH:
                    yield from out()
        if held:
            yield from out()

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, names = [], ["doc", "line", "odoc", "oline", "apart"]
        for b in batches:
            for blob, gone in zip(b.column("blob").to_pylist(), b.column("gone").to_pylist()):
                if gone:
                    p = _unpack(blob, _PLACE)
                    yield pa.RecordBatch.from_arrays([pa.array(p["doc"]), pa.array(p["line"]), pa.nulls(len(p["doc"]), pa.int64()), *[pa.nulls(len(p["doc"]), pa.int32())] * 2], names)
                else:
                    parts.append(_unpack(blob))
        if not parts:
            return
        p, doc, line = _collapse({k: np.concatenate([x[k] for x in parts]) for k, _ in _FIELDS})
        parts.clear()
        if len(doc):
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(line.astype(np.int32)), pa.nulls(len(doc), pa.int64()), *[pa.nulls(len(doc), pa.int32())] * 2], names)
        for a, b, apart in candidates(p, t):
            later = (p["doc"][a] > p["doc"][b]) | ((p["doc"][a] == p["doc"][b]) & (p["line"][a] > p["line"][b]))
            y, x = np.where(later, a, b), np.where(later, b, a)
            yield pa.RecordBatch.from_arrays([pa.array(p["doc"][y]), pa.array(p["line"][y]), pa.array(p["doc"][x]), pa.array(p["line"][x]), pa.array(apart)], names)

    found = rows.mapInArrow(post, "bucket int, blob binary, gone boolean").groupBy("bucket").applyInArrow(meet, "doc long, line int, odoc long, oline int, apart int")
    met = cut(found.groupBy("doc", "line", "odoc", "oline").agg(F.min("apart").alias("apart")), "candidates")
    gone = met.where("odoc is null").select("doc", "line")
    # a line known to go needs no further proof, and one proof is enough: the likeliest partner is tried first
    pairs = cut(met.where("odoc is not null").join(gone, ["doc", "line"], "left_anti"), "pairs")
    lines = cut(_wanted(rows, pairs), "lines")
    best = cut(pairs.groupBy("doc", "line").agg(F.min(F.struct("apart", "odoc", "oline")).alias("b")).select("doc", "line", "b.odoc", "b.oline"), "best")
    first = cut(_proven(best, lines, t), "proven")
    open_ = best.join(first, ["doc", "line"], "left_anti").select("doc", "line", F.col("odoc").alias("tdoc"), F.col("oline").alias("tline"))
    rest = pairs.join(open_, ["doc", "line"]).where("odoc <> tdoc or oline <> tline").select("doc", "line", "odoc", "oline")
    every = gone.unionAll(first).unionAll(_proven(rest, lines, t))
    out = cut(every.distinct().select(F.col("doc").alias("doc_id"), F.col("line").cast("long").alias("line_no")), "removed")
    for x in (met, pairs, lines, best, first):
        drop(x)
    return out


def _spot(doc: np.ndarray, line: np.ndarray, bits: int) -> np.ndarray:
    """Place of a line in a bitmap of 2**bits."""
    return (V.mix(V.mix(doc.astype(np.uint64)) + line.astype(np.uint64)) >> V.U64(64 - bits)).astype(np.int64)


def _wanted(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, line, tokens) of the lines in ``pairs``: the sorted tokens of each as packed hashes.

    The wanted lines are marked in a bitmap that every task gets (16 bits a line, of
    ``MOST_MARKS`` at most), so that of a text only these lines, and a few others by chance,
    leave the task that reads it.
    """
    bits = int(np.clip(np.ceil(np.log2(32 * (pairs.count() + 1))), 15, MOST_MARKS))

    def spots(batches):
        for b in batches:
            for doc, line in ((0, 1), (2, 3)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_spot(np.asarray(b.column(doc)), np.asarray(b.column(line)), bits)))], ["at"])

    at = pairs.select("doc", "line", "odoc", "oline").mapInArrow(spots, "at long")
    marks = np.zeros(1 << (bits - 3), np.uint8)
    for r in at.groupBy(F.floor(F.col("at") / 32768).cast("int").alias("slot")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("marks")).toLocalIterator():
        marks[r.slot * 4096 : r.slot * 4096 + 4096] = np.frombuffer(r.marks, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(marks)

    def fetch(batches):
        for b in batches:
            ids, table = np.asarray(b.column(0)), sent.value
            for row, line, first, tokens in line_sets(b.column(1)):
                at = _spot(ids[row], line, bits)
                own = np.flatnonzero((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                if len(own):
                    size = np.diff(first)[own]
                    take = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    packed = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.r_[0, 8 * np.cumsum(size)].astype(np.int32)), pa.py_buffer(tokens[take].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row[own]]), pa.array(line[own].astype(np.int32)), packed], ["doc", "line", "tokens"])

    return rows.mapInArrow(fetch, "doc long, line int, tokens binary").groupBy("doc", "line").agg(F.min("tokens").alias("tokens"))


def _proven(pairs: DataFrame, lines: DataFrame, t: Fraction) -> DataFrame:
    """(doc, line) of the lines that have a Jaccard index at or above the threshold with one of their partners."""
    theirs = lines.select(F.col("doc").alias("odoc"), F.col("line").alias("oline"), F.col("tokens").alias("other"))
    sides = pairs.join(theirs, ["odoc", "oline"]).select("doc", "line", "other").join(lines, ["doc", "line"])

    def judge(batches):
        for b in batches:
            own, other = (V.buffers(b.column(b.schema.get_field_index(c))) for c in ("tokens", "other"))
            many = [np.diff(off) // 8 for _, off in (own, other)]
            keep = np.zeros(b.num_rows, bool)
            for lo, hi in V.slices(np.r_[0, np.cumsum(many[0] + many[1])], 1 << 20):
                sets = [np.frombuffer(data[off[lo] : off[hi]].tobytes(), np.uint64) for data, off in (own, other)]
                owner = np.concatenate([np.repeat(np.arange(hi - lo), n[lo:hi]) for n in many])
                key = np.concatenate(sets) + V.mix(owner.astype(np.uint64))  # equal for equal tokens of one pair
                order = np.argsort(key)
                key, owner = key[order], owner[order]
                twice = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
                common = np.bincount(owner[1:][twice], minlength=hi - lo)
                keep[lo:hi] = t.denominator * common >= t.numerator * (many[0][lo:hi] + many[1][lo:hi] - common)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("doc", "line")], ["doc", "line"]).filter(pa.array(keep))

    return sides.mapInArrow(judge, "doc long, line int")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length_col: str | None = None, threshold: Fraction = THRESHOLD) -> DataFrame:
    """``docs`` with the removed lines taken out of the text.

    A document that loses lines and keeps no word at all goes (it only repeated others); one
    that had none to begin with, or loses nothing, stays as it is, null id and null text
    included.  All columns stay; ``length_col``, if given, becomes the number of characters
    of a text that lost lines.
    """
    gone = removed_lines(docs, id_col, text_col, threshold=threshold)
    lists = gone.groupBy(F.col("doc_id").alias("_gone_id")).agg(F.collect_set("line_no").alias("_gone"))
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # by place: no name can clash
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    joined = rows.join(lists, F.col(place[id_col]).cast("long") == F.col("_gone_id"), "left").drop("_gone_id")
    text, types = joined.columns.index(place[text_col]), joined.drop("_gone").schema
    length = None if length_col is None else joined.columns.index(place[length_col])
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            new, keep = cols[text].to_pylist(), [True] * b.num_rows
            n = None if length is None else cols[length].to_pylist()
            for i in np.flatnonzero(np.asarray(cols[width].is_valid())).tolist():
                out = set(cols[width][i].as_py())
                new[i] = "\n".join(x for k, x in enumerate(new[i].split("\n")) if k not in out)
                keep[i] = bool(V.ALNUM[np.frombuffer(new[i].encode(), np.uint8)].any())
                if n is not None:
                    n[i] = len(new[i])
            cols[text] = pa.array(new, cols[text].type)
            if length is not None:
                cols[length] = pa.array(n, cols[length].type)
            yield pa.RecordBatch.from_arrays(cols[:width], names=b.schema.names[:width]).filter(pa.array(keep))

    return joined.mapInArrow(run, types).toDF(*docs.columns)
