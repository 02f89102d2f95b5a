"""Substring deduplication by super-k-mer partitioning.

A window is ``k`` consecutive words (runs of ASCII letters and digits and of non-ASCII
characters, ASCII case folded).  A window is repeated when the same ``k`` words stand at two
or more places of the corpus.

1. The minimiser of a window is the least hash among its ``m``-word grams.  Consecutive
   windows with one minimiser are a super-k-mer: it travels as one string, the words joined by
   single spaces, to the bucket that its minimiser names.  Equal windows have equal
   minimisers, so they meet.
2. A task packs its super-k-mers by bucket and compresses each pack.  Equal super-k-mers
   of a pack travel once, with the places (document, word) of all: text that is everywhere
   reaches its bucket once a task, and is counted in full.
3. A bucket sorts the windows of its strings by hash and compares equal ones word by word (by
   the 64-bit hashes of their words), so a collision of window hashes does no harm.
4. Places of repeated windows merge to spans, in Spark SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _vec as V
from ._store import text_rows

K, M = 50, 8
BUCKET_BYTES, FLUSH_BYTES = 12 << 20, 48 << 20


def super_kmers(w: V.Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first word, last word) of the super-k-mers of a slice of rows."""
    none = np.zeros(0, np.int64)
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), none, none
    gram = np.zeros(len(w.hash) - m + 1, dtype=np.uint64)
    for j in range(m):
        gram = gram * V.U64(0xD6E8FEB86659FD93) + w.hash[j : j + len(gram)]
    least = V.window_min(V.mix(gram), k - m + 1)
    inside = w.row[:n] == w.row[k - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), none, none
    fresh = np.r_[True, (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(at)] - 1
    return least[at[first]], at[first], at[last] + k - 1


def joined(w: V.Words) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """The words of a slice, each followed by one space: (bytes, start of each word, its end)."""
    size = w.end - w.start
    start = np.cumsum(size + 1) - size - 1
    edge = np.zeros(len(w.data) + 1, dtype=np.int8)
    edge[w.start] += 1
    edge[w.end] -= 1
    is_word = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    out = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
    place = np.ones(len(out), dtype=bool)
    place[start + size] = False
    out[place] = w.data[is_word]
    return memoryview(out), start, start + size


def _pack(strings: list[bytes], copies: list[int], doc: np.ndarray, word: np.ndarray) -> bytes:
    head = np.array([len(strings), len(doc)], np.int64).tobytes()
    size = np.array([len(s) for s in strings], np.int32).tobytes()
    raw = b"".join([head, size, np.array(copies, np.int32).tobytes(), doc.astype(np.int64).tobytes(), word.astype(np.int32).tobytes(), *strings])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(size of each string, places of each, document and word of the places, bytes of the strings)."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, places = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, []
    for kind, many in ((np.int32, n), (np.int32, n), (np.int64, places), (np.int32, places)):
        out.append(np.frombuffer(raw, kind, many, at))
        at += np.dtype(kind).itemsize * many
    return (*out, np.frombuffer(raw, np.uint8, offset=at))


def _same_windows(words: np.ndarray, at: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Label of each window (sorted by key): equal for windows of equal words, and only for them."""
    label = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[label]
    twin = np.flatnonzero(head != np.arange(len(key)))
    wrong = []
    for i in range(0, len(twin), 1 << 14):
        some = twin[i : i + (1 << 14)]
        step = np.arange(k)
        differ = (words[at[some][:, None] + step] != words[at[head[some]][:, None] + step]).any(axis=1)
        wrong.append(label[some[differ]])
    for run in np.unique(np.concatenate(wrong)) if wrong else ():  # a collision of the hash: told apart by the words
        own: dict[bytes, int] = {}
        for i in np.flatnonzero(label == run):
            label[i] = own.setdefault(words[at[i] : at[i] + k].tobytes(), int(run) if not own else len(label) + int(i))
    return label


def count_windows(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans (document, first word, last word, earliest) of the repeated windows of one bucket's packs."""
    size, copies, doc, word, data = (np.concatenate(x) for x in zip(*parts))
    owner = np.repeat(np.arange(len(size)), copies)
    order = np.lexsort((word, doc, owner))
    owner, doc, word = owner[order], doc[order], word[order].astype(np.int64)
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])]  # a repeated id is one document
    owner, doc, word = owner[fresh], doc[fresh], word[fresh]
    first_place = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    copies = np.diff(np.r_[first_place, len(owner)])

    offsets = np.r_[0, np.cumsum(size.astype(np.int64))]
    kind = pa.large_binary()
    strings = pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    hashes, rows = [], []
    for w in V.words(strings, V.NOSPACE, V.SAME):
        hashes.append(w.hash)
        rows.append(w.row + w.lo)
    h, row = np.concatenate(hashes), np.concatenate(rows)
    at = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
    p, q = V._powers(len(h) + 1)
    s = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * p[: len(h)], out=s[1:])
    key = V.mix((s[at + k] - s[at]) * q[at])
    string = row[at]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    step = at - start[string]
    d, o = doc[first_place[string]], word[first_place[string]] + step
    order = np.lexsort((o, d, key))
    label = _same_windows(h, at[order], key[order], k)
    _, label = np.unique(label, return_inverse=True)
    total = np.zeros(int(label.max()) + 1, np.int64)
    place = d[order], o[order]
    lead = np.full(len(total), len(label), np.int64)
    np.minimum.at(lead, label, np.arange(len(label)))
    # two strings can put the same window at the same place only if they are one row under a repeated id
    other = (place[0] != place[0][lead[label]]) | (place[1] != place[1][lead[label]])
    np.add.at(total, label, np.where(other, copies[string[order]], 0))
    total += copies[string[order[lead]]]
    many, earliest = np.zeros(len(at), bool), np.zeros(len(at), bool)
    many[order] = total[label] > 1
    earliest[order] = ~other

    def spans(use: np.ndarray, flag: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of used windows with one flag within a string: (string, first step, last step, flag)."""
        i = np.flatnonzero(use)
        f = np.zeros(len(i), bool) if flag is None else flag[i]
        new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1] + 1) | (string[i[1:]] != string[i[:-1]]) | (f[1:] != f[:-1])]) if len(i) else i
        end = np.r_[new[1:], len(i)] - 1 if len(i) else i
        return string[i[new]], step[i[new]], step[i[end]], f[new]

    u, a, b, f = spans(many, earliest)
    out = [(doc[first_place[u]], word[first_place[u]] + a, word[first_place[u]] + b + k - 1, f)]
    u, a, b, f = spans(many, None)
    rest = copies[u] - 1
    i = np.repeat(np.arange(len(u)), rest)
    p = first_place[u[i]] + 1 + np.arange(len(i)) - np.repeat(np.cumsum(rest) - rest, rest)
    out.append((doc[p], word[p] + a[i], word[p] + b[i] + k - 1, f[i]))
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = K, m: int = M) -> DataFrame:
    """(doc_id, first_word, last_word, earliest): the stretches of text covered by repeated windows,
    words counted from 0.  ``earliest`` marks those whose windows stand here for the first time by
    document id, then word: a deduplication keeps these and removes the others.

    Ids are integers.  Null and empty texts and those of fewer than ``k`` words have no windows.  Rows with a
    null id can't be named and are left out.  Rows that repeat an id are one document: equal
    words at equal places are one occurrence.  Texts of any length are used whole; an
    empty table gives no rows; other columns are never looked at.
    """
    rows = text_rows(docs, id_col, text_col).where("_id is not null and _text is not null")
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    many = max(12, -(-3 * total // BUCKET_BYTES))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, strings, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            bucket, doc, word = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                at: dict[bytes, list[int]] = {}
                for i in order[lo:hi].tolist():
                    at.setdefault(strings[i], []).append(i)
                place = np.array([i for x in at.values() for i in x])
                blob = _pack(list(at), [len(x) for x in at.values()], doc[place], word[place])
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[order[lo]])], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])
            held.clear()
            strings.clear()

        for b in batches:
            ids = np.asarray(b.column(0))
            for w in V.words(b.column(1)):
                least, first, last = super_kmers(w, k, m)
                if not len(least):
                    continue
                start_of_row = np.searchsorted(w.row, w.row[first])
                text, start, end = joined(w)
                lo, hi = start[first], end[last]
                strings += [text[x:y].tobytes() for x, y in zip(lo.tolist(), hi.tolist())]
                held.append(((V.mix(least) % V.U64(many)).astype(np.int32), ids[w.lo + w.row[first]], (first - start_of_row).astype(np.int32)))
                size += int((hi - lo).sum())
                if size >= FLUSH_BYTES:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(x) for b in batches for x in b.column("blob").to_pylist()]
        doc, first, last, flag = count_windows(parts, k)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(first), pa.array(last), pa.array(flag)], ["doc_id", "first_word", "last_word", "earliest"])

    found = rows.mapInArrow(post, "bucket int, blob binary").groupBy("bucket").applyInArrow(count, "doc_id long, first_word long, last_word long, earliest boolean")
    order = Window.partitionBy("doc_id", "earliest").orderBy("first_word", "last_word")
    before = F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(F.col("first_word") <= before, 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "earliest", "run").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word")).select("doc_id", "first_word", "last_word", "earliest")
