"""Chunks of a corpus under a token budget.

A chunk depends on all before it in its group, so a group is folded in order by one task;
groups are folded in parallel.  A corpus is one group only if the caller says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed(files: DataFrame, group: str, order: str, tokens: str, size: int) -> DataFrame:
    """(group, order, chunk), chunks from 0: files in order, a new chunk where the next would pass ``size``; a larger
    file stands alone.  A null count is 0.  Groups are folded as sorted partitions stream by, none is held."""
    rows = files.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(tokens).cast("long").alias("t")).repartition("g").sortWithinPartitions("g", "o")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, total = object(), -1, 0
        for b in batches:
            at = []
            for g, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                t = t or 0
                if g != now:
                    now, chunk, total = g, 0, t
                elif total + t > size:
                    chunk, total = chunk + 1, t
                else:
                    total += t
                at.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int64())], ["g", "o", "chunk"])

    kinds = {c: files.schema[c].dataType.simpleString() for c in (group, order)}
    folded = rows.mapInArrow(fold, f"g {kinds[group]}, o {kinds[order]}, chunk long")
    return folded.select(F.col("g").alias(group), F.col("o").alias(order), "chunk")


def per_file(files: DataFrame, group: str, order: str) -> DataFrame:
    return files.withColumn("chunk", (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).cast("long"))


def by_module(files: DataFrame, module: Column, tokens: str) -> DataFrame:
    """One chunk a module, in the order of their names."""
    one = files.groupBy(module.alias("module")).agg(F.count("*").alias("files"), F.sum(tokens).alias("tokens"))
    return one.withColumn("chunk", (F.row_number().over(Window.orderBy("module")) - 1).cast("long"))  # a row a module


def semantic(files: DataFrame, group: str, path: str, module: Column, tokens: str, *, most: int, overlap: int = 200) -> DataFrame:
    """(group, chunk, path): sorted by path; a split where ``most`` would be passed, or at a change of
    module past half of it; the last file goes on into the next chunk if it is shorter than ``overlap``."""
    rows = files.select(F.col(group).alias("g"), F.col(path).alias("p"), module.alias("m"), F.col(tokens).cast("long").alias("t")).repartition("g").sortWithinPartitions("g", "p")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, chunk, last, now = [], 0, 0, None, object()
        for b in batches:
            out = []
            for g, p, m, t in zip(*(c.to_pylist() for c in b.columns)):
                if g != now:
                    held, size, chunk, last, now = [], 0, 0, None, g
                if held and (size + t > most or (m != last and size > most // 2)):
                    chunk += 1
                    held = held[-1:] if held[-1][1] < overlap else []
                    size = sum(x for _, x in held)
                    out += [(g, chunk, x) for x, _ in held]
                held.append((p, t))
                size += t
                last = m
                out.append((g, chunk, p))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.schema.field(0).type), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], ["grp", "chunk", "path"])

    kind = files.schema[group].dataType.simpleString()
    return rows.mapInArrow(fold, f"grp {kind}, chunk long, path string").withColumnRenamed("grp", group)


def dependency(files: DataFrame, group: str, path: str, module: Column, tokens: str, *, most: int, overlap: int = 200) -> DataFrame:
    """Chunks of files that depend on each other: files of a module stand together, as in ``semantic``."""
    return semantic(files, group, path, module, tokens, most=most, overlap=overlap)


def context(chunks: DataFrame, group: str, order: str, focus: str) -> DataFrame:
    """Chunks with their number in all and the labels of their neighbours."""
    w = Window.partitionBy(group).orderBy(order)
    total = F.count("*").over(Window.partitionBy(group))
    before, after = F.lag(focus).over(w), F.lead(order).over(w)
    return chunks.select("*", total.alias("total"), F.when(before.isNotNull(), F.concat(F.lit("Previous: "), before)).alias("previous"), F.when(after.isNotNull(), F.concat(F.lit("Next: Chunk "), (after + 1).cast("string"))).alias("next"))


def focus(module: Column, language: Column, paths: Column) -> Column:
    """Label of an aggregated chunk."""
    first = F.min_by(module, paths)
    return F.when(F.bool_and(paths.isNotNull()) & (F.count_distinct(module) == 1), F.concat(first, F.lit(" module"))).when(F.count_distinct(language) == 1, F.concat(F.min(language), F.lit(" files"))).otherwise("Mixed content")


def line_windows(files: DataFrame, size: int) -> DataFrame:
    """(relative_path, chunk, offset, text): windows of at most ``size`` bytes, cut at the last line feed in
    reach; a longer line is cut at a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw, at, n = (t or "").encode(), 0, 0
                while at < len(raw):
                    end = min(len(raw), at + size)
                    if end < len(raw):
                        cut = raw.rfind(b"\n", at, end) + 1
                        while not cut and end > at + 1 and raw[end] & 0xC0 == 0x80:
                            end -= 1
                        end = cut or end
                    rows.append((p, n, at, raw[at:end].decode(errors="replace")))
                    at, n = end, n + 1
            if rows:
                p, n, o, t = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(n, pa.int64()), pa.array(o, pa.int64()), pa.array(t, pa.string())], ["relative_path", "chunk", "offset", "text"])

    return files.select("relative_path", "content").mapInArrow(run, "relative_path string, chunk long, offset long, text string")


MARKERS = ("\n</file>", "\n```\n", "\n\n", "\n")
NOTICE = "\n\n[Output truncated to fit the token budget]\n"


def fit_budget(document: str, tokens: int, ratio: float = 4.0) -> str:
    """A rendered document cut to the budget, at a marker past its half if there is one."""
    raw = document.encode()
    if len(raw) / ratio <= tokens:
        return document
    text = raw[: int(tokens * ratio * 0.95)].decode(errors="ignore")
    at = next((p + len(m) for m in MARKERS if (p := text.rfind(m)) > len(text) // 2), len(text))
    return text[:at] + NOTICE
