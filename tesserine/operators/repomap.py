"""The map of a corpus: which symbols matter, how files are linked through them, and in what order to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, tokens
from . import graph, ranking, stats

BUCKETS = ("critical", "high", "normal", "low")


def symbol_index(symbols: DataFrame) -> DataFrame:
    """(name, file): where each name is declared; the last file in walk order has it, then the greatest path."""
    return symbols.where("name is not null").groupBy("name").agg(F.max_by("file", F.struct("seq", "file")).alias("file"))


def _stem(path):
    return F.regexp_replace(path, r"\.[^./]*$", "")


def index_with_paths(symbols: DataFrame) -> DataFrame:
    """``symbol_index`` that also knows every file by its path without the extension."""
    files = symbols.select("file", "seq").distinct().select(_stem(F.col("file")).alias("name"), "file", "seq")
    return symbol_index(symbols.select("name", "file", "seq").unionByName(files))


def import_edges(symbols: DataFrame, index: DataFrame) -> DataFrame:
    """(src, dst): a file that imports a name, and the file that the index gives for it.  One row an import:
    parallel edges count; an import that the index gives back to its own file is no link."""
    used = symbols.where("kind = 'import'").select(F.col("file").alias("src"), "name")
    return used.join(index.select("name", F.col("file").alias("dst")), "name").where("src <> dst").select("src", "dst")


def symbol_ranks(symbols: DataFrame, ranks: DataFrame) -> DataFrame:
    """symbols with the rank of their ``file:name`` key; of a key with several ids, the last has it."""
    keyed = symbols.select("*", F.concat_ws(":", "file", "name").alias("_key"))
    last = keyed.join(ranks, "id").groupBy("_key").agg(F.max_by("rank", "id").alias("rank"))
    return keyed.join(last, "_key", "left").drop("_key")


def top_symbols(ranked: DataFrame, n: int = 50) -> DataFrame:
    """The n symbols of the highest rank with their position from 1; ties by id, null ranks last."""
    best = ranked.orderBy(F.desc_nulls_last("rank"), "id").limit(n)
    return best.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last("rank"), "id")).cast("long"))  # n rows


def blend_file_importance(files: DataFrame, scored: DataFrame) -> DataFrame:
    """files (file, importance) averaged with the mean score of their symbols, where they have any."""
    mean = scored.groupBy("file").agg(F.avg("score").alias("_mean"))
    return files.join(mean, "file", "left").select("file", F.round(F.coalesce((F.col("importance") + F.col("_mean")) / 2, "importance"), 6).alias("importance"))


def file_index(files: DataFrame) -> DataFrame:
    """files (relative_path, importance, seq, content) as the index lists them: bucket after bucket, in walk
    order within, ``position`` from 0."""
    b = paths.bucket(F.col("importance"))
    order = F.array_position(F.array(*map(F.lit, BUCKETS)), b)
    rows = files.select("relative_path", b.alias("bucket"), tokens.count(F.col("content"), "claude").alias("tokens"), order.alias("_bucket"), "seq")
    return ranking.ordinal(rows, F.col("_bucket"), F.col("seq")).select("relative_path", "bucket", "tokens", "position")


def estimate(symbols: int, files: int) -> int:
    """Tokens that a map of so many symbols and files takes."""
    return 25 * symbols + 10 * files + 100


def summary(files: DataFrame, symbols: DataFrame, n: int = 3) -> str:
    """Three lines: what it is, its largest modules, its first symbols."""
    t = stats.totals(files).first()
    lang = stats.primary_language(files).first()[0] or "unknown"
    modules = stats.modules(files).orderBy(F.desc("files"), "module").limit(n).collect()
    names = [r.name for r in symbols.where("kind <> 'import'").orderBy(F.desc_nulls_last("rank") if "rank" in symbols.columns else "relative_path", "name").limit(n).collect()]
    return "\n".join((f"{t.files} files, {t.lines} lines, mostly {lang}", "Modules: " + ", ".join(f"{m.module} ({m.files})" for m in modules), "Key symbols: " + ", ".join(names)))


def ranked_symbols(files: DataFrame, symbols: DataFrame, rounds: int = 20) -> DataFrame:
    """Declared symbols of a corpus with the PageRank of their files in the graph of shared imports, most important first."""
    own = symbols.select(F.col("relative_path").alias("file"), "name", "kind", "signature", "start_line", "end_line", F.xxhash64("relative_path").alias("seq"))
    links = import_edges(own, index_with_paths(own))
    ranks = graph.pagerank(files.select(F.col("relative_path").alias("id")), links, rounds=rounds).withColumnRenamed("id", "file")
    share = own.where("kind <> 'import'").join(ranks, "file", "left")
    return share.select(F.col("file").alias("relative_path"), "name", "kind", "signature", "start_line", "end_line", (F.col("rank") * ranking.kind_weight(F.col("kind"))).alias("rank"))
