"""Totals and breakdowns of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text, tokens


def totals(files: DataFrame, variant: str = "scan") -> DataFrame:
    """One row: files, lines and tokens of every model."""
    rows = files.select(text.line_count(F.col("content"), F.col("size_bytes")).alias("n"), tokens.count_all(F.col("content"), variant).alias("t"))
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), *(F.coalesce(F.sum(f"t.{m}"), F.lit(0)).alias(m) for m in tokens.MODELS))


def by_language(files: DataFrame) -> DataFrame:
    """Files, tokens and the share of all files of each known language; the unknown count in the denominator only."""
    one = files.groupBy("language").agg(F.count("*").alias("files"), F.sum(tokens.count(F.col("content"), "claude")).alias("claude_tokens"))
    total = one.agg(F.sum("files").alias("total"))
    return one.crossJoin(F.broadcast(total)).where("language is not null").select("language", "files", "claude_tokens", F.round(F.col("files") * 100.0 / F.col("total"), 6).alias("percentage"))  # total: one row


def primary_language(files: DataFrame) -> DataFrame:
    """The language of most files, the first by name on a tie."""
    one = files.where("language is not null").groupBy("language").agg(F.count("*").alias("files"))
    return one.agg(F.min_by("language", F.struct(-F.col("files"), F.col("language"))).alias("language"))


def modules(files: DataFrame) -> DataFrame:
    """Files and tokens of each first path component."""
    return files.groupBy(paths.module(F.col("relative_path")).alias("module")).agg(F.count("*").alias("files"), F.sum(tokens.count(F.col("content"), "claude")).alias("claude_tokens"))
