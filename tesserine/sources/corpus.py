"""Any text table as a corpus of files: one schema for every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(table: DataFrame, path: Column, content: Column, language: Column, seq: Column) -> DataFrame:
    """relative_path, language, size_bytes, content and ``seq``, the walk order that breaks every tie."""
    return table.select(path.alias("relative_path"), language.alias("language"), F.octet_length(content).cast("long").alias("size_bytes"), content.alias("content"), seq.cast("long").alias("seq"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return files(d, path, F.col("text"), F.col("lang"), F.col("doc_id"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return files(d, F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html"), F.lit("html"), F.col("page_id"))
