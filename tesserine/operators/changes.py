"""Incremental work: what changed, what went, how often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_rescan(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that the cache lacks, or holds with another time or size."""
    c = cache.select(F.col("relative_path").alias("_p"), F.col("mtime").alias("_t"), F.col("size_bytes").alias("_s"))
    joined = listing.join(c, F.col("relative_path") == F.col("_p"), "left")
    return joined.where(F.col("_p").isNull() | ~F.col("mtime").eqNullSafe(F.col("_t")) | ~F.col("size_bytes").eqNullSafe(F.col("_s"))).drop("_p", "_t", "_s")


def deleted(listing: DataFrame, cache: DataFrame) -> DataFrame:
    return cache.join(listing.select("relative_path"), "relative_path", "left_anti")


def merge(cache: DataFrame, scanned: DataFrame, listing: DataFrame) -> DataFrame:
    """The next snapshot: fresh rows, and old ones of files that are still there and weren't scanned."""
    old = cache.join(scanned.select("relative_path"), "relative_path", "left_anti").join(listing.select("relative_path"), "relative_path", "left_semi")
    return old.unionByName(scanned, allowMissingColumns=True)


VERSION = 1


def save(cache: DataFrame, path: str) -> None:
    cache.withColumn("cache_version", F.lit(VERSION)).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    """A saved snapshot; rows of another version are left behind, so their files are scanned anew."""
    return spark.read.parquet(path).where(F.col("cache_version") == VERSION).drop("cache_version")


def frequency(log: DataFrame, days: int, path: str = "path", ts: str = "ts") -> DataFrame:
    """Changes of each path within so many days of the last entry."""
    last = log.agg(F.max(ts).alias("_last"))
    recent = log.crossJoin(F.broadcast(last)).where(F.col(ts) >= F.col("_last") - F.expr(f"INTERVAL {days} DAYS"))  # last: one row
    return recent.groupBy(path).agg(F.count("*").alias("changes"))


class Cache:
    """A snapshot by path that is kept up with a tree: what changed is scanned, what went is dropped."""

    def __init__(self, spark, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self.dirty = False
        self.clear()
        self.dirty = False

    def open(self) -> Cache:
        """With what was saved under the path."""
        self.rows = load(self.spark, self.path)
        return self

    def clear(self) -> None:
        self.rows = self.spark.createDataFrame([], self.schema)
        self.dirty = True

    def update(self, scanned: DataFrame, listing: DataFrame) -> None:
        """Rows of the scan replace those of their paths; paths that the listing lacks go."""
        self.rows = merge(self.rows, scanned, listing)
        self.dirty = True

    def remove(self, gone: DataFrame) -> None:
        self.rows = self.rows.join(gone.select("relative_path"), "relative_path", "left_anti")
        self.dirty = True

    def stale(self, listing: DataFrame) -> DataFrame:
        return to_rescan(listing, self.rows)

    def save(self) -> None:
        """Written beside the old table first: the new rows may still be read from that."""
        if self.dirty:
            save(self.rows, f"{self.path}.next")
            save(load(self.spark, f"{self.path}.next"), self.path)
            self.open()
            self.dirty = False
