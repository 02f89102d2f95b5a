"""Corpora as streams: files that arrive are totalled as they come."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources.repo import snapshot
from ..storage import shared_dir


def _shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, or a folder that gets more files, as a stream of rows."""
    schema = spark.read.parquet(path).schema
    where = path if os.path.isdir(path.removeprefix("file:")) else path[: path.rindex("/") + 1] + "*" + path[path.rindex("/") + 1 :]
    return spark.readStream.schema(schema).parquet(where)


def run(stream: DataFrame, apply, *, trigger: dict | None = None) -> None:
    """Hand every micro-batch to ``apply(batch, id)`` until what is there has been read (or, with a
    ``processingTime`` trigger, for as long as the query runs)."""
    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", _shared(stream.sparkSession)).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()


def language_totals(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of each language, totalled incrementally: every batch appends partial sums
    under its own id (a batch that is repeated replaces them), and the last step adds them up."""
    out = f"{_shared(spark)}/totals"

    def add(batch: DataFrame, i: int) -> None:
        part = batch.groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))
        part.write.mode("overwrite").parquet(f"{out}/batch={i}")

    run(read(spark, path), add)
    return spark.read.schema("language string, files long, bytes long, batch long").parquet(out).groupBy("language").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def events(old: dict[str, tuple[int, int]], new: dict[str, tuple[int, int]]) -> list[tuple[str, str]]:
    """(path, kind) of what happened between two snapshots, by path: created, modified, deleted."""
    out = [(p, "created") for p in new.keys() - old.keys()] + [(p, "deleted") for p in old.keys() - new.keys()]
    return sorted(out + [(p, "modified") for p in old.keys() & new.keys() if tuple(old[p]) != tuple(new[p])])


class EventReader(SimpleDataSourceStreamReader):
    """What a batch brings is the difference of two snapshots; an offset is a snapshot, so a batch can be read again."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"].removeprefix("file://")
        self.all_at_first = options.get("existing", "true") == "true"

    def initialOffset(self) -> dict:
        return {"files": {} if self.all_at_first else {p: list(v) for p, v in snapshot(self.root).items()}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = {"files": {p: list(v) for p, v in snapshot(self.root).items()}}
        return self.readBetweenOffsets(start, now), now

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(events(start["files"], end["files"]))


class EventSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tesserine_events"

    def schema(self) -> str:
        return "path string, kind string"

    def simpleStreamReader(self, schema) -> EventReader:
        return EventReader(dict(self.options))


def event_stream(spark: SparkSession, root: str, *, existing: bool = True) -> DataFrame:
    """Changes of a tree as a stream of (path, kind); what is there at first counts as created if ``existing``."""
    spark.dataSource.register(EventSource)
    return spark.readStream.format("tesserine_events").option("existing", str(existing).lower()).load(root)


def follow(look: Callable[[], dict[str, tuple[int, int]]], act: Callable[[list[tuple[str, str]]], object], *, poll: float = 1.0, quiet: float = 0.5, rounds: int | None = None) -> None:
    """Call ``act`` with the events whenever a tree has changed and then been quiet for a while; nothing that
    happens meanwhile is lost.  ``rounds`` bounds the polls, for tests."""
    seen = look()
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        time.sleep(poll)
        now = look()
        while now != seen:
            time.sleep(quiet)
            settled = look()
            if settled == now:
                act(events(seen, now))
                seen = now
                break
            now = settled
