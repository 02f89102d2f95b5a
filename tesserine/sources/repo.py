"""A source tree as a table: a Python data source that lists on the driver and reads on the executors.

Listing honours ignore files, drops ``.git``, files over the size limit and binary names before
anything is read.  ``metadata`` leaves contents out altogether.  Undecodable files are dropped,
or kept with a null content under the ``binding`` profile.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths
from ..operators.filters import MAX_BYTES

FORMAT = "tesserine_repo"
SCHEMA = "relative_path string, size_bytes long, mtime long, content string"
_PER_TASK = 256


def ignore_rules(text: str, folder: str = "") -> list[tuple[re.Pattern[str], bool, bool]]:
    """(pattern, negated, folders only) for the lines of an ignore file that stands in ``folder``."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        only, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        p, i = "", 0
        while i < len(line):
            if line.startswith("**/", i):
                p, i = p + "(?:.*/)?", i + 3
            elif line.startswith("**", i):
                p, i = p + ".*", i + 2
            elif line[i] == "[" and "]" in line[i + 2 :]:
                end = line.index("]", i + 2)
                p, i = p + "[" + line[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
            else:
                p, i = p + {"*": "[^/]*", "?": "[^/]"}.get(line[i], re.escape(line[i])), i + 1
        base = re.escape(folder + "/") if folder else ""
        out.append((re.compile(f"{base}{'' if anchored else '(?:.*/)?'}{p}$"), negated, only))
    return out


def ignored(path: str, is_dir: bool, rules: list[tuple[re.Pattern[str], bool, bool]]) -> bool:
    """The last rule that fits decides."""
    out = False
    for p, negated, only in rules:
        if (is_dir or not only) and p.match(path):
            out = not negated
    return out


def listing(root: str, max_bytes: int = MAX_BYTES, honour_ignores: bool = True, hidden: bool = True) -> Iterator[tuple[str, int, int]]:
    """(relative path, size, mtime) in the order of the paths; names that begin with a dot only if ``hidden``."""
    def walk(folder: str, rules: list) -> Iterator[tuple[str, int, int]]:
        here = os.path.join(root, folder)
        if honour_ignores:
            for name in (".gitignore", ".ignore"):
                if os.path.isfile(at := os.path.join(here, name)):
                    with open(at, encoding="utf-8", errors="replace") as f:
                        rules = rules + ignore_rules(f.read(), folder)
        for e in sorted(os.scandir(here), key=lambda e: e.name):
            rel = f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink() or (not hidden and e.name.startswith(".")) or ignored(rel, e.is_dir(), rules):
                continue
            if e.is_dir():
                if e.name != ".git":
                    yield from walk(rel, rules)
            elif e.stat().st_size <= max_bytes and os.path.splitext(e.name)[1][1:].lower() not in paths.BINARY:
                yield rel, e.stat().st_size, int(e.stat().st_mtime)

    yield from walk("", [])


@dataclass
class Files(InputPartition):
    rows: list[tuple[str, int, int]]


class RepoReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"].removeprefix("file://")
        self.max_bytes = int(options.get("maxbytes", MAX_BYTES))
        self.metadata = options.get("metadata", "false") == "true"
        self.keep_unreadable = options.get("profile", "cli") == "binding"
        self.honour, self.hidden = options.get("ignores", "true") == "true", options.get("hidden", "true") == "true"

    def partitions(self) -> list[Files]:
        rows = list(listing(self.root, self.max_bytes, self.honour, self.hidden))
        return [Files(rows[i : i + _PER_TASK]) for i in range(0, len(rows), _PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for rel, size, mtime in partition.rows:
            content = None
            if not self.metadata:
                try:
                    with open(os.path.join(self.root, rel), encoding="utf-8", newline="") as f:
                        content = f.read()
                except (UnicodeDecodeError, OSError):
                    if not self.keep_unreadable:
                        continue
            yield rel, size, mtime, content


class RepoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepoReader:
        return RepoReader(dict(self.options))


def scan(spark: SparkSession, root: str, *, metadata: bool = False, profile: str = "cli", max_bytes: int = MAX_BYTES, honour_ignores: bool = True, hidden: bool = True) -> DataFrame:
    """The files of a tree in the schema of every operator; the folder must be one that all executors see.
    Languages are those of the profile's own table."""
    spark.dataSource.register(RepoSource)
    said = {k: str(v).lower() for k, v in (("metadata", metadata), ("ignores", honour_ignores), ("hidden", hidden))}
    d = spark.read.format(FORMAT).options(profile=profile, maxbytes=str(max_bytes), **said).load(root)
    return d.select("relative_path", paths.language(F.col("relative_path"), profile).alias("language"), "size_bytes", "content", F.xxhash64("relative_path").alias("seq"), "mtime")


def snapshot(root: str) -> dict[str, tuple[int, int]]:
    """path -> (mtime, size) of a tree as it is now."""
    return {p: (t, n) for p, n, t in listing(root)}


def in_memory(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """(name, content) pairs as files."""
    d = spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(pairs)], "relative_path string, content string, seq long")
    return d.select("relative_path", paths.language(F.col("relative_path")).alias("language"), F.octet_length("content").cast("long").alias("size_bytes"), "content", "seq")
