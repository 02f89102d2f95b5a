"""The verbs of the library: pack, scan, map, count_tokens, scan_security, and a class that holds a tree."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import text, tokens
from .operators import document, filters, ranking, repomap, security, stats, symbols
from .sources import git, repo


def select(spark: SparkSession, path: str, settings: dict[str, Any] | None = None) -> DataFrame:
    """The files of a tree that the settings let through, their contents transformed as they say."""
    s = config.load(path) if settings is None else settings
    scan, out = s["scan"], s["output"]
    f = repo.scan(spark, path, max_bytes=scan["max_bytes"], hidden=scan["hidden"], honour_ignores=scan["gitignore"])
    if scan["default_ignores"]:
        f = filters.default_ignores(f, tests=scan["tests"], docs=scan["docs"])
    f = filters.exclude(filters.include(f, tuple(scan["include"])), tuple(scan["exclude"]))
    body = text.compress(F.col("content"), F.col("language"), out["compression"])
    return f.withColumn("content", security.redact_content(body) if s["security"]["redact"] else body)


def scan(spark: SparkSession, path: str, **settings) -> dict[str, Any]:
    """Totals of a tree, its languages, branch and commit."""
    f = Tree(spark, path, **settings).files()
    t = stats.totals(f).first().asDict()
    branch, commit = git.head(path)
    languages = [r.asDict() for r in stats.by_language(f).orderBy(F.desc("files"), "language").collect()]
    return {"name": os.path.basename(os.path.abspath(path)), "files": t.pop("files"), "lines": t.pop("lines"), "tokens": t, "languages": languages, "branch": branch, "commit": commit}


def pack(spark: SparkSession, path: str, form: str = "xml", max_tokens: int | None = None, **settings) -> str:
    return Tree(spark, path, **settings).pack(form, max_tokens)


def count_tokens(content: str, model: str = "claude") -> int:
    """Tokens of one text as a scan counts them."""
    return int(len(content.encode()) / {**dict(zip(tokens.MODELS, tokens.RATIOS["scan"])), "codellama": 3.2}[model])


def scan_security(spark: SparkSession, path: str, max_bytes: int = 10 << 20, **settings) -> DataFrame:
    """Findings in the files of a tree, those over ``max_bytes`` left out."""
    return Tree(spark, path, **settings).scan_security(max_bytes)


class Tree:
    """A source tree: its files as a DataFrame and what can be asked of them."""

    def __init__(self, spark: SparkSession, path: str, **settings):
        if not os.path.isdir(path):
            raise FileNotFoundError(path)
        self.spark, self.path = spark, path
        self.settings = config.merge(config.load(path), settings)
        self._files: DataFrame | None = None

    def load(self) -> Tree:
        """List the tree anew."""
        self._files = select(self.spark, self.path, self.settings)
        return self

    def files(self) -> DataFrame:
        if self._files is None:
            self.load()
        return self._files

    def stats(self) -> dict[str, Any]:
        return stats.totals(self.files()).first().asDict()

    def symbols(self) -> DataFrame:
        return repomap.ranked_symbols(self.files(), symbols.extract(self.files()))

    def map(self, n: int = 50) -> str:
        return document.map_text(self.files(), self.symbols(), n)

    def pack(self, form: str = "xml", max_tokens: int | None = None, parts: document.Parts | None = None, **more) -> str:
        o = self.settings["output"]
        return document.document(document.ranked(self.files()), form, name=os.path.basename(os.path.abspath(self.path)), order="_score", max_tokens=max_tokens or o["max_tokens"], numbered=o["line_numbers"], model=o["model"], parts=parts, **more)

    def scan_security(self, max_bytes: int = 10 << 20) -> DataFrame:
        return security.findings(filters.at_most(self.files(), max_bytes), tuple(self.settings["security"]["allow"]))

    def by_importance(self) -> DataFrame:
        return ranking.rank_fast(self.files())

    def __repr__(self) -> str:
        return f"Tree({self.path!r})"
