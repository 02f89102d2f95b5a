"""Importance of files and symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..storage import checkpoint

_STEMS = {"main": "c cpp go js rs ts", "index": "js jsx ts tsx", "app": "go js py rb ts", "server": "go js py ts", "cli": "js py rs ts", "lib": "rs", "mod": "rs", "__main__": "py"}
CRITICAL = tuple(f"{a}.{b}" for a, bs in _STEMS.items() for b in bs.split())
PREFIXES = tuple(f"{x}." for x in "__init__ app bootstrap cli entry index init lib main mod server".split())
CORE = tuple(f"/{x}/" for x in "app bin cmd core crates internal lib pkg src".split())
DOCS = tuple(f"{x}." for x in "authors changelog contributing license readme".split())
CONFIG = tuple(".config .env .eslint .github/ .gitlab .prettier cargo.toml config. docker-compose dockerfile jest.config makefile package.json pyproject.toml settings. setup.cfg setup.py tsconfig. vite.config webpack.".split())
TESTS = tuple("test_ _test. .test. spec. mock_ _mock.".split() + [f"{x}/" for x in "__tests__ benchmark e2e example examples fixtures integration mocks test testing tests unit".split()])
VENDOR = tuple(".bundle. .min.css .min.js".split() + [f"{x}/" for x in ".cache .generated .next __pycache__ benchmarks build coverage dist gen generated node_modules target vendor".split()])
ROLES = tuple("controller handler helper middleware model router service util".split())


def _has(c: Column, some: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(x) for x in some))


def _starts(c: Column, some: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(x) for x in some))


def importance(path: Column, symbols: Column) -> Column:
    """Tiers by path, the first that applies; symbols and role names add to all but tests and vendored files."""
    p = F.lower(path)
    name = paths.filename(p)
    vendor, test = _has(p, VENDOR), _has(p, TESTS)
    tier = F.when(vendor, 0.05).when(test, 0.15).when(_has(p, CONFIG), 0.25).when(_starts(name, DOCS), 0.35).when(name.isin(*CRITICAL), 1.0).when(_starts(name, PREFIXES), 0.9).when(_has(p, CORE), 0.75).otherwise(0.5)
    grown = F.least(F.lit(1.0), tier + F.least(symbols / F.lit(50.0), F.lit(0.15)))
    grown = F.when(_has(name, ROLES), F.least(F.lit(1.0), grown + 0.1)).otherwise(grown)
    return F.round(F.when(vendor | test, tier).otherwise(grown), 6)


FAST_ENTRY = tuple(f"{a}.{b}" for a, bs in {"main": "c cpp go js py rs ts", "index": "js jsx py ts tsx", "app": "go js jsx py ts tsx", "server": "go js py ts", "lib": "py rs", "mod": "rs", "__init__": "py", "__main__": "py"}.items() for b in bs.split())
FAST_CONFIG = tuple(".env.example build.gradle Cargo.toml CMakeLists.txt docker-compose Dockerfile Gemfile go.mod Makefile next.config package.json pom.xml pyproject.toml requirements.txt setup.cfg setup.py tsconfig.json vite.config webpack.config".split())
_FAST = (
    (-500, tuple(f"{x}/" for x in "api controllers handlers models routes services".split())),
    (2000, ("/test", "_test.", ".test.", ".spec.", "tests/", "__tests__/")),
    (1500, tuple(f"{x}/" for x in "bench benchmarks example examples scripts tools".split())),
    (3000, tuple(f"{x}/" for x in "doc docs generated third_party vendor".split())),
)


def fast_score(path: Column) -> Column:
    """Additive score of a path: the lower, the more important."""
    ends = reduce(lambda a, b: a | b, (path.endswith(x) for x in FAST_ENTRY))
    s = F.lit(1000) - F.when(ends, 5000).otherwise(0) - F.when(_has(path, FAST_CONFIG), 3000).otherwise(0) - F.when(path.rlike("^(src|lib|pkg)/"), 1000).otherwise(0)
    for add, some in _FAST:
        s = s + F.when(_has(path, some), add).otherwise(0)
    return (s + (F.length(path) - F.length(F.translate(path, "/", ""))) * 50 + F.floor(F.octet_length(paths.filename(path)) / 5)).cast("long")


def ordinal(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Rows numbered from 0 in a total order without one task that holds them all: a range-partitioned
    sort, row counts by partition, and offsets joined back.  The sorted table is checkpointed: both branches, and
    a stage that is run again, see the same partitions."""
    placed = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    local = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))  # a row a partition
    return local.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_at") + F.col("_start")).cast("long")).drop("_part", "_at", "_start")


def rank_fast(files: DataFrame) -> DataFrame:
    """score, position from 0 and importance 1 - position / files; ties in walk order."""
    scored = files.select("relative_path", "seq", fast_score(F.col("relative_path")).alias("score"))
    total = scored.agg(F.count("*").alias("_total"))
    placed = ordinal(scored, F.col("score"), F.col("seq"))
    return placed.crossJoin(F.broadcast(total)).select("relative_path", "score", "position", F.round(1 - F.col("position") / F.col("_total"), 6).alias("importance"))  # total: one row


KIND_WEIGHT = {"class": 1.0, "struct": 1.0, "interface": 1.0, "trait": 1.0, "function": 0.8, "method": 0.8, "enum": 0.7, "type": 0.6, "constant": 0.5}


def kind_weight(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in KIND_WEIGHT.items() for x in kv))
    return F.coalesce(F.try_element_at(table, kind), F.lit(0.3))


def rank_symbols(symbols: DataFrame) -> DataFrame:
    """symbols (file_importance, kind, references, lines) with their score: .4 references, .25 kind, .2 file, .15 size."""
    most = symbols.agg(F.max("references").alias("_refs"), F.max("lines").alias("_lines"))
    share = lambda c, m: F.when(F.col(m) > 0, F.col(c) / F.col(m)).otherwise(0.0)
    score = 0.4 * share("references", "_refs") + 0.25 * kind_weight(F.col("kind")) + 0.2 * F.col("file_importance") + 0.15 * share("lines", "_lines")
    return symbols.crossJoin(F.broadcast(most)).withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)).drop("_refs", "_lines")  # most: one row


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def first_files(files: DataFrame, n: int) -> DataFrame:
    """The first n files of the walk, before any ranking."""
    return files.orderBy("seq").limit(n)
