"""What stands around the files of a context document: overview, guide, metadata, index, appendices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, tokens


def _has(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def project_type(files: DataFrame) -> DataFrame:
    """One row, ``project_type``: by the manifests at the root, then by hints in the paths."""
    p = F.col("relative_path")
    seen = files.agg(
        *(_has(p.isin(*names)).alias(k) for k, names in (("cargo", ["Cargo.toml"]), ("node", ["package.json"]), ("python", ["pyproject.toml", "setup.py"]), ("go", ["go.mod"]))),
        _has(p.contains("routes") | p.contains("api/")).alias("routes"), _has(p.contains("components/") | p.contains("views/")).alias("views"), _has(p.endswith("lib.rs")).alias("library"),
    )
    is_ = F.col
    kind = (
        F.when(is_("cargo"), F.when(is_("library"), "Rust Library").otherwise("Rust Application"))
        .when(is_("node"), F.when(is_("views"), "Frontend Application (JavaScript/TypeScript)").when(is_("routes"), "Backend API (Node.js)").otherwise("JavaScript/TypeScript Project"))
        .when(is_("python"), F.when(is_("routes"), "Python Web API").otherwise("Python Package"))
        .when(is_("go"), "Go Application")
        .otherwise("Software Project")
    )
    return seen.select(kind.alias("project_type"))


def entry_points(files: DataFrame, n: int = 10, least: int = 50) -> DataFrame:
    """The first n entry files in walk order; package markers of fewer than ``least`` tokens are passed over."""
    t = tokens.count(F.col("content"), "claude")
    rows = files.where(paths.is_entry_point(F.col("relative_path"))).select("relative_path", paths.entry_type(F.col("relative_path")).alias("type"), t.alias("tokens"), "seq")
    return rows.where(~(F.col("relative_path").endswith("__init__.py") & (F.col("tokens") < least))).orderBy("seq").limit(n).select("relative_path", "type", "tokens")


def config_files(files: DataFrame) -> DataFrame:
    return files.where(paths.is_config(F.col("relative_path"))).select("relative_path", tokens.count(F.col("content"), "claude").alias("tokens"))


def token_tree(files: DataFrame) -> DataFrame:
    """A table row of Markdown for each file."""
    return files.select("seq", F.format_string("| %s | %s |", "relative_path", tokens.count(F.col("content"), "claude").cast("string")).alias("line"))


def report_lines(found: DataFrame) -> DataFrame:
    """A line of text for each finding."""
    return found.select("relative_path", F.col("line").alias("at"), F.format_string("- [%s] %s in %s (line %s)", F.initcap("severity"), "kind", "relative_path", F.col("line").cast("string")).alias("line"))


def scan_counters(files: DataFrame, max_bytes: int) -> DataFrame:
    """One row for a listing (relative_path, size_bytes): what a scan takes and what it leaves, and why."""
    binary = paths.is_binary_name(F.col("relative_path"))
    large = F.col("size_bytes") > max_bytes
    taken = ~binary & ~large
    return files.agg(F.count_if(taken).alias("scanned"), F.coalesce(F.sum(F.when(taken, F.col("size_bytes"))), F.lit(0)).alias("bytes"), F.count_if(binary).alias("skipped_binary"), F.count_if(~binary & large).alias("skipped_size"))


def emoji_tree(files: DataFrame) -> DataFrame:
    """(sort, line): a Markdown tree, folders before their contents, two spaces a level."""
    from .render import tree_rows

    rows = tree_rows(files).join(files.select(F.col("relative_path").alias("_p")).distinct(), F.col("prefix") == F.col("_p"), "left")
    mark = F.when(F.col("_p").isNotNull(), "📄 ").otherwise("📁 ")
    name = F.element_at(F.split("prefix", "/"), -1)
    return rows.select("prefix", F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.lit("- "), mark, name).alias("line"))


GUIDE = (
    "Read the overview first: it says what this is and how it is built.",
    "Entry points show where execution begins.",
    "The map shows which symbols and modules others lean on.",
    "Files stand in the order of their importance.",
)
