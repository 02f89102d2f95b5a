"""Context documents: each file becomes one block of text in a column; only the finished blocks,
within the budget, are brought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, tokens
from . import stats

FORMATS = ("xml", "markdown", "json", "yaml", "toon", "plain")


def number_lines(content: Column, form: str = "xml") -> Column:
    """Lines with their numbers as each format writes them."""
    def one(x: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        if form == "toon":
            return F.concat(n, F.lit(":"), x)
        width = F.greatest(F.lit(4), F.length(n))  # a longer number isn't cut
        padded = F.lpad(n, width, F.lit(" ")) if form == "xml" else F.rpad(n, width, F.lit(" "))
        return F.concat(padded, F.lit(" | " if form == "xml" else " "), x)

    return F.array_join(F.transform(text.lines(content), one), "\n")


def block(path: Column, language: Column, content: Column, form: str, numbered: bool = False) -> Column:
    body = number_lines(content, form) if numbered else content
    lang = F.coalesce(language, F.lit(""))
    if form == "xml":
        n = tokens.count(content, "claude").cast("string")
        safe = F.replace(body, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))  # a text can't end its own section
        return F.concat(F.lit('<file path="'), text.xml_escape(path), F.lit('" language="'), text.xml_escape(lang), F.lit('" tokens="'), n, F.lit('"><![CDATA[\n'), safe, F.lit("\n]]></file>"))
    if form == "markdown":
        return F.concat(F.lit("## "), path, F.lit("\n\n```"), lang, F.lit("\n"), body, F.lit("\n```"))
    if form == "json":
        return F.to_json(F.struct(path.alias("path"), language.alias("language"), tokens.count_all(content).alias("token_count"), body.alias("content")), {"ignoreNullFields": "false"})
    if form == "yaml":
        return F.concat(F.lit("  - path: "), F.to_json(F.struct(path.alias("p"))).substr(F.lit(6), F.length(F.to_json(F.struct(path.alias("p")))) - 6), F.lit("\n    language: "), lang, F.lit("\n    tokens: "), tokens.count(content, "gemini").cast("string"), F.lit("\n    content: |\n      "), F.replace(body, F.lit("\n"), F.lit("\n      ")))
    if form == "toon":
        return F.concat_ws(",", text.toon_escape(path), text.toon_escape(lang), tokens.count(content, "claude").cast("string"), text.toon_escape(body))
    return F.concat(F.lit("=== "), path, F.lit(" ===\n"), body)


def blocks(files: DataFrame, form: str, numbered: bool = False) -> DataFrame:
    return files.select("relative_path", "seq", block(F.col("relative_path"), F.col("language"), F.col("content"), form, numbered).alias("block"))


def small_blocks(files: DataFrame, form: str) -> DataFrame:
    """(relative_path, block) in the plainer layouts of the smallest entry point."""
    path, body, lang = F.col("relative_path"), F.col("content"), F.coalesce("language", F.lit(""))
    shapes = {
        "xml": F.concat(F.lit('<file path="'), text.xml_escape(path), F.lit('">\n'), F.replace(body, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("\n</file>")),
        "markdown": F.concat(F.lit("### "), path, F.lit("\n```"), lang, F.lit("\n"), body, F.lit("\n```")),
        "json": F.to_json(F.struct(path.alias("path"), body.alias("content"))),
        "plain": F.concat(F.lit("--- "), path, F.lit(" ---\n"), body),
    }
    return files.select("relative_path", shapes[form].alias("block"))


def tree_rows(files: DataFrame) -> DataFrame:
    """Every folder and file once, with its depth: the lines of a directory tree in the order of their components."""
    parts = F.split("relative_path", "/")
    rows = files.select(F.posexplode(F.transform(parts, lambda x, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))).alias("depth", "prefix"))
    return rows.select("prefix", F.col("depth").cast("long").alias("depth")).distinct()


def tree_text(files: DataFrame, limit: int = 50_000) -> str:
    out, size = [], 0
    for r in tree_rows(files).orderBy(F.split("prefix", "/")).toLocalIterator():
        line = "  " * r.depth + r.prefix.rsplit("/", 1)[-1]
        size += len(line) + 1
        if size > limit:
            out.append("...")
            break
        out.append(line)
    return "\n".join(out)


def summary(files: DataFrame, name: str) -> dict:
    t = stats.totals(files).first().asDict()
    return {"name": name, "files": t.pop("files"), "lines": t.pop("lines"), "tokens": t, "languages": [r.asDict() for r in stats.by_language(files).orderBy(F.desc("files"), "language").collect()]}
