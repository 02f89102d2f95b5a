"""A whole context document: head from small aggregates, then the files, as far as the budget goes.

A document is a list of sections, each a name and rows of plain values, and the blocks of its files.  A
formatter says how a section and the whole are written; any object with these methods will do.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from . import overview, ranking, render, repomap, stats
from .chunking import fit_budget

Rows = list[dict[str, Any]]
MARKDOWN_SYMBOLS = 15  # a table that people read
#: Bytes a token by which a finished document is measured, by model.
BUDGET_RATIO = dict(zip(tokens.MODELS, tokens.RATIOS["output"]))


class Formatter(Protocol):
    def section(self, name: str, rows: Rows) -> str: ...

    def whole(self, name: str, sections: list[str], blocks: list[str]) -> str: ...


def _x(v: Any) -> str:
    s = "" if v is None else str(v)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = s.replace(a, b)
    return s


class Xml:
    def section(self, name: str, rows: Rows) -> str:
        one = name.removesuffix("ies") + "y" if name.endswith("ies") else name.removesuffix("s")
        return f"<{name}>\n" + "".join(f"  <{one} " + " ".join(f'{k}="{_x(v)}"' for k, v in r.items() if v is not None) + "/>\n" for r in rows) + f"</{name}>"

    def whole(self, name: str, sections: list[str], blocks: list[str]) -> str:
        return f'<context name="{_x(name)}">\n' + "\n".join(sections) + "\n<files>\n" + "\n".join(blocks) + "\n</files>\n</context>"


class Markdown:
    def section(self, name: str, rows: Rows) -> str:
        title = f"## {name.replace('_', ' ').capitalize()}\n\n"
        if not rows:
            return title + "none"
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        cols = list(rows[0])
        return title + "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(cell(r[c]) for c in cols) + " |" for r in rows)])

    def whole(self, name: str, sections: list[str], blocks: list[str]) -> str:
        return f"# {name}\n\n" + "\n\n".join([*sections, *blocks])


class Json:
    def section(self, name: str, rows: Rows) -> str:
        return json.dumps({name: rows[0] if name == "repository" else rows}, ensure_ascii=False)

    def whole(self, name: str, sections: list[str], blocks: list[str]) -> str:
        doc = {k: v for s in sections for k, v in json.loads(s).items()}
        return json.dumps({**doc, "files": [json.loads(b) for b in blocks]}, ensure_ascii=False, indent=2)


class Yaml:
    def section(self, name: str, rows: Rows) -> str:
        if not rows:
            return f"{name}: []"
        return f"{name}:\n" + "\n".join("  - " + "\n    ".join(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in r.items()) for r in rows)

    def whole(self, name: str, sections: list[str], blocks: list[str]) -> str:
        return f"name: {json.dumps(name)}\n" + "\n".join(sections) + ("\nfiles:\n" + "\n".join(blocks) if blocks else "\nfiles: []")


class Toon:
    @staticmethod
    def value(v: Any) -> str:
        s = "" if v is None else str(v)
        plain = s and s == s.strip() and s not in ("true", "false", "null") and not any(c in s for c in ',|\n\r\t"')
        return s if plain else json.dumps(s, ensure_ascii=False)

    def section(self, name: str, rows: Rows) -> str:
        cols = ",".join(rows[0]) if rows else ""
        return "\n".join([f"{name}[{len(rows)}]{{{cols}}}:", *("  " + ",".join(map(self.value, r.values())) for r in rows)])

    def whole(self, name: str, sections: list[str], blocks: list[str]) -> str:
        return f"name: {self.value(name)}\n" + "\n".join(sections) + f"\nfiles[{len(blocks)}]{{path,language,tokens,content}}:\n" + "\n".join("  " + b for b in blocks)


class Plain:
    def section(self, name: str, rows: Rows) -> str:
        return "\n".join([name.replace("_", " ").upper(), *("  " + "  ".join(f"{k}={v}" for k, v in r.items() if v is not None) for r in rows)])

    def whole(self, name: str, sections: list[str], blocks: list[str]) -> str:
        return f"{name}\n\n" + "\n\n".join([*sections, *blocks])


FORMATTERS: dict[str, Formatter] = {"xml": Xml(), "markdown": Markdown(), "json": Json(), "yaml": Yaml(), "toon": Toon(), "plain": Plain()}


@dataclass
class Parts:
    """What a document holds besides its files."""

    branch: str | None = None
    commit: str | None = None
    commits: Rows = field(default_factory=list)
    changed: Rows = field(default_factory=list)
    symbols: DataFrame | None = None  # as repomap.ranked_symbols gives them
    findings: DataFrame | None = None
    header: str | None = None
    instructions: str | None = None
    guide: bool = True
    summary: bool = True
    tree: bool = True
    index: bool = True
    token_tree: bool = False
    key_symbols: int = 50


def _rows(df: DataFrame) -> Rows:
    return [r.asDict() for r in df.collect()]


def sections(files: DataFrame, name: str, parts: Parts, order: str) -> Iterator[tuple[str, Rows]]:
    """Name and rows of each section, in order.  Each is a small aggregate or a top list; tree and index have a
    row a file and stand only where the caller, who has a budget for them, asks for them."""
    t = stats.totals(files).first().asDict()
    languages = _rows(stats.by_language(files).orderBy(F.desc("files"), "language"))
    yield "repository", [{"name": name, "files": t["files"], "lines": t["lines"], "branch": parts.branch, "commit": parts.commit, **{f"tokens_{m}": t[m] for m in tokens.MODELS}}]
    if parts.guide:
        yield "guides", [{"tip": x} for x in overview.GUIDE]
    if parts.summary:
        primary = stats.primary_language(files).first()[0]
        yield "overviews", [{"project_type": overview.project_type(files).first()[0], "primary_language": primary}]
        named = files.withColumn("seq", F.col(order)) if order != "seq" else files
        yield "entry_points", [{"path": r["relative_path"], "type": r["type"], "tokens": r["tokens"]} for r in _rows(overview.entry_points(named))]
        yield "config_files", [{"path": r["relative_path"], "tokens": r["tokens"]} for r in _rows(overview.config_files(files).orderBy("relative_path"))]
        yield "languages", [{"language": r["language"], "files": r["files"], "percentage": round(r["percentage"], 1)} for r in languages]
    if parts.commits:
        yield "commits", parts.commits
    if parts.changed:
        yield "changes", parts.changed
    if parts.symbols is not None:
        s = parts.symbols.where("kind <> 'import'")
        best = s.orderBy(F.desc_nulls_last("rank"), "relative_path", "start_line").limit(parts.key_symbols)
        yield "symbols", [{"name": r.name, "kind": r.kind, "file": r.relative_path, "line": r.start_line, "signature": r.signature} for r in best.collect()]
        yield "modules", [{"module": r["module"], "files": r["files"], "tokens": r["claude_tokens"]} for r in _rows(stats.modules(files).orderBy(F.desc("files"), "module"))]
    if parts.tree:
        yield "directories", [{"line": x} for x in render.tree_text(files).split("\n")]


def index_rows(files: DataFrame, order: str) -> Iterator[dict[str, Any]]:
    rows = files.select(F.col(order).alias("_o"), "relative_path", tokens.count(F.col("content"), "claude").alias("tokens")).orderBy("_o")
    for r in rows.toLocalIterator():
        yield {"path": r.relative_path, "tokens": r.tokens}


def _first(rows: Iterable[dict[str, Any]], budget: float) -> Rows:
    """As many rows as the budget (in bytes) can hold at all."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(str(r["path"]))
        if size > budget:
            break
    return out


def document(files: DataFrame, form: str = "xml", *, name: str = "corpus", order: str = "seq", max_tokens: int | None = None, numbered: bool = False, parts: Parts | None = None, model: str = "claude", formatter: Formatter | None = None) -> str:
    """One context document within ``max_tokens`` of ``model``."""
    if formatter is None and form not in FORMATTERS:
        raise ValueError(f"unknown format {form}")
    f, parts = formatter or FORMATTERS[form], parts or Parts()
    if form == "markdown":
        parts = replace(parts, key_symbols=min(parts.key_symbols, MARKDOWN_SYMBOLS))
    budget = float("inf") if max_tokens is None else max_tokens * BUDGET_RATIO[model]
    head = [f.section(n, r) for n, r in sections(files, name, parts, order)]
    if parts.index:
        head.append(f.section("indexes", _first(index_rows(files, order), budget)))
    rows = files.select(F.col(order).alias("_o"), render.block(F.col("relative_path"), F.col("language"), F.col("content"), form, numbered).alias("block")).where("block is not null").orderBy("_o").select("block")
    blocks, size = [], 0
    for r in rows.toLocalIterator():  # no more of them than the budget can hold
        blocks.append(r.block)
        size += len(r.block.encode())
        if size > budget:
            break
    doc = (f"{parts.header}\n\n" if parts.header else "") + f.whole(name, head, blocks)
    if parts.instructions:
        doc += f"\n\n<!-- instructions -->\n{parts.instructions}\n"
    if parts.token_tree:
        doc += "\n\n<!-- tokens by file -->\n| file | tokens |\n|---|---|\n" + "\n".join(f"| {r['path']} | {r['tokens']} |" for r in _first(index_rows(files, order), budget))
    if parts.findings is not None:
        lines = [r.line for r in overview.report_lines(parts.findings).orderBy("relative_path", "at").select("line").collect()]
        if lines:
            doc += f"\n\n<!-- security -->\n{len(lines)} possible secrets:\n" + "\n".join(lines)
    return doc if max_tokens is None else fit_budget(doc, max_tokens, BUDGET_RATIO[model])


def ranked(files: DataFrame) -> DataFrame:
    """files with ``_score``, by which the default order goes."""
    return files.withColumn("_score", F.struct(ranking.fast_score(F.col("relative_path")), "relative_path"))


def map_text(files: DataFrame, symbols: DataFrame, n: int = 50) -> str:
    """The map alone: its summary, an estimate of its size, and the symbols that matter most."""
    best = symbols.where("kind <> 'import'").orderBy(F.desc_nulls_last("rank"), "relative_path", "start_line").limit(n).collect()
    size = repomap.estimate(symbols.where("kind <> 'import'").count(), files.count())
    lines = [repomap.summary(files, symbols), f"About {size} tokens in full.", ""]
    return "\n".join(lines + [f"{i + 1}. {r.name} ({r.kind}) {r.relative_path}:{r.start_line}  {r.signature or ''}".rstrip() for i, r in enumerate(best)])
