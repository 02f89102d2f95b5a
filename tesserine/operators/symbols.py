"""Symbols and imports of source files: Python by its own parser, five other languages by declaration
patterns over text whose strings and comments are blanked."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "relative_path string, name string, kind string, signature string, docstring string, start_line long, end_line long, parent string"
_NAME = r"([A-Za-z_$][\w$]*)"
_DECL = {
    "javascript": [("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}"), ("class", rf"^\s*(?:export\s+)?(?:default\s+)?class\s+{_NAME}"), ("method", rf"^\s+(?:static\s+|async\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_NAME}\s*\([^;]*\)\s*\{{")],
    "rust": [("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+{_NAME}"), *((k, rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?{k}\s+{_NAME}") for k in ("struct", "enum", "trait"))],
    "go": [("method", rf"^func\s+\([^)]*\)\s*{_NAME}"), ("function", rf"^func\s+{_NAME}"), ("struct", rf"^type\s+{_NAME}\s+struct"), ("interface", rf"^type\s+{_NAME}\s+interface")],
    "java": [*((k, rf"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*{k}\s+{_NAME}") for k in ("class", "interface", "enum")), ("method", rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|native)\s+)*[\w<>\[\],.? ]+\s+(?<!new )(?<!return ){_NAME}\s*\([^;{{]*\)\s*(?:throws [\w., ]+)?\s*[{{;]")],
}
_DECL["typescript"] = [*_DECL["javascript"][:2], ("class", rf"^\s*(?:export\s+)?abstract\s+class\s+{_NAME}"), ("interface", rf"^\s*(?:export\s+)?interface\s+{_NAME}"), ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_NAME}"), ("method", rf"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|readonly\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_NAME}\s*\([^;]*\)\s*(?::[^{{;]+)?\{{")]
_IMPORT = {
    "javascript": r"^\s*import\b.*|^.*\brequire\s*\(.*", "typescript": r"^\s*import\b.*|^.*\brequire\s*\(.*", "rust": r"^\s*(?:pub\s+)?use\s+[^;]+", "go": r"^import\s+.*", "java": r"^import\s+[^;]+",
}
_COMPILED = {k: [(kind, re.compile(p)) for kind, p in v] for k, v in _DECL.items()}
_BLANK = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', re.DOTALL)


def _blanked(text: str) -> str:
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _clean(doc: str) -> str:
    lines = (re.sub(r"^\s*(?:/\*\*|\*/|\*|///|//)?\s?|\s*\*/\s*$", "", x).strip() for x in doc.splitlines())
    return " ".join(x for x in lines if x)


def _head(n: ast.AST, lines: list[str]) -> str:
    """The declaration up to its colon, over however many lines."""
    body = n.body[0]
    if body.lineno == n.lineno:
        own = [lines[n.lineno - 1].encode()[n.col_offset : body.col_offset].decode(errors="replace")]
    else:
        own = lines[n.lineno - 1 : body.lineno - 1] if body.lineno - 1 > n.lineno - 1 else lines[n.lineno - 1 : n.lineno]
    kept = []
    for x in own:
        if kept and kept[-1].endswith(":") or x.strip().startswith(("#", "@")):
            break
        kept.append(re.sub(r"\s+#.*$", "", x.strip()))
    return re.sub(r"\(\s+", "(", re.sub(r"\s+\)", ")", " ".join(kept))).rstrip().removesuffix(":")


_DEF = re.compile(r"^(\s*)(?:(class)|(?:async\s+)?def)\s+([A-Za-z_]\w*)")
_PY_IMPORT = re.compile(r"^(?:import\s+\S.*|from\s+\S+\s+import\s+\S.*)$")


def _lines_of_python(text: str) -> list[tuple]:
    """Declarations by line, for text that Python's own parser refuses: a block ends where its indent does."""
    out, lines = [], text.splitlines()
    holders: list[tuple[int, str]] = []
    for i, line in enumerate(lines):
        if _PY_IMPORT.match(line):
            out.append((line.strip(), "import", line.strip(), None, i + 1, i + 1, None))
        if not (m := _DEF.match(line)):
            continue
        indent = len(m.group(1).expandtabs())
        while holders and holders[-1][0] >= indent:
            holders.pop()
        end = i
        for j in range(i + 1, len(lines)):
            if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= indent:
                break
            end = j if lines[j].strip() else end
        kind = "class" if m.group(2) else "method" if holders else "function"
        out.append((m.group(3), kind, line.strip().removesuffix(":"), None, i + 1, end + 1, holders[-1][1] if holders and kind == "method" else None))
        if m.group(2):
            holders.append((indent, m.group(3)))
    return out


def _python(text: str) -> list[tuple]:
    out, lines = [], text.splitlines()

    def walk(node: ast.AST, parent: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if parent else "function"
                doc = ast.get_docstring(n)
                out.append((n.name, kind, _head(n, lines), doc, n.lineno, n.end_lineno, parent))
                walk(n, n.name if kind == "class" else None)
            elif isinstance(n, (ast.Import, ast.ImportFrom)) and node is tree:
                out.append((ast.unparse(n), "import", ast.unparse(n), None, n.lineno, n.end_lineno, None))
            elif not isinstance(n, ast.expr):
                walk(n, parent)

    tree = ast.parse(text)
    walk(tree, None)
    return out


def _scanned(text: str, language: str) -> list[tuple]:
    raw, lines = text.splitlines(), _blanked(text).splitlines()
    out: list[tuple] = []
    depth, holders = 0, []
    imports = re.compile(_IMPORT[language])
    block = False
    for i, line in enumerate(lines):
        if language == "go" and (block or line.startswith("import (")):
            item = raw[i].strip()
            if block and item.startswith(")"):
                block = False
            elif '"' in item:
                out.append((item, "import", item, None, i + 1, i + 1, None))
            block = block or line.startswith("import (")
            continue
        if depth == 0 and imports.match(line):
            end, level = i, line.count("{") - line.count("}")
            while end + 1 < len(lines) and (level > 0 or (language in ("rust", "java") and ";" not in lines[end])):
                end += 1
                level += lines[end].count("{") - lines[end].count("}")
            whole = " ".join(x.strip() for x in raw[i : end + 1])
            out.append((whole, "import", whole, None, i + 1, end + 1, None))
        for kind, p in _COMPILED[language]:
            m = p.match(line)
            if m:
                if kind == "method" and language != "go" and not holders:
                    continue
                level, end, opened = 0, i, False
                for j in range(i, len(lines)):
                    level += lines[j].count("{") - lines[j].count("}")
                    opened = opened or "{" in lines[j]
                    end = j
                    if (opened and level <= 0) or (not opened and ";" in lines[j]):
                        break
                j, doc = i - 1, []
                while j >= 0 and re.match(r"\s*(///|//|/\*\*|\*|@|#\[)", raw[j]):
                    doc.insert(0, raw[j])
                    j -= 1
                text_doc = _clean("\n".join(x for x in doc if not re.match(r"\s*(@|#\[)", x)))
                parent = holders[-1][0] if kind == "method" and holders else None
                stop = next((j for j in range(i, end + 1) if "{" in lines[j] or ";" in lines[j]), i)
                last = re.split(r"[{;]", lines[stop])[0]
                head = " ".join(x.strip() for x in [*raw[i:stop], raw[stop][: len(last)]])
                out.append((m.group(1), kind, re.sub(r"\(\s+", "(", re.sub(r",?\s+\)", ")", head)).strip(), text_doc or None, i + 1, end + 1, parent))
                if kind in ("class", "interface", "enum", "trait", "struct"):
                    holders.append((m.group(1), end))
                break
        depth += line.count("{") - line.count("}")
        while holders and holders[-1][1] <= i:
            holders.pop()
    return out


def parse(text: str | None, language: str | None) -> list[tuple]:
    """(name, kind, signature, docstring, start, end, parent) of a file's declarations and imports;
    none for other languages.  Python that can't be parsed is read line by line."""
    language = {"jsx": "javascript", "tsx": "typescript"}.get(language or "", language)
    if not text:
        return []
    if language == "python":
        try:
            return _python(text)
        except (SyntaxError, ValueError, RecursionError):
            return _lines_of_python(text)
    return _scanned(text, language) if language in _COMPILED else []


def extract(files: DataFrame) -> DataFrame:
    """A row for each symbol of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *s) for p, n, t in zip(*(c.to_pylist() for c in b.columns)) for s in parse(t, n)]
            if rows:
                c = list(zip(*rows))
                t = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, t)], ["relative_path", "name", "kind", "signature", "docstring", "start_line", "end_line", "parent"])

    rows = files.selectExpr("cast(relative_path as string) relative_path", "language", "content")
    return rows.mapInArrow(run, SCHEMA)
