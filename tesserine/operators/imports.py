"""Import statements of source files: what they name, what it means for a path, what is external."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .graph import resolve

#: Files whose texts are held as Python strings at a time.
SLICE = 1024
LANGUAGES = ("python", "javascript", "typescript", "rust", "go", "java")
_ALIKE = {"jsx": "javascript", "tsx": "typescript"}
_CODE = re.compile(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?\*/""", re.DOTALL)
_NOTES = re.compile(r"(?://|#)[^\n]*|/\*.*?\*/", re.DOTALL)
_PY = re.compile(r"^[ \t]*(?:from[ \t]+(\.*)([\w.]*)[ \t]+import[ \t]*(\([^)]*\)|[^\n#;]+)|import[ \t]+([^\n#;]+))", re.MULTILINE)
_JS = re.compile(r"""(?:\b(?:import|export)\s+(?:type\s+)?(?P<names>(?:[\w$*,\s]|\{[^}]*\})*?)\s*from\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)(["'])(?P<spec>[^"'\n]+)\2""")
_RUST = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:use[ \t]+([^;]+);|mod[ \t]+(\w+)[ \t]*;)", re.MULTILINE)
_GO = re.compile(r'^import[ \t]+(?:\(([^)]*)\)|(?:[\w.]+[ \t]+)?"([^"]+)")', re.MULTILINE)
_JAVA = re.compile(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;", re.MULTILINE)


def names_in(clause: str) -> list[str]:
    """Names of an import clause without their aliases: ``a, { b as c }, * as d`` -> a, b, *."""
    bare = re.sub(r"[{}()]", ",", _NOTES.sub(" ", clause))
    found = (re.split(r"\s+as\s+", x.strip())[0].removeprefix("type ").strip() for x in bare.split(","))
    return [x for x in found if x]


def spread(tree: str) -> list[str]:
    """``a::{b, c::{self, D}}`` -> a::b, a::c, a::c::D."""
    tree = re.sub(r"\s+as\s+\w+", "", re.sub(r"\s+", " ", tree)).strip()
    at = tree.find("{")
    if at < 0:
        return [tree.removesuffix("::self")] if tree else []
    head, depth, part, out = tree[:at], 0, "", []
    for c in tree[at + 1 : tree.rfind("}")] + ",":
        if c == "," and depth == 0:
            out += [(head + x).removesuffix("::self") for x in spread(part)]
            part = ""
        else:
            depth += (c == "{") - (c == "}")
            part += c
    return out


def dotted(path: str) -> list[str]:
    """Components of a file's module below its source folder."""
    parts = path.split("/")
    while len(parts) > 1 and parts[0] in ("src", "lib", "app"):
        parts.pop(0)
    parts[-1] = parts[-1].rsplit(".", 1)[0]
    return parts[:-1] if parts[-1] in ("mod", "lib", "main") else parts


def _live(pattern: re.Pattern[str], text: str) -> Iterator[re.Match[str]]:
    """Matches that don't begin in a comment.  Comments are looked for only as far as matches go: most imports
    stand on top of a file."""
    comments = (c.span() for c in _CODE.finditer(text) if c.group(1) is None)
    at, start, end = 0, -1, -1
    while m := pattern.search(text, at):
        first = m.end() - len(m.group().lstrip())
        while end <= first:
            start, end = next(comments, (len(text) + 1, len(text) + 1))
        if start <= first:
            at = end
        else:
            yield m
            at = max(m.end(), at + 1)


def parse(text: str | None, language: str | None, path: str = "") -> list[tuple[str, list[str], int]]:
    """(target, names, line) of every import of a file, in order.

    Targets are paths seen from the file where the import is relative (``./x``, ``../y/z``), ``crate::`` paths
    in Rust, and the name as written elsewhere.  Imports over several lines are read whole.
    """
    language = _ALIKE.get(language or "", language)
    out: list[tuple[int, str, list[str]]] = []
    if not text or language not in LANGUAGES:
        return []
    if language == "python":
        for m in _PY.finditer(text):
            up, module, names, plain = m.groups()
            if plain is not None:
                out += [(m.start(), n, []) for n in names_in(plain)]
                continue
            got = names_in(names)
            if not up:
                out.append((m.start(), module, got))
            else:
                base = "./" if len(up) == 1 else "../" * (len(up) - 1)
                out += [(m.start(), base + module.replace(".", "/"), got)] if module else [(m.start(), base + n, []) for n in got]
    elif language in ("javascript", "typescript"):
        out += [(m.start(), m["spec"], names_in(m["names"] or "")) for m in _live(_JS, text)]
    elif language == "rust":
        own = dotted(path)
        for m in _live(_RUST, text):
            for x in spread(_NOTES.sub(" ", m.group(1))) if m.group(1) else [f"self::{m.group(2)}"]:
                parts = x.split("::")
                if parts[0] in ("self", "super"):
                    here = list(own)
                    while parts and parts[0] in ("self", "super"):
                        here = here[:-1] if parts.pop(0) == "super" else here
                    parts = ["crate", *here, *parts]
                out.append((m.start(), "::".join(parts), parts[-1:]))
    elif language == "go":
        for m in _live(_GO, text):
            out += [(m.start(), x, []) for x in ([m.group(2)] if m.group(2) else re.findall(r'"([^"]+)"', m.group(1)))]
    elif language == "java":
        out += [(m.start(), m.group(1).removesuffix(".*"), [m.group(1).rsplit(".", 1)[-1]]) for m in _live(_JAVA, text)]
    return [(spec, names, text.count("\n", 0, at) + 1) for at, spec, names in out if spec]


def extract(files: DataFrame) -> DataFrame:
    """(src, language, target, names, line): a row for each import of each file.  Null contents and other
    languages have none; texts are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            rows = [(p, n, *x) for p, n, t in zip(*(c.to_pylist() for c in b.columns)) for x in parse(t, n, p or "")]
            if rows:
                kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["src", "language", "target", "names", "line"])

    rows = files.where(F.col("language").isin(*LANGUAGES, *_ALIKE)).selectExpr("cast(relative_path as string) relative_path", "language", "content")
    return rows.mapInArrow(run, "src string, language string, target string, names array<string>, line long")


def is_external(target: Column, language: Column) -> Column:
    """Whether a target can't be a file of the tree: neither relative, nor under an alias of its root, nor ``crate``."""
    return ~target.rlike(r"^(\.|/|@/|~/|#|crate(::|$)|self(::|$)|super(::|$))") & language.isNotNull()


def package(target: Column, language: Column) -> Column:
    """The package that an external target belongs to; null where the name can't be one."""
    name = (
        F.when(language.isin("python", "java"), F.split(target, r"\.")[0])
        .when(language == "rust", F.split(target, "::")[0])
        .when(language == "go", F.when(F.split(target, "/")[0].contains("."), F.array_join(F.slice(F.split(target, "/"), 1, 3), "/")).otherwise(F.split(target, "/")[0]))
        .otherwise(paths.package_name(F.regexp_replace(target, "^node:", "")))
    )
    return F.when(name.rlike(r"^@?[A-Za-z_][\w.-]*(/[\w.-]+)*$"), name)


def mentioned(files: DataFrame) -> DataFrame:
    """(src, package): packages named by any ``require`` or ``import`` of a script, wherever it stands."""
    script = files.where(F.col("language").isin("javascript", "typescript", "jsx", "tsx"))
    call = F.lit(r"""(?:\brequire\s*\(\s*|\bfrom\s+|\bimport\s*\(?\s*)["']([^"'\n]+)["']""")
    found = script.select(F.col("relative_path").alias("src"), F.lit("javascript").alias("language"), F.explode(F.regexp_extract_all("content", call, F.lit(1))).alias("target"))
    return found.where(is_external(F.col("target"), F.col("language"))).select("src", package(F.col("target"), F.col("language")).alias("package")).where("package is not null")


def links(files: DataFrame) -> DataFrame:
    """Imports, one that stands twice on a line once, with ``dst`` (the file they mean, or null) and ``external``: not of the tree, as far as the name tells, and not resolved."""
    found = resolve(extract(files), files)
    return found.withColumn("external", F.col("dst").isNull() & is_external(F.col("target"), F.col("language")))


def edges(resolved: DataFrame) -> DataFrame:
    """(src, dst) of the imports that resolve, each once, without a file's imports of itself."""
    return resolved.where("dst is not null and src <> dst").select("src", "dst").distinct()


def external_packages(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every external package once: those of parsed imports and those that scripts mention."""
    parsed = resolved.where("external").select(package(F.col("target"), F.col("language")).alias("package")).where("package is not null")
    return parsed.unionByName(mentioned(files).select("package")).distinct()
