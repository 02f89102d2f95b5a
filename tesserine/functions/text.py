"""Text transforms and escapes as column expressions; state machines as Arrow batch functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths, tokens


def lines(text: Column) -> Column:
    """Lines without their ends; no empty line after a last line feed."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", "")))


def line_count(text: Column, size: Column | None = None) -> Column:
    """Lines of the text; a fortieth of the size where there is none."""
    n = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.translate(text, "\n", "")) + F.when(text.endswith("\n"), 0).otherwise(1))
    return (n if size is None else F.coalesce(n, F.floor(size / 40))).cast("long")


def newline_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, "\n", ""))).cast("long")


def redact(value: Column) -> Column:
    """All stars up to 8 characters, else at most 4 kept at both ends."""
    n = F.length(value)
    keep = F.least(F.lit(4), F.floor(n / 4).cast("int"))
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, F.lit(1), keep), F.repeat(F.lit("*"), n - 2 * keep), F.substring(value, n - keep + 1, keep)))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def toon_escape(text: Column) -> Column:
    """Bare where it can't be misread, else in quotes with backslash escapes."""
    risky = (text == "") | text.rlike(r"^\s|\s$") | text.isin("true", "false", "null") | text.try_cast("double").isNotNull() | text.rlike(r'[,|\n\r\t"]')
    q = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        q = F.replace(q, F.lit(a), F.lit(b))
    return F.when(risky, F.concat(F.lit('"'), q, F.lit('"'))).otherwise(text)


def remove_empty_lines(text: Column) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: ~x.rlike(r"^\s*$")), "\n")


def truncate_base64(text: Column) -> Column:
    """Data URIs get a marker behind their prefix; runs of more than 100 base64 characters keep 50."""
    t = F.regexp_replace(text, r"(data:[^;]+;base64,)", r"$1[BASE64_TRUNCATED]")
    return F.regexp_replace(t, r"([A-Za-z0-9+/]{50})(?:[A-Za-z0-9+/]{51,}={0,2}|[A-Za-z0-9+/]{50}={1,2})", r"$1...[BASE64_TRUNCATED]")


def compress_minimal(text: Column) -> Column:
    """Trailing blanks go; runs of blank lines become one."""
    t = F.array_join(F.transform(lines(text), lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def comment_mark(language: Column) -> Column:
    return F.when(language.isin("python", "ruby", "bash", "shell", "yaml", "toml"), "#").otherwise("//")


def compress_balanced(text: Column, language: Column) -> Column:
    """Without empty lines and those that begin as a comment."""
    mark = comment_mark(language)
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.array_join(F.filter(lines(text), lambda x: (trim(x) != "") & ~F.startswith(trim(x), mark) & ~trim(x).rlike(r"^(/\*|\*)")), "\n")


_MARKS = {
    "python": ("#", '"""', '"""'), "ruby": ("#", "=begin", "=end"), "html": (None, "<!--", "-->"), "xml": (None, "<!--", "-->"), "css": (None, "/*", "*/"), "sql": ("--", "/*", "*/"),
    "lua": ("--", "--[[", "]]"), "haskell": ("--", "{-", "-}"), **dict.fromkeys(("bash", "shell", "yaml", "toml", "zsh", "fish", "r", "make", "dockerfile"), ("#", None, None)),
}


def strip_comments(text: str, language: str | None) -> str:
    """Block comments go, over any number of lines; a line comment goes if the quotes before it are even."""
    line_mark, opening, closing = _MARKS.get(language or "", ("//", "/*", "*/"))
    out, inside = [], False
    for line in text.splitlines():
        kept = ""
        while line:
            if inside:
                at = line.find(closing)
                line, inside = ("", True) if at < 0 else (line[at + len(closing) :], False)
                continue
            at = line.find(opening) if opening else -1
            cut = line.find(line_mark) if line_mark else -1
            if 0 <= cut and (at < 0 or cut < at):
                before = kept + line[:cut]
                if before.count('"') % 2 == 0 and before.count("'") % 2 == 0:
                    kept, line = before, ""
                else:
                    kept, line = kept + line[: cut + len(line_mark)], line[cut + len(line_mark) :]
            elif at >= 0:
                kept, line, inside = kept + line[:at], line[at + len(opening) :], True
            else:
                kept, line = kept + line, ""
        if kept.strip():
            out.append(kept.rstrip())
    return "\n".join(out)


def toggle_docstrings(text: str, language: str | None) -> str:
    """Balanced compression that also drops what lies between lines that hold a triple quote."""
    mark, out, inside = ("#" if language in ("python", "ruby", "bash", "shell", "yaml", "toml") else "//"), [], False
    for line in text.splitlines():
        t = line.strip()
        if '"""' in t or "'''" in t:
            inside = not inside
        elif not inside and t and not t.startswith((mark, "/*", "*")):
            out.append(line)
    return "\n".join(out)


def _batched(f):
    @F.pandas_udf("string")
    def run(text: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t, n) for t, n in zip(text, language)], dtype=object)

    return run


def remove_comments(text: Column, language: Column) -> Column:
    return _batched(strip_comments)(text, language)


def compress_aggressive(text: Column, language: Column) -> Column:
    return _batched(toggle_docstrings)(text, language)


def compress(text: Column, language: Column, level: str) -> Column:
    """none, minimal, and balanced = aggressive = extreme (empty lines, then comments)."""
    if level == "none":
        return text
    return remove_empty_lines(text) if level == "minimal" else remove_comments(remove_empty_lines(text), language)


def parse_size(text: Column) -> Column:
    """'10MB' -> bytes, in powers of 1024; null where it isn't a size."""
    n = F.regexp_extract(F.upper(F.trim(text)), r"^(\d+)\s*(?:B|(?:[KMG])B?)?$", 1)
    unit = F.regexp_extract(F.upper(F.trim(text)), r"^\d+\s*([KMG])B?$", 1)
    scale = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    return F.when(n != "", n.try_cast("long") * scale)


def content_hash(content: Column) -> Column:
    """64-bit hash: equal contents have equal ones."""
    return F.xxhash64(content)


def span_lines(start: Column, end: Column) -> Column:
    """Lines of a span, both ends counted; 1 where they are reversed."""
    return F.when(end >= start, end - start + 1).otherwise(1)


def process_file(path: Column, content: Column) -> Column:
    """Language, size and tokens of one file as a struct, as the smallest entry point gives them."""
    return F.struct(paths.language(path, "wasm").alias("language"), F.octet_length(content).cast("long").alias("size_bytes"), tokens.count_all(content, "wasm").alias("token_count"))


def epoch_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def is_binary_content(content: Column) -> Column:
    """Of the first 8192 bytes: any NUL, or more than a tenth control bytes other than tab and line ends."""
    head = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    return head.contains("\0") | (F.regexp_count(head, F.lit(r"[\x01-\x08\x0b\x0c\x0e-\x1f]")) * 10 > F.length(head))
