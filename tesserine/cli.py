"""Command line: pack, scan, map, info, init."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, config
from .functions import text
from .operators import changes, document, filters, ranking, render, security, stats, symbols
from .operators.repomap import ranked_symbols
from .sources import git, repo
from .streaming import watch as watching


def settings_of(a: argparse.Namespace) -> dict:
    """Settings of the tree, overridden by what the command line says."""
    s = config.load(a.path, a.profile, at=a.config)
    said = lambda **kv: {k: v for k, v in kv.items() if v is not None and v is not False and v != []}
    scan = said(tests=a.include_tests, docs=a.include_docs, hidden=a.hidden, include=a.include)
    scan |= {k: False for k, off in (("gitignore", a.no_gitignore), ("default_ignores", a.no_default_ignores)) if off}
    scan["exclude"] = list(dict.fromkeys([*s["scan"]["exclude"], *a.exclude]))
    out = said(format=a.format, max_tokens=a.max_tokens, compression=a.compression, model=a.model)
    out["line_numbers"] = a.line_numbers or (s["output"]["line_numbers"] and not a.no_line_numbers)
    return config.merge(s, {"scan": scan, "output": out, "security": said(redact=a.redact) | {"allow": [*s["security"]["allow"], *a.allow]}})


def selected(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    f = api.select(spark, a.path, settings_of(a))
    if a.stdin:
        f = filters.listed(f, spark.createDataFrame([(x.strip(),) for x in sys.stdin if x.strip()], "name string"))
    if a.top_files:
        f = ranking.first_files(f, a.top_files)
    if a.remove_empty_lines:
        f = f.withColumn("content", text.remove_empty_lines(F.col("content")))
    if a.remove_comments:
        f = f.withColumn("content", text.remove_comments(F.col("content"), F.col("language")))
    return f


def by_changes(spark: SparkSession, a: argparse.Namespace, f: DataFrame) -> DataFrame:
    """Most changed first, the rest as they are ranked; as they are ranked all, without a history."""
    if not git.is_repo(a.path):
        return document.ranked(f)
    n = changes.frequency(git.changes(spark, a.path), a.days).select(F.col("path").alias("_p"), "changes")
    own = document.ranked(f).join(n, F.col("relative_path") == F.col("_p"), "left").drop("_p")
    return own.withColumn("_score", F.struct(-F.coalesce("changes", F.lit(0)), "_score")).drop("changes")


def pack(spark: SparkSession, a: argparse.Namespace) -> str:
    s = settings_of(a)
    f = selected(spark, a)
    found = security.findings(f, tuple(s["security"]["allow"]))
    if a.fail_on_secrets:
        security.refuse_critical(found)
    branch, commit = git.head(a.path)
    parts = document.Parts(branch=branch, commit=commit, header=a.header_text, token_tree=a.token_tree, tree=not a.no_directory_structure, summary=not a.no_file_summary, guide=not a.no_file_summary, index=not a.no_file_summary)
    if a.instruction_file:
        with open(a.instruction_file, encoding="utf-8") as fh:
            parts.instructions = fh.read()
    if a.security_check:
        parts.findings = found
    if a.symbols or a.full:
        parts.symbols = ranked_symbols(f, symbols.extract(f))
    if (a.include_logs or a.full) and git.is_repo(a.path):
        parts.commits = [{"commit": r.short, "author": r.author, "date": r.date, "message": r.message} for r in git.log(spark, a.path, a.logs_count).collect()]
    if (a.include_diffs or a.full) and git.is_repo(a.path):
        parts.changed = [r.asDict() for r in git.status(spark, a.path).collect()]
    rows = by_changes(spark, a, f) if a.sort_by_changes else document.ranked(f)
    o = s["output"]
    doc = document.document(rows, o["format"], name=os.path.basename(os.path.abspath(a.path)), order="_score", max_tokens=o["max_tokens"] or None, numbered=o["line_numbers"], model=o["model"], parts=parts)
    if a.verbose:
        print(verbose(f), file=sys.stderr)
    return doc


def verbose(f: DataFrame, n: int = 20) -> str:
    """The n largest files."""
    return "\n".join(f"{r.size_bytes:>10}  {r.relative_path}" for r in ranking.top(f, n, F.desc("size_bytes"), F.col("relative_path")).select("size_bytes", "relative_path").collect())


def scan(spark: SparkSession, a: argparse.Namespace) -> str:
    f = selected(spark, a)
    got = render.summary(f, os.path.basename(os.path.abspath(a.path)))
    return json.dumps(got, indent=2) + (f"\n{verbose(f)}" if a.verbose else "")


def map_(spark: SparkSession, a: argparse.Namespace) -> str:
    f = selected(spark, a)
    return document.map_text(f, ranked_symbols(f, symbols.extract(f)), a.top)


def info(spark: SparkSession, a: argparse.Namespace) -> str:
    branch, commit = git.head(a.path)
    lang = stats.primary_language(selected(spark, a)).first()[0]
    return json.dumps({"path": os.path.abspath(a.path), "branch": branch, "commit": commit, "primary_language": lang})


def init(spark: SparkSession | None, a: argparse.Namespace) -> str:
    kind = a.format if a.format in ("json", "toml", "yaml") else "json"
    at = a.output or os.path.join(a.path, f".tesserine.{kind}")
    if os.path.exists(at) and not a.force:
        raise FileExistsError(at)
    with open(at, "w", encoding="utf-8") as f:
        f.write(config.render(kind))
    return at


FLAGS = "hidden no-gitignore symbols full include-tests include-docs no-default-ignores verbose token-tree no-directory-structure no-file-summary remove-empty-lines remove-comments include-logs include-diffs sort-by-changes stdin security-check line-numbers no-line-numbers watch redact fail-on-secrets force json".split()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserine")
    sub = p.add_subparsers(dest="command", required=True)
    for name, run in (("pack", pack), ("scan", scan), ("map", map_), ("info", info), ("init", init)):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("path", nargs="?", default=".", help="a folder, or the address of a repository, which is cloned")
        c.add_argument("--format", choices=("json", "toml", "yaml") if run is init else render.FORMATS)
        c.add_argument("--model", choices=document.BUDGET_RATIO)
        c.add_argument("--output")
        c.add_argument("--config")
        c.add_argument("--profile")
        c.add_argument("--max-tokens", type=int)
        c.add_argument("--include", action="append", default=[])
        c.add_argument("--exclude", action="append", default=[])
        c.add_argument("--allow", action="append", default=[])
        c.add_argument("--compression", choices=("none", "minimal", "balanced", "aggressive", "extreme"))
        c.add_argument("--top", "--budget", type=int, default=50, help="symbols in a map")
        c.add_argument("--top-files", type=int, default=0, help="only the first so many files of the walk")
        c.add_argument("--header-text")
        c.add_argument("--instruction-file")
        c.add_argument("--logs-count", type=int, default=10)
        c.add_argument("--days", type=int, default=90, help="history that counts for --sort-by-changes")
        c.add_argument("--remote-branch")
        for flag in FLAGS:
            c.add_argument(f"--{flag}", action="store_true")
    return p


def fetched(a: argparse.Namespace) -> argparse.Namespace:
    """With the path of a clone in place of an address; a folder that exists is never taken for one."""
    if not os.path.exists(a.path) and git.is_address(a.path):
        url, branch, subdir = git.address(a.path)
        a.path = os.path.join(git.clone(url, tempfile.mkdtemp(prefix="tesserine-clone-"), a.remote_branch or branch), subdir or "")
    return a


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(args)
    if a.run is not init:
        spark = spark or SparkSession.builder.appName("tesserine").getOrCreate()
        a = fetched(a)
    out = a.run(spark, a)
    if a.output and a.run is not init:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(out)
    if a.watch:
        watching.follow(lambda: repo.snapshot(a.path), lambda _: main([x for x in (args or sys.argv[1:]) if x != "--watch"], spark))
    return out


if __name__ == "__main__":
    print(main())
