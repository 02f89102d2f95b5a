"""History of a local git repository as tables, through the ``git`` program on the driver; remote repositories by clone."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

_STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "?": "added"}


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout


def head(root: str) -> tuple[str | None, str | None]:
    """(branch, commit) from the files of ``.git`` alone; a detached head has no branch."""
    base = os.path.join(root, ".git")
    if not os.path.isfile(os.path.join(base, "HEAD")):
        return None, None
    with open(os.path.join(base, "HEAD")) as f:
        ref = f.read().strip()
    if not ref.startswith("ref: "):
        return None, ref[:7]
    name = ref.removeprefix("ref: ")
    commit = None
    if os.path.isfile(at := os.path.join(base, name)):
        with open(at) as f:
            commit = f.read().strip()[:7]
    elif os.path.isfile(at := os.path.join(base, "packed-refs")):
        with open(at) as f:
            commit = next((x.split()[0][:7] for x in f if x.strip().endswith(" " + name)), None)
    return name.removeprefix("refs/heads/"), commit


def log(spark: SparkSession, root: str, last: int = 100, path: str | None = None) -> DataFrame:
    """Commits, newest first: hash, short, author, email, date, message."""
    out = git(root, "log", f"-{last}", "--date=short", "--format=%H%x1f%h%x1f%an%x1f%ae%x1f%ad%x1f%s", *(["--follow", "--", path] if path else []))
    return spark.createDataFrame([tuple(x.split("\x1f")) for x in out.split("\n") if x], "hash string, short string, author string, email string, date string, message string")


def changes(spark: SparkSession, root: str) -> DataFrame:
    """(path, ts) for every change of every file: one pass over the log, not one for each file."""
    rows, at = [], 0
    for x in git(root, "log", "--format=%x1e%ct", "--name-only").split("\n"):
        if x.startswith("\x1e"):
            at = int(x[1:])
        elif x:
            rows.append((x, at))
    return spark.createDataFrame(rows, "path string, epoch long").selectExpr("path", "timestamp_seconds(epoch) ts")


def status(spark: SparkSession, root: str) -> DataFrame:
    rows = []
    for x in git(root, "status", "--porcelain").splitlines():
        mark = x[1] if x[1] != " " else x[0]  # staged changes count too
        rows.append((x[3:].split(" -> ")[-1], _STATUS.get(mark, "unknown")))
    return spark.createDataFrame(rows, "path string, status string")


def diff(spark: SparkSession, root: str, old: str, new: str) -> DataFrame:
    """(path, status, added, removed) of each file that differs; no counts for binary files."""
    kinds = {x.split("\t")[-1]: _STATUS.get(x[0], "unknown") for x in git(root, "diff", "--no-renames", "--name-status", old, new).splitlines() if x}
    rows = []
    for x in git(root, "diff", "--no-renames", "--numstat", old, new).splitlines():
        a, d, p = x.split("\t", 2)
        rows.append((p, kinds.get(p, "unknown"), None if a == "-" else int(a), None if d == "-" else int(d)))
    return spark.createDataFrame(rows, "path string, status string, added long, removed long")


def is_repo(root: str) -> bool:
    return subprocess.run(["git", "-C", root, "rev-parse", "--git-dir"], capture_output=True).returncode == 0


def tracked(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in git(root, "ls-files", "-z").split("\0") if x], "path string")


def diff_text(root: str, old: str, new: str, path: str) -> str:
    return git(root, "diff", old, new, "--", path)


def has_changes(root: str, path: str) -> bool:
    return bool(git(root, "status", "--porcelain", "--", path).strip())


def last_commit(root: str, path: str) -> tuple[str, str, str] | None:
    """(short hash, date, message) of the last commit that changed a file, or None."""
    out = git(root, "log", "-1", "--date=short", "--format=%h%x1f%ad%x1f%s", "--", path).strip()
    return tuple(out.split("\x1f")) if out else None


def short(root: str, revision: str = "HEAD") -> str:
    return git(root, "rev-parse", "--short", revision).strip()


_FORGES = {"github": "github.com", "gitlab": "gitlab.com", "bitbucket": "bitbucket.org"}


def is_address(text: str) -> bool:
    return re.match(r"(https?|git|ssh)://|git@|(github|gitlab|bitbucket):|[\w-][\w.-]*/[\w.-]+$", text) is not None


def address(text: str) -> tuple[str, str | None, str | None]:
    """(URL to clone, branch, folder) of an address as people write it."""
    if m := re.match(r"(github|gitlab|bitbucket):(.+)$", text):
        text = f"https://{_FORGES[m[1]]}/{m[2]}"
    elif re.match(r"[\w-][\w.-]*/[\w.-]+$", text):
        text = f"https://github.com/{text}"
    if m := re.match(r"(https?://[^/]+/[^/]+/[^/]+)/(?:-/)?(?:tree|blob)/([^/]+)(?:/(.+))?$", text):
        return m[1], m[2], m[3]
    return text, None, None


def blame(spark: SparkSession, root: str, path: str) -> DataFrame:
    rows, commit, line, author = [], "", 0, {}
    for x in git(root, "blame", "--porcelain", path).splitlines():
        if x.startswith("\t"):
            rows.append((line, commit[:8], author.get(commit)))
        elif x.startswith("author "):
            author[commit] = x.removeprefix("author ")
        elif len(parts := x.split()) >= 3 and len(parts[0]) == 40:
            commit, line = parts[0], int(parts[2])
    return spark.createDataFrame(rows, "line long, commit string, author string")


def clone(url: str, target: str, branch: str | None = None, sparse: tuple[str, ...] = ()) -> str:
    """A shallow clone; a target that holds anything is refused, never cleared."""
    if os.path.isdir(target) and os.listdir(target):
        raise FileExistsError(f"{target} is not empty")
    picked = ["--branch", branch] if branch else []
    subprocess.run(["git", "clone", "--depth", "1", "--single-branch", *picked, *(["--sparse", "--filter=blob:none"] if sparse else []), "--", url, target], check=True, capture_output=True)
    if sparse:
        git(target, "sparse-checkout", "set", *sparse)
    return target
