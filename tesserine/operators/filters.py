"""File filters: default ignores, tests, documentation, globs, size, language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import matches_any

_FOLDERS = "__generated__ __pycache__ __snapshots__ _build .cache .git .hg .idea .netlify .next .npm .nuxt .nyc_output .output .pnpm .svelte-kit .svn .temp .tmp .venv .vercel .vscode .yarn bower_components build coverage dist generated htmlcov jspm_packages logs node_modules out target temp tmp vendor venv"
_ENDINGS = "ai arrow avi avif backup bak bmp bundle.js chunk.js csv d.ts.map db eot feather fig flv g.dart gen.js gen.ts gif ico iml jpeg jpg lcov log min.css min.js min.map mkv mov mp3 mp4 ogg otf parquet pb.go pdf png psd pyc pyd pyo sketch snap sqlite sqlite3 svg swo swp tiff ttf wasm wav webm webp woff woff2"
_NAMES = "*_generated.go *.generated.* *~ .coverage .DS_Store .env .env.* bun.lockb Cargo.lock composer.lock flake.lock Gemfile.lock lcov.info npm-debug.log* package-lock.json Pipfile.lock pnpm-lock.yaml poetry.lock Thumbs.db yarn-debug.log* yarn-error.log* yarn.lock"
IGNORED = tuple([f"{x}/**" for x in _FOLDERS.split()] + [f"*.{x}" for x in _ENDINGS.split()] + _NAMES.split())
TESTS = tuple(f"**/{x}" for x in "*_test.* *_test/** *.spec.* *.stories.* *.story.* *.test.* __fixtures__/** __mocks__/** __tests__/** conftest.py fixtures/** mocks/** spec/** specs/** test_*.* test-data/** test/** testdata/** tests/**".split())
DOCS = tuple("*.md *.mdx *.rst AUTHORS* CHANGELOG* CODE_OF_CONDUCT* CONTRIBUTING* CONTRIBUTORS* doc/** docs/** documentation/** HISTORY*".split())
MAX_BYTES = 50 << 20


def keeps(path: Column, *, tests: bool = False, docs: bool = False) -> Column:
    """Whether the default ignores let a path through."""
    return ~matches_any(path, IGNORED + (() if tests else TESTS) + (() if docs else DOCS))


def default_ignores(files: DataFrame, **settings) -> DataFrame:
    return files.where(keeps(F.col("relative_path"), **settings))


def include(files: DataFrame, globs: tuple[str, ...]) -> DataFrame:
    return files.where(matches_any(F.col("relative_path"), globs)) if globs else files


def exclude(files: DataFrame, globs: tuple[str, ...], more: tuple[str, ...] = ()) -> DataFrame:
    every = tuple(dict.fromkeys((*globs, *more)))
    return files.where(~matches_any(F.col("relative_path"), every)) if every else files


def at_most(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    return files.where(F.col("size_bytes") <= max_bytes)


def of_language(files: DataFrame, language: str) -> DataFrame:
    return files.where(F.col("language") == language)


def listed(files: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Files whose path is, or ends with, a listed name.  The ends of a path that are as long as some
    listed name are joined by equality: a hash join, where ``endswith`` would be a nested loop."""
    wanted = names.select(F.col(name).alias("_name")).where("_name is not null and _name <> ''").distinct()
    lengths = [r[0] for r in wanted.select(F.length("_name")).distinct().collect()]  # no more than a path has characters
    own = F.filter(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: n <= F.length("relative_path"))
    ends = files.select("relative_path", F.explode(F.transform(own, lambda n: F.right(F.col("relative_path"), n))).alias("_name"))
    hit = ends.join(wanted, "_name", "left_semi").select("relative_path").distinct()
    return files.join(hit, "relative_path", "left_semi")
