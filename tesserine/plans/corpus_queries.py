"""Queries over a corpus of files: totals, filters, ranking, secrets, chunks, changes, rendering, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text, tokens
from ..operators import changes, chunking, filters, ranking, render, security, stats, symbols
from ..sources import corpus
from ..streaming import watch
from .base import FILES, query, table

_CLAUDE = "CAST(floor(CAST(CAST(strlen(text) AS FLOAT) / CAST(3.5 AS FLOAT) AS FLOAT)) AS BIGINT)"
_LINES = "CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN suffix(text, chr(10)) THEN 0 ELSE 1 END END"
_F32 = "floor(CAST(CAST(strlen(text) AS FLOAT) / CAST({} AS FLOAT) AS FLOAT))"


@query("language_stats", f"SELECT lang AS language, count(*) AS files, CAST(sum({_CLAUDE}) AS BIGINT) AS claude_tokens, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 6) AS percentage FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_language(corpus.documents(spark, sf_dir))


@query("repo_totals", f"SELECT count(*) AS files, CAST(sum({_LINES}) AS BIGINT) AS lines, " + ", ".join(f"CAST(sum({_F32.format(r)}) AS BIGINT) AS {m}" for m, r in zip(tokens.MODELS, tokens.RATIOS["scan"])) + " FROM documents")
def repo_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(corpus.documents(spark, sf_dir))


@query("primary_language", "SELECT lang AS language FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1")
def primary_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.primary_language(corpus.documents(spark, sf_dir))


@query("module_stats", f"SELECT source AS module, count(*) AS files, CAST(sum({_CLAUDE}) AS BIGINT) AS claude_tokens FROM documents GROUP BY source")
def module_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.modules(corpus.documents(spark, sf_dir))


@query("map_token_estimate", "SELECT CAST(25 * count(DISTINCT source) + 10 * count(*) + 100 AS BIGINT) AS tokens FROM documents")
def map_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.documents(spark, sf_dir)
    return f.agg((25 * F.count_distinct(paths.module(F.col("relative_path"))) + 10 * F.count("*") + 100).cast("long").alias("tokens"))


# paths that exercise every list: each document under one of these folders and names
_DIRS = "src lib node_modules docs tests app/api vendor internal/core examples/demo .github a/dist".split()
_FILES = "main.py index.ts README.md package.json test_core.py user_handler.rs app.min.js lib.rs data.csv Cargo.toml types.go setup.cfg image.svg".split()
_MADE = f"(SELECT doc_id, text, lang, [{', '.join(map(repr, _DIRS))}][CAST(doc_id % {len(_DIRS)} AS INTEGER) + 1] || '/d' || doc_id || '/' || [{', '.join(map(repr, _FILES))}][CAST(doc_id % {len(_FILES)} AS INTEGER) + 1] AS path FROM documents)"


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pick = lambda some: F.get(F.array(*map(F.lit, some)), (F.col("doc_id") % len(some)).cast("int"))
    return corpus.files(d, F.concat(pick(_DIRS), F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/"), pick(_FILES)), F.col("text"), F.col("lang"), F.col("doc_id"))


def _parts_sql(dirs: str, names: str) -> str:
    """Files neither under one of these folders nor of one of these names, by the id that made them."""
    no = lambda some, every: ", ".join(str(every.index(x)) for x in some.split())
    return f"SELECT path AS relative_path FROM {_MADE} WHERE doc_id % {len(_DIRS)} NOT IN ({no(dirs, _DIRS)}) AND doc_id % {len(_FILES)} NOT IN ({no(names, _FILES)})"


@query("default_ignores", _parts_sql("node_modules vendor docs tests", "app.min.js data.csv image.svg README.md test_core.py"))
def default_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.default_ignores(made(spark, sf_dir)).select("relative_path")


@query("default_ignores_with_tests_and_docs", _parts_sql("node_modules vendor", "app.min.js data.csv image.svg"))
def default_ignores_with_tests_and_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.default_ignores(made(spark, sf_dir), tests=True, docs=True).select("relative_path")


@query("glob_include", f"SELECT path AS relative_path FROM {_MADE} WHERE path LIKE 'src/%.py' OR regexp_matches(path, '(^|/)[^/]*\\.rs$')")
def glob_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.include(made(spark, sf_dir), ("src/*.py", "**/*.rs")).select("relative_path")


@query("glob_exclude", f"SELECT path AS relative_path FROM {_MADE} WHERE NOT (path LIKE 'docs/%' OR path LIKE '%.m_')")
def glob_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.exclude(made(spark, sf_dir), ("docs/**",), ("*.m?",)).select("relative_path")


@query("size_cap_filter", "SELECT doc_id AS seq FROM documents WHERE strlen(text) <= 5000")
def size_cap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.at_most(corpus.documents(spark, sf_dir), 5000).select("seq")


@query("language_filter", "SELECT doc_id AS seq FROM documents WHERE lang = 'de'")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.of_language(corpus.documents(spark, sf_dir), "de").select("seq")


@query("stdin_semi_join", f"SELECT path AS relative_path FROM {FILES} f WHERE EXISTS (SELECT 1 FROM benchmark b WHERE suffix(f.path, '_' || b.item_id || '.txt'))")
def stdin_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("_"), F.col("item_id").cast("string"), F.lit(".txt")).alias("name"))
    return filters.listed(corpus.documents(spark, sf_dir), names).select("relative_path")


def _any(c: str, some) -> str:
    return "(" + " OR ".join(f"contains({c}, '{x}')" for x in some) + ")"


_NAME = "regexp_extract(lower(path), '[^/]*$')"
_LOW = "lower(path)"
_TIER = (
    f"CASE WHEN {_any(_LOW, ranking.VENDOR)} THEN 0.05 WHEN {_any(_LOW, ranking.TESTS)} THEN 0.15 WHEN {_any(_LOW, ranking.CONFIG)} THEN 0.25 WHEN " + " OR ".join(f"starts_with({_NAME}, '{x}')" for x in ranking.DOCS) + f" THEN 0.35 WHEN {_NAME} IN ({', '.join(map(repr, ranking.CRITICAL))}) THEN 1.0 WHEN "
    + " OR ".join(f"starts_with({_NAME}, '{x}')" for x in ranking.PREFIXES) + f" THEN 0.9 WHEN {_any(_LOW, ranking.CORE)} THEN 0.75 ELSE 0.5 END::DOUBLE"
)
_RANK = f"SELECT path, doc_id, CASE WHEN {_any(_LOW, ranking.VENDOR)} OR {_any(_LOW, ranking.TESTS)} THEN {_TIER} ELSE least(1.0::DOUBLE, least(1.0::DOUBLE, {_TIER} + least((doc_id % 20) / 50.0::DOUBLE, 0.15::DOUBLE)) + CASE WHEN {_any(_NAME, ranking.ROLES)} THEN 0.1::DOUBLE ELSE 0 END) END AS importance FROM {_MADE}"


@query("rank_files", f"SELECT path AS relative_path, round(importance, 6) AS importance FROM ({_RANK})")
def rank_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir).select("relative_path", ranking.importance(F.col("relative_path"), F.col("seq") % 20).alias("importance"))


@query("top_n_files", f"SELECT path AS relative_path, round(importance, 6) AS importance FROM ({_RANK}) ORDER BY round(importance, 6) DESC, doc_id LIMIT 20")
def top_n_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = made(spark, sf_dir).select("relative_path", "seq", ranking.importance(F.col("relative_path"), F.col("seq") % 20).alias("importance"))
    return ranking.top(scored, 20, F.desc("importance"), F.col("seq")).select("relative_path", "importance")


@query("file_index_buckets", f"SELECT CASE WHEN round(importance, 6) > 0.8 THEN 'critical' WHEN round(importance, 6) > 0.6 THEN 'high' WHEN round(importance, 6) > 0.3 THEN 'normal' ELSE 'low' END AS bucket, count(*) AS files FROM ({_RANK}) GROUP BY 1")
def file_index_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir).groupBy(paths.bucket(ranking.importance(F.col("relative_path"), F.col("seq") % 20)).alias("bucket")).agg(F.count("*").alias("files"))


_SCORE = (
    "1000 - CASE WHEN " + " OR ".join(f"suffix(path, '{x}')" for x in ranking.FAST_ENTRY) + f" THEN 5000 ELSE 0 END - CASE WHEN {_any('path', ranking.FAST_CONFIG)} THEN 3000 ELSE 0 END - CASE WHEN regexp_matches(path, '^(src|lib|pkg)/') THEN 1000 ELSE 0 END"
    + "".join(f" + CASE WHEN {_any('path', some)} THEN {add} ELSE 0 END" for add, some in ranking._FAST) + " + (length(path) - length(replace(path, '/', ''))) * 50 + strlen(regexp_extract(path, '[^/]*$')) // 5"
)


@query("rank_files_fast", f"SELECT path AS relative_path, score, position, round(1 - position::DOUBLE / total, 6) AS importance FROM (SELECT path, score, row_number() OVER (ORDER BY score, doc_id) - 1 AS position, count(*) OVER () AS total FROM (SELECT path, doc_id, CAST({_SCORE} AS BIGINT) AS score FROM {_MADE}))")
def rank_files_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_fast(made(spark, sf_dir))


_KINDS = ["class", "function", "enum", "type", "import", "method", "constant"]


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % len(_KINDS)).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), (F.col("p_partkey") % 13).alias("references"), F.col("p_size").cast("long").alias("lines"), (F.col("p_retailprice") / 10000).alias("file_importance"), F.col("p_brand").alias("file"))


_SYMS = f"(SELECT p_partkey AS id, [{', '.join(map(repr, _KINDS))}][CAST(p_partkey % {len(_KINDS)} AS INTEGER) + 1] AS kind, p_partkey % 13 AS refs, p_size AS lines, p_retailprice / 10000 AS fi, p_brand AS file FROM part)"
_WEIGHT = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {w}" for k, w in ranking.KIND_WEIGHT.items()) + " ELSE 0.3 END::DOUBLE"


@query("symbol_rank", f"SELECT id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.4::DOUBLE * (refs::DOUBLE / (SELECT max(refs) FROM {_SYMS})) + 0.25::DOUBLE * {_WEIGHT} + 0.2::DOUBLE * fi + 0.15::DOUBLE * (lines::DOUBLE / (SELECT max(lines) FROM {_SYMS})))), 6) AS score FROM {_SYMS}")
def symbol_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_symbols(_symbols(spark, sf_dir)).select("id", "score")


@query("ranking_stats", f"SELECT kind, count(*) AS symbols, max(refs) AS most_references, CAST(max(lines) AS BIGINT) AS most_lines FROM {_SYMS} GROUP BY kind")
def ranking_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("symbols"), F.max("references").alias("most_references"), F.max("lines").alias("most_lines"))


@query("file_symbol_importance", f"SELECT file, round(avg(fi), 6) AS importance FROM {_SYMS} GROUP BY file")
def file_symbol_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir).groupBy("file").agg(F.round(F.avg("file_importance"), 6).alias("importance"))


_RULES = " UNION ALL ".join(f"SELECT path, line, '{k}' AS kind, '{s}' AS severity, regexp_extract(t, '{p.replace(chr(39), chr(39) * 2)}', 0) AS m FROM live" for k, s, p in security.RULES)
_RK = "least(4, length(m) // 4)"
_FOUND = f"""WITH lines AS (SELECT path, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM {FILES}),
live AS (SELECT * FROM lines WHERE NOT regexp_matches(regexp_replace(t, '^\\s+', ''), '^(//|#|\\*)') AND NOT regexp_matches(t, 'example|placeholder|xxxxx')),
hits AS (SELECT * FROM ({_RULES}) WHERE m <> ''),
found AS (SELECT path AS relative_path, CAST(line AS BIGINT) AS line, kind, severity, CASE WHEN length(m) <= 8 THEN repeat('*', length(m)) ELSE substring(m, 1, {_RK}) || repeat('*', length(m) - 2 * {_RK}) || substring(m, length(m) - {_RK} + 1, {_RK}) END AS pattern FROM hits)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.findings(corpus.documents(spark, sf_dir))


@query("secret_findings", f"{_FOUND} SELECT * FROM found")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


@query("secret_summary", f"{_FOUND} SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM found")
def secret_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.summary(_found(spark, sf_dir))


@query("secret_safe_files", f"{_FOUND} SELECT path AS relative_path FROM {FILES} WHERE path NOT IN (SELECT relative_path FROM found)")
def secret_safe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.documents(spark, sf_dir)
    return security.safe(f, security.findings(f)).select("relative_path")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tokens.count(F.col("text"), "claude").alias("tokens"))


_FOLD = f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {_CLAUDE} AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, turn, k, n AS s, CAST(0 AS BIGINT) AS chunk FROM t WHERE k = 1 UNION ALL
SELECT t.conv_id, t.turn, t.k, CASE WHEN f.s + t.n > 300 THEN t.n ELSE f.s + t.n END, f.chunk + CASE WHEN f.s + t.n > 300 THEN 1 ELSE 0 END FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)"""


@query("chunk_fixed", f"{_FOLD} SELECT conv_id, turn, chunk FROM f")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed(_turns(spark, sf_dir), "conv_id", "turn", "tokens", 300).select("conv_id", "turn", "chunk")


@query("chunk_context", f"{_FOLD}, c AS (SELECT conv_id, chunk, 'chunk ' || chunk AS focus FROM f GROUP BY conv_id, chunk) SELECT conv_id, chunk, count(*) OVER (PARTITION BY conv_id) AS total, 'Previous: ' || lag(focus) OVER w AS previous, 'Next: Chunk ' || (lead(chunk) OVER w + 1) AS next FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY chunk)")
def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk_fixed(spark, sf_dir).select("conv_id", "chunk").distinct().withColumn("focus", F.concat(F.lit("chunk "), F.col("chunk").cast("string")))
    return chunking.context(c, "conv_id", "chunk", "focus").drop("focus")


@query("chunk_file", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk FROM conversations")
def chunk_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.per_file(_turns(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "chunk")


@query("chunk_module", f"SELECT source AS module, count(*) AS files, CAST(sum({_CLAUDE}) AS BIGINT) AS tokens, row_number() OVER (ORDER BY source) - 1 AS chunk FROM documents GROUP BY source")
def chunk_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.documents(spark, sf_dir).withColumn("tokens", tokens.count(F.col("content"), "claude"))
    return chunking.by_module(f, paths.module(F.col("relative_path")), "tokens")


@query("chunk_semantic")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.documents(spark, sf_dir).withColumn("tokens", tokens.count(F.col("content"), "claude"))
    return chunking.semantic(f, "language", "relative_path", paths.module(F.col("relative_path")), "tokens", most=8000)


@query("chunk_lines")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_windows(corpus.documents(spark, sf_dir), 4096)


@query("change_frequency", "SELECT user_id AS path, count(*) AS changes FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY user_id")
def change_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.frequency(table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts"), 30)


@query("sort_by_changes", "SELECT doc_id, coalesce(n, 0) AS changes FROM documents LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON doc_id = user_id ORDER BY 2 DESC, 1")
def sort_by_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.join(n, d["doc_id"] == n["user_id"], "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("changes")).orderBy(F.desc("changes"), "doc_id")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = corpus.documents(spark, sf_dir).select("relative_path", "seq", "size_bytes")
    old = f.where("seq % 7 <> 0").select("relative_path", F.col("seq").alias("mtime"), "size_bytes")
    new = f.where("seq % 5 <> 0").select("relative_path", (F.col("seq") + F.when(F.col("seq") % 3 == 0, 1).otherwise(0)).alias("mtime"), (F.col("size_bytes") + F.when(F.col("seq") % 11 == 0, 1).otherwise(0)).alias("size_bytes"))
    return old, new


@query("cache_rescan", f"SELECT path AS relative_path FROM {FILES} WHERE doc_id % 5 <> 0 AND (doc_id % 7 = 0 OR doc_id % 3 = 0 OR doc_id % 11 = 0)")
def cache_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return changes.to_rescan(new, old).select("relative_path")


@query("cache_deleted", f"SELECT path AS relative_path FROM {FILES} WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0")
def cache_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return changes.deleted(new, old).select("relative_path")


@query("cache_stats", "SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query("scan_json_stats", "SELECT '{\"files\":' || count(*) || ',\"bytes\":' || CAST(sum(strlen(text)) AS BIGINT) || '}' AS json FROM documents")
def scan_json_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_stats(spark, sf_dir).select(F.to_json(F.struct("files", "bytes")).alias("json"))


@query("directory_tree", f"SELECT DISTINCT p AS prefix, d AS depth FROM (SELECT source AS p, 0 AS d FROM documents UNION ALL SELECT source || '/' || lang, 1 FROM documents UNION ALL SELECT path, 2 FROM {FILES})")
def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.tree_rows(corpus.documents(spark, sf_dir)).select("prefix", "depth")


@query("verbose_list", f"SELECT path AS relative_path, CAST(strlen(text) AS BIGINT) AS size_bytes FROM {FILES} ORDER BY strlen(text) DESC, doc_id LIMIT 20")
def verbose_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(corpus.documents(spark, sf_dir), 20, F.desc("size_bytes"), F.col("seq")).select("relative_path", "size_bytes")


@query("render_xml_blocks", f"SELECT path AS relative_path, '<file path=\"' || path || '\" language=\"' || lang || '\" tokens=\"' || {_CLAUDE} || '\"><![CDATA[' || chr(10) || replace(text, ']]>', ']]]]><![CDATA[>') || chr(10) || ']]></file>' AS block FROM {FILES}")
def render_xml_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.blocks(corpus.documents(spark, sf_dir), "xml").select("relative_path", "block")


@query("render_markdown_blocks", f"SELECT path AS relative_path, '## ' || path || chr(10) || chr(10) || '```' || lang || chr(10) || text || chr(10) || '```' AS block FROM {FILES}")
def render_markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.blocks(corpus.documents(spark, sf_dir), "markdown").select("relative_path", "block")


@query("render_plain_blocks", f"SELECT path AS relative_path, '=== ' || path || ' ===' || chr(10) || text AS block FROM {FILES}")
def render_plain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.blocks(corpus.documents(spark, sf_dir), "plain").select("relative_path", "block")


_GEMINI = _F32.format(3.8)
_QUOTED = "replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
_RISKY = "text = '' OR text <> trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) OR text IN ('true', 'false', 'null') OR try_cast(text AS DOUBLE) IS NOT NULL OR contains(text, ',') OR contains(text, '|') OR contains(text, '\"') OR contains(text, chr(10)) OR contains(text, chr(13)) OR contains(text, chr(9))"
for _format, _sql in (
    ("json", "to_json({'path': path, 'language': lang, 'token_count': {" + ", ".join(f"'{m}': CAST({_F32.format(r)} AS BIGINT)" for m, r in zip(tokens.MODELS, tokens.RATIOS["scan"])) + "}, 'content': text})::VARCHAR"),
    ("yaml", f"'  - path: \"' || path || '\"' || chr(10) || '    language: ' || coalesce(lang, '') || chr(10) || '    tokens: ' || CAST({_GEMINI} AS BIGINT) || chr(10) || '    content: |' || chr(10) || '      ' || replace(text, chr(10), chr(10) || '      ')"),
    ("toon", f"path || ',' || coalesce(lang, '') || ',' || {_CLAUDE} || ',' || CASE WHEN {_RISKY} THEN '\"' || {_QUOTED} || '\"' ELSE text END"),
):

    @query(f"render_{_format}_blocks", f"SELECT path AS relative_path, {_sql} AS block FROM {FILES}")
    def _blocks(spark: SparkSession, sf_dir: str, form: str = _format) -> DataFrame:
        return render.blocks(corpus.documents(spark, sf_dir), form).select("relative_path", "block")


@query("watch_stream", f"SELECT lang AS language, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def watch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.language_totals(spark, f"{sf_dir}/documents.parquet")


@query(
    "symbols_extract",
    "SELECT '' || doc_id AS relative_path, 'f' || doc_id AS name, 'function' AS kind, 'def f' || doc_id || '(x: int)' AS signature, NULL::VARCHAR AS docstring, 1::BIGINT AS start_line, 2::BIGINT AS end_line, NULL::VARCHAR AS parent FROM documents UNION ALL SELECT '' || doc_id, 'C' || doc_id, 'class', 'class C' || doc_id, NULL, 4, 6, NULL FROM documents UNION ALL "
    "SELECT '' || doc_id, 'm', 'method', 'def m(self)', ltrim(translate(text, chr(39) || chr(92) || chr(10), '   ')), 5, 6, 'C' || doc_id FROM documents",
)
def symbols_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    code = F.concat(F.lit("def f"), F.col("doc_id").cast("string"), F.lit("(x: int):\n    return x\n\nclass C"), F.col("doc_id").cast("string"), F.lit(":\n    def m(self):\n        '''"), F.translate("text", "'\\\n", "   "), F.lit("'''\n"))
    return symbols.extract(d.select(F.col("doc_id").alias("relative_path"), F.lit("python").alias("language"), code.alias("content")))
