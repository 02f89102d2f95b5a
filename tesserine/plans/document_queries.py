"""Queries for the repository map and for the parts of a context document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text, tokens
from ..operators import chunking, overview, ranking, render, repomap, security, stats
from ..sources import corpus
from .base import FILES, query, table
from .corpus_queries import _CLAUDE, _DIRS, _FILES, _KINDS, _MADE, _RANK, _SYMS, _WEIGHT, _symbols, made


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: a name is that of a part's type, a file its brand; imports name a type."""
    p = table(spark, sf_dir, "part")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % len(_KINDS)).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("seq"), kind.alias("kind"))


_NAMED = f"(SELECT p_partkey AS id, p_type AS name, p_brand AS file, [{', '.join(map(repr, _KINDS))}][CAST(p_partkey % {len(_KINDS)} AS INTEGER) + 1] AS kind FROM part)"
_INDEX = f"(SELECT name, arg_max(file, id) AS file FROM {_NAMED} GROUP BY name)"


@query("symbol_index", f"SELECT name, file FROM {_INDEX}")
def symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repomap.symbol_index(_named(spark, sf_dir))


_EDGES = f"SELECT s.file AS src, i.file AS dst FROM {_NAMED} s JOIN {_INDEX} i ON s.name = i.name WHERE s.kind = 'import' AND s.file <> i.file"


@query("import_symbol_edges", f"SELECT src, dst, count(*) AS many FROM ({_EDGES}) GROUP BY src, dst")
def import_symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _named(spark, sf_dir)
    return repomap.import_edges(s, repomap.symbol_index(s)).groupBy("src", "dst").agg(F.count("*").alias("many"))


_RANKED = f"(SELECT id, file, name, max_rank AS rank FROM (SELECT *, arg_max(r, id) OVER (PARTITION BY file, name) AS max_rank FROM (SELECT id, file, name, p_retailprice AS r FROM {_NAMED} JOIN part ON id = p_partkey)))"


def _with_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("rank"))
    return repomap.symbol_ranks(_named(spark, sf_dir), ranks)


@query("symbol_to_rank", f"SELECT id, rank FROM {_RANKED}")
def symbol_to_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_ranks(spark, sf_dir).select("id", "rank")


@query("top_symbols", f"SELECT id, name, rank, row_number() OVER (ORDER BY rank DESC, id) AS position FROM {_RANKED} QUALIFY position <= 50")
def top_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repomap.top_symbols(_with_ranks(spark, sf_dir)).select("id", "name", "rank", "position")


@query("file_importance_blend", f"SELECT file, round((avg(fi) + avg(round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.4::DOUBLE * (refs::DOUBLE / (SELECT max(refs) FROM {_SYMS})) + 0.25::DOUBLE * {_WEIGHT} + 0.2::DOUBLE * fi + 0.15::DOUBLE * (lines::DOUBLE / (SELECT max(lines) FROM {_SYMS})))), 6))) / 2, 6) AS importance FROM {_SYMS} GROUP BY file")
def file_importance_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    files = s.groupBy("file").agg(F.avg("file_importance").alias("importance"))
    return repomap.blend_file_importance(files, ranking.rank_symbols(s))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir).withColumn("importance", ranking.importance(F.col("relative_path"), F.col("seq") % 20))


_BUCKET = "CASE WHEN round(importance, 6) > 0.8 THEN 0 WHEN round(importance, 6) > 0.6 THEN 1 WHEN round(importance, 6) > 0.3 THEN 2 ELSE 3 END"


@query("file_index", f"SELECT path AS relative_path, ['critical', 'high', 'normal', 'low'][b + 1] AS bucket, {_CLAUDE} AS tokens, row_number() OVER (ORDER BY b, doc_id) - 1 AS position FROM (SELECT path, r.doc_id, text, {_BUCKET} AS b FROM ({_RANK}) r JOIN documents USING (doc_id))")
def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repomap.file_index(_scored(spark, sf_dir))


@query("project_type", "SELECT CASE r_regionkey WHEN 0 THEN 'Rust Library' WHEN 1 THEN 'Rust Application' WHEN 2 THEN 'Backend API (Node.js)' WHEN 3 THEN 'Python Package' ELSE 'Go Application' END AS project_type, r_regionkey AS region FROM region")
def project_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree a region: its manifest at the root, and a file of each nation."""
    root = F.get(F.array(*map(F.lit, ("Cargo.toml", "Cargo.toml", "package.json", "setup.py", "go.mod"))), F.col("r_regionkey"))
    hint = F.get(F.array(*map(F.lit, ("src/lib.rs", "src/main.rs", "src/routes/a.js", "src/a.py", "a.go"))), F.col("r_regionkey"))
    regions = table(spark, sf_dir, "region")
    out = None
    for k in range(5):  # the five regions of the schema
        one = regions.where(F.col("r_regionkey") == k).select(F.explode(F.array(root, hint)).alias("relative_path"))
        row = overview.project_type(one).withColumn("region", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return out.join(regions.select(F.col("r_regionkey").alias("region")), "region", "left_semi").select("project_type", "region")


_ENTRY = ("main.py", "index.ts", "lib.rs")


@query("entry_points", f"SELECT path AS relative_path, CASE WHEN contains(path, 'main') THEN 'main' WHEN contains(path, 'index') THEN 'index' WHEN contains(path, 'app') THEN 'app' WHEN contains(path, 'server') THEN 'server' ELSE 'library' END AS type, {_CLAUDE} AS tokens FROM {_MADE} WHERE doc_id % {len(_FILES)} IN ({', '.join(str(_FILES.index(x)) for x in _ENTRY)}) ORDER BY doc_id LIMIT 10")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.entry_points(made(spark, sf_dir))


@query("entry_types", f"SELECT path AS relative_path, doc_id % {len(_FILES)} IN ({', '.join(str(_FILES.index(x)) for x in _ENTRY)}) AS entry FROM {_MADE}")
def entry_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir).select("relative_path", paths.is_entry_point(F.col("relative_path")).alias("entry"))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names, every third at the root, every third one folder down, the others two."""
    f = made(spark, sf_dir)
    name = F.element_at(F.split("relative_path", "/"), -1)
    return f.withColumn("relative_path", F.when(F.col("seq") % 3 == 0, F.concat(F.lit(""), name)).when(F.col("seq") % 3 == 1, F.concat(F.lit("d"), "seq", F.lit("/"), name)).otherwise(F.concat(F.lit("a/d"), "seq", F.lit("/"), name)))


@query("config_files", f"SELECT CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'd' || doc_id || '/' END || [{', '.join(map(repr, _FILES))}][CAST(doc_id % {len(_FILES)} AS INTEGER) + 1] AS relative_path, {_CLAUDE} AS tokens FROM documents WHERE doc_id % 3 < 2 AND doc_id % {len(_FILES)} IN ({', '.join(str(_FILES.index(x)) for x in ('package.json', 'Cargo.toml', 'setup.cfg'))})")
def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.config_files(_flat(spark, sf_dir))


@query("token_tree", f"SELECT '| ' || path || ' | ' || {_CLAUDE} || ' |' AS line FROM {FILES}")
def token_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.token_tree(corpus.documents(spark, sf_dir)).select("line")


@query("scan_counters", f"SELECT count(*) FILTER (NOT bin AND n <= 5000) AS scanned, CAST(coalesce(sum(n) FILTER (NOT bin AND n <= 5000), 0) AS BIGINT) AS bytes, count(*) FILTER (bin) AS skipped_binary, count(*) FILTER (NOT bin AND n > 5000) AS skipped_size FROM (SELECT suffix(path, '.svg') AS bin, strlen(text) AS n FROM {_MADE})")
def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.scan_counters(made(spark, sf_dir), 5000)


@query("markdown_tree", f"SELECT '- 📁 ' || source AS line, source AS prefix FROM documents GROUP BY source UNION ALL SELECT '  - 📁 ' || lang, source || '/' || lang FROM documents GROUP BY source, lang UNION ALL SELECT '    - 📄 doc_' || doc_id || '.txt', path FROM {FILES}")
def markdown_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.emoji_tree(corpus.documents(spark, sf_dir)).select("line", "prefix")


@query("top_files_limit", f"SELECT path AS relative_path FROM {_MADE} ORDER BY doc_id LIMIT 25")
def top_files_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_files(made(spark, sf_dir), 25).select("relative_path")


@query("numbered_xml_lines", f"SELECT path AS relative_path, array_to_string(list_transform(CASE WHEN text = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END, lambda x, i: lpad(CAST(i AS VARCHAR), CAST(greatest(4, length(CAST(i AS VARCHAR))) AS INTEGER), ' ') || ' | ' || x), chr(10)) AS text FROM {FILES}")
def numbered_xml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).select("relative_path", render.number_lines(F.col("content")).alias("text"))


for _form, _sql in (
    ("xml", "'<file path=\"' || path || '\">' || chr(10) || replace(text, ']]>', ']]]]><![CDATA[>') || chr(10) || '</file>'"),
    ("markdown", "'### ' || path || chr(10) || '```' || coalesce(lang, '') || chr(10) || text || chr(10) || '```'"),
    ("plain", "'--- ' || path || ' ---' || chr(10) || text"),
):

    @query(f"small_context_{_form}", f"SELECT path AS relative_path, {_sql} AS block FROM {FILES}")
    def _small(spark: SparkSession, sf_dir: str, form: str = _form) -> DataFrame:
        return render.small_blocks(corpus.documents(spark, sf_dir), form)


#: A line for each rule of the secret scan, and two that are none.
_PLANTS = (
    ("aws_credential", "critical", "id = AKIA" + "Q7" * 8), ("aws_credential", "critical", "aws_secret_access_key = " + "aB3/" * 10), ("github_token", "critical", "use ghp_" + "a1B2" * 9 + " now"),
    ("github_token", "critical", "github_pat_" + "A1" * 11 + "_" + "b2C" * 19 + "zz"), ("private_key", "critical", "-----BEGIN RSA PRIVATE KEY-----"), ("api_key", "high", "api_key: " + "k3Y-" * 6), ("generic", "high", "token = " + "t0K_" * 6),
    ("password", "high", "password = hunter2hunter2"), ("connection_string", "high", "at postgres://u:p@h/db ok"), ("access_token", "high", "eyJhb.eyJzd.sig-1"), ("access_token", "high", "xoxb-" + "1" * 11 + "-" + "2" * 12 + "-" + "aB" * 12), ("api_key", "critical", "sk_live_" + "z9" * 12),
    (None, None, "nothing to see"), (None, None, "# password = hunter2hunter2"),
)


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lines = F.array(*(F.lit(x[2]) for x in _PLANTS))
    return corpus.files(d, F.concat(F.lit("d"), "doc_id"), F.concat(F.get(lines, (F.col("doc_id") % len(_PLANTS)).cast("int")), F.lit("\n"), F.coalesce("text", F.lit(""))), F.col("lang"), F.col("doc_id"))


_PLANTED = "CASE doc_id % 14 " + " ".join(f"WHEN {i} THEN {{}}".format(repr(k)) for i, (k, _, _) in enumerate(_PLANTS) if k) + " END"
_LEVELS = "CASE doc_id % 14 " + " ".join(f"WHEN {i} THEN {s!r}" for i, (_, s, _) in enumerate(_PLANTS) if s) + " END"


@query("secret_rules", f"SELECT 'd' || doc_id AS relative_path, {_PLANTED} AS kind, {_LEVELS} AS severity FROM documents WHERE doc_id % 14 < 12")
def secret_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule on a line of its own kind, put in front of every text."""
    return security.findings(_planted(spark, sf_dir)).where("line = 1").select("relative_path", "kind", "severity")


@query("secret_allowed", f"SELECT 'd' || doc_id AS relative_path, {_PLANTED} AS kind FROM documents WHERE doc_id % 14 < 12 AND doc_id % 14 NOT IN (2, 8)")
def secret_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = security.findings(_planted(spark, sf_dir), allowed=("ghp_", "postgres://u"))
    return found.where("line = 1").select("relative_path", "kind")


@query("secret_report", f"SELECT '- [' || CASE {_LEVELS} WHEN 'critical' THEN 'Critical' ELSE 'High' END || '] ' || {_PLANTED} || ' in d' || doc_id || ' (line 1)' AS line FROM documents WHERE doc_id % 14 < 12")
def secret_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.report_lines(security.findings(_planted(spark, sf_dir)).where("line = 1")).select("line")


@query("chunk_focus", "SELECT doc_id // 3 AS chunk, CASE WHEN count(DISTINCT source) = 1 THEN min(source) || ' module' WHEN count(DISTINCT lang) = 1 THEN min(lang) || ' files' ELSE 'Mixed content' END AS focus FROM documents GROUP BY doc_id // 3")
def chunk_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.documents(spark, sf_dir)
    return f.groupBy(F.floor(F.col("seq") / 3).alias("chunk")).agg(chunking.focus(paths.module(F.col("relative_path")), F.col("language"), F.col("relative_path")).alias("focus"))


@query("wasm_stats", f"SELECT count(*) AS files, " + ", ".join(f"CAST(sum(ceil(strlen(text)::DOUBLE / {r}::DOUBLE)) AS BIGINT) AS {m}" for m, r in zip(tokens.MODELS, tokens.RATIOS["wasm"])) + " FROM documents")
def wasm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(corpus.documents(spark, sf_dir), "wasm").drop("lines")


@query("size_only_estimate", "SELECT doc_id, CAST(ceil(n_chars::DOUBLE / 4.0::DOUBLE) AS BIGINT) AS tokens FROM documents")
def size_only_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the size alone: the text is never read."""
    return table(spark, sf_dir, "documents").select("doc_id", tokens.of_size(F.col("n_chars"), 4.0, "wasm").alias("tokens"))


@query("compression_level", "SELECT doc_id, text FROM documents")
def compression_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No compression on even ids; on odd ones the least of all levels, over texts whose every line says something."""
    d = table(spark, sf_dir, "documents")
    padded = F.concat(F.replace("text", F.lit("\n"), F.lit("\n \n\t\n")), F.lit("\n\n"))
    bare = text.compress(F.regexp_replace(padded, r"\n\s*\n", "\n\n"), F.col("lang"), "minimal")
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, text.compress(F.col("text"), F.col("lang"), "none")).otherwise(bare).alias("text"))


@query("critical_gate", f"SELECT min('d' || doc_id) AS first FROM documents WHERE {_LEVELS} = 'critical'")
def critical_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that the gate names: the first by path with a critical finding."""
    found = security.findings(_planted(spark, sf_dir)).where("line = 1")
    return found.where("severity = 'critical'").agg(F.min("relative_path").alias("first"))
