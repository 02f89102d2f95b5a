"""Queries over single texts and paths: tokens, escapes, transforms, parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text, tokens
from ..sources import corpus
from .base import FILES, query, table


def _tokens(name: str, variant: str, sql_of) -> None:
    cols = ", ".join(f"CAST({sql_of(r)} AS BIGINT) AS {m}" for m, r in zip(tokens.MODELS, tokens.RATIOS[variant]))

    @query(name, f"SELECT doc_id, {cols} FROM documents")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", *(tokens.count(F.col("text"), m, variant).alias(m) for m in tokens.MODELS))


_F32 = "CAST(CAST(strlen(text) AS FLOAT) / CAST({} AS FLOAT) AS FLOAT)"
_tokens("token_counts_scan", "scan", lambda r: f"floor({_F32.format(r)})")
_tokens("token_counts_quick", "quick", lambda r: f"CASE WHEN strlen(text) = 0 THEN 0 ELSE greatest(1, ceil({_F32.format(r)})) END")
_tokens("token_counts_output", "output", lambda r: f"floor(CAST(strlen(text) AS DOUBLE) / {r}::DOUBLE)")
_tokens("token_counts_wasm", "wasm", lambda r: f"ceil(CAST(strlen(text) AS DOUBLE) / {r}::DOUBLE)")
_tokens("token_counts_node", "node", lambda r: f"floor(CAST(strlen(text) AS DOUBLE) / {r}::DOUBLE)")


def _estimate_sql(model: str, ratio: float) -> str:
    special = tokens.SPECIAL.replace("'", "''")
    less = lambda chars: f"(length(text) - length(translate(text, {chars}, '')))"
    t = f"strlen(text) / {ratio}::DOUBLE - {less('chr(32) || chr(9)')} * 0.3::DOUBLE + {less('chr(10)')} * 0.5::DOUBLE"
    if model in ("claude", "codellama"):
        t += " + " + less(f"'{special}'") + " * 0.3::DOUBLE"
    return f"CAST(CASE WHEN strlen(text) = 0 THEN 0 ELSE ceil(greatest(1.0::DOUBLE, round({t}, 9))) END AS BIGINT)"


_EST = {m: _estimate_sql(m, r) for m, r in zip(tokens.MODELS, tokens.RATIOS["estimate"])}


@query("token_counts_estimate", "SELECT doc_id, " + ", ".join(f"{s} AS {m}" for m, s in _EST.items()) + f", {_estimate_sql('codellama', 3.2)} AS codellama FROM documents")
def token_counts_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokens.estimates(F.col("text"), (*tokens.MODELS, "codellama")).alias("e")).select("doc_id", "e.*")


@query(
    "most_efficient_model",
    "SELECT doc_id, CASE WHEN gpt4o <= least(claude, gpt4, gemini, llama) THEN 'gpt4o' WHEN claude <= least(gpt4, gemini, llama) THEN 'claude' WHEN gpt4 <= least(gemini, llama) THEN 'gpt4' WHEN gemini <= llama THEN 'gemini' ELSE 'llama' END AS model FROM (SELECT doc_id, " + ", ".join(f"{s} AS {m}" for m, s in _EST.items()) + " FROM documents)",
)
def most_efficient_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokens.most_efficient(F.col("text")).alias("model"))


@query("exceeds_budget", f"SELECT doc_id, {_EST['claude']} > 500 AS over FROM documents")
def exceeds_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokens.exceeds(F.col("text"), 500).alias("over"))


@query("truncate_to_budget")
def truncate_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokens.truncate(F.col("text"), 200).alias("text"))


@query("line_count", "SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN suffix(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT) AS lines, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS newlines FROM documents")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.line_count(F.col("text")).alias("lines"), text.newline_count(F.col("text")).alias("newlines"))


_KEEP = "least(4, length(v) // 4)"


@query("redact", f"SELECT doc_id, CASE WHEN length(v) <= 8 THEN repeat('*', length(v)) ELSE substring(v, 1, {_KEEP}) || repeat('*', length(v) - 2 * {_KEEP}) || substring(v, length(v) - {_KEEP} + 1, {_KEEP}) END AS redacted FROM (SELECT doc_id, text AS v FROM documents)")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.col("text")).alias("redacted"))


@query("xml_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.xml_escape(F.col("html")).alias("escaped"))


_TOON = "replace(replace(replace(replace(replace(v, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"


_BARE = "(SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || ' ' || html WHEN 1 THEN 'page_' || page_id WHEN 2 THEN '' || page_id WHEN 3 THEN 'two words' ELSE 'true' END AS v FROM pages)"


@query("toon_escape", f"SELECT page_id, CASE page_id % 5 WHEN 1 THEN v WHEN 3 THEN v WHEN 0 THEN CASE WHEN contains(v, chr(34)) OR contains(v, ',') OR contains(v, '|') OR contains(v, chr(10)) THEN '\"' || {_TOON} || '\"' ELSE v END ELSE '\"' || v || '\"' END AS escaped FROM {_BARE}")
def toon_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 5
    v = F.when(kind == 0, F.concat_ws(" ", "url", "html")).when(kind == 1, F.concat(F.lit("page_"), "page_id")).when(kind == 2, F.col("page_id").cast("string")).when(kind == 3, "two words").otherwise("true")
    return table(spark, sf_dir, "pages").select("page_id", text.toon_escape(v).alias("escaped"))


_LINES = "(CASE WHEN {0} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace({0}, '\\n$', ''), chr(10)) END)"
#: Texts with a blank line and a comment behind every sentence.
_SPACED = "replace(text, '. ', '.  ' || chr(10) || '  ' || chr(10) || chr(10) || chr(10) || ' // a note' || chr(10) || '/* one */' || chr(10))"


def _spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.withColumn("text", F.replace("text", F.lit(". "), F.lit(".  \n  \n\n\n // a note\n/* one */\n")))


@query("remove_empty_lines", f"SELECT doc_id, coalesce(array_to_string(list_filter({_LINES.format('text')}, lambda x: trim(x) <> ''), chr(10)), '') AS text FROM (SELECT doc_id, {_SPACED} AS text FROM documents)")
def remove_empty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spaced(spark, sf_dir).select("doc_id", text.remove_empty_lines(F.col("text")).alias("text"))


@query("compress_minimal", f"SELECT doc_id, regexp_replace(array_to_string(list_transform({_LINES.format('text')}, lambda x: rtrim(x)), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM (SELECT doc_id, {_SPACED} AS text FROM documents)")
def compress_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spaced(spark, sf_dir).select("doc_id", text.compress_minimal(F.col("text")).alias("text"))


@query("compress_balanced", f"SELECT doc_id, coalesce(array_to_string(list_filter({_LINES.format('text')}, lambda x: trim(x) NOT IN ('', '// a note', '/* one */') AND NOT starts_with(trim(x), '*') AND NOT starts_with(trim(x), '//')), chr(10)), '') AS text FROM (SELECT doc_id, {_SPACED} AS text FROM documents)")
def compress_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spaced(spark, sf_dir).select("doc_id", text.compress_balanced(F.col("text"), F.col("lang")).alias("text"))


@query("truncate_base64", "SELECT page_id, html || ' <img src=\"data:image/png;base64,[BASE64_TRUNCATED]' || CASE WHEN k >= 4 THEN left(run, 50) || '...[BASE64_TRUNCATED]' ELSE run || '==' END || '\"> ' AS html FROM (SELECT page_id, html, 1 + page_id % 5 AS k, repeat(md5(html), CAST(1 + page_id % 5 AS INTEGER)) AS run FROM pages)")
def truncate_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.concat(F.lit(' <img src="data:image/png;base64,'), F.repeat(F.md5("html"), (F.col("page_id") % 5 + 1).cast("int")), F.lit('=="> '))
    return table(spark, sf_dir, "pages").select("page_id", text.truncate_base64(F.concat("html", image)).alias("html"))


@query("remove_comments")
def remove_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.pages(spark, sf_dir)
    return f.select("relative_path", text.remove_comments(F.col("content"), F.col("language")).alias("content"))


@query("compress_aggressive")
def compress_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = corpus.documents(spark, sf_dir)
    return f.select("relative_path", text.compress_aggressive(F.col("content"), F.col("language")).alias("content"))


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1)"


@query("path_to_module", f"SELECT page_id, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PATH}, '^(?:src/)+', ''), '^(?:lib/)+', ''), '^(?:app/)+', ''), '\\.[^.]*$', ''), '/', '.'), '^\\.+|\\.+$', '', 'g') AS module FROM pages")
def path_to_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_extract("url", "^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", paths.dotted_module(p).alias("module"))


@query("normalize_path", f"SELECT page_id, concat_ws('/', 'x', nullif(array_to_string(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''), '/'), ''), 'end') AS path FROM pages")
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_extract("url", "^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    winding = F.concat(F.when(F.col("page_id") % 2 == 0, "../../").otherwise("./"), F.lit("x/./y"), "page_id", F.lit("/../"), p, F.lit("//end/z/.."))
    return table(spark, sf_dir, "pages").select("page_id", paths.normalise(winding).alias("path"))


@query("package_name", f"SELECT page_id, CASE WHEN s LIKE '@%' THEN regexp_extract(s, '^(@[^/]+(?:/[^/]+)?)', 1) ELSE string_split(s, '/')[1] END AS package FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '@' ELSE '' END || {_PATH} AS s FROM pages)")
def package_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_extract("url", "^[a-z]+://[^/?#]+/?([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", paths.package_name(F.concat(F.when(F.col("page_id") % 2 == 0, "@").otherwise(""), p)).alias("package"))


#: Addresses of six shapes, by the id of the page.
_SHAPES = ("https://github.com/o{}/n{}/tree/main/src/x", "git@gitlab.com:o{}/n{}.git", "bitbucket:o{}/n{}", "o{}/n{}", "./o{}/n{}", "https://git.example.org/o{}/n{}")


def _address() -> Column:
    shape = F.get(F.array(*map(F.lit, _SHAPES)), (F.col("page_id") % 6).cast("int"))
    return F.replace(shape, F.lit("{}"), F.col("page_id").cast("string"))


@query("is_remote_url", "SELECT page_id, page_id % 6 <> 4 AS remote FROM pages")
def is_remote_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.is_remote(_address()).alias("remote"))


@query("remote_parse", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'bitbucket' WHEN 3 THEN 'github' ELSE 'generic' END AS provider, 'o' || page_id AS owner, 'n' || page_id AS name, CASE WHEN page_id % 6 = 0 THEN 'main' END AS branch, CASE WHEN page_id % 6 = 0 THEN 'src/x' END AS subdir FROM pages WHERE page_id % 6 <> 4 UNION ALL SELECT page_id, 'generic', NULL, NULL, NULL, NULL FROM pages WHERE page_id % 6 = 4")
def remote_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "pages").select("page_id", _address().alias("a")).select("page_id", paths.is_remote(F.col("a")).alias("ok"), paths.remote(F.col("a")).alias("r"))
    some = lambda c: F.when(F.col("ok"), F.col(f"r.{c}")).alias(c)
    return r.select("page_id", F.when(F.col("ok"), F.col("r.provider")).otherwise("generic").alias("provider"), *map(some, ("owner", "name", "branch", "subdir")))


def _ext_sql(table_: dict[str, str]) -> str:
    return "CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


_EXTS = sorted({*paths.LANGUAGE_OF, *paths.BINARY, "unknown"})
_NAMED = f"(SELECT doc_id, [{', '.join(repr(x) for x in _EXTS)}][CAST(doc_id % {len(_EXTS)} AS INTEGER) + 1] AS e FROM documents)"


@query("language_detect", f"SELECT doc_id, {_ext_sql(paths.LANGUAGE_OF)} AS language, {_ext_sql(paths.PARSED)} AS parser, e IN ({', '.join(repr(x) for x in paths.BINARY)}) AS is_binary FROM {_NAMED}")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    exts = F.array(*map(F.lit, _EXTS))
    p = F.concat(F.lit("src/File."), F.upper(F.get(exts, (F.col("doc_id") % len(_EXTS)).cast("int"))))
    return table(spark, sf_dir, "documents").select("doc_id", paths.language(p).alias("language"), paths.parser_language(p).alias("parser"), paths.is_binary_name(p).alias("is_binary"))


@query("size_parse", "SELECT doc_id, CAST(CASE doc_id % 5 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 1024 WHEN 2 THEN n_chars * 1048576 WHEN 3 THEN n_chars * 1073741824 END AS BIGINT) AS bytes FROM documents")
def size_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(*map(F.lit, ("B", "K", "mb", "GB", "x"))), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.parse_size(F.concat(F.col("n_chars").cast("string"), unit)).alias("bytes"))


@query("epoch_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def epoch_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.epoch_date(F.unix_timestamp("ts")).alias("day"))


@query("mermaid_id", "SELECT page_id, replace(replace(u, '-', '_'), '.', '_') AS id FROM (SELECT page_id, url AS u FROM pages)")
def mermaid_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.mermaid_id(F.col("url")).alias("id"))


@query("content_hash", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_alike FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with one hash are one content."""
    d = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("first_alike")), "h").select("doc_id", "first_alike")


@query("symbol_line_count", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey >= l_partkey THEN l_suppkey - l_partkey + 1 ELSE 1 END AS lines FROM lineitem")
def symbol_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.span_lines(F.col("l_partkey"), F.col("l_suppkey")).cast("long").alias("lines"))


_PROFILED = {p: _ext_sql(t) for p, t in paths.PROFILES.items()}


@query("language_profiles", f"SELECT doc_id, {_PROFILED['binding']} AS binding, {_PROFILED['mmap']} AS mmap, {_PROFILED['wasm']} AS wasm, NULL::VARCHAR AS wasm_upper FROM {_NAMED}")
def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat(F.lit("src/file."), F.get(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % len(_EXTS)).cast("int")))
    upper = F.concat(F.lit("src/file."), F.upper(F.regexp_extract(p, r"\.(.*)$", 1)), F.lit("_"))
    return table(spark, sf_dir, "documents").select("doc_id", *(paths.language(p, k).alias(k) for k in ("binding", "mmap", "wasm")), paths.language(upper, "wasm").alias("wasm_upper"))


@query("process_file", f"SELECT doc_id, {_PROFILED['wasm']} AS language, strlen(text) AS size_bytes, " + ", ".join(f"CAST(ceil(strlen(text)::DOUBLE / {r}::DOUBLE) AS BIGINT) AS {m}" for m, r in zip(tokens.MODELS, tokens.RATIOS["wasm"])) + f" FROM {_NAMED} JOIN documents USING (doc_id)")
def process_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat(F.lit("src/file."), F.get(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % len(_EXTS)).cast("int")))
    r = table(spark, sf_dir, "documents").select("doc_id", text.process_file(p, F.col("text")).alias("f"))
    return r.select("doc_id", "f.language", "f.size_bytes", "f.token_count.*")


@query("is_binary_content", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN strlen(text) < 720 ELSE false END AS is_binary FROM documents WHERE strlen(text) >= 0")
def is_binary_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the texts with a NUL in front, one with 80 control characters, which are a tenth of up to 800 bytes, two plain."""
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, F.concat(F.unhex(F.lit("00")), F.encode("text", "utf-8"))).when(kind == 1, F.concat(F.unhex(F.repeat(F.lit("01"), 80)), F.encode("text", "utf-8"))).otherwise(F.encode("text", "utf-8"))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_binary_content(raw).alias("is_binary"))
