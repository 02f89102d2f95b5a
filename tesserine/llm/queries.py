"""Queries opN_<name>: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, line_dedup, minhash, packing, pii, rp_forest, substring, toxicity, warc
from ._store import read, table_path


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages, reads the archive, and returns what each record holds: its page, URL, size in
    bytes and MD5, and whether its digest is right."""
    path = table_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.load(spark, path).select("page_id", "url", F.octet_length("html").cast("long").alias("html_bytes"), F.md5(F.col("html").cast("binary")).alias("html_md5"), "intact")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.flag(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(read(spark, sf_dir, "documents"))


def op10_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicates(read(spark, sf_dir, "embeddings"))


def embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over ``embeddings`` and a copy of each vector turned by a few degrees, so that every one has a near-duplicate."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    turned = rows.select((F.col("vec_id") + _COPY).alias("vec_id"), F.transform("embedding", lambda x, i: x * F.when(i % 2 == 0, 1.25).otherwise(0.75)).alias("embedding"))
    return rp_forest.near_duplicates(rows.unionAll(turned))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | {"embedding_copies": embedding_copies}


_COPY = 1_000_000_000

_WORDS = r"""
  pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
  sets AS (SELECT doc_id, line_no, list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM pieces),
  lines AS (SELECT *, len(w) AS n, row_number() OVER (ORDER BY doc_id, line_no) AS seq FROM sets WHERE len(w) > 0)"""

#: Jaccard self-join: prefixes in an order of rarity of its own, lengths, and every candidate verified.
_LINES = f"""WITH {_WORDS},
  tokens AS (SELECT seq, n, unnest(w) AS token FROM lines),
  rarity AS (SELECT token, count(*) AS f FROM tokens GROUP BY token),
  ranked AS (SELECT seq, n, token, row_number() OVER (PARTITION BY seq ORDER BY f, token) AS pos FROM tokens JOIN rarity USING (token)),
  prefix AS (SELECT seq, n, token FROM ranked WHERE pos <= n - (4 * n + 4) // 5 + 1),
  pairs AS (SELECT DISTINCT a.seq AS x, b.seq AS y FROM prefix a JOIN prefix b ON a.token = b.token AND a.seq < b.seq AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n)
SELECT DISTINCT b.doc_id, b.line_no FROM pairs JOIN lines a ON a.seq = x JOIN lines b ON b.seq = y
WHERE 5 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n - len(list_intersect(a.w, b.w)))"""

#: Every window of 50 words is spelt out and counted; places of those that repeat merge to spans.
_SPANS = r"""WITH texts AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
  windows AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM texts WHERE len(w) >= 50)),
  counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) = 1 AS earliest FROM windows),
  marked AS (SELECT doc_id, i, earliest, i > coalesce(max(i + 49) OVER (PARTITION BY doc_id, earliest ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM counted WHERE n > 1),
  runs AS (SELECT doc_id, i, earliest, sum(fresh::INT) OVER (PARTITION BY doc_id, earliest ORDER BY i) AS run FROM marked)
SELECT doc_id, min(i) AS first_word, max(i) + 49 AS last_word, earliest FROM runs GROUP BY doc_id, earliest, run"""


def _cosine_groups(table: str) -> str:
    """All pairs, and the least id that each vector reaches."""
    return f"""WITH RECURSIVE rows AS ({table}),
  pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
  reach AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
SELECT x AS vec_id, min(y) AS duplicate_of FROM reach GROUP BY x HAVING min(y) < x"""


_VECTORS = "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings"
_TURNED = f"{_VECTORS} UNION ALL SELECT vec_id + {_COPY}, list_transform(embedding::DOUBLE[], lambda x, i: x * CASE WHEN i % 2 = 1 THEN 1.25 ELSE 0.75 END) FROM embeddings"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": "SELECT page_id, url, octet_length(encode(html)) AS html_bytes, md5(html) AS html_md5, true AS intact FROM pages WHERE html IS NOT NULL",
        "op2_line_dedup": _LINES,
        "op9_substring_dedup": _SPANS,
        "op10_embedding_near_duplicates": _cosine_groups(_VECTORS),
        "embedding_copies": _cosine_groups(_TURNED),
    }
