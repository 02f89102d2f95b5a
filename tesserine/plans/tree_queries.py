"""Queries over a source tree made of all documents: imports, links, ranks, cycles, entry points.

Five documents are a folder; folders are Python, TypeScript and Rust in turn.  Every file imports the next of
its folder, the last of an even folder the first (a cycle), every third also one three folders back; some
import what isn't there.  The text of the document stands below as a comment.  The SQL states the links from
the ids alone: it never reads a line of code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, imports
from ..sources import corpus
from .base import query, table

_EXT = ("py", "ts", "rs")
_LANG = ("python", "typescript", "rust")


def _path(x: Column) -> Column:
    b = F.floor(x / 5)
    return F.concat(F.lit("src/b"), b, F.lit("/m"), x, F.lit("."), F.get(F.array(*map(F.lit, _EXT)), (b % 3).cast("int")))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    b = F.floor(d / 5)
    near = F.when(d % 5 < 4, d + 1).when(b % 2 == 0, d - 4)
    far = F.when((d % 5 == 2) & (d >= 15), d - 15)
    gone = F.when(d % 7 == 0, d)
    say = lambda x, *parts: F.when(x.isNotNull(), F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))).otherwise("")
    code = (
        F.when(b % 3 == 0, F.concat(F.lit("import numpy as np, json\n"), say(near, "from .m", near, " import (\n    a,\n    b as c,\n)\n"), say(far, "from ..b", b - 3, ".m", far, " import run\n"), say(gone, "from .gone", gone, " import x\n")))
        .when(b % 3 == 1, F.concat(F.lit("import * as r from '@scope/pkg/deep';\nconst z = require(\"react\");\n"), say(near, "import {\n  a,\n  b as c,\n} from './m", near, "';\n"), say(far, "import type { T } from '../b", b - 3, "/m", far, "';\n"), say(gone, "export * from './gone", gone, "';\n")))
        .otherwise(F.concat(F.lit("use serde::{Serialize, de::{self, Error}};\n"), say(near, "use super::m", near, "::{run, Stop as Halt};\n"), say(far, "pub use crate::b", b - 3, "::m", far, "::go;\n"), say(gone, "use super::gone", gone, "::x;\n")))
    )
    mark = F.when(b % 3 == 0, "# ").otherwise("// ")
    body = F.concat(code, mark, F.replace(F.regexp_replace(text, "[\"'`]", " "), F.lit("\n"), F.concat(F.lit("\n"), mark)))
    return corpus.files(table(spark, sf_dir, "documents"), _path(d), body, F.get(F.array(*map(F.lit, _LANG)), (b % 3).cast("int")), d)


def _p(x: str) -> str:
    return f"('src/b' || ({x} // 5) || '/m' || ({x}) || CASE ({x} // 5) % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.rs' END)"


_BASE = f"""d AS (SELECT doc_id AS i, doc_id // 5 AS b, CASE WHEN doc_id % 5 < 4 THEN doc_id + 1 WHEN (doc_id // 5) % 2 = 0 THEN doc_id - 4 END AS near, CASE WHEN doc_id % 5 = 2 AND doc_id >= 15 THEN doc_id - 15 END AS far, CASE WHEN doc_id % 7 = 0 THEN doc_id END AS gone FROM documents),
said AS (
  SELECT i, unnest(['numpy', 'json']) AS target, true AS external, NULL::BIGINT AS dst FROM d WHERE b % 3 = 0 UNION ALL
  SELECT i, unnest(['@scope/pkg/deep', 'react']), true, NULL FROM d WHERE b % 3 = 1 UNION ALL
  SELECT i, unnest(['serde::Serialize', 'serde::de', 'serde::de::Error']), true, NULL FROM d WHERE b % 3 = 2 UNION ALL
  SELECT i, './m' || near, false, near FROM d WHERE b % 3 < 2 AND near IS NOT NULL UNION ALL
  SELECT i, '../b' || (b - 3) || '/m' || far, false, far FROM d WHERE b % 3 < 2 AND far IS NOT NULL UNION ALL
  SELECT i, './gone' || gone, false, NULL FROM d WHERE b % 3 < 2 AND gone IS NOT NULL UNION ALL
  SELECT i, 'crate::b' || b || '::m' || near || unnest(['::run', '::Stop']), false, near FROM d WHERE b % 3 = 2 AND near IS NOT NULL UNION ALL
  SELECT i, 'crate::b' || (b - 3) || '::m' || far || '::go', false, far FROM d WHERE b % 3 = 2 AND far IS NOT NULL UNION ALL
  SELECT i, 'crate::b' || b || '::gone' || gone || '::x', false, NULL FROM d WHERE b % 3 = 2 AND gone IS NOT NULL),
linked AS (SELECT {_p('i')} AS src, target, external, CASE WHEN dst IN (SELECT i FROM d) THEN {_p('dst')} END AS dst FROM said),
e AS (SELECT DISTINCT src, dst FROM linked WHERE dst IS NOT NULL AND src <> dst)"""


def rank_sql(rounds: int, spread: bool, scaled: bool, vertices: str, edges: str, before: str = "") -> str:
    """PageRank in SQL: ``vertices`` gives id, ``edges`` src and dst."""
    lost = "coalesce((SELECT sum(r.rank) FROM pr r WHERE r.id NOT IN (SELECT src FROM deg)), 0)" if spread else "0"
    value = "rank / max(rank) OVER ()" if scaled else "rank"
    return f"""WITH RECURSIVE {before}{',' if before else ''} g AS MATERIALIZED (SELECT * FROM ({edges})), vs AS MATERIALIZED (SELECT * FROM ({vertices})), deg AS MATERIALIZED (SELECT src, count(*) AS d FROM g GROUP BY src), n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM vs),
pr AS (SELECT id, 1.0::DOUBLE / (SELECT n FROM n) AS rank, 0 AS i FROM vs
UNION ALL
SELECT v.id, (0.15::DOUBLE / (SELECT n FROM n)) + 0.85::DOUBLE * (coalesce(x.s, 0) + {lost} / (SELECT n FROM n)), (SELECT max(i) FROM pr) + 1
FROM vs v LEFT JOIN (SELECT g.dst, sum(p.rank / q.d) AS s FROM pr p JOIN g ON g.src = p.id JOIN deg q ON q.src = p.id GROUP BY g.dst) x ON x.dst = v.id WHERE (SELECT max(i) FROM pr) < {rounds})
SELECT id, round({value}, 9) AS rank FROM pr WHERE i = {rounds}"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.links(tree(spark, sf_dir))


@query("import_parse", f"WITH {_BASE} SELECT src, target FROM linked")
def import_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.extract(tree(spark, sf_dir)).select("src", "target")


@query("import_names", f"WITH {_BASE} SELECT {_p('i')} AS src, unnest(CASE b % 3 WHEN 2 THEN ['run', 'Stop'] ELSE ['a', 'b'] END) AS name FROM d WHERE near IS NOT NULL")
def import_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imports.extract(tree(spark, sf_dir)).where(F.col("target").rlike(r"^\./m\d+$") | F.col("target").rlike(r"::(run|Stop)$"))
    return found.select("src", F.explode("names").alias("name"))


@query("import_resolution", f"WITH {_BASE} SELECT src, target, dst FROM linked")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("src", "target", "dst")


@query("unresolved_imports", f"WITH {_BASE} SELECT src, target FROM linked WHERE dst IS NULL AND NOT external")
def unresolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where("dst is null and not external").select("src", "target")


@query("external_deps", f"WITH {_BASE} SELECT DISTINCT CASE WHEN target LIKE '@%' THEN '@scope/pkg' WHEN target LIKE 'serde%' THEN 'serde' ELSE target END AS package FROM linked WHERE external")
def external_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tree(spark, sf_dir)
    return imports.external_packages(f, imports.links(f))


@query("external_mentions", f"WITH {_BASE} SELECT {_p('i')} AS src, unnest(['@scope/pkg', 'react']) AS package FROM d WHERE b % 3 = 1")
def external_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.mentioned(tree(spark, sf_dir)).select("src", "package").distinct()


@query("dependency_stats", f"WITH {_BASE} SELECT count(*) AS imports, count(DISTINCT src) AS files, count(dst) AS resolved, count(*) FILTER (external) AS external, count(*) FILTER (dst IS NULL AND NOT external) AS unresolved FROM linked")
def dependency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).agg(F.count("*").alias("imports"), F.count_distinct("src").alias("files"), F.count("dst").alias("resolved"), F.count_if("external").alias("external"), F.count_if(F.col("dst").isNull() & ~F.col("external")).alias("unresolved"))


_FILES = f"SELECT {_p('i')} AS id FROM d"


def _file_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tree(spark, sf_dir)
    return graph.pagerank(f.select(F.col("relative_path").alias("id")), imports.edges(imports.links(f)), rounds=30, spread_dangling=False, scale_to_max=True).select("id", F.round("rank", 9).alias("rank"))


@query("pagerank_files", rank_sql(30, False, True, _FILES, "SELECT * FROM e", _BASE))
def pagerank_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the files through their imports to the ranks."""
    return _file_ranks(spark, sf_dir)


@query("top_files_by_imports", rank_sql(30, False, True, _FILES, "SELECT * FROM e", _BASE) + " ORDER BY rank DESC, id LIMIT 10")
def top_files_by_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_ranks(spark, sf_dir).orderBy(F.desc("rank"), "id").limit(10)


@query("scc_cycles", f"WITH RECURSIVE {_BASE}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT min(a.dst) AS component, a.src AS member FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src HAVING count(DISTINCT a.dst) > 1")
def scc_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycles(imports.edges(_links(spark, sf_dir))).select("component", F.explode("members").alias("member"))


@query("dependency_importers", f"WITH {_BASE} SELECT dst, src FROM e")
def dependency_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importers of every file."""
    return graph.all_importers(imports.edges(_links(spark, sf_dir)))
