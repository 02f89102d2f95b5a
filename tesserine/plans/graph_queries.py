"""Queries over graphs and vectors: ranks of the trade graph, similarity of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, vectors
from .base import query, table
from .tree_queries import rank_sql

#: Trade between nations: an edge for each pair of nations, a nation with itself too, that a line was sold between.
_TRADE = "SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"
_SALES = _TRADE.replace("DISTINCT ", "")


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nations, sales): every line sold is an edge from the customer's nation to the supplier's."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return t("nation").select(F.col("n_nationkey").alias("id")), lines.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))


_NATIONS = "SELECT n_nationkey AS id FROM nation"


@query("pagerank_symbols", rank_sql(20, True, False, _NATIONS, _TRADE))
def pagerank_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, sales = trade(spark, sf_dir)
    return graph.pagerank(nations, sales.distinct(), rounds=20).select("id", F.round("rank", 9).alias("rank"))


@query("pagerank_parallel_edges", rank_sql(20, True, False, _NATIONS, _SALES))
def pagerank_parallel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sale counts: parallel edges are summed before anything moves."""
    nations, sales = trade(spark, sf_dir)
    return graph.pagerank(nations, sales, rounds=20, in_memory=0).select("id", F.round("rank", 9).alias("rank"))


@query("embedding_topk", "SELECT vec_id, neighbour, score FROM (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) <= 10")
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector."""
    return vectors.all_most_similar(table(spark, sf_dir, "embeddings"), 10)
