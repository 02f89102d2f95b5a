"""Shared storage that outlives executors, and small helpers all operators use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Where the session has none, a fresh folder is
    made if all runs in one process (``local[n]``, as in tests); on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tesserine-")
        at = _own[app]
    return at.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tesserine/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back: the lineage ends
    there, and no lost executor can take the rows with it."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tesserine_path = path
    _made.append(path)
    return out


def drop(df: DataFrame) -> None:
    """Remove a table made by ``cut`` once nothing reads it any more."""
    path = getattr(df, "_tesserine_path", None)
    if path:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def kept_only(step: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``step`` returns by ``cut``; all other tables made meanwhile are removed."""
    before = set(_made)
    out = step()
    for path in [p for p in _made if p not in before and p != out._tesserine_path]:
        _remove(out.sparkSession, path)
    return out


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names no other column can clash with."""
    return docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))


def bytes_of(rows: DataFrame, col: str = "_text") -> int:
    """Bytes of text in all rows: sizes the buckets of a shuffle."""
    return rows.agg(F.sum(F.octet_length(col))).first()[0] or 0


def buckets_for(total_bytes: int, per_bucket: int, least: int = 12) -> int:
    return max(least, -(-total_bytes // per_bucket))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
