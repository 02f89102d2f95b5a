"""The corpus pipeline: toxicity, line deduplication, near-duplicates, decontamination, packing.

Each stage takes the documents that the one before it kept and returns those it keeps, with the
columns of ``documents``; the last packs them into training windows.  ``run`` writes every
stage as a Parquet table of the shared folder and reads it again for the next, so no plan
spans two stages and a lost executor costs only the tasks at hand.

Nulls, empty texts, repeated rows and empty tables pass through as the operators define:
documents without text are kept up to packing, where they fill no window.  Texts of any length are used
whole.  Further columns, under whatever names, pass through all stages but the last; ids are integers.
Of equal lines the one of the least document id, then line number, stays; of near copies the least id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserine.llm import decontaminate, line_dedup, minhash, packing, toxicity
from tesserine.llm._store import cut, drop, kept_only, read


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't reject.

    A score equal to the threshold rejects.  Without labels of both classes nothing goes; empty in, empty out.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; ``n_chars`` follows the text.

    A document of which no word is left goes.  Null ids and null texts stay as they are; empty in, empty out.
    """
    return line_dedup.drop_repeated_lines(docs, length_col="n_chars")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all that are in none.

    The least id of a group stays, with all its rows.  Null ids, null and empty texts stay; empty in, empty out.
    """
    return minhash.drop_near_duplicates(docs)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts stay; an empty benchmark takes nothing away; empty in, empty out.
    """
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows over all documents that are left.

    Null ids are packed as null, repeated rows each for itself; null and empty texts fill no window; empty in, empty out.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", reject_contaminated),
    ("packing", pack_windows),
]

#: Classifier, sketches, alignment and packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of ``documents`` after all stages.  A stage's table is removed once the next one stands,
    and so are the tables that a stage made on its way."""
    docs, held = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = kept_only(lambda docs=docs, name=name, stage=stage: cut(stage(spark, docs, sf_dir), f"stage-{name}"))
        if held is not None:
            drop(held)
        docs = held = out
    return docs
