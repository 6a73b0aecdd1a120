"""A corpus pipeline: STAGES in order, each written as Parquet to the shared folder and read again by the next.

Every stage takes all that its predecessor kept, and all but the last return the columns of their input, whatever their names.
A null text counts as the empty text and stays null; null and repeated doc_ids are values like any other; rows that are the
same document (doc_id and text) become one row in ``near_copies``; an empty table gives no rows. See ``tidemark.llm.stages``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.pieces import piece_report
from tidemark.llm.queries import vocabulary
from tidemark.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_common_lines(docs, min_docs=10, min_chars=1)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_one_of_each(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.drop_leaked(docs, table(spark, sf_dir, "benchmark"), size=5, percent=80)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_report(docs, vocabulary("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("pieces", pieces),
]

#: No SQL: the quality votes and the subword ids can't be written in it. tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
