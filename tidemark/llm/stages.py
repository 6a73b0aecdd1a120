"""Filtering stages over documents tables: each returns the columns of its input, whatever their names.

A table has ``doc_id`` and ``text``; all columns travel in one struct, so no name of theirs meets a stage's own. Two rows
are the same document where doc_id and text are equal, nulls included. A null text is treated as the empty text and comes
back null; null and repeated doc_ids are values like any other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.lines import kept_text, line_bitmaps
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.quality import fit, with_scores
from tidemark.llm.shared import chunks, nested, tidy, unnested, written
from tidemark.llm.templates import leaks


def _named(found: DataFrame) -> DataFrame:
    return found.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"))


def _same(rows: DataFrame, found: DataFrame) -> Column:
    return (rows["tag"] == found["_tag"]) & rows["doc_id"].eqNullSafe(found["_id"])


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Documents whose quality score is at least ``threshold``. A text without words has the share of label 1 as its score;
    rows that repeat a text have equal scores."""
    rows = with_scores(nested(docs).select("row", "text"), fit(docs.select("doc_id", "text"), labels))
    return unnested(rows.where(F.col("score") >= threshold), docs.columns)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """All documents, without the lines that are common; ``n_chars``, where there is one, follows. Null texts stay null; a
    document that loses all lines is empty; rows that repeat a document count once and all lose the line."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            kept = [kept_text(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([t for t, _, _ in kept], pa.string()), pa.array([n for _, _, n in kept], pa.int64())], names=["row", "text", "dropped"])

    left = nested(docs)
    bitmaps = line_bitmaps(docs.select("doc_id", "text"), min_docs, min_chars)
    right = bitmaps.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "keep")
    wide = left.join(right, _same(left, right), "left").select("row", "text", "keep")
    out = wide.mapInArrow(tidy(rows), left.select("row").schema.add("text", "string").add("dropped", "long"))
    changed = F.col("dropped") > 0
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id. Documents without words stay, one row each.
    Of rows that are the same document but differ elsewhere, that with the least hash of its other columns stays."""
    kept = written(near_duplicates(docs.select("doc_id", "text"), size, percent).where("kept").select("doc_id", "tag"), "kept")
    rows = nested(docs)
    one = _named(kept).distinct()
    rows = rows.join(one, _same(rows, one), "left_semi")
    if not kept.groupBy("doc_id", "tag").count().where("count > 1").isEmpty():
        others = F.xxhash64(F.lit(0), *(F.col("row")[c].cast("string") for c in docs.columns if c != "text"))
        rows = rows.groupBy("doc_id", "tag").agg(F.min_by("row", others).alias("row"))
    return unnested(rows, docs.columns)


def drop_leaked(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Documents that leak no benchmark item; all rows of a document that does go. Without items all documents stay."""
    found = _named(leaks(docs.select("doc_id", "text"), items, size, percent)).distinct()
    rows = nested(docs)
    return unnested(rows.join(found, _same(rows, found), "left_anti"), docs.columns)
