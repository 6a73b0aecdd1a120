"""Snapshot answers over ticks and matches: sorted, as JSON bodies, with a not-found form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import book, views

KEEP = {"ignoreNullFields": "false"}


def instruments(ticks: DataFrame) -> DataFrame:
    """Every quote with its mid, by instrument."""
    return book.quotes(ticks).orderBy("instrument")


def matches(legs: DataFrame, ticks: DataFrame) -> DataFrame:
    """Every match view, by match."""
    return views.match_views(legs, ticks).orderBy("match_id")


def match_view(legs: DataFrame, ticks: DataFrame, match_id: str) -> DataFrame:
    """One row, or none where the match is unknown. Only the match's legs and their ticks are read."""
    own = legs.where(F.col("match_id") == match_id)
    return views.match_views(own, ticks.join(own.select("instrument").distinct(), "instrument", "left_semi"))


def answer(rows: DataFrame, what: str) -> tuple[int, str]:
    """Status and body of a question for one thing: its row, or 404 and what is unknown."""
    found = rows.select(F.to_json(F.struct("*"), KEEP).alias("body")).first()
    return (200, found.body) if found else (404, f'{{"error":"unknown {what}"}}')
