"""The book: which ticks count, and the last quote of each instrument.

A tick counts if its seq exceeds all earlier seqs of its instrument, in arrival order; that running maximum is the same
over counted ticks and over all ticks, so a window finds it. A counted tick replaces the whole quote, nulls included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.prices import mid


def with_accepted(ticks: DataFrame) -> DataFrame:
    before = Window.partitionBy("instrument").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return ticks.withColumn("_top", F.max("seq").over(before)).withColumn("accepted", F.col("_top").isNull() | (F.col("seq") > F.col("_top"))).drop("_top")


def accepted(ticks: DataFrame) -> DataFrame:
    return with_accepted(ticks).where("accepted").drop("accepted")


def quotes(ticks: DataFrame) -> DataFrame:
    """Last counted tick of each instrument with its mid. The greatest seq is the last that counted; of equal seqs the
    first arrival did. An aggregate with map-side parts, no window."""
    columns = [c for c in ticks.columns if c != "instrument"]
    last = ticks.groupBy("instrument").agg(F.max_by(F.struct(*columns), F.struct("seq", -F.col("arrival"))).alias("q"))
    return last.select("instrument", "q.*").withColumn("mid", mid(F.col("yes_bid"), F.col("yes_ask")))


def tick_counts(ticks: DataFrame) -> DataFrame:
    return with_accepted(ticks).agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def quote(ticks: DataFrame, instrument: str) -> DataFrame:
    """One row, or none where the instrument is unknown."""
    return quotes(ticks.where(F.col("instrument") == instrument))
