"""Match views: for each match, its legs' quotes and the best prices among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.prices import mid
from tidemark.operators.book import accepted, quotes


def match_legs(matches: DataFrame) -> DataFrame:
    """(match_id, pos, instrument) of matches with two legs and more."""
    return matches.where(F.size("legs") >= 2).select("match_id", F.posexplode("legs").alias("pos", "instrument"))


def match_views(legs: DataFrame, ticks: DataFrame) -> DataFrame:
    """Per match: legs in order with quote and mid (null without one), best bid and best ask."""
    book = quotes(ticks).select("instrument", "yes_bid", "yes_ask", "mid", F.col("recv_ts").alias("last_update"))
    rows = legs.join(book, "instrument", "left")
    leg = F.struct("pos", "instrument", "yes_bid", "yes_ask", "mid", "last_update")
    return rows.groupBy("match_id").agg(F.array_sort(F.collect_list(leg)).alias("legs"), F.max("yes_bid").alias("best_yes_bid"), F.min("yes_ask").alias("best_yes_ask"))


def touched(legs: DataFrame, ticks: DataFrame) -> DataFrame:
    """Each counted tick with each match that has its instrument."""
    return accepted(ticks).join(legs.select("match_id", "instrument").distinct(), "instrument")


def leg_states(legs: DataFrame, ticks: DataFrame) -> DataFrame:
    """For each counted tick of a match: every leg's quote as of that tick. One row (match_id, arrival, leg).

    The quote is a struct, so one with null prices still replaces the one before it."""
    hits = touched(legs, ticks).select("match_id", "arrival", F.col("recv_ts").alias("now"), F.col("instrument").alias("hit"), F.struct("yes_bid", "yes_ask", F.col("recv_ts").alias("at")).alias("quote"))
    rows = hits.join(legs.select("match_id", "pos", F.col("instrument").alias("leg")), "match_id")
    window = Window.partitionBy("match_id", "pos").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(F.col("hit") == F.col("leg"), F.col("quote")), ignorenulls=True).over(window)
    return rows.withColumn("state", state).select("match_id", "arrival", "now", "pos", "leg", F.col("state.yes_bid").alias("yes_bid"), F.col("state.yes_ask").alias("yes_ask"), F.col("state.at").alias("at"), mid(F.col("state.yes_bid"), F.col("state.yes_ask")).alias("mid"))
