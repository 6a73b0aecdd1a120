"""Divergence of a match: fresh legs whose mids are far apart, reported with a debounce.

A candidate is a counted tick after which at least two legs are fresh (age below the limit) and have a mid, with the largest
and least mid at least ``threshold`` apart. A candidate is reported unless the last *reported* one of the match is less
than ``debounce_s`` old and the spread has grown by less than ``widening`` since. Only candidates touch that state, so
they are filtered first; then each match's candidates are streamed in order through a two-number state.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.prices import PRICE
from tidemark.operators.views import leg_states


def candidates(legs: DataFrame, ticks: DataFrame, threshold: str = "0.03", freshness_s: int = 60) -> DataFrame:
    states = leg_states(legs, ticks)
    fresh = states.where((F.unix_micros("now") - F.unix_micros("at") < freshness_s * 1_000_000) & F.col("mid").isNotNull())
    leg = F.struct("pos", F.col("leg").alias("instrument"), "mid")
    spread = (F.max("mid") - F.min("mid")).cast(PRICE)
    events = fresh.groupBy("match_id", "arrival").agg(F.first("now").alias("detected_at"), spread.alias("spread"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(leg)).alias("legs"))
    events = events.where((F.col("n") >= 2) & (F.col("spread") >= F.lit(threshold).cast(PRICE))).drop("n")
    return events.withColumn("legs", F.transform("legs", lambda x: F.struct(x["instrument"], x["mid"])))


def debounced(events: DataFrame, debounce_s: int = 10, widening: str = "0.01", reported: DataFrame | None = None) -> DataFrame:
    """The reported ones. Memory doesn't grow with a match's history. ``reported``: the last report (match_id, detected_at,
    spread) of matches before all these events."""
    wait, step = debounce_s * 1_000_000, int(Decimal(widening).scaleb(9))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = at = spread = None
        for batch in batches:
            keep = []
            for m, now, s, old in zip(*(batch.column(c).to_pylist() for c in ("match_id", "_us", "_nano", "_old")), strict=True):
                if m != match:
                    match, at = m, None
                out = at is None or now - at >= wait or s - spread >= step
                if out:
                    at, spread = now, s
                keep.append(out and not old)
            yield batch.filter(pa.array(keep, pa.bool_())).select([c for c in batch.schema.names if c not in ("_us", "_nano", "_old")])

    rows = events.withColumn("_old", F.lit(False))
    if reported is not None:
        rows = rows.unionByName(reported.select("match_id", "detected_at", "spread").withColumn("_old", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumns({"_us": F.unix_micros("detected_at"), "_nano": (F.col("spread") * 1_000_000_000).cast("bigint")})
    return rows.repartition("match_id").sortWithinPartitions("match_id", F.desc("_old"), "arrival").mapInArrow(report, events.schema)


def divergences(legs: DataFrame, ticks: DataFrame, threshold: str = "0.03", freshness_s: int = 60, debounce_s: int = 10, widening: str = "0.01") -> DataFrame:
    return debounced(candidates(legs, ticks, threshold, freshness_s), debounce_s, widening)
