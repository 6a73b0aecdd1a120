"""Measures of a run: latency summaries, histograms, counters, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.tables import numbered_rows


def latency_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, p50, p95, p99 and max per group; the percentile p is the element at round(p/100 * (n - 1)) of the sorted
    values. Values are numbered over ranges, so no group is gathered or sorted by one task; three of a group are then picked."""
    some = rows.where(F.col(value).isNotNull()).select(by, value)
    total = some.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    ranked = numbered_rows(some, [by], [value], "_at").join(total, F.col(by).eqNullSafe(F.col("_by")))
    place = lambda p: F.floor((F.col("n") - 1) * (p / 100) + 0.5) + 1
    picked = ranked.where(F.col("_at").isin(place(50), place(95), place(99)))
    pick = lambda p: F.max(F.when(F.col("_at") == place(p), F.col(value))).alias(f"p{p}")
    return picked.groupBy(by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), pick(50), pick(95), pick(99), F.first("max").alias("max"))


def bounds(start: float, factor: float = 2.0, n: int = 14) -> list[float]:
    return [start * factor**k for k in range(n)]


def histogram(rows: DataFrame, by: str, value: str, les: list[float]) -> DataFrame:
    """Cumulative counts per bound (and infinity), in one pass: the bounds are few and fixed."""
    counts = rows.groupBy(by).agg(*(F.count_if(F.col(value) <= le).alias(f"b{k}") for k, le in enumerate(les)), F.count(value).alias("inf"), F.sum(value).alias("total"))
    each = F.array(*(F.struct(F.lit(float(le)).alias("le"), F.col(f"b{k}").alias("n")) for k, le in enumerate(les)), F.struct(F.lit(float("inf")).alias("le"), F.col("inf").alias("n")))
    return counts.select(by, F.explode(each).alias("b"), "total").select(by, "b.le", "b.n", "total")


def counters(rows: DataFrame, by: str, kinds: dict[str, str]) -> DataFrame:
    """Per group, how many rows meet each named condition."""
    return rows.groupBy(by).agg(*(F.count_if(F.expr(c)).alias(n) for n, c in kinds.items()))


def ingest_rate(ticks: DataFrame, seconds: int = 10) -> DataFrame:
    """Ticks and ticks a second per tumbling window."""
    return ticks.groupBy(F.window("recv_ts", f"{seconds} seconds").start.alias("start")).agg(F.count(F.lit(1)).alias("ticks")).withColumn("per_second", F.col("ticks") / seconds)


def throughput(ticks: DataFrame) -> DataFrame:
    span = (F.unix_micros(F.max("recv_ts")) - F.unix_micros(F.min("recv_ts"))) / 1e6
    return ticks.agg(F.count(F.lit(1)).alias("ticks"), F.try_divide(F.count(F.lit(1)), span).alias("per_second"))


def health(ticks: DataFrame, legs: DataFrame) -> DataFrame:
    """One row: instruments with a quote, matches, counted and rejected ticks."""
    from tidemark.operators.book import tick_counts

    return tick_counts(ticks).crossJoin(ticks.agg(F.countDistinct("instrument").alias("instruments"))).crossJoin(legs.agg(F.countDistinct("match_id").alias("matches")))


def exposition(rows: DataFrame, name: str, by: str, value: str) -> DataFrame:
    """Text lines of a metric."""
    return rows.select(F.format_string(f'{name}{{{by}="%s"}} %s', F.col(by), F.col(value).cast("string")).alias("line"))
