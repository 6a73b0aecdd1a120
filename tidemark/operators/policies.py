"""Delivery policies as queries: conflation, coalescing, gaps, quiet spells, batching, retention, lag, topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import numbered_rows


def conflated(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Per time bucket and instrument: the last tick by arrival and how many it superseded."""
    columns = [c for c in ticks.columns if c != "instrument"]
    rows = ticks.groupBy(F.window("recv_ts", width).start.alias("bucket"), "instrument").agg(F.max_by(F.struct(*columns), "arrival").alias("t"), (F.count(F.lit(1)) - 1).alias("superseded"))
    return rows.select("bucket", "instrument", "superseded", "t.*")


def mirrored(quotes: DataFrame, width: str = "250 milliseconds", ttl_s: int = 3600) -> DataFrame:
    """Key-value writes: per flush and key only the last value, with its expiry."""
    rows = conflated(quotes, width).select("bucket", F.concat(F.lit("tm:quote:"), "instrument").alias("key"), "superseded", "recv_ts", "seq", "yes_bid", "yes_ask")
    return rows.withColumn("expires_at", F.timestamp_micros(F.unix_micros("recv_ts") + ttl_s * 1_000_000))


def first_seen(rows: DataFrame, key: str = "id", order: str = "arrival") -> DataFrame:
    """The first row of each key."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def numbered(events: DataFrame, by: str = "venue", order: str = "arrival") -> DataFrame:
    """seq from 1 per connector over the events that count; drop the others first."""
    return numbered_rows(events, [by], [order], "seq")


def gaps(ticks: DataFrame, by: str = "venue") -> DataFrame:
    """Rows whose seq is above the one expected next, with both."""
    rows = numbered_rows(ticks, [by], ["arrival"], "_n")
    before = rows.select(F.col(by).alias("_by"), (F.col("_n") + 1).alias("_next"), (F.col("seq") + 1).alias("expected"))
    found = rows.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_n") == F.col("_next"))).where("seq > expected")
    return found.drop("_n", "_by", "_next").withColumnRenamed("seq", "got")


def counter_deltas(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Growth of a counter since the row before, never negative; the first row counts whole."""
    before = F.lag(value, 1, 0).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("delta", F.greatest(F.col(value) - before, F.lit(0)))


def quiet_spells(rows: DataFrame, by: str, limit_s: int = 30) -> DataFrame:
    """Times without a row of at least ``limit_s``, inclusive: where they begin and how long they are."""
    window = Window.partitionBy(by).orderBy("recv_ts", "arrival")
    now, before = F.unix_micros("recv_ts"), F.unix_micros(F.lag("recv_ts").over(window))
    return rows.withColumns({"_s": before, "quiet_us": now - before}).where(F.col("quiet_us") >= limit_s * 1_000_000).select(by, "arrival", F.col("_s").alias("since_us"), "quiet_us")


def replay_offsets(frames: DataFrame, speed: float = 1.0) -> DataFrame:
    """Microseconds after its session's first frame at which a frame is due; steps back count as none."""
    first = frames.groupBy(F.col("venue").alias("_venue")).agg(F.min_by("recv_ts", "arrival").alias("_first"))
    rows = frames.join(first, F.col("venue").eqNullSafe(F.col("_venue")))
    return rows.withColumn("offset_us", (F.greatest(F.unix_micros("recv_ts") - F.unix_micros("_first"), F.lit(0)) / speed).cast("long")).drop("_venue", "_first")


def batches(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Number of the batch of ``size`` that a row falls in, per table."""
    return numbered_rows(rows, [by], [order], "_n").withColumn("batch", F.expr(f"(_n - 1) div {size}")).drop("_n")


def retained(batched: DataFrame, by: str, cap: int) -> DataFrame:
    """(table, batch, rows, kept): the newest batches whose rows together stay within ``cap``; the oldest go first."""
    sizes = batched.groupBy(by, "batch").agg(F.count(F.lit(1)).alias("rows"))
    newest = Window.partitionBy(by).orderBy(F.desc("batch")).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("kept", F.sum("rows").over(newest) <= cap)


def lag(readers: DataFrame, capacity: int = 1024) -> DataFrame:
    """For readers (head, cursor): how many events they missed in a ring, and where they go on."""
    missed = F.greatest(F.col("head") - F.col("cursor") - capacity, F.lit(0))
    return readers.withColumns({"missed": missed, "resume": F.col("cursor") + missed})


def topic_predicate(topics: list[str], kind: Column, venue: Column, subject: Column) -> Column:
    """Whether a stream event is wanted: ``ticks:*``, ``ticks:{venue}:*``, ``ticks:{instrument}``, ``divergence:*``,
    ``divergence:{match}``. Any topic suffices; no topic wants nothing."""
    wanted = []
    for topic in topics:
        head, _, rest = topic.partition(":")
        if head == "ticks":
            of = kind == "tick"
            wanted.append(of if rest == "*" else of & (venue == rest[:-2]) if rest.endswith(":*") else of & (subject == rest))
        elif head == "divergence":
            of = kind == "divergence"
            wanted.append(of if rest == "*" else of & (subject == rest))
        else:
            raise ValueError(f"unknown topic {topic}")
    return reduce(lambda a, b: a | b, wanted, F.lit(False))


def backlog(events: DataFrame) -> DataFrame:
    """Events (kind, key, arrival) that wait for a slow reader, in the order in which they go out: control events as they
    came, then the last event of each key, by the first time that the key had to wait."""
    control = events.where("kind = 'control'").select(F.lit(0).alias("turn"), F.col("arrival").alias("since"), *events.columns)
    columns = [c for c in events.columns if c != "key"]
    ticks = events.where("kind <> 'control'").groupBy("key").agg(F.min("arrival").alias("since"), F.max_by(F.struct(*columns), "arrival").alias("r"))
    return control.unionByName(ticks.select(F.lit(1).alias("turn"), "since", "key", *(f"r.{c}" for c in columns))).orderBy("turn", "since").drop("turn", "since")


def topics_after(now: list[str], subscribe: list[str] = (), unsubscribe: list[str] = ()) -> list[str]:
    return sorted((set(now) | set(subscribe)) - set(unsubscribe))


def top_within_budget(markets: DataFrame, by: str, value: str, most: int) -> DataFrame:
    """The ``most`` rows with the largest value, ties by key: a bounded heap per task, no full sort."""
    return markets.orderBy(F.desc(value), by).limit(most)
