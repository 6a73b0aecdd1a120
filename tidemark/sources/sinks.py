"""Stored forms of ticks, divergences, mirrored values and the registry."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.prices import mid, stored, stored_time


def tick_rows(ticks: DataFrame) -> DataFrame:
    prices = [stored(F.col(c)).alias(c) for c in ("yes_bid", "yes_ask", "last_price")]
    return ticks.select("instrument", "venue", *prices, stored_time(F.col("venue_ts")).alias("venue_ts"), stored_time(F.col("recv_ts")).alias("recv_ts"), "seq")


def divergence_rows(events: DataFrame) -> DataFrame:
    legs = F.to_json(F.transform("legs", lambda x: F.array(x["instrument"], x["mid"].cast("string"))))
    return events.select("match_id", stored(F.col("spread")).alias("spread"), legs.alias("legs"), stored_time(F.col("detected_at")).alias("detected_at"))


def write_ticks(ticks: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Parquet by venue and day, sorted by instrument and time inside a file, so scans prune by either."""
    rows = ticks.withColumn("day", F.to_date(stored_time(F.col("recv_ts"))))
    rows.repartition("venue", "day", F.pmod(F.xxhash64("instrument"), F.lit(16))).sortWithinPartitions("venue", "day", "instrument", "recv_ts").write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("venue", "day").parquet(path)


def ensure_tables(spark: SparkSession, database: str = "default") -> None:
    prices = ", ".join(f"{c} decimal(9,6)" for c in ("yes_bid", "yes_ask", "last_price"))
    spark.sql(f"create table if not exists {database}.ticks (instrument string, {prices}, venue_ts timestamp, recv_ts timestamp, seq bigint, venue string, day date) using parquet partitioned by (venue, day)")
    spark.sql(f"create table if not exists {database}.divergences (match_id string, spread decimal(9,6), legs string, detected_at timestamp) using parquet")


def record(frames: DataFrame, path: str) -> None:
    """Raw frames as NDJSON by venue, nothing dropped."""
    frames.withColumn("v", F.col("venue")).write.mode("append").partitionBy("v").json(path)


def session_name(venue: str, at) -> str:
    """Name of a recorded session that began at ``at`` (UTC)."""
    return f"{venue}-{at:%Y%m%dT%H%M%SZ}"


def mirror_values(quotes: DataFrame, ttl_s: int = 3600) -> DataFrame:
    body = F.to_json(F.struct(*[c for c in quotes.columns if c != "mid"], mid(F.col("yes_bid"), F.col("yes_ask")).alias("mid")), {"ignoreNullFields": "false"})
    return quotes.select(F.concat(F.lit("tm:quote:"), "instrument").alias("key"), body.alias("value"), F.timestamp_micros(F.unix_micros("recv_ts") + ttl_s * 1_000_000).alias("expires_at"))


def save_registry(rows: list[dict], path: str) -> None:
    """The registry, a table small enough for people to edit, as JSON lines; whole or not at all."""
    import json

    with open(f"{path}.tmp", "w") as f:
        f.write("# one entry a line; edit status, confidence or note\n")
        f.writelines(json.dumps(r) + "\n" for r in rows)
    os.replace(f"{path}.tmp", path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Missing, empty or comment-only files are an empty registry; a malformed line fails."""
    import json

    from tidemark.schema import REGISTRY

    rows = []
    if os.path.exists(path):
        with open(path) as f:
            rows = [json.loads(x) for x in f if x.strip() and not x.lstrip().startswith("#")]
    names = ["match_id", "legs", "confidence", "method", "status", "note"]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], REGISTRY)
