"""Recorded frames: NDJSON files of {recv_ts, venue, raw_frame}, in batch or as a stream, and driver tables as ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.prices import PRICE, utc

_LINE = "struct<recv_ts:string,venue:string,raw_frame:string>"


def _parsed(lines: DataFrame, name: Column, number: Column | None = None) -> DataFrame:
    row = F.from_json("value", _LINE, {"mode": "PERMISSIVE"})
    bad = row.isNull() | row["recv_ts"].isNull() | row["venue"].isNull() | row["raw_frame"].isNull()
    stop = F.raise_error(F.concat(F.lit("malformed frame in line "), name.cast("string")))
    rows = lines.where(F.trim("value") != "").select(F.when(bad, stop.cast(_LINE)).otherwise(row).alias("r"), (name if number is None else number).alias("frame_no"))
    return rows.select(F.to_timestamp("r.recv_ts").alias("recv_ts"), "r.venue", "r.raw_frame", "frame_no")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames in file order; blank lines are skipped, a malformed one fails with its number in the session. Files are read in
    byte ranges; a line's number is its place in its range and the lines of the ranges before, one row a range."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range")]
    lines = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("at"))
    ranges = lines.groupBy("file", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select("file", "range", "first", before.alias("before"))
    return _parsed(lines.join(offsets, ["file", "range"]), F.col("before") + F.col("at") - F.col("first") + 1)


def stream_frames(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Landed NDJSON files as a stream. A malformed line stops the stream with its file; order is the lander's ``frame_no``,
    null where it wrote none."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return _parsed(lines, F.concat(F.lit("of "), F.col("file")), F.get_json_object("value", "$.frame_no").cast("long"))


def replay_speed(text: str) -> float | None:
    """A positive finite factor, or None for ``max``."""
    if text.strip().lower() == "max":
        return None
    value = float(text)
    if not 0 < value < float("inf"):
        raise ValueError(f"speed {text}")
    return value


def event_ticks(events: DataFrame) -> DataFrame:
    """Ticks from the driver's events table: two venues, two legs a match, some seqs set back so that they are rejected."""
    cents = F.round(F.col("value") * 100).cast("long") % 9000
    to_price = lambda n: (n.cast("decimal(10,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast(PRICE)
    kind = F.col("event_type")
    venue = F.when(F.col("user_id") % 2 == 0, "kalshi").otherwise("polymarket")
    return events.select(
        F.concat(venue, F.lit(":U"), F.col("user_id").cast("string")).alias("instrument"), venue.alias("venue"), F.when(kind.isin("view", "purchase", "click"), to_price(cents)).alias("yes_bid"), F.when(kind.isin("view", "purchase", "signup"), to_price(cents + 200)).alias("yes_ask"), F.lit(None).cast(PRICE).alias("last_price"),
        F.lit(None).cast("timestamp").alias("venue_ts"), utc(F.col("ts")).alias("recv_ts"), (F.col("event_id") - F.when(F.col("event_id") % 7 == 0, 500).otherwise(0)).cast("long").alias("seq"), F.col("event_id").cast("long").alias("arrival"),
    )


def event_matches(events: DataFrame) -> DataFrame:
    """The matches that go with ``event_ticks``: users 2k and 2k+1."""
    k = F.floor(F.col("user_id") / 2).cast("long")
    return events.select(k.alias("k")).distinct().select(F.concat(F.lit("m"), F.col("k").cast("string")).alias("match_id"), F.array(F.concat(F.lit("kalshi:U"), (F.col("k") * 2).cast("string")), F.concat(F.lit("polymarket:U"), (F.col("k") * 2 + 1).cast("string"))).alias("legs"))
