"""A recorded session of several venues as canonical events: instruments by first sight, ticks, and statuses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.normalize import kalshi, polymarket
from tidemark.operators.policies import first_seen
from tidemark.tables import numbered_rows

VENUES = ("kalshi", "polymarket")


@dataclass(frozen=True)
class Session:
    instruments: DataFrame
    ticks: DataFrame
    statuses: DataFrame


def session_venue(frames: DataFrame) -> str:
    """The venue of the first frame; kalshi where there is none."""
    first = frames.orderBy("frame_no").select("venue").first()
    return first.venue if first and first.venue else VENUES[0]


def universe(sights: DataFrame) -> DataFrame:
    """What is known of each instrument by its last sight, as matching reads it."""
    columns = [c for c in sights.columns if c != "id"]
    return sights.groupBy("id").agg(F.max_by(F.struct(*columns), "arrival").alias("r")).select("id", "r.*")


def replay(frames: DataFrame) -> Session:
    """Frames (frame_no, recv_ts, venue, raw_frame) of any mix of venues, each by its venue's rules; frames of other venues
    give nothing. ``seq`` counts the ticks of the whole session in order of frames and of elements in them. Statuses: one
    row before the first frame and one after the last, with the number of frames."""
    one, ticks_one = kalshi(frames.where(F.col("venue") == VENUES[0]))
    two, ticks_two, _ = polymarket(frames.where(F.col("venue") == VENUES[1]))
    ticks = numbered_rows(ticks_one.unionByName(ticks_two).withColumn("_of", F.lit("session")), ["_of"], ["frame_no", "elem"], "seq").drop("_of")
    ends = frames.agg(F.count(F.lit(1)).alias("n"), F.min("recv_ts").alias("low"), F.max("recv_ts").alias("high"))
    said = F.array(F.struct(F.lit("connected").alias("status"), F.lit(None).cast("string").alias("reason"), F.col("low").alias("at")), F.struct(F.lit("disconnected").alias("status"), F.concat(F.lit("session ended after "), F.col("n").cast("string"), F.lit(" frames")).alias("reason"), F.col("high").alias("at")))
    return Session(first_seen(one.unionByName(two)), ticks, ends.select(F.inline(said)))


def invariants(session: Session) -> DataFrame:
    """One row: instruments, ticks, and how many of them have no instrument, no price, or a seq that another has."""
    ticks = session.ticks
    bare = ticks.where("yes_bid is null and yes_ask is null and last_price is null").agg(F.count(F.lit(1)).alias("bare"))
    lost = ticks.join(session.instruments.select(F.col("id").alias("instrument")), "instrument", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    each = ticks.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ticks"), F.count_if(F.col("n") > 1).alias("repeated"))
    return session.instruments.agg(F.count(F.lit(1)).alias("instruments")).crossJoin(each).crossJoin(bare).crossJoin(lost)  # one row each
