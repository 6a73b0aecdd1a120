"""Subscriptions to the stream of ticks and divergences: one reader's topics, what is delivered, and lag notices."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.policies import topic_predicate, topics_after
from tidemark.serving.snapshots import KEEP


class Subscription:
    """The topics of one reader, which add up over its operations, and its place in the ring of events.

    ``operate`` takes an operation, ``{"op": "subscribe" | "unsubscribe", "topics": [...]}``, and gives the frame that answers
    it. ``deliver`` gives the frames of the wanted events (kind, venue, subject, data, at) from the reader's place on; where
    more than ``capacity`` events came since, the oldest are gone and the first frame tells how many."""

    def __init__(self, capacity: int = 1024):
        self.topics: list[str] = []
        self.capacity, self.cursor, self.missed = capacity, 0, 0

    def operate(self, text: str) -> str:
        try:
            said = json.loads(text)
            kind, topics = said["op"], said["topics"]
            if kind not in ("subscribe", "unsubscribe") or not all(isinstance(t, str) for t in topics):
                raise ValueError(f"unknown operation {kind!r}")
        except (ValueError, KeyError, TypeError) as e:
            return json.dumps({"type": "error", "message": f"invalid operation: {e}"})
        self.topics = topics_after(self.topics, **{kind: topics})
        return json.dumps({"type": f"{kind}d", "topics": self.topics})

    def deliver(self, events: DataFrame) -> tuple[str | None, DataFrame]:
        """(lag notice or None, frames in order). Topics of another form match nothing."""
        head = events.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]
        gone = max(0, head - self.cursor - self.capacity)
        start, self.cursor = self.cursor + gone, max(head, self.cursor)
        self.missed += gone
        known = [t for t in self.topics if t.partition(":")[0] in ("ticks", "divergence")]
        rows = events.where((F.col("at") > start) & topic_predicate(known, F.col("kind"), F.col("venue"), F.col("subject")))
        return (json.dumps({"type": "lagged", "missed": gone}) if gone else None), rows.select("at", F.to_json(F.struct(F.col("kind").alias("type"), "data"), KEEP).alias("frame")).orderBy("at")


def tick_events(ticks: DataFrame) -> DataFrame:
    """Ticks as events of the stream, at their arrival."""
    own = [c for c in ticks.columns if c not in ("arrival", "frame_no", "elem")]
    return ticks.select(F.lit("tick").alias("kind"), "venue", F.col("instrument").alias("subject"), F.struct(*own).alias("data"), F.col("arrival").alias("at"))
