"""The live pipeline: ticks in, divergences out, a book and match views to ask, and a match set that can be exchanged.

State lives in tables of the shared folder: the last quote of each instrument, and the last report of each match. A batch of
ticks runs through the batch operators with the book's quotes before it, so a match that joins later starts from the book.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import book, divergence, views
from tidemark.schema import REPORT, TICK
from tidemark.tables import cut


class LivePipeline:
    def __init__(self, matches: DataFrame, threshold: str = "0.03", freshness_s: int = 60, debounce_s: int = 10, widening: str = "0.01"):
        spark = matches.sparkSession
        self.options = (threshold, freshness_s, debounce_s, widening)
        self.book = spark.createDataFrame([], TICK)
        self.reported = spark.createDataFrame([], REPORT)
        self.accepted = self.rejected = 0
        self.set_matches(matches)

    def set_matches(self, matches: DataFrame) -> None:
        """Exchanges the match set. The book stays; reports of matches that are gone are forgotten, others kept."""
        self.legs = cut(views.match_legs(matches))
        self.reported = cut(retained(self.reported, self.legs))

    def apply(self, ticks: DataFrame) -> DataFrame:
        """Ticks that arrived after all before; returns the divergences that they give, as a written table."""
        threshold, freshness_s, debounce_s, widening = self.options
        new = cut(ticks.select(self.book.columns))
        rows = self.book.withColumn("new", F.lit(False)).unionByName(new.withColumn("new", F.lit(True)))
        marks = book.with_accepted(rows).where("new").agg(F.count_if("accepted"), F.count_if(~F.col("accepted"))).first()
        first = new.agg(F.min("arrival")).first()[0]
        found = divergence.candidates(self.legs, rows.drop("new"), threshold, freshness_s).where(F.col("arrival") >= (0 if first is None else first))
        out = cut(divergence.debounced(found, debounce_s, widening, self.reported))
        self.accepted, self.rejected = self.accepted + marks[0], self.rejected + marks[1]
        self.book = cut(book.quotes(rows.drop("new")).select(self.book.columns))
        last = out.groupBy("match_id").agg(F.max_by(F.struct("detected_at", "spread"), "arrival").alias("r")).select("match_id", "r.*")
        self.reported = cut(self.reported.join(last, "match_id", "left_anti").unionByName(last))
        return out

    def quote(self, instrument: str) -> DataFrame:
        return book.quote(self.book, instrument)

    def all_quotes(self) -> DataFrame:
        return book.quotes(self.book).orderBy("instrument")

    def match_view(self, match_id: str) -> DataFrame:
        return views.match_views(self.legs.where(F.col("match_id") == match_id), self.book)

    def all_match_views(self) -> DataFrame:
        return views.match_views(self.legs, self.book).orderBy("match_id")

    def tick_counts(self) -> tuple[int, int]:
        return self.accepted, self.rejected


def retained(state: DataFrame, legs: DataFrame) -> DataFrame:
    """State of the matches that are still there."""
    return state.join(legs.select("match_id").distinct(), "match_id", "left_semi")


def versioned_divergences(versions: DataFrame, ticks: DataFrame, threshold: str = "0.03", freshness_s: int = 60, debounce_s: int = 10, widening: str = "0.01") -> DataFrame:
    """Divergences under match sets that change: (match_id, legs, valid_from, valid_to) by arrival, the end exclusive and null
    for none. A match that joins has its legs' quotes as of then; one that left and comes back has no last report."""
    named = F.concat_ws("#", "valid_from", "match_id")
    legs = views.match_legs(versions.select(named.alias("match_id"), "legs"))
    life = versions.select(named.alias("match_id"), F.col("match_id").alias("_own"), "valid_from", "valid_to")
    found = divergence.candidates(legs, ticks, threshold, freshness_s)
    inside = found.join(life, "match_id").where((F.col("arrival") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("arrival") < F.col("valid_to")))).select(found.columns)
    out = divergence.debounced(inside, debounce_s, widening).join(life.select("match_id", "_own"), "match_id")
    return out.withColumn("match_id", F.col("_own")).drop("_own")


def shutdown(producers: list, drain: Callable[[], object], flush: Callable[[], object]) -> None:
    """Stops in order: what is under way in each streaming query, the queries, then what waits, then what is buffered."""
    for query in producers:
        query.processAllAvailable()
        query.stop()
    drain()
    flush()


def matching_due(now_s: float, started_s: float, last_s: float | None, instruments: int, first_s: float = 10, every_s: float = 600) -> bool:
    """Whether a matching pass is due: a while after the start, then at intervals, and never without instruments."""
    return instruments > 0 and (now_s - started_s >= first_s if last_s is None else now_s - last_s >= every_s)
