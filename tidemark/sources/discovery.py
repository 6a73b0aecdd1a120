"""Which markets to follow: tags in order, the largest by volume, one budget for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.normalize import tradable
from tidemark.tables import cut


def resolved(slugs: list[str], tags: DataFrame) -> list[tuple[str, str]]:
    """(slug, tag id) of the configured slugs that the tag table (slug, tag_id) knows, in their order; others are skipped."""
    known = {r.slug: r.tag_id for r in tags.where(F.col("slug").isin(slugs)).groupBy("slug").agg(F.min("tag_id").alias("tag_id")).collect()}  # as many as slugs
    return [(s, known[s]) for s in slugs if s in known]


def active_markets(markets: DataFrame, tag_id: str, most: int) -> DataFrame:
    """The ``most`` tradable markets of a tag with the largest volume, ties by condition; with their ``rank``."""
    rows = tradable(markets.where(F.col("tag_id") == tag_id)).orderBy(F.desc("volume"), "condition").limit(most)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("tag_id").orderBy(F.desc("volume"), "condition")))  # at most `most` rows


def discover(slugs: list[str], tags: DataFrame, markets: DataFrame, budget: int) -> DataFrame:
    """One pass over the tags of (tag_id, condition, volume, raw_frame): each tag fetches what is left of the budget; a market
    that an earlier tag gave takes a place among these but costs nothing. Returns the markets with their slug and rank."""
    found = None
    for slug, tag_id in resolved(slugs, tags):
        if budget <= 0:
            break
        rows = active_markets(markets, tag_id, budget).withColumn("slug", F.lit(slug))
        rows = cut(rows if found is None else rows.join(found.select("condition"), "condition", "left_anti").select(rows.columns))
        budget -= rows.count()
        found = rows if found is None else found.unionByName(rows)
    return active_markets(markets.limit(0), "", 1).withColumn("slug", F.lit("")) if found is None else found
