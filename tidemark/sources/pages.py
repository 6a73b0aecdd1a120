"""Landed venue pages as a Spark data source, poll passes over them, and the lists that a session subscribes to.

A lander stores each answer of a venue's paged market listing as ``{path}/{series}/page-{number:03d}.json``: an object with
``markets`` (or ``data``), and ``cursor``, empty on the last page. The source reads a series in one partition, page by page as
long as there is a cursor, ten pages at most, as the live scan does. Folders may be in any store that Arrow reads by URI.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.operators.normalize import kalshi
from tidemark.operators.policies import batches
from tidemark.operators.replay import universe
from tidemark.sources.frames import stream_frames

PAGES, PAGE_ROWS = 10, 200


class _Series(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.series = options["path"], [s.strip() for s in options.get("series", "").split(",") if s.strip()]

    def partitions(self) -> list[InputPartition]:
        return [_Series(s) for s in self.series]

    def read(self, partition: _Series) -> Iterator[tuple]:
        uri = self.path if "://" in self.path else f"file://{self.path}"
        fs, root = pafs.FileSystem.from_uri(f"{uri.rstrip('/')}/{partition.name}")
        for page in range(PAGES):
            name = f"{root}/page-{page:03d}.json"
            info = fs.get_file_info(name)
            if info.type == pafs.FileType.NotFound:
                break
            with fs.open_input_stream(name) as f:
                said = json.loads(f.read())
            for place, market in enumerate(said.get("markets", said.get("data", []))):
                yield partition.name, page, place, datetime.fromtimestamp(info.mtime.timestamp(), timezone.utc), json.dumps(market)
            if not said.get("cursor"):
                break


class LandedPages(DataSource):
    """``spark.read.format("landed_pages").option("path", ...).option("series", "A,B").load()``."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return "series string, page int, place int, recv_ts timestamp, raw_frame string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def open_markets(spark: SparkSession, path: str, series: list[str]) -> DataFrame:
    """Markets of the series' pages, in their order."""
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").option("path", path).option("series", ",".join(series)).load()


def poll_pass(spark: SparkSession, path: str, series: list[str], known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(instruments seen for the first time, ticks of all markets) of one pass over all series. ``known``: ids seen before."""
    order = {s: k for k, s in enumerate(series)}
    place = F.create_map(*(F.lit(x) for s in order.items() for x in s))[F.col("series")] if order else F.lit(0)
    pages = open_markets(spark, path, series).withColumn("frame_no", (place * PAGES + F.col("page")) * 1_000_000 + F.col("place"))
    sights, ticks = kalshi(pages.select(F.col("frame_no").cast("long").alias("frame_no"), "recv_ts", "raw_frame"))
    first = universe(sights)
    return (first if known is None else first.join(known.select("id").distinct(), "id", "left_anti")), ticks


def frame_ticker(raw: Column) -> Column:
    """The native ticker of a market frame: the key that a session subscribes by."""
    return F.get_json_object(raw, "$.ticker")


def subscriptions(tickers: DataFrame, size: int = 100) -> DataFrame:
    """(batch, tickers): what each subscribe message carries, in order of ``place``."""
    rows = batches(tickers.withColumn("_all", F.lit(0)), "_all", "place", size)
    return rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", "ticker"))).alias("t")).select("batch", F.col("t.ticker").alias("tickers"))


def yes_tokens(tokens: DataFrame) -> DataFrame:
    """The yes leg's token of each condition by its last registration: what a session of that venue subscribes to."""
    last = tokens.where("yes_leg").groupBy("condition").agg(F.max_by("token", F.struct("frame_no", "part")).alias("token"))
    return last.orderBy("condition")


def tapped(frames: DataFrame, path: str, checkpoint: str, seconds: float = 2.0):
    """Starts the raw tap of a frame stream: NDJSON by venue, flushed at least each ``seconds``, nothing dropped."""
    rows = frames.withColumn("v", F.col("venue"))
    return rows.writeStream.format("json").partitionBy("v").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()


def polled(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Frames that a lander's polls leave in a folder, as a stream; the venues' token map and book are the stream's state, so a
    lander that reconnects changes nothing here."""
    return stream_frames(spark, path, files_per_trigger)
