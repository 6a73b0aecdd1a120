"""Command line.

``python -m tidemark tap ticks --replay FILE [--venue V]``: ticks of a recorded session, a line each.
``python -m tidemark tap divergence --replay FILE --registry FILE``: divergences of the active matches.
``python -m tidemark bench FILE...``: ticks a second through the book, and latencies of the session's frames.
``python -m tidemark run --replay FILE --registry FILE --out DIR [--config FILE]``: stores ticks and divergences.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.prices import native_id
from tidemark.operators import book, divergence, views
from tidemark.operators.matching import active_matches
from tidemark.operators.replay import replay
from tidemark.sources.frames import read_frames
from tidemark.sources.sinks import divergence_rows, load_registry, tick_rows
from tidemark.streaming.store import Store, parquet


def shown_price(price: Column) -> Column:
    """A price as a column of a terminal; a dash where there is none."""
    return F.lpad(F.when(price.isNull(), "—").otherwise(F.format_string("%.4f", price.cast("double"))), 7, " ")


def shown_age(ms: Column) -> Column:
    """An age in ms below a second, else in seconds."""
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s")))


def tick_lines(ticks: DataFrame) -> DataFrame:
    age = F.when(F.col("venue_ts").isNotNull(), F.greatest(F.unix_millis("recv_ts") - F.unix_millis("venue_ts"), F.lit(0)))
    columns = [F.rpad(F.col("venue"), 10, " "), F.rpad(native_id(F.col("instrument")), 32, " "), *(shown_price(F.col(c)) for c in ("yes_bid", "yes_ask", "last_price")), F.when(age.isNull(), "—").otherwise(shown_age(age))]
    return ticks.select("seq", F.concat_ws(" ", *columns).alias("line")).orderBy("seq")


def divergence_lines(events: DataFrame) -> DataFrame:
    legs = F.array_join(F.transform("legs", lambda x: F.concat(x["instrument"], F.lit("="), x["mid"].cast("decimal(9,4)").cast("string"))), " ")
    return events.select("arrival", F.concat_ws(" ", F.rpad("match_id", 40, " "), F.col("spread").cast("decimal(9,4)").cast("string"), legs).alias("line")).orderBy("arrival")


def _printed(rows: DataFrame, most: int) -> None:
    for r in rows.limit(most).toLocalIterator():
        print(r.line)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="tidemark")
    sub = top.add_subparsers(dest="command", required=True)
    tap = sub.add_parser("tap")
    tap.add_argument("what", choices=["ticks", "divergence"])
    for p in (tap, run := sub.add_parser("run")):
        p.add_argument("--replay", required=True)
        p.add_argument("--registry")
        p.add_argument("--config")
    tap.add_argument("--venue")
    tap.add_argument("--lines", type=int, default=1000)
    run.add_argument("--out", required=True)
    sub.add_parser("bench").add_argument("files", nargs="+")
    args = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    if args.command == "bench":
        for path in args.files:
            start = time.time()
            session = replay(read_frames(spark, path))
            accepted, rejected = book.tick_counts(session.ticks).first()
            took = time.time() - start
            print(f"{path}: {accepted} ticks accepted, {rejected} rejected, {(accepted + rejected) / took:.0f} a second")
        return 0
    ticks = replay(read_frames(spark, args.replay)).ticks
    ticks = ticks.withColumn("arrival", F.col("seq"))
    if args.command == "tap" and args.what == "ticks":
        _printed(tick_lines(ticks if args.venue is None else ticks.where(F.col("venue") == args.venue)), args.lines)
        return 0
    set_to = config.load(args.config).divergence
    legs = views.match_legs(active_matches(load_registry(spark, args.registry or "")))
    found = divergence.divergences(legs, ticks, set_to.threshold, set_to.freshness_s, set_to.debounce_s, set_to.widening)
    if args.command == "tap":
        _printed(divergence_lines(found), args.lines)
        return 0
    store = Store(parquet(args.out), most=None)
    store.put("ticks", tick_rows(ticks))
    store.put("divergences", divergence_rows(found))
    if not store.flush():
        return 1
    print(f"{store.counts.written} rows stored")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
