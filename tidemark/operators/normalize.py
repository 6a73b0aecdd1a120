"""Venue frames to canonical events. A frame is (frame_no, recv_ts, raw_frame); absent or ill-typed fields are null.

Frames that carry no data give no event and take no seq: classification comes before numbering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.prices import PRICE, cents, complement, instant, instrument_id, last_price_of, millis, oriented, price, string_list, yes_index
from tidemark.operators.policies import numbered

_NESTED = 2  # arrays in arrays that a frame may have
EVENT = ["frame_no", "elem", "instrument", "venue", "yes_bid", "yes_ask", "last_price", "venue_ts", "recv_ts"]


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _string(value: Column, path: str) -> Column:
    """The field if it is a JSON string."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{path}", "variant")) == "STRING", _get(value, path, "string"))


def _whole(value: Column, path: str) -> Column:
    """The field if it is a JSON integer."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{path}", "variant")) == "BIGINT", _get(value, path, "bigint"))


def _true(value: Column, path: str) -> Column:
    """Whether the field is the literal true; a string or number isn't."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{path}", "variant"))
    return F.coalesce((kind == "BOOLEAN") & F.when(kind == "BOOLEAN", _get(value, path, "boolean")), F.lit(False))


def _flat(value: Column) -> Column:
    """The elements of an array, those of arrays in it in their place, and so on; a value that is none alone."""
    one = lambda x: F.schema_of_variant(x).startswith("ARRAY")
    parts = lambda x: F.when(one(x), F.try_variant_get(x, "$", "array<variant>")).otherwise(F.array(x))
    out = parts(value)
    for _ in range(_NESTED):
        out = F.flatten(F.transform(out, parts))
    deep = F.raise_error(F.lit(f"arrays within more than {_NESTED} arrays")).cast("array<variant>")
    return F.when(F.exists(out, one), deep).otherwise(out)


def _dollars_or_cents(value: Column, name: str) -> Column:
    return F.coalesce(price(_string(value, f"{name}_dollars")), cents(_whole(value, name)))


def kalshi(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instruments by first sight, ticks) of market snapshots and ticker messages."""
    rows = frames.withColumn("v", F.try_parse_json("raw_frame"))
    kind = _string(F.col("v"), "type")
    market = kind.isNull() & _string(F.col("v"), "ticker").isNotNull()
    ticker = (kind == "ticker") & _string(F.col("v"), "msg.market_ticker").isNotNull()
    rows = rows.withColumn("kind", F.when(market, "market").when(ticker, "ticker")).where("kind is not null")
    is_market, v = F.col("kind") == "market", F.col("v")
    native = F.when(is_market, _string(v, "ticker")).otherwise(_string(v, "msg.market_ticker"))
    pick = lambda m, t: F.when(is_market, _dollars_or_cents(v, m)).otherwise(_dollars_or_cents(v, f"msg.{t}"))
    events = rows.select(
        "frame_no", F.lit(0).alias("elem"), instrument_id(F.lit("kalshi"), native).alias("instrument"), F.lit("kalshi").alias("venue"), pick("yes_bid", "yes_bid").alias("yes_bid"), pick("yes_ask", "yes_ask").alias("yes_ask"), pick("last_price", "price").alias("last_price"),
        F.when(is_market, instant(_string(v, "updated_time"))).otherwise(F.timestamp_millis(_whole(v, "msg.ts_ms"))).alias("venue_ts"), "recv_ts", "kind", "v", "raw_frame",
    )
    sights = events.where("kind = 'market'").select(F.col("instrument").alias("id"), "venue", F.coalesce(_string(v, "title"), _string(v, "ticker")).alias("title"), _string(v, "rules_primary").alias("description"), instant(_string(v, "close_time")).alias("close_time"), F.lit(None).cast("string").alias("category"), F.col("raw_frame").alias("raw"), F.col("frame_no").alias("arrival"))
    return sights, _ticks(events.select(EVENT))


def _ticks(events: DataFrame) -> DataFrame:
    """seq within the connector, in order of frames and of elements in them."""
    rows = events.withColumn("_order", F.struct("frame_no", "elem"))
    return numbered(rows, "venue", "_order").drop("_order").withColumn("arrival", F.col("frame_no"))


def polymarket(frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(instruments, ticks, tokens). A token's market and leg hold from the frame that registers it on, until another frame
    registers it anew; entries of tokens unknown by then are dropped."""
    parsed = frames.withColumn("v", F.try_parse_json("raw_frame")).where("v is not null")
    rows = parsed.select("frame_no", "recv_ts", "raw_frame", F.posexplode(_flat(F.col("v"))).alias("part", "e"))
    e = F.col("e")
    market = F.try_variant_get(e, "$.conditionId", "variant").isNotNull()  # a market, whatever else the object says
    kind = F.when(~market, _string(e, "event_type"))
    markets = rows.where(market & _string(e, "conditionId").isNotNull())
    yes = yes_index(F.coalesce(string_list(_string(e, "outcomes")), F.array().cast("array<string>")))
    tokens_of = string_list(_string(e, "clobTokenIds"))
    last = price(F.get(string_list(_string(e, "outcomePrices")), yes))
    best = lambda name: F.when(yes == 0, price(F.coalesce(_string(e, name), _get(e, name, PRICE).cast("string"))))
    market_events = markets.select("frame_no", (F.col("part") * 1_000_000).alias("elem"), instrument_id(F.lit("polymarket"), _string(e, "conditionId")).alias("instrument"), F.lit("polymarket").alias("venue"), best("bestBid").alias("yes_bid"), best("bestAsk").alias("yes_ask"), last.alias("last_price"), instant(_string(e, "updatedAt")).alias("venue_ts"), "recv_ts")
    sights = markets.select(instrument_id(F.lit("polymarket"), _string(e, "conditionId")).alias("id"), F.lit("polymarket").alias("venue"), F.coalesce(_string(e, "question"), _string(e, "conditionId")).alias("title"), _string(e, "description").alias("description"), instant(_string(e, "endDate")).alias("close_time"), F.lit(None).cast("string").alias("category"), "raw_frame", F.col("frame_no").alias("arrival")).withColumnRenamed("raw_frame", "raw")
    tokens = markets.select("frame_no", "part", _string(e, "conditionId").alias("condition"), yes.alias("yes"), F.posexplode(tokens_of).alias("place", "token")).select("frame_no", "part", "token", "condition", (F.col("place") == F.col("yes")).alias("yes_leg"))
    none = F.lit(None).cast(PRICE)
    level = "array<struct<price:string,size:string>>"
    books = rows.where(kind == "book").select("frame_no", (F.col("part") * 1_000_000).alias("elem"), "recv_ts", _string(e, "asset_id").alias("token"), last_price_of(_get(e, "bids", level)).alias("bid"), last_price_of(_get(e, "asks", level)).alias("ask"), none.alias("last"), millis(_get(e, "timestamp", "string")).alias("venue_ts"))
    changes = rows.where(kind == "price_change").select("frame_no", "part", "recv_ts", millis(_get(e, "timestamp", "string")).alias("venue_ts"), F.posexplode(_get(e, "price_changes", "array<struct<asset_id:string,best_bid:string,best_ask:string>>")).alias("k", "c"))
    changes = changes.select("frame_no", (F.col("part") * 1_000_000 + F.col("k")).alias("elem"), "recv_ts", F.col("c.asset_id").alias("token"), price(F.col("c.best_bid")).alias("bid"), price(F.col("c.best_ask")).alias("ask"), none.alias("last"), "venue_ts")
    trades = rows.where(kind == "last_trade_price").select("frame_no", (F.col("part") * 1_000_000).alias("elem"), "recv_ts", _string(e, "asset_id").alias("token"), none.alias("bid"), none.alias("ask"), price(_get(e, "price", "string")).alias("last"), millis(_get(e, "timestamp", "string")).alias("venue_ts")).where("last is not null")
    quoted = books.unionByName(changes).unionByName(trades)
    # as-of by arrival: registrations and entries in one order, the last registration before an entry wins
    order = F.struct("frame_no", "elem")
    both = quoted.withColumn("reg", F.lit(None).cast("struct<condition:string,yes_leg:boolean>")).unionByName(
        tokens.select("frame_no", (F.col("part") * 1_000_000 - 1).alias("elem"), F.lit(None).cast("timestamp").alias("recv_ts"), "token", none.alias("bid"), none.alias("ask"), none.alias("last"), F.lit(None).cast("timestamp").alias("venue_ts"), F.struct("condition", "yes_leg").alias("reg"))
    )
    known = F.last("reg", ignorenulls=True).over(Window.partitionBy("token").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    known_rows = both.withColumn("known", known).where("reg is null and known is not null")
    sides = oriented(F.col("known.yes_leg"), F.col("bid"), F.col("ask"))
    entry_events = known_rows.select("frame_no", "elem", instrument_id(F.lit("polymarket"), F.col("known.condition")).alias("instrument"), F.lit("polymarket").alias("venue"), sides["bid"].alias("yes_bid"), sides["ask"].alias("yes_ask"), F.when(F.col("known.yes_leg"), F.col("last")).otherwise(complement(F.col("last"))).alias("last_price"), "venue_ts", "recv_ts")
    return sights, _ticks(market_events.select(EVENT).unionByName(entry_events.select(EVENT))), tokens


def tradable(markets: DataFrame) -> DataFrame:
    """Raw markets whose order book is on and takes orders; anything but a literal true is no."""
    v = F.try_parse_json("raw_frame")
    return markets.where(_true(v, "enableOrderBook") & _true(v, "acceptingOrders"))
