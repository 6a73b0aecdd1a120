"""Price expressions over exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = "decimal(18,9)"


def price(text: Column) -> Column:
    """A string or number as a price; ``.48`` counts, exponents and other text are null."""
    plain = F.trim(text.cast("string"))
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain).try_cast(PRICE)


def cents(value: Column) -> Column:
    """Cents as a probability."""
    return (value * F.lit("0.01").cast("decimal(3,2)")).cast(PRICE)


def complement(p: Column) -> Column:
    return (F.lit(1).cast("decimal(1,0)") - p).cast(PRICE)


def mid(bid: Column, ask: Column) -> Column:
    """Middle of both sides, or the one there is."""
    return F.coalesce(((bid + ask) * F.lit("0.5").cast("decimal(2,1)")).cast(PRICE), bid, ask)


def oriented(yes_leg: Column, bid: Column, ask: Column) -> Column:
    """Sides of a contract as those of its yes leg: a no leg's sides swap and complement."""
    return F.when(yes_leg, F.struct(bid.alias("bid"), ask.alias("ask"))).otherwise(F.struct(complement(ask).alias("bid"), complement(bid).alias("ask")))


def yes_index(outcomes: Column) -> Column:
    """Place of the first "yes" in any case, else 0."""
    return F.greatest(F.array_position(F.transform(outcomes, lambda x: F.lower(x)), "yes") - 1, F.lit(0)).cast("int")


def string_list(text: Column) -> Column:
    """The strings of a JSON array that stands in a string; other elements are left out. Null where it isn't an array."""
    raw = F.from_json(text, "array<variant>")
    strings = F.filter(raw, lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(strings, lambda v: F.variant_get(v, "$", "string"))


def last_price_of(levels: Column) -> Column:
    """Price of the last level of a book side."""
    return price(F.try_element_at(levels, F.lit(-1))["price"])


def instant(text: Column) -> Column:
    """An RFC 3339 time; dates and times without a zone are null."""
    full = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(full, F.try_to_timestamp(F.regexp_replace(F.upper(text), " ", "T")))


def millis(text: Column) -> Column:
    return F.timestamp_millis(text.cast("string").try_cast("bigint"))


def instrument_id(venue: Column, native: Column) -> Column:
    return F.concat_ws(":", venue, native)


def native_id(instrument: Column) -> Column:
    return F.regexp_replace(instrument, "^[^:]*:", "")


def stored(value: Column) -> Column:
    """As stored: 6 places, half to even."""
    return F.bround(value, 6).cast("decimal(9,6)")


def stored_time(ts: Column) -> Column:
    """As stored: text in UTC, cut to milliseconds, whatever the session's time zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss.SSS")


def utc(ts: Column) -> Column:
    """A time without a zone as the UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts.cast("timestamp_ntz")).cast("timestamp")
