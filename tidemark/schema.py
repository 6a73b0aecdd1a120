"""Canonical schemas. Prices are exact decimals, never floats; timestamps are UTC."""

from __future__ import annotations

FRAME = "recv_ts timestamp, venue string, raw_frame string, frame_no long"
TICK = "instrument string, venue string, yes_bid decimal(18,9), yes_ask decimal(18,9), last_price decimal(18,9), venue_ts timestamp, recv_ts timestamp, seq long, arrival long"
INSTRUMENT = "id string, venue string, title string, description string, close_time timestamp, category string, raw string"
REGISTRY = "match_id string, legs array<string>, confidence string, method string, status string, note string"
EVENT = "match_id string, spread decimal(18,9), legs array<struct<instrument:string,mid:decimal(18,9)>>, detected_at timestamp, arrival long"
REPORT = "match_id string, detected_at timestamp, spread decimal(18,9)"
