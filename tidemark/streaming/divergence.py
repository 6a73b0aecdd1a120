"""The divergence pipeline over a stream of ticks: keyed state per match, one shuffle.

State of a match: each leg's last counted quote and seq, and the last report. Inside a micro-batch a match's ticks are
processed in arrival order. There is no watermark: lateness is decided by seq alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "match_id string, arrival long, spread_nano long, detected_us long, legs array<struct<instrument:string,mid_nano:long>>"
_STATE = "legs array<struct<instrument:string,seq:long,mid:long,at:long>>, reported boolean, last_at long, last_spread long"


def _mid(bid, ask) -> int | None:
    if pd.isna(bid) or pd.isna(ask):
        one = ask if pd.isna(bid) else bid
        return None if pd.isna(one) else int(one) * 1
    both = int(bid) + int(ask)
    return (both + 1) // 2 if both >= 0 else -((1 - both) // 2)  # halves away from zero, as in prices.mid


def stepper(threshold: str, freshness_s: int, debounce_s: int, widening: str) -> Callable:
    nano = lambda x: int(Decimal(x).scaleb(9))
    least, step = nano(threshold), nano(widening)
    fresh, wait = freshness_s * 1_000_000, debounce_s * 1_000_000

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        legs: dict[str, tuple] = {}
        reported, last_at, last_spread = False, 0, 0
        if state.exists:
            held, reported, last_at, last_spread = state.get
            legs = {x["instrument"]: (x["seq"], x["mid"], x["at"]) for x in (r.asDict() if hasattr(r, "asDict") else r for r in held)}
        out = []
        rows = pd.concat(list(frames)).sort_values("arrival")
        order = list(rows["all_legs"].iloc[0])
        for r in rows.itertuples(index=False):
            if r.instrument in legs and r.seq <= legs[r.instrument][0]:
                continue
            legs[r.instrument] = (int(r.seq), _mid(r.bid_nano, r.ask_nano), int(r.us))
            live = [(i, legs[i][1]) for i in order if i in legs and legs[i][1] is not None and r.us - legs[i][2] < fresh]
            if len(live) < 2:
                continue
            mids = [m for _, m in live]
            spread = max(mids) - min(mids)
            if spread >= least and not (reported and r.us - last_at < wait and spread - last_spread < step):
                reported, last_at, last_spread = True, int(r.us), spread
                out.append((key[0], int(r.arrival), spread, int(r.us), [{"instrument": i, "mid_nano": m} for i, m in live]))
        state.update(([{"instrument": i, "seq": s, "mid": m, "at": a} for i, (s, m, a) in legs.items()], reported, last_at, last_spread))
        yield pd.DataFrame(out, columns=["match_id", "arrival", "spread_nano", "detected_us", "legs"])

    return run


def divergence_stream(ticks: DataFrame, matches: DataFrame, threshold: str = "0.03", freshness_s: int = 60, debounce_s: int = 10, widening: str = "0.01") -> DataFrame:
    """``ticks``: a stream of canonical ticks; ``matches``: a static table, read again by each micro-batch."""
    legs = matches.where(F.size("legs") >= 2).select("match_id", F.col("legs").alias("all_legs"), F.explode(F.array_distinct("legs")).alias("instrument"))
    nano = lambda c: (F.col(c) * 1_000_000_000).cast("long")
    rows = ticks.join(legs, "instrument").select("match_id", "instrument", "all_legs", "arrival", "seq", F.unix_micros("recv_ts").alias("us"), nano("yes_bid").alias("bid_nano"), nano("yes_ask").alias("ask_nano"))
    return rows.groupBy("match_id").applyInPandasWithState(stepper(threshold, freshness_s, debounce_s, widening), _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def consume(ticks: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 0.5):
    """Starts a query that hands each micro-batch to ``on_batch`` (publish, store, mirror)."""
    return ticks.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
