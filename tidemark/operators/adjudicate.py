"""Adjudication of similar pairs by a judge from outside: text in, verdicts out. Without one, pairs stay for review.

A judge is a function from a prompt to a reply. Pairs are asked for in batches; a reply that can't be read, or doesn't cover
its batch exactly, leaves the whole batch to the lexical rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.titles import slug
from tidemark.operators.matching import two_places
from tidemark.tables import numbered_rows

_VERDICT = "array<struct<index:bigint,same:boolean,confidence:double,reason:string>>"
TASK = (
    "Below are numbered pairs of event contracts of two venues. Say of each pair whether both settle on one and the same "
    "event by the same rules: equal level, equal date, equal direction. Another level or date is another event.\n"
    'Answer with a JSON array only, one object a pair, in order: [{"index": 0, "same": true, "confidence": 0.95, "reason": "a short sentence"}]\n'
)


def truncated(text: Column, most: int = 600) -> Column:
    """The first ``most`` characters (code points)."""
    return F.left(text, F.lit(most))


def contract_text(label: str, side: str) -> Column:
    """The lines of one contract: its title, and description and close time where it has them."""
    at = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(f"{side}.close_time").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [F.concat(F.lit(f"  {label} ["), F.col(f"{side}.venue"), F.lit("] "), F.col(f"{side}.title")), F.concat(F.lit(f"  {label} rules: "), truncated(F.col(f"{side}.description"))), F.concat(F.lit(f"  {label} closes: "), at)]
    return F.concat_ws("\n", *lines)


def prompts(pairs: DataFrame, instruments: DataFrame, size: int = 16) -> DataFrame:
    """(batch, prompt, pairs in order) of pairs a_id, b_id, score: best score first, ``size`` a batch."""
    rows = numbered_rows(pairs.withColumns({"_of": F.lit(0), "_s": -F.col("score")}), ["_of"], ["_s", "a_id", "b_id"], "_n").drop("_of", "_s")
    sides = instruments.select("id", "venue", "title", "description", "close_time")
    wide = rows.join(sides.alias("a"), F.col("a_id") == F.col("a.id")).join(sides.alias("b"), F.col("b_id") == F.col("b.id"))
    place = ((F.col("_n") - 1) % size).cast("int")
    text = F.concat(F.lit("\nPair "), place.cast("string"), F.lit(":\n"), contract_text("A", "a"), F.lit("\n"), contract_text("B", "b"), F.lit("\n"))
    each = wide.select(F.expr(f"(_n - 1) div {size}").alias("batch"), F.struct(place.alias("place"), "a_id", "b_id", "score").alias("pair"), F.struct(place.alias("place"), text.alias("text")).alias("part"))
    groups = each.groupBy("batch").agg(F.array_sort(F.collect_list("pair")).alias("pairs"), F.array_sort(F.collect_list("part")).alias("parts"))
    return groups.select("batch", F.concat(F.lit(TASK), F.array_join(F.col("parts.text"), "")).alias("prompt"), "pairs")


def verdicts(reply: Column, expected: Column) -> Column:
    """The verdicts of a reply in order, confidence held within 0 to 1: what stands from its first ``[`` to its last ``]``. Null
    where that is no array of verdicts or doesn't cover 0 to expected - 1 exactly once each."""
    found = F.nullif(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), F.lit(""))
    rows = F.array_sort(F.from_json(found, _VERDICT, {"mode": "PERMISSIVE"}))
    whole = F.when(expected > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(expected.cast("bigint") - 1, F.lit(0))), lambda x: x)).otherwise(F.array().cast("array<bigint>"))
    full = (F.transform(rows, lambda v: v["index"]) == whole) & ~F.exists(rows, lambda v: v["same"].isNull() | v["confidence"].isNull())
    held = F.transform(rows, lambda v: F.struct(v["index"].alias("index"), v["same"].alias("same"), F.least(F.greatest(v["confidence"], F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.coalesce(v["reason"], F.lit("")).alias("reason")))
    return F.when(full, held)


def band(same: Column, confidence: Column, high: float = 0.9, review: float = 0.6) -> Column:
    """high, review, or null: dropped."""
    return F.when(same & (confidence >= high), "high").when(same & (confidence >= review), "review")


def asked(batches: DataFrame, judge: Callable[[str], str]) -> DataFrame:
    """(batch, pairs, reply): the judge's answer to each prompt; null where it raised."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            replies = []
            for prompt in part.column("prompt").to_pylist():
                try:
                    replies.append(judge(prompt))
                except Exception:  # noqa: BLE001 - any failure of the judge leaves the batch to the lexical rule
                    replies.append(None)
            yield pa.RecordBatch.from_arrays([part.column("batch"), part.column("pairs"), pa.array(replies, pa.string())], names=["batch", "pairs", "reply"])

    schema = batches.select("batch", "pairs").schema.add("reply", "string")
    return batches.select("batch", "prompt", "pairs").mapInArrow(ask, schema)


def adjudicated(pairs: DataFrame, titles: DataFrame, judge: Callable[[str], str], size: int = 16, high: float = 0.9, review: float = 0.6, lexical: float = 0.55) -> DataFrame:
    """Chosen pairs as matches by the judge's verdicts; pairs of a batch without any by their lexical score."""
    replies = asked(prompts(pairs, titles, size), judge).withColumn("v", verdicts(F.col("reply"), F.size("pairs")))
    each = replies.select(F.col("v").isNull().alias("failed"), F.posexplode("pairs").alias("k", "p"), "v").select("failed", "p.a_id", "p.b_id", "p.score", F.get("v", F.col("k")).alias("v"))
    own = F.when(F.col("failed"), F.when(F.col("score") >= lexical, "review")).otherwise(band(F.col("v.same"), F.col("v.confidence"), high, review))
    note = F.when(F.col("failed"), F.concat(F.lit("lexical score "), two_places(F.col("score")))).otherwise(F.concat(F.lit("judge "), two_places(F.col("v.confidence")), F.lit(": "), F.trim("v.reason")))
    rows = each.select("a_id", "b_id", own.alias("confidence"), note.alias("note")).where("confidence is not null")
    sets = titles.select("id", "combined")
    rows = rows.join(sets.select(F.col("id").alias("a_id"), F.col("combined").alias("ca")), "a_id").join(sets.select(F.col("id").alias("b_id"), F.col("combined").alias("cb")), "b_id")
    legs = F.array_sort(F.array("a_id", "b_id"))
    return rows.select(slug(F.array_intersect("ca", "cb"), legs).alias("match_id"), legs.alias("legs"), "confidence", F.lit("embedding").alias("method"), "note")
