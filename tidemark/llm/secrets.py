"""Secret scans by a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned, on the driver, into a Boolean query of trigrams that any match must hold
(``trigram_query``). ``write_index`` goes through the texts once, numbers them, and writes for each trigram that some rule asks
for the texts whose lower-cased form holds it: blocks of 32,768 numbers, in a block 64-bit words of one bit a text, sorted by
trigram. ``candidates`` looks up the rules' trigrams and intersects (or unites) their words bit by bit; words are keyed by
number, not by trigram, so a trigram that stands in every text is no hot key. Candidates are verified by the expression
itself; a rule without mandatory trigrams scans every text.

The candidates, a few texts in a hundred here, are joined to the texts: broadcast where they are at most ``SMALL`` (counted
in their table), else by a shuffle of both.

Offsets come from the built-in functions: the text split at the expression gives the gaps between matches, so a match starts
after the gaps and matches before it. Offsets count code points, ends are exclusive.

Defined cases: a null text is empty and has no spans; rows that repeat are each returned; a null doc_id is a value of its
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import documents, keyed, written

Query = bool | str | tuple
SMALL = 1_000_000  # candidates that are broadcast, about 40 bytes each


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    base: bool = False
    value_group: int = 0  # the group that has a least length
    least: int = 0


#: Order is the order of kinds among spans with one start. Runs of at least n characters are written {n,}: as a run is
#: always taken whole, that drops the same matches as a test of its length.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", True),
    Rule("hex", r"[0-9a-f]{24,}", True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def _grams(word: str) -> Query:
    return _all({word[i : i + 3] for i in range(len(word) - 2)})


def _all(parts) -> Query:
    parts = {x for p in parts if p is not True for x in (p[1:] if p[0] == "and" else [p])}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", *sorted(parts, key=str))


def _any(parts) -> Query:
    parts = set(parts)
    plain = {p: {p} if isinstance(p, str) else set(p[1:]) for p in parts if isinstance(p, str) or p is not True and p[0] == "and" and all(isinstance(x, str) for x in p)}
    parts -= {p for p, own in plain.items() if any(other < own for other in plain.values())}  # implied by another
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", *sorted(parts, key=str))


def _sequence(items) -> tuple[set[str] | None, Query]:
    """Strings that a sequence matches, if few, else None and a query for its matches."""
    query: list[Query] = []
    now, exact = {""}, True
    for op, arg in items:
        words, more = _item(op, arg)
        query.append(more)
        if words is not None and len(now) * len(words) <= 64:
            now = {a + b for a, b in product(now, words)}
        else:
            query.append(_any(map(_grams, now)))
            now, exact = words if words is not None else {""}, False
    if exact:
        return now, _all(query)
    return None, _all([*query, _any(map(_grams, now))])


def _item(op, arg) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, True
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 6:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (chars if len(chars) <= 6 else None), True
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        both = [_sequence(b) for b in arg[1]]
        if all(w is not None for w, _ in both):
            return set().union(*(w for w, _ in both)), True
        return None, _any(_all([q, True if w is None else _any(map(_grams, w))]) for w, q in both)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        words, query = _sequence(inner)
        if words is not None and low == high and len(words) ** low <= 64:
            return {"".join(p) for p in product(words, repeat=low)}, True
        if words is not None and (low, high) == (0, 1):
            return words | {""}, True
        return None, query if low else True
    if op is C.AT:
        return {""}, True
    return None, True


def trigram_query(pattern: str) -> Query:
    """True (no mandatory trigram), a trigram, or ("and" | "or", query, ...). Trigrams are in lower case."""
    words, query = _sequence(_parser.parse(pattern))
    return query if words is None else _any(map(_grams, words))


def trigrams(query: Query) -> set[str]:
    if isinstance(query, tuple):
        return set().union(*map(trigrams, query[1:]))
    return {query} if isinstance(query, str) else set()


@dataclass(frozen=True)
class Index:
    """``rows``: number, doc_id, tag of each text. ``postings``: trigram, block, words (array of struct of word, bits)."""

    rows: DataFrame
    postings: DataFrame


def write_index(docs: DataFrame, wanted: list[str]) -> Index:
    """The inverted index of the wanted trigrams, as tables in the shared folder."""
    low = keyed(docs).select("doc_id", "tag", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in wanted))) if wanted else F.array().cast("array<string>")
    # numbers follow the rows of a partition and hold once they are written
    texts = written(low.select(F.monotonically_increasing_id().alias("number"), "doc_id", "tag", held.alias("held")), "numbers")
    each = texts.select(F.explode("held").alias("trigram"), "number")
    words = each.groupBy("trigram", F.expr("number div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(number % 64 as int)))").alias("bits"))
    blocks = words.groupBy("trigram", F.expr("word div 512").alias("block")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return Index(texts.select("number", "doc_id", "tag"), written(blocks.sortWithinPartitions("trigram", "block"), "postings"))


def _holds(query: Query, lists: dict[str, Column]) -> Column:
    """Bits of the texts of one word whose lists satisfy the query."""
    if isinstance(query, str):
        return lists[query]
    return reduce((lambda a, b: a.bitwiseAND(b)) if query[0] == "and" else (lambda a, b: a.bitwiseOR(b)), (_holds(q, lists) for q in query[1:]))


def candidates(index: Index, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, tag, one Boolean per indexed rule) of the documents whose postings satisfy a rule's query."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    wanted = sorted(set().union(*map(trigrams, queries.values())))
    number = {g: f"_{k}" for k, g in enumerate(wanted)}
    found = index.postings.where(F.col("trigram").isin(wanted)).select("trigram", F.inline("words"))
    lists = found.groupBy("word").agg(*(F.bit_or(F.when(F.col("trigram") == g, F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(n) for g, n in number.items()))
    met = lists.select("word", *(_holds(q, {g: F.col(n) for g, n in number.items()}).alias(k) for k, q in queries.items()))
    some = reduce(lambda a, b: a.bitwiseOR(b), map(F.col, queries))
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftrightunsigned", some, b).bitwiseAND(F.lit(1)) == 1))
    met = met.where(some != 0).select("*", bit.alias("bit"))
    flags = [(F.call_function("shiftrightunsigned", F.col(k), F.col("bit")).bitwiseAND(F.lit(1)) == 1).alias(f"may_{k}") for k in queries]
    return met.select((F.col("word") * 64 + F.col("bit")).alias("number"), *flags).join(index.rows, "number").drop("number")


_SPANS = "array<struct<start:bigint,kind:int,stop:bigint>>"


def _spans(k: int, rule: Rule) -> Column:
    """Spans of the matches in the columns m_, g_ and v_ of the rule."""
    each = F.arrays_zip(F.col(f"m_{rule.kind}").alias("m"), F.slice(f"g_{rule.kind}", 1, F.size(f"m_{rule.kind}")).alias("g"), F.col(f"v_{rule.kind}").alias("v"))
    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        stop = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(k).alias("kind"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(F.length(x["v"]) >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(each, nothing, step, lambda acc: acc["out"])


def _text_of(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` as doc_id, text and spans (array of start, number of the rule, stop), sorted."""
    queries = [trigram_query(r.pattern) for r in rules]
    indexed = [r.kind for r, q in zip(rules, queries, strict=True) if q is not True]
    flags = [f"may_{k}" for k in indexed]
    rows = documents(docs)
    if indexed:
        may = candidates(write_index(docs, sorted(set().union(*map(trigrams, queries)))), rules)
        may = written(may.groupBy("doc_id", "tag").agg(*(F.bool_or(f).alias(f) for f in flags)), "candidates")
        right = may.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), *flags)
        left = keyed(docs)
        rows = left.join(F.broadcast(right) if may.count() <= SMALL else right, (left.tag == right["_tag"]) & left.doc_id.eqNullSafe(right["_id"]), "left")
    none = F.array().cast("array<string>")
    asked = {}
    for r in rules:
        hit = F.col("text").rlike(r.pattern)
        asked[f"hit_{r.kind}"] = F.coalesce(F.col(f"may_{r.kind}"), F.lit(False)) & hit if f"may_{r.kind}" in flags else hit
    rows = rows.select("doc_id", "text", *(c.alias(n) for n, c in asked.items()))
    found = []
    for r in rules:
        hit, p = F.col(f"hit_{r.kind}"), F.lit(r.pattern)
        found += [
            F.when(hit, F.regexp_extract_all("text", p, F.lit(0))).otherwise(none).alias(f"m_{r.kind}"),
            F.when(hit, F.split("text", r.pattern, -1)).otherwise(none).alias(f"g_{r.kind}"),
            F.when(hit, F.regexp_extract_all("text", p, F.lit(r.value_group))).otherwise(none).alias(f"v_{r.kind}"),
        ]
    rows = rows.select("doc_id", "text", *found)
    return rows.select("doc_id", "text", F.array_sort(F.concat(*(_spans(k, r) for k, r in enumerate(rules)))).alias("spans"))


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: counts and digest of the base rules' spans, and all spans as text."""
    base = [k for k, r in enumerate(rules) if r.base]
    rows = secret_spans(docs, rules).select("doc_id", "spans", F.filter("spans", lambda s: s["kind"].isin(base)).alias("own"))
    kinds = F.transform("own", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, (lambda n: lambda kind: kind == n)(k))).cast("long").alias(f"n_{rules[k].kind}") for k in base]
    return rows.select("doc_id", *counts, F.sha2(_text_of(F.col("own"), rules), 256).alias("base_sha256"), _text_of(F.col("spans"), rules).alias("spans"))

