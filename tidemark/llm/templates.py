"""Benchmark decontamination by templates.

Words are compared without signs at their ends and in lower case; a number with letters after it ("5km", "3rd") is two words.
Numbers (digits, or a number word), names (a capital first letter inside a sentence) and units (a unit's word after a
number, or letters joined to it) become typed placeholders; their words are the slots. A capitalised word that opens a text,
sentence or line may be a name or not: its windows are made both ways. A window is ``size`` template words with at least
two that are no placeholder. Beside it each ``size`` words make a literal window, which finds equal words only, and an item
of fewer words makes one of all its words.
Document windows and item windows are joined by hash. Matches of a document and an item with the same shift between their
positions form a run. Windows with all slots as in the item always count; the others count if the run's slots are
consistent: equal words of the item always stand for equal words of the document. Opening words don't decide on the run:
only changed windows that take an inconsistent one for a name are left out.
An item is leaked if the windows that count cover at least ``percent`` of its places with a template window, or else of all its
places; these are the counts returned. ``verbatim`` where each of
these is also found with all slots as in the item, else ``changed`` (the same question with other values).

Plan: the hashes of the items' windows are broadcast where there are at most ``small`` of them (8 bytes each), and
documents emit matching windows only, with one narrow pass over the texts; beyond that bound all windows are joined by a
shuffle. Either way the rest is keyed by (document, item).

Defined cases: texts and items that are null or have no words can't be found or leak; an item of fewer than ``size`` words, or
of placeholders mainly, is found by its own words only, signs aside (an item of one word in every text with that word);
rows that repeat a text are each reported once by (doc_id, tag); items are told apart by item_id, which may be null, and text, so a
shared item_id can give a row for each of its texts; an empty table on either side gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytehash import Prefix, _numbers, lowered, mix, pieces, words
from tidemark.llm.shared import buffer_of, chunks, keyed, tidy

# fixed values
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams pound pounds ounce ounces ton tons ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees"
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half"
SUFFIXES = "am pm k st nd rd th"

_NUM, _NAME, _UNIT = (int(x) for x in _numbers(21, 3))
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True


def _known(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, stops, _ = words(data, np.array([0, len(data)]))
    return np.sort(Prefix(data).of(starts, stops))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def template(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per word: hash, template hash, whether it is a slot, whether it may be a name too, row, start and stop without signs at the ends."""
    starts, stops, rows = words(data, ends)
    good = np.flatnonzero(_LETTER[data] | _DIGIT[data])
    low, high = np.searchsorted(good, starts), np.searchsorted(good, stops)
    full = high > low
    raw_start, raw_stop, rows, low, high = starts[full], stops[full], rows[full], low[full], high[full]
    if not len(rows):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none.astype(bool), none.astype(bool), none, none, none
    start, stop = good[low], good[high - 1] + 1
    first = np.append(True, rows[1:] != rows[:-1])
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opens = first.copy()
    opens[1:] |= _STOP[data[raw_stop[:-1] - 1]] | (lines[raw_start[1:]] != lines[raw_stop[:-1]])
    # a number and the letters after it are two words
    letters, digits = (np.concatenate([[0], np.cumsum(kind[data])]) for kind in (_LETTER, _DIGIT))
    at = np.append(np.flatnonzero(_LETTER[data]), len(data))
    letter = np.minimum(at[np.searchsorted(at, start)], stop)
    parts = _DIGIT[data[start]] & (letter < stop) & (digits[stop] == digits[letter])
    each = np.repeat(np.arange(len(rows)), 1 + parts)
    joined = np.append(False, each[1:] == each[:-1])
    head = parts[each] & ~joined
    number_stop = good[np.searchsorted(good, letter) - 1] + 1
    start, stop = np.where(joined, letter[each], start[each]), np.where(head, number_stop[each], stop[each])
    rows, first, opens = rows[each], first[each] & ~joined, opens[each] & ~joined
    text = lowered(data)
    plain = value = Prefix(text).of(start, stop)
    number = (letters[stop] == letters[start]) | _among(value, _known(NUMBERS))
    upper = (data[start] >= 65) & (data[start] <= 90) & (stop - start > 1) & (data[np.minimum(start + 1, len(data) - 1)] >= 97)
    name = upper & ~opens & ~number & ~joined
    unit = joined & ~number
    unit[1:] |= number[:-1] & ~first[1:] & _among(value[1:], _known(f"{UNITS} {SUFFIXES}"))
    for mask, kind in ((number, _NUM), (name, _NAME), (unit, _UNIT)):
        value = np.where(mask, np.uint64(kind), value)
    return plain, value, number | name | unit, upper & opens & ~number & ~unit, rows, start, stop


def windows(data: np.ndarray, ends: np.ndarray, size: int, short: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Hash, row, first word and words of each window, the bits of its opening words that are taken for names (-1: literal),
    whether its place has a template window, and the words. ``short``: lengths of further literal windows; None: whole short rows."""
    plain, value, slot, maybe, rows, start, stop = template(data, ends)
    odd = _numbers(22, size) | np.uint64(1)
    n = len(value) - size + 1
    sums, at, chosen, fit, length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    if n > 0:
        sums, own = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(size):
            sums += value[k : k + n] * odd[k]
            own += plain[k : k + n] * odd[k]
        slots = np.concatenate([[0], np.cumsum(slot)])
        held = slots[size:] - slots[:-size]
        whole = rows[:n] == rows[size - 1 :]
        literal = np.flatnonzero(whole & (held > 0))
        own, own_fit = own[literal], held[literal] <= size - 2
        at = np.flatnonzero(whole & (held <= size - 2))
        sums, held, chosen = sums[at], held[at], np.zeros(len(at), np.int64)
        for k in range(size):
            more = np.flatnonzero(maybe[at + k] & (held < size - 2))
            other = sums[more] + (np.uint64(_NAME) - value[at[more] + k]) * odd[k]
            sums, at, held, chosen = (np.concatenate([x, y]) for x, y in ((sums, other), (at, at[more]), (held, held[more] + 1), (chosen, chosen[more] | 1 << k)))
        fit = np.append(np.ones(len(at), bool), own_fit)
        sums, at, chosen = np.append(sums, own), np.append(at, literal), np.append(chosen, np.full(len(literal), -1))
        length = np.full(len(at), size)
    count = np.bincount(rows, minlength=len(ends) - 1)
    for m in range(1, size) if short is None else short:
        n = len(plain) - m + 1
        if n <= 0:
            continue
        few = np.flatnonzero((rows[:n] == rows[m - 1 :]) & ((count[rows[:n]] == m) | (short is not None)))
        each = _numbers(2200 + m, m) | np.uint64(1)
        own = np.zeros(len(few), np.uint64)
        for k in range(m):
            own += plain[few + k] * each[k]
        sums, at, chosen, fit, length = np.append(sums, own), np.append(at, few), np.append(chosen, np.full(len(few), -1)), np.append(fit, np.zeros(len(few), bool)), np.append(length, np.full(len(few), m))
    return mix(sums), rows[at], at, length, chosen, fit, (slot, rows, start, stop)


def _reach(data: np.ndarray, at: int, need: int, back: bool) -> int:
    """The place, before or after ``at``, up to which there are ``need`` words with a letter or digit; or the buffer's end."""
    size = 1 << 14
    while True:
        low, high = (max(0, at - size), at) if back else (at, min(len(data), at + size))
        if (low == 0) if back else (high == len(data)):
            return low if back else high
        full = np.concatenate([[0], np.cumsum(_LETTER[data[low:high]] | _DIGIT[data[low:high]])])
        starts, stops, _ = words(data[low:high], np.array([0, high - low]))
        cut = 1 if back else 0  # the word at the far end may be part of one
        starts, stops = (starts[cut:], stops[cut:]) if back else (starts[:-1], stops[:-1])
        good = np.flatnonzero(full[stops] > full[starts])
        if len(good) >= need:
            return low + int(starts[good[-need]]) if back else low + int(stops[good[need - 1]])
        size *= 2


def _parts(data: np.ndarray, ends: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """A buffer of rows as it is, or a long row in parts, each with the words around that its windows need: data, row ends, and
    the range in which the part's own words begin."""
    cuts = pieces(data, ends)
    if len(cuts) == 1:
        yield data, ends, 0, len(data) + 1
        return
    for a, b in cuts:
        low, high = _reach(data, a, 3, True), _reach(data, b, 2 * size, False)
        yield data[low:high], np.array([0, high - low]), a - low, b - low


def _emit(size: int, id_column: str, wanted: np.ndarray | None, short: list[int] | None = None):
    """Rows (id, tag, hash, pos, n, fit, slots, open) of all windows, or of those in the sorted hashes ``wanted``. Long texts are
    gone through in parts, unless short rows of unknown length are asked for."""
    marks = None
    if wanted is not None:
        marks = np.zeros(1 << 22, bool)
        marks[wanted & np.uint64(len(marks) - 1)] = True

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            whole, all_ends = buffer_of(batch.column("text"))
            before = 0  # words of a long text before the part
            for data, ends, low, high in [(whole, all_ends, 0, len(whole) + 1)] if short is None else _parts(whole, all_ends, size):
                found, row, at, length, chosen, fit, (slot, owner, start, stop) = windows(data, ends, size, short)
                own = np.searchsorted(start, [low, high])
                ok = np.flatnonzero((at >= own[0]) & (at < own[1]))
                if wanted is not None:
                    ok = ok[marks[found[ok] & np.uint64(len(marks) - 1)]]
                    ok = ok[_among(found[ok], wanted)] if len(wanted) else ok[:0]
                found, row, at, length, chosen, fit = found[ok], row[ok], at[ok], length[ok], chosen[ok], fit[ok]
                pos = at - np.searchsorted(owner, row) if low == 0 and high > len(data) else at - own[0] + before
                before += int(own[1] - own[0])
                has = np.concatenate([[0], np.cumsum(slot)])
                slots: list[list[str]] = [[]] * len(at)
                opens: list[list[bool]] = [[]] * len(at)
                for i in np.flatnonzero((chosen >= 0) & ((has[at + length] > has[at]) | (chosen > 0))).tolist():
                    taken = [(w, bool(chosen[i] >> k & 1)) for k, w in enumerate(range(at[i], at[i] + size)) if slot[w] or chosen[i] >> k & 1]
                    slots[i] = [data[start[w] : stop[w]].tobytes().decode(errors="replace").lower() for w, _ in taken]
                    opens[i] = [o for _, o in taken]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(id_column).take(take), batch.column("tag").take(take), pa.array(found.view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(fit), pa.array(slots, pa.list_(pa.string())), pa.array(opens, pa.list_(pa.bool_()))], names=["id", "tag", "hash", "pos", "n", "fit", "slots", "open"])

    return rows


_WINDOW = "id long, tag long, hash long, pos int, n int, fit boolean, slots array<string>, open array<boolean>"


def leaks(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, small: int = 4_000_000) -> DataFrame:
    """One row per leaked item and document: doc_id, tag, item_id, n_windows, item_windows, kind."""
    spark = docs.sparkSession
    ours = items.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text")).transform(keyed)
    ours = ours.mapInArrow(tidy(_emit(size, "doc_id", None)), _WINDOW).select(F.col("id").alias("item_id"), F.col("tag").alias("item_tag"), F.col("hash"), F.col("pos").alias("at"), F.col("n"), F.col("fit"), F.col("slots").alias("own"), F.col("open").alias("own_open")).distinct()
    totals = ours.groupBy(F.col("item_id").alias("_id"), F.col("item_tag").alias("_tag")).agg(F.countDistinct("at").alias("places"), F.countDistinct(F.when(F.col("fit"), F.col("at"))).alias("fit_places"))
    wanted = None
    hashes = ours.select("hash", "n").distinct().limit(small + 1).toArrow()
    if len(hashes) <= small:
        wanted = np.sort(hashes.column("hash").to_numpy().view(np.uint64))
        lengths = set(hashes.column("n").to_pylist())
    else:
        lengths = {r.n for r in ours.select("n").distinct().collect()}
    short = sorted(lengths - {size})
    held = spark.sparkContext.broadcast(wanted)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit(size, "doc_id", held.value, short)(batches)

    theirs = keyed(docs).mapInArrow(tidy(emit), _WINDOW).withColumnRenamed("id", "doc_id").drop("n", "fit")
    pair = theirs.join(ours, "hash").withColumn("shift", F.col("pos") - F.col("at"))
    pair = pair.withColumn("words", F.transform(F.arrays_zip("own", "slots", "own_open", "open"), lambda w: F.struct(w["own"].alias("own"), w["slots"].alias("slots"), (w["own_open"] | w["open"]).alias("open"))))
    run = pair.groupBy("doc_id", "tag", "item_id", "item_tag", "shift").agg(F.collect_set(F.struct("at", "fit", "words")).alias("matched"))
    run = run.withColumn("words", F.array_distinct(F.flatten(F.col("matched.words"))))
    plain = lambda words: F.array_sort(F.array_distinct(F.transform(words, lambda w: F.struct(w["own"], w["slots"]))))
    run = run.withColumn("sure", plain(F.filter("words", lambda w: ~w["open"]))).withColumn("all", plain(F.col("words")))
    run = run.withColumn("unlike", F.filter("all", lambda p, n: (n > 0) & (F.get("all", n - 1)["own"] == p["own"]))["own"])
    run = run.withColumn("steady", F.size(F.array_distinct(F.col("sure.own"))) == F.size("sure"))
    each = run.select("doc_id", "tag", "item_id", "item_tag", "steady", "unlike", F.explode("matched").alias("m")).select("doc_id", "tag", "item_id", "item_tag", "m.at", "m.fit", "m.words", "steady", "unlike")
    each = each.withColumn("same", F.forall("words", lambda w: w["own"] == w["slots"]))
    each = each.where(F.col("same") | F.col("steady") & ~F.exists("words", lambda w: w["open"] & F.array_contains("unlike", w["own"])))
    places = lambda name, *of: F.size(F.collect_set(F.when(functools.reduce(lambda x, y: x & y, map(F.col, of), F.lit(True)), F.col("at")))).cast("long").alias(name)
    found = each.groupBy("doc_id", "tag", "item_id", "item_tag").agg(places("n"), places("n_same", "same"), places("n_fit", "fit"), places("n_fit_same", "fit", "same"))
    found = found.join(totals, F.col("item_id").eqNullSafe(F.col("_id")) & (F.col("item_tag") == F.col("_tag"))).withColumn("by_fit", (F.col("n_fit") > 0) & (F.col("n_fit") * 100 >= F.col("fit_places") * percent))
    found = found.where(F.col("by_fit") | (F.col("n") * 100 >= F.col("places") * percent))
    pick = lambda fit, all_: F.when(F.col("by_fit"), F.col(fit)).otherwise(F.col(all_))
    found = found.select("doc_id", "tag", "item_id", pick("n_fit", "n").alias("n_windows"), pick("fit_places", "places").alias("item_windows"), pick("n_fit_same", "n_same").alias("n_same"))
    return found.select("doc_id", "tag", "item_id", "n_windows", "item_windows", F.when(F.col("n_same") == F.col("n_windows"), "verbatim").otherwise("changed").alias("kind"))
