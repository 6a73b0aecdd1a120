"""Removal of repeated byte strings by families of suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or the same document
and an earlier start). Every start of such a string is a suffix; two suffixes matter to each other only if their first
``length`` bytes are equal. Suffix arrays of all positions of a corpus would take eight bytes and more for each byte of
text, so suffixes are gathered under samples: of the ``GRAM``-byte strings inside a suffix's first ``length`` bytes, the one
with the least hash (rightmost among equals) is its sample. Equal strings have equal samples at equal places, so suffixes
whose sample is unique in the corpus need no look at all. A sample and the neighbouring suffixes that share it are an entry;
the entries of a sample are a family.

Pass 1 counts samples. Pass 2 finds the samples again and sends entries of repeated ones, with the bytes around them, to
tasks by sample, in document order. There, each new batch of a family gets its suffix array: its suffixes in
lexicographic order of their first ``length`` bytes. Neighbours with a common prefix of ``length`` bytes are matches within
the batch. The array is merge-scanned against the levels of the batches before, whose matches are found likewise, and its
new suffixes become a level (their bytes, and their starts in order); levels of equal size merge, so a family of n suffixes
has about log2(n) levels.

Scale: entries that repeat as a whole inside one chunk of text, or one batch, are settled there, so a passage in a third of
all documents sends one entry a chunk. Samples with more than ``HOT`` entries (passages amid different texts) are dealt by
suffix instead of by sample: the first place of each 128-bit suffix hash is an aggregate with map-side parts, and the
places are joined with it, a join that Spark splits where a suffix is hot. Repeated samples are told to pass 2 by a bitmap
of at most ``BITS`` bits, put together from blocks of 4 kB that executors fill (checked; false hits only cost time), beyond
which they are joined. Texts over 2 MB go through in overlapping pieces.

Defined cases: a null or empty text has no bytes; strings never cross rows; rows that repeat a doc_id are ordered by their
texts' hash, and rows that also repeat the text are one document; a null doc_id comes first; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytehash import Prefix, mix
from tidemark.llm.shared import buffer_of, chunks, documents, tidy, written

GRAM = 24
BITS = 1 << 28
HOT = 20_000
_PIECE = 1 << 20
_SLICE = 1 << 16  # suffixes of a level that are compared at once
_BATCH = 4096  # entries of one suffix array
_LOW = np.uint64((1 << 31) - 1)
_FIRST = np.iinfo(np.int64).min


def _windows(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes at each start, as values that compare byte by byte."""
    if not len(at):
        return np.zeros(0, f"S{length}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[at]).reshape(-1).view(f"S{length}")


def suffix_array(data: np.ndarray, at: np.ndarray, family: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the starts ``at`` in order of family and then of their first ``length`` bytes, equal ones as they come; and
    which have a common prefix of ``length`` bytes with the one before in their family."""
    wide = np.empty((len(at), 4 + length), np.uint8)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    wide[:, :4] = family.astype(">u4").view(np.uint8).reshape(-1, 4)
    wide[:, 4:] = np.lib.stride_tricks.sliding_window_view(data, length)[at]
    keys = wide.reshape(-1).view(f"S{4 + length}")
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return order, np.append(False, keys[1:] == keys[:-1])


class Levels:
    """Suffix arrays of a family that grows by batches, sizes roughly halving. A level is the bytes of its entries and the
    starts of its suffixes in lexicographic order, all different."""

    def __init__(self, length: int):
        self.length = length
        self.arrays: list[tuple[np.ndarray, np.ndarray]] = []

    def _scan(self, level: tuple[np.ndarray, np.ndarray], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted windows belong in a level, and which have a match there: both are gone through in order, in slices."""
        data, starts = level
        place, found, at = np.zeros(len(windows), np.int64), np.zeros(len(windows), bool), 0
        for a in range(0, len(starts), _SLICE):
            own = _windows(data, starts[a : a + _SLICE], self.length)
            to = len(windows) if a + _SLICE >= len(starts) else at + int(np.searchsorted(windows[at:], own[-1], "right"))
            inside = np.searchsorted(own, windows[at:to])
            found[at:to] = own[np.minimum(inside, len(own) - 1)] == windows[at:to]
            place[at:to], at = a + inside, to
        return place, found

    def holds(self, windows: np.ndarray) -> np.ndarray:
        """Which of the sorted windows some level has."""
        found = np.zeros(len(windows), bool)
        for level in self.arrays:
            found |= self._scan(level, windows)[1]
        return found

    def add(self, data: np.ndarray, starts: np.ndarray) -> None:
        """``starts``: in order of their windows, and new to all levels."""
        if len(starts):
            self.arrays.append((data, starts))
        while len(self.arrays) > 1 and len(self.arrays[-2][1]) <= len(self.arrays[-1][1]):
            (low_data, low), (data, high) = self.arrays.pop(), self.arrays.pop()
            place = self._scan((data, high), _windows(low_data, low, self.length))[0]
            self.arrays.append((np.concatenate([data, low_data]), np.insert(high, place, low + len(data))))


def entries(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Samples of a buffer of rows: hash, row, first and last suffix start, and a hash of everything the entry spans."""
    n, wide = len(data), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    prefix = Prefix(data)
    at = np.arange(n - GRAM + 1)
    gram = prefix.of(at, at + GRAM)
    least = (gram & ~_LOW) | (_LOW - at.astype(np.uint64))
    span = 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    valid = np.zeros(n + 1, np.int32)  # starts whose string lies inside a row
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= length:
            valid[a] += 1
            valid[b - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(valid[: len(least)]) > 0)
    if not len(starts):
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    sample = (_LOW - (least[starts] & _LOW)).astype(np.int64)
    rows = np.searchsorted(ends, starts, "right") - 1
    new = np.append(True, (sample[1:] != sample[:-1]) | (rows[1:] != rows[:-1]))
    first = np.flatnonzero(new)
    low, high = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    sample = sample[first]
    whole = mix(prefix.of(low, high + length) + (sample - low).astype(np.uint64))
    return gram[sample], rows[first], low, high, whole


def _pieces(batches: Iterator[pa.RecordBatch], length: int):
    """(data, ends, doc_id, null, tag, offset of the piece in its text)."""
    for batch in chunks(batches, "text", _PIECE):
        data, ends = buffer_of(batch.column("text"))
        ids = batch.column("doc_id")
        keys = ids.fill_null(_FIRST).to_numpy(), batch.column("tag").to_numpy(), ids
        if batch.num_rows > 1 or len(data) <= 2 * _PIECE:
            yield data, ends, *keys, 0
        else:
            for at in range(0, len(data), _PIECE):
                part = data[at : at + _PIECE + length - 1]
                yield part, np.array([0, len(part)]), *keys, at


def _combined(piece, length: int):
    """Entries of a piece, and which of them are the first of those equal as a whole."""
    data, ends, ids, tags, column, offset = piece
    gram, row, low, high, whole = entries(data, ends, length)
    order = np.lexsort((low, tags[row], ids[row], whole, gram))
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (gram[a] == gram[b]) & (whole[a] == whole[b])
    first = np.ones(len(order), bool)
    first[order[same]] = False
    return gram, row, low, high, first


def _counts(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, length):
            gram, _, _, _, first = _combined(piece, length)
            each, n = np.unique(gram[first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return rows


_ENTRY = "kind int, gram long, doc_id long, tag long, low int, high int, bytes binary"


def _bit(gram: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    place = (gram >> np.uint64(5)) & np.uint64(bits - 1)
    return (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)


def _emit(length: int, maps):
    """Rows of pass 2. kind 0: an entry known to repeat (low to high are removed starts); 1: to compare; 2: of a hot sample.
    ``maps``: broadcast bitmaps of the repeated and of the hot samples, or None."""

    def among(gram: np.ndarray, bitmap: np.ndarray | None) -> np.ndarray:
        if bitmap is None:
            return np.ones(len(gram), bool)
        word, bit = _bit(gram, len(bitmap) * 64)
        return (bitmap[word] >> bit) & np.uint64(1) == 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = maps.value
        for piece in _pieces(batches, length):
            data, ends, ids, tags, column, offset = piece
            gram, row, low, high, first = _combined(piece, length)
            keep = np.flatnonzero(~first | among(gram, repeated))
            gram, row, low, high, first = (x[keep] for x in (gram, row, low, high, first))
            kind = np.where(first, 1, 0).astype(np.int32)
            if hot is not None:
                kind[first & among(gram, hot)] = 2
            size = np.where(first, high + length - low, 0)
            stop = np.cumsum(size)
            at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(low - stop + size, size)
            key = np.where(first, gram, mix(gram + np.arange(len(gram), dtype=np.uint64)))  # settled rows go anywhere
            text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], stop]).astype(np.int32)), pa.py_buffer(data[at])])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key.view(np.int64)), column.take(pa.array(row)), pa.array(tags[row]), pa.array((low - ends[row] + offset).astype(np.int32)), pa.array((high - ends[row] + offset).astype(np.int32)), text], names=["kind", "gram", "doc_id", "tag", "low", "high", "bytes"])

    return rows


def _starts(ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the buffer, row and number in its row of each suffix of entries that end at ``ends``."""
    count = np.maximum(np.diff(ends) - length + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return ends[row] + inner, row, inner


_SPAN = "doc_id long, tag long, start int, stop int"


def _spans(batch: pa.RecordBatch, row: np.ndarray, start: np.ndarray, length: int, last: np.ndarray | None = None) -> pa.RecordBatch:
    """Spans of removed starts, those that follow each other joined."""
    if last is None and len(row):
        new = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))
        first = np.flatnonzero(new)
        last = start[np.append(first[1:], len(row)) - 1]
        row, start = row[first], start[first]
    last = start if last is None else last
    take = pa.array(row)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("tag").take(take), pa.array(start.astype(np.int32)), pa.array((last + length).astype(np.int32))], names=["doc_id", "tag", "start", "stop"])


def _resolve(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_gram, levels = None, Levels(length)
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                kind = batch.column("kind").to_numpy()
                _, first = np.unique(batch.column("bytes").dictionary_encode().indices.to_numpy(), return_index=True)
                again = np.ones(len(kind), bool)
                again[first] = False  # equal bytes have equal suffixes
                settled = np.flatnonzero((kind == 0) | again)
                if len(settled):
                    yield _spans(batch, settled, batch.column("low").to_numpy()[settled], length, batch.column("high").to_numpy()[settled])
                rest = np.flatnonzero((kind == 1) & ~again)
                if not len(rest):
                    continue
                gram = batch.column("gram").to_numpy()[rest]
                opens = np.append(True, gram[1:] != gram[:-1])
                family = np.cumsum(opens) - 1
                # a family of one entry has no matches; the last family may go on
                need = (np.bincount(family)[family] > 1) | (gram == open_gram) | (gram == gram[-1])
                batch, gram, family = batch.take(pa.array(rest[need])), gram[need], family[need]
                data, ends = buffer_of(batch.column("bytes"))
                place, row, inner = _starts(ends, length)
                order, repeated = suffix_array(data, place, family[row], length)
                place, row, inner = place[order], row[order], inner[order]
                if gram[0] == open_gram:
                    until = int(np.searchsorted(family[row], family[0], "right"))
                    repeated[:until] |= levels.holds(_windows(data, place[:until], length))
                if gram[-1] != open_gram:
                    open_gram, levels = gram[-1], Levels(length)
                tail = int(np.searchsorted(family[row], family[-1]))
                low = int(ends[np.searchsorted(family, family[-1])])
                levels.add(data[low:].copy(), place[tail:][~repeated[tail:]] - low)
                row, start = row[repeated], batch.column("low").to_numpy()[row[repeated]] + inner[repeated]
                order = np.lexsort((start, row))
                yield _spans(batch, row[order], start[order], length)

    return rows


def _hot_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                data, ends = buffer_of(batch.column("bytes"))
                place, row, inner = _starts(ends, length)
                names = [pa.array(Prefix(data, k).of(place, place + length).view(np.int64)) for k in range(2)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*names, batch.column("doc_id").take(take), batch.column("tag").take(take), pa.array((batch.column("low").to_numpy()[row] + inner).astype(np.int32))], names=["s1", "s2", "doc_id", "tag", "start"])

    return rows


def _hot_spans(warm: DataFrame, length: int) -> DataFrame:
    """All places of a suffix but its first."""
    warm = written(warm, "suffixes")
    place = F.struct("doc_id", "tag", "start")
    first = warm.groupBy("s1", "s2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = warm.join(first, ["s1", "s2"]).where(~place.eqNullSafe(F.col("first")))
    return again.select("doc_id", "tag", "start", (F.col("start") + length).alias("stop"))


def _bitmap(samples: DataFrame, n: int) -> np.ndarray:
    """Bits of the samples, from blocks of 32,768 that executors fill: at most ``BITS`` bits come to the driver."""
    bits = 1 << 16
    while bits < min(16 * n, BITS):
        bits *= 2
    place = F.expr(f"(shiftrightunsigned(gram, 5) & {bits - 1}L) + 1")
    blocks = samples.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("held")).toArrow()
    out = np.zeros((max(1, bits >> 15), 1 << 12), np.uint8)
    for block, held in zip(blocks.column("block").to_pylist(), blocks.column("held").to_pylist(), strict=True):
        out[block - 1] = np.frombuffer(held, np.uint8)
    return out.reshape(-1).view(np.uint64)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a tag that tells rows with one doc_id apart: 0 where each doc_id has one row."""
    rows = documents(docs)
    alone = rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    return rows.withColumn("tag", F.lit(0).cast("long") if alone else F.xxhash64("text"))


def repeated_spans(texts: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, tag, start, stop) of the rows (doc_id, text, tag): spans of bytes to remove; they may overlap."""
    spark = texts.sparkSession
    texts = texts.dropDuplicates(["doc_id", "tag"]) if texts.select("tag").where("tag <> 0").limit(1).count() else texts  # a row never repeats itself
    counts = texts.mapInArrow(tidy(_counts(length)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    counts = written(counts, "samples")
    n, hot = counts.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") > HOT, 1))).first()
    small = n * 8 <= BITS
    maps = spark.sparkContext.broadcast((_bitmap(counts, n) if small else None, _bitmap(counts.where(F.col("n") > HOT), hot) if small and hot else None))
    rows = texts.mapInArrow(tidy(_emit(length, maps)), _ENTRY)
    if not small:
        rows = rows.join(counts, "gram", "left").where("kind = 0 or n is not null").withColumn("kind", F.when((F.col("kind") == 1) & (F.col("n") > HOT), 2).otherwise(F.col("kind"))).drop("n")
    if hot:
        rows = written(rows, "entries")
    cold = rows.where("kind < 2").repartition("gram").sortWithinPartitions("gram", "doc_id", "tag", "low").mapInArrow(tidy(_resolve(length)), _SPAN)
    if not hot:
        return cold
    warm = rows.where("kind = 2").mapInArrow(tidy(_hot_rows(length)), "s1 long, s2 long, doc_id long, tag long, start int")
    return cold.unionByName(_hot_spans(warm, length))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def span_report(docs: DataFrame, length: int = 100) -> DataFrame:
    """Per row: bytes, removed bytes, removed runs, and SHA-256 of what stays."""
    left = _texts(docs)
    spans = repeated_spans(left, length).groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    wide = left.join(spans, (F.col("tag") == F.col("_tag")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "spans")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, ends = buffer_of(batch.column("text"))
            out = []
            for a, b, spans in zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column("spans").to_pylist(), strict=True):
                own = data[a:b].tobytes()
                runs = merged(spans) if spans else []
                stay, at = [], 0
                for x, y in runs:
                    stay.append(own[at:x])
                    at = y
                stay.append(own[at:])
                out.append((len(own), sum(y - x for x, y in runs), len(runs), hashlib.sha256(b"".join(stay)).hexdigest()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return wide.mapInArrow(tidy(rows), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
