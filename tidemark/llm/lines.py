"""Line dedup: range-partitioned line hashes, sorted by document and position, streamed to keep bitmaps.

Lines end at \\n. A line's key is the line without blanks, tabs and line-end characters at its ends, A-Z lowered. Keys of
at least ``min_chars`` code points found in at least ``min_docs`` documents are common.

Two modes: ``keep="none"`` drops every line with a common key; ``keep="first"`` keeps the first one by (doc_id, position).

Plan: one narrow pass turns each line into (128-bit hash, document, position), written as a table. The rows are dealt by
ranges of (hash, document), so a line that stands in a third of all documents is split over many tasks, and sorted by
(hash, document, position) in each. A task streams through its rows and holds back only the lines of the first
``min_docs - 1`` documents of a hash. Only the first and last hash of a task can go on in another task: their counts
(two rows a task) are summed and broadcast, which settles the held-back lines of these.

Defined cases: a null text is one empty line; a document is a (doc_id, text) pair, so rows that repeat both count once and
get the same bitmap, and a null doc_id is a value of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytehash import SPACE, Prefix, lowered, pieces
from tidemark.llm.shared import buffer_of, chunks, keyed, tidy, written

_BREAK = np.zeros(256, bool)
_BREAK[10] = True
_LINE = "h1 long, h2 long, doc_id long, tag long, pos int"
_MARK = "kind int, h1 long, h2 long, doc_id long, tag long, pos int, n long"


def _lines(data: np.ndarray, ends: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
    """Row and position of each line with a key of ``min_chars`` code points and more, the key's hashes, and all lines' number."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([ends[:-1], breaks + 1]))
    stops = np.sort(np.concatenate([ends[1:], breaks]))
    counts = np.diff(np.searchsorted(breaks, ends)) + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    full = np.flatnonzero(~SPACE[data])
    low, high = np.searchsorted(full, starts), np.searchsorted(full, stops)
    good = np.flatnonzero(high > low)
    start, stop = full[low[good]], full[high[good] - 1] + 1
    del full
    if min_chars > 1:
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        long = points[stop] - points[start] >= min_chars
        start, stop, good = start[long], stop[long], good[long]
    text = lowered(data)
    return owner[good], pos[good], [Prefix(text, k).of(start, stop) for k in range(2)], len(starts)


def _line_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, ends = buffer_of(batch.column("text"))
            before = 0
            for a, b in pieces(data, ends, _BREAK):  # a long text's pieces end before a line break, whose line is the next one
                part, own = (data, ends) if (a, b) == (0, len(data)) else (data[a:b], np.array([0, b - a]))
                owner, pos, hashes, n = _lines(part, own, min_chars)
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(pa.array(h.view(np.int64)) for h in hashes), batch.column("doc_id").take(at), batch.column("tag").take(at), pa.array((pos + before).astype(np.int32))], names=["h1", "h2", "doc_id", "tag", "pos"])
                before += n - 1

    return rows


class _Runs:
    """Streams the sorted rows of a task and tells lines to drop (kind 0), lines that another task's count decides
    (kind 1), and for the first and last hash of the task its documents (kind 2) and, where first lines stay, its
    first line (kind 3)."""

    def __init__(self, min_docs: int, first_stays: bool):
        self.min_docs, self.first_stays = min_docs, first_stays
        self.key, self.doc, self.docs, self.edge = None, None, 0, True
        self.held: list[pa.Table] = []
        self.lead: pa.Table | None = None

    def out(self, kind: int, rows: pa.Table, n: int | None = None) -> pa.RecordBatch:
        size = rows.num_rows
        columns = [rows.column(c).combine_chunks() for c in ("h1", "h2", "doc_id", "tag", "pos")]
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *columns, pa.array([n] * size, pa.int64())], names=["kind", "h1", "h2", "doc_id", "tag", "pos", "n"])

    def open(self, key: tuple[int, int]) -> None:
        self.key, self.docs, self.held, self.lead = key, 0, [], None

    def feed(self, part: pa.Table, docs: int) -> Iterator[pa.RecordBatch]:
        self.docs += docs
        if self.lead is None:
            self.lead = part.slice(0, 1)
            part = part.slice(1) if self.first_stays else part
        self.held.append(part)
        if self.docs >= self.min_docs:
            yield self.out(0, pa.concat_tables(self.held))
            self.held = []

    def close(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.key is not None and (self.edge or last):
            if self.held:
                yield self.out(1, pa.concat_tables(self.held))
            yield self.out(2, self.lead, self.docs)
            if self.first_stays:
                yield self.out(3, self.lead)
        if self.key is not None:
            self.edge = False
        self.key = None

    def settled(self, rows: pa.Table, low: np.ndarray, high: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Runs that lie inside one batch and aren't the task's first or last."""
        pick = np.repeat(docs >= self.min_docs, high - low)
        if self.first_stays:
            pick[low - low[0]] = False
        if pick.any():
            yield self.out(0, rows.take(pa.array(np.flatnonzero(pick) + low[0])))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            h1, h2, tag = (batch.column(c).to_numpy() for c in ("h1", "h2", "tag"))
            ids, null = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = self.key != (int(h1[0]), int(h2[0]))
            fresh = new.copy()
            fresh[1:] |= (ids[1:] != ids[:-1]) | (tag[1:] != tag[:-1]) | (null[1:] != null[:-1])
            fresh[0] |= self.doc != (ids[0], null[0], tag[0])
            seen = np.concatenate([[0], np.cumsum(fresh)])
            edges = np.union1d(np.flatnonzero(new), [0, len(h1)])
            docs = np.diff(seen[edges])
            part = lambda k: rows.slice(int(edges[k]), int(edges[k + 1] - edges[k]))
            at, last = 0, len(edges) - 2
            if not new[0]:
                yield from self.feed(part(0), int(docs[0]))
                at = 1
            if at <= last:
                yield from self.close()
                if self.edge and at < last:
                    self.open((int(h1[edges[at]]), int(h2[edges[at]])))
                    yield from self.feed(part(at), int(docs[at]))
                    yield from self.close()
                    at += 1
                if at < last:
                    yield from self.settled(rows, edges[at:last], edges[at + 1 : last + 1], docs[at:last])
                self.open((int(h1[edges[last]]), int(h2[edges[last]])))
                yield from self.feed(part(last), int(docs[last]))
            self.doc = (ids[-1], null[-1], tag[-1])
        yield from self.close(last=True)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for places in batch.column("places"):
            places = places.values.to_numpy()
            keep = np.ones(int(places.max()) // 8 * 8 + 8, bool)
            keep[places] = False
            out.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(out, pa.binary())], names=["doc_id", "tag", "keep"])


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """One row (doc_id, tag, pos) per line to drop; ``tag`` tells rows with the same doc_id apart."""
    if keep not in ("none", "first"):
        raise ValueError(keep)
    lines = written(keyed(docs).mapInArrow(tidy(_line_rows(min_chars)), _LINE), "lines")
    order = ["h1", "h2", "doc_id", "tag", "pos"]
    first_stays = keep == "first"
    dealt = lines.repartitionByRange("h1", "h2", "doc_id", "tag").sortWithinPartitions(*order)
    marks = written(dealt.mapInArrow(tidy(lambda batches: _Runs(min_docs, first_stays)(batches)), _MARK), "marks")
    lead = F.struct("doc_id", "tag", "pos")
    # at most two rows a task: small whatever the lines hold
    totals = F.broadcast(marks.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.min(lead).alias("lead")).where(F.col("docs") >= min_docs))
    open_lines = marks.where("kind in (1, 3)").drop("n").join(totals, ["h1", "h2"]).where((F.col("kind") == 1) | ~lead.eqNullSafe(F.col("lead")))
    wanted = ["doc_id", "tag", "pos"]
    return marks.where("kind = 0").select(wanted).unionByName(open_lines.select(wanted))


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """(doc_id, tag, keep) of the documents that lose a line. ``keep``: zlib of packed bits, one a line, 1 = stays; lines
    past its end stay. Documents that aren't listed stay whole. A row's positions are gathered per document, so memory
    follows the longest document."""
    places = dropped_lines(docs, min_docs, min_chars, keep).groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("places"))
    return places.mapInArrow(tidy(_bitmaps), "doc_id long, tag long, keep binary")


def kept_text(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """The text without the lines that the bitmap drops, its lines before, and how many went."""
    lines = text.split("\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
    stay = [x for k, x in enumerate(lines) if k >= len(bits) or bits[k]]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def line_report(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Per document: lines, dropped lines, and the SHA-256 of what stays."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            kept = [kept_text(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True)]
            digests = [hashlib.sha256(t.encode()).hexdigest() for t, _, _ in kept]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for _, n, _ in kept], pa.int64()), pa.array([n for _, _, n in kept], pa.int64()), pa.array(digests)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    left = keyed(docs)
    right = bitmaps.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "keep")
    wide = left.join(right, (left.tag == right["_tag"]) & left.doc_id.eqNullSafe(right["_id"]), "left").select("doc_id", "text", "keep")
    return wide.mapInArrow(tidy(rows), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
