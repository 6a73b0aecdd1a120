"""Token ids as length-delimited binary records.

Format of a shard, all numbers little-endian:

* data file: one record after another. A record is ``u64 length, u32 masked checksum of those 8 bytes, payload, u32 masked
  checksum of the payload``. The payload is ``u8 id width, u8 has doc_id, i64 doc_id, u32 ids`` and the ids, in 2 bytes each
  where the vocabulary fits, else 4.
* index file: per record ``u64 offset of the record, u64 ids before it in the shard``, then ``u64 records`` and ``u32 masked
  checksum`` of all that. A reader that wants records in any order seeks by it.

A masked checksum is the CRC-32 turned right by 15 bits plus a constant, so that checksums of data that hold checksums
stay sound.

Plan: the texts are dealt by ranges of doc_id (the key is a plain column, so taking the sample of the ranges doesn't run
Python), sorted in each task, encoded, and written by the task to the shared folder under a name of its own attempt, then
renamed: a task that runs again after a lost executor replaces the file by the same bytes. The driver gets one row a shard.

Words between ASCII blanks are encoded once and their ids kept as arrays (``words.Kept``): the tokenizers concerned never
let a token cross white space, which is checked when they are loaded (others encode whole texts). The index is written
and read in blocks, so memory doesn't follow the number of records.

Defined cases: a null text is empty and gets the end id only; null ids come first, repeated ids are ordered by their
texts' hash; an empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.shared import buffer_of, chunks, keyed, scratch_path, tidy
from tidemark.llm.words import Kept, blank_words

_HEAD = struct.Struct("<BBqI")
_FRAME = struct.Struct("<QI")
_KEPT = 1 << 19  # words that a worker keeps encoded
_PARTS = 200_000  # runs of letters that it keeps
_BLOCK = 4096  # records between two writes of the index
_MARK = "\u2980"  # stands between words that are encoded in one call
#: A line that is a run of Latin letters (each its own composed form, with a lower case of one letter), perhaps with signs
#: before and after. These parts are tokens' bounds in any case, so they are looked up on their own.
_PLAIN = re.compile("^(?:([(\\[\"#$*-]*)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\\[-`{-~]*)|.*)$", re.MULTILINE)


def turned(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def masked(data: bytes) -> int:
    return turned(zlib.crc32(data))


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return dict(zip((b for b in range(256) if b not in shown), range(256, 512), strict=False))


class WordEncoder:
    """Ids of texts as bytes of ``dtype``; equal to the library's ``encode(text, add_special_tokens=False)``."""

    loaded: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        probe = ["an ox's 12 ids ,x", "\tq  é\r\n9 ?!  z\x0b\x0cw "]
        added = self.library.get_added_tokens_decoder().values()
        self.by_word = not any(set(str(a.content)) & set(" \t\r\n\x0b\x0c") or a.lstrip or a.rstrip for a in added)
        self.by_word = self.by_word and all(self.whole([t]) == [b"".join(self.whole(t.split()))] for t in probe)
        self.parts: dict[str, bytes] = {}
        self.letters = _byte_letters()
        plain = ["Éclair,", "(\"it'", "a***", "the", "ÜBER!!", "Ǆñandú?", "x"]
        self.by_part = self.by_word and self.plain(plain) == self.whole(plain)
        self.kept = Kept(self.new_words, _KEPT)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, words: list[str]) -> list[bytes | None]:
        """Ids of words of plain letters with signs around them, the letters' by the model alone; None for other words."""
        found = _PLAIN.findall("\n".join(words).lower())
        if len(self.parts) > _PARTS:
            self.parts.clear()
        parts, tokenize, signs, letters, kind = self.parts, self.library.model.tokenize, self.signs, self.letters, self.dtype.char
        for core in {c for _, c, _ in found if c}.difference(parts):
            shown = core if core.isascii() else core.encode().decode("latin-1").translate(letters)
            parts[core] = array(kind, [t.id for t in tokenize(shown)]).tobytes()
        return [None if not c else parts[c] if not a and not z else (signs(a) if a else b"") + parts[c] + (signs(z) if z else b"") for a, c, z in found]

    def signs(self, run: str) -> bytes:
        ids = self.parts.get(run)
        if ids is None:
            ids = self.parts[run] = self.whole([run])[0]
        return ids

    def new_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids of words without blanks, and where each word's end."""
        ids: list[bytes | None] = self.plain(words) if self.by_part else [None] * len(words)
        rest = [n for n, x in enumerate(ids) if x is None]
        if rest:
            for n, x in zip(rest, self.words([words[n] for n in rest]), strict=True):
                ids[n] = x
        return np.frombuffer(b"".join(ids), np.uint8), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words without blanks, by one library call on all of them with a mark between; its ids tell them apart."""
        mark = self.whole([_MARK])[0]
        if not mark or any(_MARK in w for w in words):
            return self.whole(words)
        raw = self.whole([f" {_MARK} ".join(words)])[0]
        ids, own = np.frombuffer(raw, self.dtype), np.frombuffer(mark, self.dtype)
        hit = np.ones(max(0, len(ids) - len(own) + 1), bool)
        for k in range(len(own)):
            hit &= ids[k : k + len(hit)] == own[k]
        at = np.flatnonzero(hit) * self.dtype.itemsize
        if len(at) != len(words) - 1:
            raise ValueError("marks between words were lost")
        starts, stops = [0, *(at + len(mark)).tolist()], [*at.tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(starts, stops, strict=True)]

    def __call__(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a string column without nulls."""
        if not self.by_word:
            data, ends = buffer_of(column)
            return self.whole([data[a:b].tobytes().decode(errors="replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
        words, upto = blank_words(column)
        data, ends = self.kept.codes(words)
        raw, ends = data.tobytes(), ends[upto].tolist()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class _Shard:
    """A data and an index file, written under attempt-bound names and renamed when whole."""

    def __init__(self, folder: str, part: int, attempt: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.names = [f"{root}/tokens-{part:06d}.{kind}" for kind in ("bin", "idx")]
        self.temporary = [f"{n}.{attempt}.tmp" for n in self.names]
        self.file, self.index = map(self.fs.open_output_stream, self.temporary)
        self.at, self.tokens, self.records, self.crc = 0, 0, 0, 0
        self.pending: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: bytes, width: int) -> None:
        payload = _HEAD.pack(width, doc_id is not None, doc_id or 0, len(ids) // width) + ids
        length = struct.pack("<Q", len(payload))
        frame = b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))
        self.pending.append((self.at, self.tokens))
        self.file.write(frame)
        self.at += len(frame)
        self.tokens += len(ids) // width
        self.records += 1
        if len(self.pending) == _BLOCK:
            self._flush()

    def _flush(self) -> None:
        body = np.array(self.pending, "<u8").tobytes()
        self.crc = zlib.crc32(body, self.crc)
        self.index.write(body)
        self.pending = []

    def close(self) -> None:
        self._flush()
        self.index.write(struct.pack("<QI", self.records, turned(zlib.crc32(struct.pack("<Q", self.records), self.crc))))
        for f in (self.file, self.index):
            f.close()
        for a, b in zip(self.temporary, self.names, strict=True):
            self.fs.move(a, b)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> list[dict]:
    """Writes the shards in ascending doc_id order and returns one dict (part, records, tokens) for each, in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encode = WordEncoder.of(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        shard = None
        for batch in chunks(batches, "text", 1 << 20):
            shard = shard or _Shard(folder, task.partitionId(), task.taskAttemptId())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                shard.add(doc_id, ids + end, encode.dtype.itemsize)
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "records": [shard.records], "tokens": [shard.tokens]})

    dealt = keyed(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tag")
    return sorted((r.asDict() for r in dealt.mapInArrow(tidy(write), "part long, records long, tokens long").collect()), key=lambda r: r["part"])


def read_index(fs: pafs.FileSystem, path: str, records: int) -> Iterator[np.ndarray]:
    """(offset, ids before it) per record, in blocks; fails at the end where the checksum doesn't hold."""
    crc = 0
    with fs.open_input_stream(path) as f:
        for at in range(0, records, _BLOCK):
            body = f.read(16 * min(_BLOCK, records - at))
            crc = zlib.crc32(body, crc)
            yield np.frombuffer(body, "<u8").reshape(-1, 2)
        tail = f.read()
    if len(tail) != 12 or struct.unpack("<QI", tail) != (records, turned(zlib.crc32(tail[:8], crc))):
        raise ValueError(f"{path}: index checksum")


def read_record(file, offset: int) -> tuple[int | None, np.ndarray]:
    """The record at ``offset``: doc_id and ids; fails where a checksum doesn't hold."""
    file.seek(offset)
    head = file.read(_FRAME.size)
    length, check = _FRAME.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError(f"length checksum at {offset}")
    payload = file.read(length)
    if masked(payload) != struct.unpack("<I", file.read(4))[0]:
        raise ValueError(f"payload checksum at {offset}")
    width, has, doc_id, n = _HEAD.unpack(payload[: _HEAD.size])
    ids = np.frombuffer(payload[_HEAD.size :], f"<u{width}")
    if len(ids) != n:
        raise ValueError(f"id count at {offset}")
    return (doc_id if has else None), ids


def read_tokens(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """Per record: doc_id, start (ids in all records before), n_tokens, ids_crc32 (ids as unsigned 32-bit). One task a shard."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    before = np.cumsum([0, *(s["tokens"] for s in shards)]).tolist()
    parts = [(s["part"], s["records"]) for s in shards]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                part, records = parts[k]
                name = f"{root}/tokens-{part:06d}"
                with fs.open_input_file(f"{name}.bin") as file:
                    for index in read_index(fs, f"{name}.idx", records):
                        rows = []
                        for offset, start in index.tolist():
                            doc_id, ids = read_record(file, offset)
                            rows.append((doc_id, before[k] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(tidy(read), schema)


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encodes, writes to the shared folder, and reads back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(docs, tokenizer, end_id, folder))
