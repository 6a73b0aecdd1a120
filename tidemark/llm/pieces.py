"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols, one a character, with blanks as U+2581 and one before the text. An agenda holds every adjacent pair
of symbols that together are a piece, best score first and leftmost first among equals; the best pair is merged until none
is left. Characters without a piece fall back to their bytes.

Where no piece has a U+2581 after another character, no merge crosses the beginning of a word, so words are encoded on
their own and kept. The agendas of many words are worked off side by side: words with equally many symbols are rows of one
matrix of the ranks of their pairs, each step merges every row's best pair, and rows without a pair leave. Words of more
than ``_LONG`` symbols and words with characters without a piece have an agenda of their own, a heap. All words that a worker
meets anew in an Arrow batch are also encoded by the sentencepiece library in one call; a difference stops the job.
Decoding is the library's.

Vocabularies with user-defined or unused pieces, without byte fallback, or with another normalisation are refused.

Defined cases: a null or empty text has the begin and end id only and decodes to the empty text; rows that repeat are
encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.bytehash import mix
from tidemark.llm.shared import buffer_of, chunks, documents, tidy
from tidemark.llm.words import Kept, binaries

_BLANK = "▁"
_KEPT = 1 << 19  # words that a worker keeps encoded
_LONG = 32
_NEVER = np.iinfo(np.int32).max


class Pairs:
    """Which piece two pieces make, by an open-addressing table."""

    def __init__(self, pieces: dict[str, int]):
        made = [(pieces[p[:k]], pieces[p[k:]], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces]
        left, right, whole = np.array(made, np.int64).reshape(-1, 3).T
        slots = 1 << 16
        while slots < 4 * len(made):
            slots *= 2
        self.mask = slots - 1
        self.key, self.whole = np.full(slots, -1, np.int64), np.full(slots, -1, np.int32)
        key = left << 32 | right
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = np.flatnonzero(self.key[slot] < 0)
            self.key[slot[free]] = key[todo[free]]
            own = self.key[slot] == key[todo]
            self.whole[slot[own]] = whole[todo[own]]
            todo, slot = todo[~own], (slot[~own] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces; -1 where there is none."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        held = self.key[slot]
        out = np.where(held == key, self.whole[slot], np.int32(-1))
        todo = np.flatnonzero((held != key) & (held >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            held = self.key[slot]
            hit = held == key[todo]
            out[todo[hit]] = self.whole[slot[hit]]
            go = ~hit & (held >= 0)
            todo, slot = todo[go], slot[go]
        return out


class PieceModel:
    loaded: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.score = {pieces[i]: sp.get_score(i) for i in plain}
        self.id = {pieces[i]: i for i in plain}
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        probe = f"  a\tb  {_BLANK}é ﬁ "
        if len(self.bytes) != 256 or any(sp.is_unused(i) for i in range(size)) or sp.normalize(probe) != _BLANK + probe.replace(" ", _BLANK):
            raise ValueError(f"{path}: not a plain merge-type vocabulary with byte fallback")
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
        many = [p for p in self.id if len(p) > 1]
        self.lines = not any("\n" in p for p in many)  # a line break is a word of its own
        self.by_word = not any(_BLANK in p.lstrip(_BLANK) for p in many)
        self.pairs = Pairs(self.id)
        self.rank = np.full(size + 1, _NEVER, np.int32)  # of the best score first; equal scores have equal ranks; the last is no piece's
        self.rank[plain] = np.unique([-self.score[pieces[i]] for i in plain], return_inverse=True)[1]
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[32] = self.id[_BLANK]
        self.kept = Kept(self.checked, _KEPT)

    @classmethod
    def of(cls, path: str) -> PieceModel:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def agenda(self, word: str) -> list[int]:
        """Ids of one run of symbols."""
        whole = self.id.get(word)
        symbols: list[str] = list(word)
        n = len(symbols)
        if n == 1:
            return [whole] if whole is not None else [self.bytes[b] for b in word.encode(errors="replace")]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        score = self.score
        todo = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in score:
                todo.append((-score[pair], i, i + 1, len(pair)))
        heapq.heapify(todo)
        while todo:
            _, i, j, size = heapq.heappop(todo)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size or right[i] != j:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                pair = symbols[i] + symbols[k]
                if pair in score:
                    heapq.heappush(todo, (-score[pair], i, k, len(pair)))
            h = left[i]
            if h >= 0:
                pair = symbols[h] + symbols[i]
                if pair in score:
                    heapq.heappush(todo, (-score[pair], h, i, len(pair)))
        out = []
        for s in symbols:
            if s:
                one = self.id.get(s)
                if one is not None:
                    out.append(one)
                else:
                    out += [self.bytes[b] for b in s.encode(errors="replace")]
        return out

    def agendas(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's end."""
        joined = "".join(words)
        symbols = self.symbol[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        unknown = np.add.reduceat(symbols < 0, start) > 0
        alone = np.flatnonzero(unknown | (size > _LONG))
        own = [np.array(self.agenda(words[i].replace(" ", _BLANK)), np.uint32) for i in alone.tolist()]
        count = np.zeros(len(words), np.int64)
        count[alone] = [len(x) for x in own]
        size[alone] = 0
        done: list[tuple[np.ndarray, np.ndarray]] = [(alone[i : i + 1], x[None, :]) for i, x in enumerate(own)]
        row, ids, best = np.zeros(0, np.int64), np.zeros((0, _LONG + 1), np.int32), np.zeros((0, _LONG), np.int32)
        for wide in range(_LONG, 0, -1):
            fresh = np.flatnonzero(size == wide)
            more = symbols[start[fresh][:, None] + np.arange(wide)]
            whole = self.pairs(more[:, :-1].ravel(), more[:, 1:].ravel()).reshape(len(fresh), wide - 1)
            row, ids, best = (np.concatenate(x) for x in ((row, fresh), (ids[:, :wide], more), (best[:, : wide - 1], self.rank[whole])))
            if wide == 1 or not len(row):
                done.append((row, ids))
                count[row] = wide
                continue
            at = best.argmin(1)
            each = np.arange(len(row))
            live = best[each, at] < _NEVER
            done.append((row[~live], ids[~live]))
            count[row[~live]] = wide
            row, ids, best, at = row[live], ids[live], best[live], at[live]
            each = np.arange(len(row))
            both = self.pairs(ids[each, at], ids[each, at + 1])
            after = np.arange(wide - 1) > at[:, None]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[each, at] = both
            best = np.where(after[:, 1:], best[:, 1:], best[:, :-1])
            for k, has in ((at - 1, at > 0), (at, at < wide - 2)):
                i, k = each[has], k[has]
                best[i, k] = self.rank[self.pairs(ids[i, k], ids[i, k + 1])]
        ends = np.cumsum(count)
        out = np.zeros(int(ends[-1]), np.uint32)
        for row, ids in done:
            if len(row):
                out[(ends[row] - count[row])[:, None] + np.arange(ids.shape[1])] = ids
        return out, ends

    def checked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The agendas' ids of new words as bytes, compared with the library's. The library puts a U+2581 before each text
        itself; a word without one follows a line break here, whose byte it then begins with."""
        out, ends = self.agendas(words)
        asked = [w[1:] if w[0] == " " else "\n" + w for w in words]
        theirs = self.library.encode(asked, num_threads=1)
        lead = np.array([0 if w[0] == " " else 2 for w in words])
        count = np.fromiter(map(len, theirs), np.int64, len(words)) - lead
        own = np.diff(ends, prepend=0)
        flat = np.fromiter(chain.from_iterable(theirs), np.uint32)
        keep = np.ones(len(flat), bool)
        at = np.cumsum(count + lead) - count - lead
        keep[np.concatenate([at[lead > 0], at[lead > 0] + 1])] = False
        asked_for = np.array([w != " " for w in words])  # a blank alone can't be asked for
        same = np.where(asked_for, own, 0) == count
        if not same.all() or not np.array_equal(flat[keep], out[np.repeat(asked_for, own)]):
            raise ValueError(f"the agenda and the library differ among {[w for w, s in zip(words, same, strict=True) if not s][:3] or words[:3]}")
        return out.view(np.uint8), ends * 4

    def words(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, blanks before them included, and how many there are before each text's end."""
        if (buffer_of(column)[0] == 0xE2).any():
            column = pc.replace_substring(column, _BLANK, " ")
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type)))
        data, ends = buffer_of(column)
        opens = np.zeros(len(data), bool)
        opens[ends[:-1][ends[:-1] < ends[1:]]] = True
        if self.by_word:
            blank = data == 32
            opens[1:] |= blank[1:] & ~blank[:-1]
            if self.lines:
                line = data == 10
                opens |= line
                opens[1:] |= line[:-1]
        at = np.flatnonzero(opens)
        return binaries(data, np.append(at, len(data))), np.searchsorted(at, ends)

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each text with begin and end id, as little-endian unsigned 32-bit numbers."""
        words, upto = self.words(column)
        data, ends = self.kept.codes(words)
        raw, ends = data.tobytes(), ends[upto].tolist()
        return [self.begin + raw[a:b] + self.end for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(i, "<u4").tolist() for i in ids], num_threads=1)


def piece_report(docs: DataFrame, model: str) -> DataFrame:
    """Per document: number of ids, and SHA-256 of the ids and of the decoded text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.of(model)
        for batch in chunks(batches, "text"):
            ids = pieces.encode(batch.column("text"))
            sha = [[hashlib.sha256(x).hexdigest() for x in v] for v in (ids, (t.encode() for t in pieces.decode(ids)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), *map(pa.array, sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(tidy(rows), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """Per document: its ids (array of int) and the text decoded from them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.of(model)
        for batch in chunks(batches, "text"):
            ids = pieces.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())), pa.array(pieces.decode(ids))], names=["doc_id", "ids", "decoded"])

    return documents(docs).mapInArrow(tidy(rows), "doc_id long, ids array<int>, decoded string")
