"""Baseline JPEG as a media column: a numpy encoder for lossless payloads, and a decoder.

Payload: a text's UTF-8 bytes, zero bytes up to a positive multiple of 64. JPEG's own transform loses bits, so the payload
is stored in JPEG's unit, the quantised coefficient: the bytes of a block of 64 are its coefficients in scan order, each by
a fixed table that gives common bytes small values (``VALUES``). The file is an ordinary greyscale baseline JPEG with
quantisers 1, restart markers each 8 blocks, and the payload's length in a comment. Blocks lie in 16 columns (more where
the 65,535-pixel limit asks for it); blocks past the payload are zero.

The decoder parses the markers of any interleaved 8-bit baseline file (several components, sampling factors, its own Huffman
tables, restart intervals) and decodes the scans of many files at once: each restart interval is a lane, and each numpy
step decodes the next symbol of all lanes. A thumbnail has one pixel a luminance block, from its DC coefficient alone.

Scans are written and read in pieces of ``_PIECE`` blocks, so beside the file itself and two bytes a coefficient, memory
doesn't follow the length of a text. ``stored`` writes the media table to the shared folder.

Defined cases: a null or empty text is 64 zero bytes; equal texts give equal files; rows that repeat are stored each; an
empty table gives no rows; a text beyond the format's largest picture (about 4 GB) is refused; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shared import buffer_of, chunks, documents, tidy, written

_EACH = 8  # blocks a restart interval
_COLUMNS, _MOST = 16, 8191
_PIECE = 1 << 14  # blocks that are worked on at once; a multiple of 8 intervals
# code lengths by the size of a value: common bytes have sizes 1 to 3
_DC = dict.fromkeys(range(10), 4)
_AC = {1: 2, 2: 2, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7, 0: 8}
_COMMON = b" etaoinsrhldcumgpfbvwy.k,TSAIMCBPRDNHWELFOGUzjxq-'\n"
#: Bytes from the most common on. The first two have the values of size 1, the next four those of size 2, and so on.
_ORDER = np.array([*_COMMON, *(b for b in range(256) if b not in _COMMON)])
_RANK = np.arange(2, 258)
_SIZE = np.array([int(n).bit_length() - 1 for n in _RANK])
_BITS_OF_RANK = _RANK - (1 << _SIZE)
VALUES = np.zeros(256, np.int32)
VALUES[_ORDER] = np.where(_BITS_OF_RANK < 1 << (_SIZE - 1), _BITS_OF_RANK - (1 << _SIZE) + 1, _BITS_OF_RANK)
_BYTE = np.zeros(1024, np.uint8)  # of each value + 512
_BYTE[VALUES + 512] = np.arange(256)


def _huffman(lengths: dict[int, int]) -> tuple[bytes, dict[int, int]]:
    """Marker body and codes: symbols of the same length in order, codes counted up, as the standard has it."""
    order = sorted(lengths, key=lambda s: (lengths[s], list(lengths).index(s)))
    counts = bytes(sum(v == k for v in lengths.values()) for k in range(1, 17))
    codes, code, size = {}, 0, 0
    for s in order:
        code <<= lengths[s] - size
        size = lengths[s]
        codes[s] = code
        code += 1
    return counts + bytes(order), codes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


_DC_BODY, _DC_CODES = _huffman(_DC)
_AC_BODY, _AC_CODES = _huffman(_AC)
_DC_TABLE = np.array([_DC_CODES[s] for s in range(10)])
_BITS = np.array([0] + [k.bit_length() for k in range(1, 1024)])
_AC_WORD, _AC_LENGTH = np.zeros(256, np.int32), np.zeros(256, np.int32)
_AC_WORD[_ORDER] = [_AC_CODES[s] << s | b for s, b in zip(_SIZE.tolist(), _BITS_OF_RANK.tolist(), strict=True)]
_AC_LENGTH[_ORDER] = [_AC[s] + s for s in _SIZE.tolist()]
_TABLES = _segment(0xDB, bytes([0] + [1] * 64)), _segment(0xC4, b"\x00" + _DC_BODY) + _segment(0xC4, b"\x10" + _AC_BODY) + _segment(0xDD, struct.pack(">H", _EACH)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _place(blocks: int) -> tuple[int, int]:
    columns = min(blocks, max(_COLUMNS, -(-blocks // _MOST)))
    if columns > _MOST:
        raise ValueError("the payload is beyond the largest picture")
    return columns, -(-blocks // columns)


def _scans(blocks: np.ndarray, real: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan data of blocks of bytes, and where that of each interval ends. ``real`` blocks hold payload, the others are zero;
    ``inside``: number of the block in its picture. Before each interval but a picture's first stands its marker."""
    total = len(blocks)
    opens = inside % _EACH == 0
    dc = np.where(real, VALUES[blocks[:, 0]], 0)
    diff = dc.copy()
    diff[1:] -= np.where(opens[1:], 0, dc[:-1])
    size = _BITS[np.abs(diff)]
    lengths, word = _AC_LENGTH[blocks], _AC_WORD[blocks]
    lengths[:, 0] = 4 + size
    word[:, 0] = (_DC_TABLE[size] << size) | (diff + np.where(diff < 0, (1 << size) - 1, 0))
    lengths[~real, 1:] = word[~real, 1:] = 0  # a zero block: its DC and the end-of-block code
    lengths[~real, 1], word[~real, 1] = _AC[0], _AC_CODES[0]
    # bit places: each interval begins on a byte; before an interval stand two bytes for the marker
    bits = lengths.sum(1)
    start = np.flatnonzero(opens)
    whole = np.add.reduceat(bits, start)
    width = (whole + 7) >> 3
    lead = np.where(inside[start] > 0, 2, 0)
    byte0 = np.cumsum(width + lead) - width
    before = np.cumsum(bits) - bits
    count = np.diff(np.append(start, total))
    block0 = before - np.repeat(before[start], count) + 8 * np.repeat(byte0, count)
    place = (np.cumsum(lengths, 1) - lengths + block0[:, None]).ravel()
    lengths, word = lengths.ravel(), word.ravel()
    spread = word << (24 - lengths - (place & 7))
    n = int(byte0[-1] + width[-1])
    sums = np.bincount(place >> 3, spread, n + 1).astype(np.int64)
    data = (sums[:n] >> 16) & 255
    data[1:] += (sums[: n - 1] >> 8) & 255
    data[2:] += sums[: n - 2] & 255
    data[byte0 + width - 1] += (1 << (8 * width - whole)) - 1  # the last byte is filled with ones
    data = data.astype(np.uint8)
    stuffed = data == 255
    moved = np.arange(n) + np.cumsum(stuffed) - stuffed
    out = np.zeros(n + int(stuffed.sum()), np.uint8)
    out[moved] = data
    marked = lead > 0
    out[moved[byte0[marked] - 2]] = 255
    out[moved[byte0[marked] - 1]] = 0xD0 + (inside[start][marked] // _EACH - 1) % 8
    last = byte0 + width - 1
    return out, moved[last] + 1 + stuffed[last]


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """One file for each payload, whose length is a positive multiple of 64."""
    sizes = [len(p) // 64 for p in payloads]
    dims = [_place(b) for b in sizes]
    files = []
    for p, (w, h) in zip(payloads, dims, strict=True):
        head = b"\xff\xd8" + _segment(0xFE, b"payload=%d" % len(p)) + _TABLES[0] + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * h, 8 * w, 1, 1, 0x11, 0))
        files.append([head + _TABLES[1]])
    queue: list[tuple[int, np.ndarray, int, int]] = []  # file, bytes, first block, blocks with the zero ones

    def flush() -> None:
        counts = np.array([n for _, _, _, n in queue])
        first = np.cumsum(counts) - counts
        blocks, real = np.zeros((int(counts.sum()), 64), np.uint8), np.zeros(int(counts.sum()), bool)
        for (_, p, _, _), at in zip(queue, first.tolist(), strict=True):
            blocks[at : at + len(p) // 64] = p.reshape(-1, 64)
            real[at : at + len(p) // 64] = True
        inside = np.arange(len(blocks)) + np.repeat(np.array([at for _, _, at, _ in queue]) - first, counts)
        out, ends = _scans(blocks, real, inside)
        upto = ends[np.cumsum(-(-counts // _EACH)) - 1].tolist()
        for (k, _, _, _), a, b in zip(queue, [0, *upto[:-1]], upto, strict=True):
            files[k].append(out[a:b].tobytes())
        queue.clear()

    held = 0
    for k, (p, (w, h)) in enumerate(zip(payloads, dims, strict=True)):
        for at in range(0, w * h, _PIECE):
            n = min(_PIECE, w * h - at)
            if queue and held + n > _PIECE:
                flush()
                held = 0
            queue.append((k, p[64 * at : 64 * (at + n)], at, n))
            held += n
    if queue:
        flush()
    return [b"".join([*f, b"\xff\xd9"]) for f in files]


@dataclass
class Picture:
    """What the markers of a file say."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    quantiser: dict[int, int] = field(default_factory=dict)  # of the DC coefficient
    parts: list[list[int]] = field(default_factory=list)  # component id, horizontal and vertical factor, quantiser
    tables: dict[int, bytes] = field(default_factory=dict)
    order: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC and AC table in the scan
    interval: int = 0
    scan: np.ndarray | None = None

    @property
    def mcu(self) -> tuple[int, int]:
        if len(self.parts) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def pattern(self) -> list[tuple[int, int, int]]:
        """(component, DC table, AC table) of the blocks of one unit."""
        if len(self.parts) == 1:
            return self.order
        return [o for o in self.order for _ in range(self.parts[o[0]][1] * self.parts[o[0]][2])]


def parse(data: bytes) -> Picture:
    """Markers up to the scan. Refuses progressive, arithmetic, 12-bit and multi-scan files."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    out, at = Picture(), 2
    while True:
        while data[at + 1] == 255:
            at += 1
        marker = data[at + 1]
        if data[at] != 255:
            raise ValueError(f"no marker at {at}")
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quantiser[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out.tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("8-bit samples only")
            out.height, out.width = struct.unpack(">HH", body[1:5])
            out.parts = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]] for k in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"not baseline: marker {marker:x}")
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDD:
            out.interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            if body[0] != len(out.parts):
                raise ValueError("one scan of all components only")
            ids = [p[0] for p in out.parts]
            out.order = [(ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, 16 | body[2 + 2 * k] & 15) for k in range(body[0])]
            out.scan = np.frombuffer(data, np.uint8)[at:]
            return out


def _lookup(body: bytes) -> np.ndarray:
    """For the next 16 bits: symbol and code length as symbol << 8 | length; 0 where no code begins so."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 16
    for size in range(1, 17):
        for _ in range(body[size - 1]):
            out[code << (16 - size) : (code + 1) << (16 - size)] = body[k] << 8 | size
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lanes(data: np.ndarray, place: np.ndarray, blocks: np.ndarray, first: np.ndarray, shape: np.ndarray, coding: tuple, out: np.ndarray) -> None:
    """Decodes lanes that begin at the bits ``place`` of ``data``, each of some blocks from block ``first`` on, into ``out``."""
    lengths, dc, ac, tables = coding
    limit = 8 * (len(data) - 16)
    wide = data.astype(np.uint64)
    window = np.zeros(len(wide) - 8, np.uint64)
    for k in range(8):
        window |= wide[k : k + len(window)] << np.uint64(56 - 8 * k)

    def symbol(where: np.ndarray, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if int(where.max()) >= limit + 64:
            raise ValueError("the scan ends too soon")
        w = window[where >> 3] << (where & 7).astype(np.uint64)
        found = tables[(w >> np.uint64(48)).astype(np.int64) + table]
        code, size = found & 255, (found >> 8) & 15
        if not code.all():
            raise ValueError("a code that no table has")
        s = size.astype(np.uint64)
        value = ((w << code.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - s)).astype(np.int64)
        value -= np.where((value << 1 < (1 << size)) & (size > 0), (1 << size) - 1, 0)
        return value, found >> 12, code + size

    for b in range(int(blocks.max())):
        live = np.flatnonzero(blocks > b)
        where, base, kind = place[live], (first[live] + b) * 64, shape[live]
        turn = b % lengths[kind]
        value, _, used = symbol(where, dc[kind, turn])
        out[base] = value
        where = where + used
        table = ac[kind, turn]
        table = int(table[0]) if (table == table[0]).all() else table
        k = np.ones(len(live), np.int64)
        going = None  # all
        while True:
            value, run, used = symbol(where if going is None else where[going], table if going is None or isinstance(table, int) else table[going])
            size0 = value == 0
            if going is None:
                where = where + used
                if not run.any() and not size0.any():
                    out[base + k] = value
                    k = k + 1
                    if k[0] < 64 and (len(k) == 1 or k.max() < 64):
                        continue
                else:
                    going = np.arange(len(live))
            else:
                where[going] += used
            if going is not None:
                over = size0 & (run == 0)
                k[going] += run
                write = ~size0 & (k[going] < 64)
                out[base[going[write]] + k[going[write]]] = value[write]
                k[going] = np.where(over, 64, k[going] + 1)
                going = going[k[going] < 64]
            else:
                going = np.flatnonzero(k < 64)
            if not len(going):
                break
        place[live] = where


def decode(files: list[bytes]) -> list[tuple[Picture, np.ndarray]]:
    """Each file's markers and its blocks in scan order: quantised coefficients, 64 a block in zigzag order, DC summed up."""
    pictures = [parse(f) for f in files]
    bodies: dict[bytes, int] = {}
    buffers, starts, lane_blocks, lane_first, patterns, at, block = [], [], [], [], [], 0, 0
    shapes: dict[tuple, int] = {}
    counts = []
    for p in pictures:
        scan = p.scan
        ff = np.flatnonzero(scan[:-1] == 255)
        after = scan[ff + 1]
        stop = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
        stop = int(stop[0]) if len(stop) else len(scan)
        inner = ff < stop
        marks, zeros = ff[inner & (after != 0)], ff[inner & (after == 0)] + 1
        gone = np.concatenate([marks, marks + 1, zeros])
        keep = np.ones(stop, bool)
        keep[gone] = False
        buffers.append(scan[:stop][keep])
        w, h = p.mcu
        pattern = tuple((bodies.setdefault(p.tables[d], len(bodies)), bodies.setdefault(p.tables[a], len(bodies)), c) for c, d, a in p.pattern)
        shape = shapes.setdefault(pattern, len(shapes))
        units = w * h
        each = p.interval or units
        lanes = -(-units // each)
        if lanes != len(marks) + 1:
            raise ValueError(f"{len(marks)} restart markers, {lanes - 1} expected")
        removed = np.searchsorted(np.sort(gone), marks + 2)
        starts.append(np.concatenate([[0], marks + 2 - removed]) + at)
        n = np.full(lanes, each) * len(pattern)
        n[-1] = (units - each * (lanes - 1)) * len(pattern)
        lane_blocks.append(n)
        lane_first.append(block + np.cumsum(n) - n)
        patterns.append(np.full(lanes, shape))
        at += len(buffers[-1])
        block += int(n.sum())
        counts.append(units * len(pattern))
    buffer = np.concatenate([*buffers, np.full(16, 255, np.uint8)])
    tables = np.concatenate([_lookup(b) for b in bodies])
    origin = np.concatenate(starts)
    blocks, first, shape = np.concatenate(lane_blocks), np.concatenate(lane_first), np.concatenate(patterns)
    longest = max(map(len, shapes))
    dc, ac = np.zeros((len(shapes), longest), np.int64), np.zeros((len(shapes), longest), np.int64)
    lengths = np.array([len(s) for s in shapes])
    for s, k in shapes.items():
        dc[k, : len(s)], ac[k, : len(s)] = [x[0] << 16 for x in s], [x[1] << 16 for x in s]
    out = np.zeros(block * 64, np.int16)
    edges = np.append(np.unique((first // _PIECE), return_index=True)[1], len(first)).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        low = int(origin[a])
        high = int(origin[b]) if b < len(origin) else len(buffer) - 16
        _lanes(buffer[low : high + 16], (origin[a:b] - low) * 8, blocks[a:b], first[a:b], shape[a:b], (lengths, dc, ac, tables), out)
    coefficients = out.reshape(-1, 64)
    # DC values are sums of differences within an interval, by component
    lane = np.repeat(np.arange(len(blocks)), blocks)
    turn = (np.arange(block) - np.repeat(first, blocks)) % lengths[shape[lane]]
    part = np.zeros((len(shapes), longest), np.int64)
    for s, k in shapes.items():
        part[k, : len(s)] = [x[2] for x in s]
    group = lane * 4 + part[shape[lane], turn]
    order = np.argsort(group, kind="stable") if longest > 1 else np.arange(block)
    sums = np.cumsum(coefficients[order, 0].astype(np.int64))
    opens = np.append(True, group[order][1:] != group[order][:-1])
    start = np.flatnonzero(opens)
    base = np.where(start > 0, sums[start - 1], 0)
    coefficients[order, 0] = sums - np.repeat(base, np.diff(np.append(start, block)))
    ends = np.cumsum(counts)
    return [(p, coefficients[e - n : e]) for p, e, n in zip(pictures, ends.tolist(), counts, strict=True)]


def thumbnail(picture: Picture, blocks: np.ndarray) -> np.ndarray:
    """One pixel a block of the first component, from the DC coefficients."""
    w, h = picture.mcu
    across, down = (1, 1) if len(picture.parts) == 1 else picture.parts[0][1:3]
    each = len(picture.pattern)
    dc = blocks[:, 0].reshape(h, w, each)[:, :, : across * down].reshape(h, w, down, across)
    dc = dc.transpose(0, 2, 1, 3).reshape(h * down, w * across)[: -(-picture.height // 8), : -(-picture.width // 8)]
    quantiser = picture.quantiser[picture.parts[0][3]]
    return np.clip(np.rint(dc.astype(np.float64) * quantiser / 8) + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid are above the picture's mean."""
    rows = np.minimum(np.arange(9) * pixels.shape[0] // 8, pixels.shape[0])
    cols = np.minimum(np.arange(9) * pixels.shape[1] // 8, pixels.shape[1])
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    sums[1:, 1:] = pixels.astype(np.float64).cumsum(0).cumsum(1)
    r0, c0 = np.minimum(rows[:-1], pixels.shape[0] - 1), np.minimum(cols[:-1], pixels.shape[1] - 1)
    r1, c1 = np.maximum(rows[1:], r0 + 1), np.maximum(cols[1:], c0 + 1)
    cell = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    cell /= np.outer(r1 - r0, c1 - c0)
    return np.packbits((cell > pixels.mean()).ravel()).tobytes().hex()


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text as a JPEG file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 2 << 20):
            data, ends = buffer_of(batch.column("text"))
            sizes = np.diff(ends)
            payloads = []
            for a, n in zip(ends[:-1].tolist(), sizes.tolist(), strict=True):
                p = np.zeros(max(64, -(-n // 64) * 64), np.uint8)
                p[:n] = data[a : a + n]
                payloads.append(p)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(encode(payloads), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents(docs).mapInArrow(tidy(rows), "doc_id long, n_bytes long, media binary")


def stored(docs: DataFrame) -> DataFrame:
    """The media table as read back from the shared folder."""
    return written(with_media(docs), "media")


def payload_of(picture: Picture, blocks: np.ndarray) -> bytes:
    n = int(picture.comment.removeprefix(b"payload="))
    return _BYTE[blocks[: n // 64] + 512].tobytes()


def media_report(media: DataFrame) -> DataFrame:
    """Decodes the stored files: payload and file digests, dimensions and the thumbnail's hash."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "feature"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media", 2 << 20):
            files = batch.column("media").to_pylist()
            out = []
            for f, (p, blocks) in zip(files, decode(files), strict=True):
                payload = payload_of(p, blocks)
                feature = f"{p.width}x{p.height}:{thumbnail_hash(thumbnail(p, blocks))}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(f), hashlib.sha256(f).hexdigest(), p.width, p.height, feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=names)

    return media.mapInArrow(tidy(rows), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string")
