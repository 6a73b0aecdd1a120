"""MinHash near-dedup by a multi-index Hamming join.

A document's set is its distinct shingles of ``size`` words (A-Z lowered; with fewer words the whole sequence; without words
the empty set, linked with nothing). Its signature is 64 min-hash symbols of 16 bits: 16 chunks of 4 symbols. Two signatures
that differ in at most 31 symbols (``MOST``) differ in at most one symbol of some chunk (pigeonhole), so each signature is
entered under every chunk with each of its 4 symbols left out: 64 exact keys of three symbols. Every pair of signatures
within that distance shares a key, and no other pair is looked at; a pair at similarity 0.8 is beyond it with a probability
of about 3 in 10**8 (binomial, 64 symbols that differ with probability 0.2 each).

Plan. Equal sets are one node from the start, numbered. Keys that only one node has are dropped. Each remaining key links
its nodes to one of them, its centre (a star, not all pairs): the node that shares keys with the most others. Pairs are
compared by signature and then by full sets. Stars can leave similar nodes in different components. So families, the nodes
that share keys with one centre, are gone through once more where some of their nodes, the outside, are not in the centre's
component: the outside against the family, in blocks bounded by bytes, on full sets inside the task, which returns a forest.
A family whose outside exceeds ``_LARGE`` blocks is first given further stars, each around a node of its outside, which joins what
copies of several originals left apart. Where that doesn't do, it is split by each further key that its nodes share; so what
is compared many times is only what is alike in six symbols, outside, and still apart. Components are found by alternating
large-star and small-star rounds on tables in the shared folder.

Exact links: 100 * |A and B| >= percent * |A or B| on full sets of 64-bit shingle hashes. ``percent`` is 80 or more.

Defined cases: a null or empty text, or one without words, is its own component; rows that repeat a text are one node, so
they share a component; a null doc_id never names a component unless all rows of it have none; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytehash import _numbers, distinct, mix, shingles
from tidemark.llm.shared import buffer_of, chunks, keyed, tidy, written

_CHUNKS, _WIDE, _SYMBOLS = 16, 4, 64
MOST = 2 * _CHUNKS - 1  # symbols that linked signatures differ in at most
_ODD = (_numbers(5, _SYMBOLS) | np.uint64(1)).astype(np.uint32)
_PLUS = _numbers(6, _SYMBOLS).astype(np.uint32)
_OUTSIDE, _FAMILY = 1 << 20, 1 << 20  # bytes of each side of a block
_NODE = 400  # bytes of a node beside its set
_LARGE = 64  # blocks of an outside that gets further stars, and after these is split
_STARS = 2


def signatures(found: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Min-hash symbols by row; ``owner`` is sorted. Rows without shingles get zeros."""
    out = np.zeros((rows, _SYMBOLS), "<u2")
    if len(found):
        start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        low, high = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        for k in range(_SYMBOLS):
            v = low * _ODD[k] + high * _PLUS[k]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            least = np.minimum.reduceat(v, start)
            out[owner[start], k] = mix(least.astype(np.uint64)).astype(np.uint16)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a contiguous array as one binary value."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.strides[0] if len(rows) else 0)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _sketcher(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, ends = buffer_of(batch.column("text"))
            found, owner = distinct(*shingles(data, ends, size))
            n = np.bincount(owner, minlength=batch.num_rows)
            node = np.zeros((batch.num_rows, 2), np.uint64)
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
            for k in range(2):
                if len(owner):
                    node[owner[start], k] = np.add.reduceat(mix(found + np.uint64(k + 1)), start)
            empty = pa.array(n == 0)
            names = _binary(node)
            names = pa.compute.if_else(empty, pa.scalar(None, pa.binary()), names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(n), names, _binary(signatures(found, owner, batch.num_rows))], names=["doc_id", "tag", "n", "set", "sig"])

    return rows


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the signature, and ``key``, for each key of it."""
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            sig = _matrix(part.column("sig"), "<u2", _SYMBOLS).astype(np.int64)
            keys = np.zeros((len(sig), _CHUNKS * _WIDE), np.int64)
            for c in range(_CHUNKS):
                for out in range(_WIDE):
                    k = np.full(len(sig), c * _WIDE + out)
                    for j in range(_WIDE):
                        if j != out:
                            k = k << 16 | sig[:, c * _WIDE + j]
                    keys[:, c * _WIDE + out] = k
            names = [n for n in part.schema.names if n != "sig"]
            rows = pa.array(np.repeat(np.arange(len(sig)), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(part.column(n).take(rows) for n in names)], names=["key", *names])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(buffer_of(column)[0], kind).reshape(-1, width)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose signatures are near."""
    for batch in batches:
        differ = (_matrix(batch.column("sig_a"), "<u2", _SYMBOLS) != _matrix(batch.column("sig_b"), "<u2", _SYMBOLS)).sum(1)
        yield batch.select(["a", "b"]).filter(pa.array(differ <= MOST))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity."""
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _exact(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("set_a"), batch.column("set_b")
            good = []
            for a, b in zip(left, right, strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                good.append(_similar(a, b, percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows


def _sets(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, ends = buffer_of(batch.column("text"))
            found, owner = distinct(*shingles(data, ends, size))
            at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            sets = [found[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return rows


def _family(percent: int):
    """Links found in one block of a family, between its side 0 (of the outside) and its side 1. Signature-close pairs of
    different components are checked on full sets, closest first, unless links found here already connect them: what goes
    out is a forest, at most one row a node."""

    def links(table: pa.Table) -> pa.Table:
        side, n, comp = table.column("side").to_numpy(), table.column("n").to_numpy(), np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
        sig = _matrix(pa.concat_arrays(table.column("sig").chunks), "<u2", _SYMBOLS)
        rows, cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = [np.zeros((0, 3), np.int64)]
        for at in range(0, len(rows), 64):
            part = rows[at : at + 64]
            differ = np.zeros((len(part), len(cols)), np.int16)
            for k in range(_SYMBOLS):
                differ += sig[part, k][:, None] != sig[cols, k][None, :]
            alike = np.minimum(n[part][:, None], n[cols][None, :]) * 100 >= percent * np.maximum(n[part][:, None], n[cols][None, :])
            i, j = np.nonzero((differ <= MOST) & alike & (comp[part][:, None] != comp[cols][None, :]))
            found.append(np.stack([differ[i, j].astype(np.int64), part[i], cols[j]], 1))
        pairs = np.concatenate(found)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        above = list(range(int(comp.max()) + 1))

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        sets, out, names = table.column("shingles"), [], comp.tolist()
        for _, i, j in pairs.tolist():
            x, y = top(names[i]), top(names[j])
            if x != y and _similar(*(np.frombuffer(sets[r].as_buffer(), np.uint64) for r in (i, j)), percent):
                above[x] = y
                out.append((i, j))
        nodes = table.column("node")
        return pa.table({"a": nodes.take(pa.array([i for i, _ in out], pa.int64())), "b": nodes.take(pa.array([j for _, j in out], pa.int64()))})

    return links


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, comp) of all nodes in ``edges`` (a, b): ``comp`` is the component's least node. Alternates large-star (each
    node hands its larger neighbours to the least) and small-star (each hands the others to the least) until nothing
    changes; a star's centre is a hot key only of joins that Spark splits."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    size = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, label)
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        if state == size:
            break
        size = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, tag, n (set size), set (128 bits that name the set; null when empty) and signature."""
    return written(keyed(docs).mapInArrow(tidy(_sketcher(size)), "doc_id long, tag long, n long, set binary, sig binary"), "sketches")


def _shared(keys: DataFrame, *names: str) -> DataFrame:
    """Entries whose key another node has too. The counts are a table, so that the join is one that Spark splits at a hot key."""
    many = keys.groupBy(*names).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return keys.join(written(many, "counts"), list(names))


class _Links:
    """Tests of pairs of nodes, and what they need: ``nodes`` (node, n, sig) and ``sets`` (node, shingles)."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int):
        self.nodes, self.sets, self.percent = nodes, sets, percent

    def _sides(self, pairs: DataFrame, frame: DataFrame, *names: str) -> DataFrame:
        for s in "ab":
            pairs = pairs.join(frame.select(F.col("node").alias(s), *(F.col(n).alias(f"{n}_{s}") for n in names)), s)
        return pairs

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of (a, b), by signature and then by full set."""
        near = self._sides(pairs, self.nodes, "n", "sig").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent).select("a", "b", "sig_a", "sig_b")
        tested = written(near.mapInArrow(tidy(_close), "a long, b long"), "tested")
        wide = self._sides(tested, self.sets.withColumnRenamed("shingles", "set"), "set")
        return written(wide.mapInArrow(tidy(_exact(self.percent)), "a long, b long"), "edges")

    def families(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """Of (family, node): the families with an outside, each node with its component, the largest one of the family by
        bytes, and the bytes of the family and of its outside."""
        named = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(self.nodes.select("node", "n"), "node")
        parts = named.groupBy("family", "comp").agg(F.sum(F.col("n") * 8 + _NODE).alias("bytes"))
        whole = parts.groupBy("family").agg(F.sum("bytes").alias("bytes"), F.max(F.struct("bytes", "comp")).alias("most")).select("family", "bytes", F.col("most.comp").alias("main"), (F.col("bytes") - F.col("most.bytes")).alias("outside"))
        return written(named.join(written(whole.where("outside > 0"), "apart"), "family"), "rest")

    def star(self, rest: DataFrame, salt: int) -> DataFrame:
        """Links of all other components of each family to one node of its outside."""
        centre = rest.where("comp <> main").groupBy("family").agg(F.min(F.struct(F.xxhash64("node", F.lit(salt)), F.col("node"), F.col("comp"))).alias("c"))
        pairs = rest.join(centre, "family").where(F.col("comp") != F.col("c.comp"))
        return self.pairs(pairs.select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct())

    def blocks(self, rest: DataFrame) -> DataFrame:
        """Links between the outside and the whole of each family. With an outside of one block a family's nodes are dealt once
        and its outside to each of its blocks, so rows follow the family's size."""
        wide = rest.join(self.nodes.select("node", "sig"), "node").join(self.sets, "node")
        wide = wide.withColumns({"across": F.ceil(F.col("outside") / _OUTSIDE).cast("int"), "down": F.ceil(F.col("bytes") / _FAMILY).cast("int")})
        place = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        columns = ["node", "comp", "n", "sig", "shingles"]
        sides = wide.where("comp <> main").select("family", place("across").alias("i"), every("down").alias("j"), F.lit(0).alias("side"), *columns)
        sides = sides.unionByName(wide.select("family", every("across").alias("i"), place("down").alias("j"), F.lit(1).alias("side"), *columns))
        return written(sides.groupBy("family", "i", "j").applyInArrow(_family(self.percent), "a long, b long"), "edges")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, tag, n_shingles, component_id (least doc_id of its component) and kept."""
    if not 80 <= percent <= 100:
        raise ValueError("the index covers similarities of 80 % and more")
    sketch = sketches(docs, size)
    full = sketch.where("n > 0")
    nodes = full.groupBy("set").agg(F.min("n").alias("n"), F.min(F.struct("doc_id", "tag")).alias("row"), F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers hold once they are written
    members = written(_shared(nodes.select("node", "sig").mapInArrow(tidy(_key_rows), "key long, node long"), "key"), "members")
    # a key's centre is its node with the most company over all keys: an original rather than one of its copies
    company = members.groupBy("node").agg(F.sum("members").alias("company"))
    centres = members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("c")).select("key", F.col("c.node").alias("family"))
    buckets = written(members.select("key", "node").join(written(centres, "centres"), "key").select("family", "node").distinct(), "families")  # a family is named by its centre
    # full sets of the nodes that share a key with another node
    needed = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("row.doc_id").alias("_id"), F.col("row.tag").alias("_tag"))
    texts = keyed(docs)
    texts = texts.join(needed, (F.col("tag") == F.col("_tag")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
    sets = written(texts.mapInArrow(tidy(_sets(size)), "node long, shingles binary").dropDuplicates(["node"]), "sets")
    links = _Links(nodes.select("node", "n", "sig"), sets, percent)
    edges = links.pairs(buckets.where("node <> family").select(F.col("family").alias("a"), F.col("node").alias("b")))
    comps = components(edges)
    rest = links.families(buckets, comps)
    for salt in range(_STARS):
        large = rest.where(F.col("outside") > _LARGE * _OUTSIDE)
        if large.isEmpty():
            break
        edges = edges.unionByName(links.star(large, salt))
        comps = components(edges)
        rest = links.families(buckets.join(rest.select("family").distinct(), "family", "left_semi"), comps)
    found = [links.blocks(rest.where(F.col("outside") <= _LARGE * _OUTSIDE))]
    large = rest.where(F.col("outside") > _LARGE * _OUTSIDE)
    if not large.isEmpty():
        parts = large.select("family", "node").join(nodes.select("node", "sig"), "node")
        parts = _shared(parts.mapInArrow(tidy(_key_rows), "key long, node long, family long"), "family", "key").select(F.struct("family", "key").alias("family"), "node")
        found.append(links.blocks(links.families(written(parts, "parts"), comps)))
    more = [f for f in found if not f.isEmpty()]
    if more:
        comps = components(reduce(DataFrame.unionByName, more, edges))
    comps = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("set", "comp", "rep")
    least = comps.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_set = comps.join(least, "comp").select("set", "component_id")
    rows = full.join(by_set, "set").select("doc_id", "tag", "n", "component_id")
    rows = rows.unionByName(sketch.where("n = 0").select("doc_id", "tag", "n", F.col("doc_id").alias("component_id")))
    return rows.select("doc_id", "tag", F.col("n").alias("n_shingles"), "component_id", _kept(F.col("doc_id"), F.col("component_id")).alias("kept"))


def _kept(doc_id: Column, component: Column) -> Column:
    return doc_id.eqNullSafe(component)
