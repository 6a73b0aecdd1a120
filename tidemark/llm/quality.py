"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's features are counts of its words (hashed, A-Z lowered) and of its words' shapes (letters, digits and signs as
classes, repeats shortened: ``Stop!!`` is ``Aa!``), with damped counts. The fit takes at most ``most`` labelled rows (those
with the least hash of the id; the bound keeps the model small whatever the labels hold), weighs features by their rarity
among these, and takes the first ``dims`` singular directions. The labelled vectors and the projection are broadcast:
at most ``most * dims + features * dims`` 4-byte numbers, about 3 MB. Every document is projected, compared with all
labelled vectors by blocked exact products, and the ``k`` most similar vote with their similarity to a power.

Defined cases: a null or empty text has no vector and gets the share of label 1 in the fit, as do all texts if there are no
usable labels (then 0.5); several labels of an id count as their mean, half and more is 1; labels without a document or
value are left out; a document column named ``score`` is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytehash import LONG, Prefix, lowered, pieces, words
from tidemark.llm.shared import buffer_of, chunks, tidy

_WORDS, _SHAPES = 4096, 1024
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_ROWS = 128


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def cells(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each word and of each word's shape."""
    low = lowered(data)
    starts, stops, rows = words(low, ends)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = (Prefix(low).of(starts, stops) % np.uint64(_WORDS)).astype(np.int64)
    kind = _CLASS[data]
    stay = np.ones(len(data), bool)
    stay[1:] = kind[1:] != kind[:-1]
    stay[starts] = True
    before = np.concatenate([[0], np.cumsum(stay)])
    shape = (Prefix(kind[stay]).of(before[starts], before[stops]) % np.uint64(_SHAPES)).astype(np.int64) + _WORDS
    return np.concatenate([rows, rows]), np.concatenate([word, shape])


def tally(data: np.ndarray) -> np.ndarray:
    """How often each feature is found in one long text, gone through in pieces."""
    out = np.zeros(_WORDS + _SHAPES, np.int64)
    for a, b in pieces(data, np.array([0, len(data)])):
        out += np.bincount(cells(data[a:b], np.array([0, b - a]))[1], minlength=len(out))
    return out


def counted(row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    """Damped counts: the logarithm, with the words' and the shapes' parts of length 1 each."""
    width = _WORDS + _SHAPES
    return damped(np.bincount(row * width + feature, minlength=n * width).astype(np.float32).reshape(n, width))


def damped(counts: np.ndarray) -> np.ndarray:
    out, width = np.log1p(counts), _WORDS + _SHAPES
    for a, b in ((0, _WORDS), (_WORDS, width)):
        length = np.sqrt((out[:, a:b] ** 2).sum(1, keepdims=True))
        out[:, a:b] /= np.where(length > 0, length, 1)
    return out


@dataclass
class Model:
    project: np.ndarray  # features x dims
    vectors: np.ndarray  # labelled rows x dims, of length 1
    votes: np.ndarray  # their labels
    prior: float
    k: int = 15
    power: int = 4

    def embed(self, counts: np.ndarray) -> np.ndarray:
        out = counts @ self.project
        length = np.sqrt((out**2).sum(1, keepdims=True))
        return out / np.where(length > 1e-6, length, 1)

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(ends) - 1
        out = np.full(n, self.prior)
        if not len(self.votes):
            return out
        if n == 1 and len(data) > LONG:
            many = tally(data)
            feature = np.flatnonzero(many)
            return self._voted(damped(many[None, :].astype(np.float32))) if len(feature) else out
        row, feature = cells(data, ends)
        if not len(row):
            return out
        order = np.argsort(row, kind="stable")
        row, feature = row[order], feature[order]
        for at in range(0, n, _ROWS):
            to = min(n, at + _ROWS)
            a, b = np.searchsorted(row, [at, to])
            out[at:to] = self._voted(counted(row[a:b] - at, feature[a:b], to - at))
        return out

    def _voted(self, counts: np.ndarray) -> np.ndarray:
        """The neighbours' votes on damped counts; the prior where there is nothing to compare."""
        own = self.embed(counts)
        near = own @ self.vectors.T
        k = min(self.k, near.shape[1])
        top = np.argpartition(near, near.shape[1] - k, 1)[:, near.shape[1] - k :]
        weight = np.clip(np.take_along_axis(near, top, 1), 0, 1).astype(np.float64) ** self.power
        small = 1e-3
        votes = ((weight * self.votes[top]).sum(1) + small * self.prior) / (weight.sum(1) + small)
        return np.clip(np.where((own != 0).any(1), votes, self.prior), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4000, dims: int = 48, k: int = 15) -> Model:
    """Learns from at most ``most`` labelled rows outside the held-out ones."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("vote"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, ends = buffer_of(batch.column("text"))
            width = _WORDS + _SHAPES
            if batch.num_rows == 1 and len(data) > LONG:
                many = tally(data)
                cell = np.flatnonzero(many)
                n = many[cell]
            else:
                row, feature = cells(data, ends)
                cell, n = np.unique(row * width + feature, return_counts=True)
            at = np.searchsorted(cell // width, np.arange(batch.num_rows + 1))
            packed = [np.stack([cell[a:b] % width, n[a:b]]).astype("<i4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("vote"), pa.array(packed, pa.binary())], names=["doc_id", "vote", "cells"])

    # at most `most` ids, each of at most _WORDS + _SHAPES cells; a repeated id counts once
    found = texts.mapInArrow(tidy(rows), "doc_id long, vote int, cells binary").groupBy("doc_id").agg(F.first("vote").alias("vote"), F.min("cells").alias("cells")).orderBy("doc_id").collect()
    votes = np.array([r.vote for r in found], np.float64)
    width = _WORDS + _SHAPES
    if not len(votes):
        return Model(np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), votes, 0.5, k)
    parts = [np.frombuffer(r.cells, "<i4").reshape(2, -1) for r in found]
    matrix = np.zeros((len(parts), width), np.float32)
    for i, (feature, n) in enumerate(parts):
        matrix[i, feature] = np.log1p(n)
    for a, b in ((0, _WORDS), (_WORDS, width)):
        length = np.sqrt((matrix[:, a:b] ** 2).sum(1, keepdims=True))
        matrix[:, a:b] /= np.where(length > 0, length, 1)
    rare = np.log((1 + len(parts)) / (1 + (matrix > 0).sum(0))).astype(np.float32) + 0.1
    matrix *= rare
    dims = min(dims, *matrix.shape)
    draw = np.random.Generator(np.random.PCG64(3)).standard_normal((width, dims + 8)).astype(np.float32)
    basis = np.linalg.qr(matrix @ draw)[0]
    for _ in range(3):  # subspace iteration
        basis = np.linalg.qr(matrix @ (matrix.T @ basis))[0]
    _, _, right = np.linalg.svd(basis.T @ matrix, full_matrices=False)
    project = (rare[:, None] * right[:dims].T).astype(np.float32)
    vectors = matrix @ right[:dims].T
    length = np.sqrt((vectors**2).sum(1, keepdims=True))
    vectors = (vectors / np.where(length > 1e-6, length, 1)).astype(np.float32)
    return Model(project, vectors, votes, float(votes.mean()), k)


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` and ``score``, 0 to 1. Columns travel in one struct, whatever their names."""
    columns = [c for c in docs.columns if c.lower() != "score"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(shared.value.score(*buffer_of(batch.column("text"))))], names=["row", "score"])

    scored = rows.mapInArrow(tidy(score), rows.select("row").schema.add("score", "double"))
    return scored.select(*(F.col("row")[c].alias(c) for c in columns), "score")
