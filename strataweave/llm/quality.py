"""Nearest-neighbour voting in a latent-semantic space: how likely is a text of good quality?

A text becomes counts of terms: its words (hashed to ``WORDS`` cells), runs of three character classes (what its writing
looks like, ``SHAPES`` cells), and how many words equal the one before, the second before, or an earlier one. Log counts
for two hundred words times inverse document frequency, scaled to unit length, are projected onto the leading singular
directions of the labelled texts' term matrix. The labelled vectors are broadcast (at most ``max_labelled`` rows of
``rank`` floats, beside ``TERMS`` rows of axes); for every document the exact cosine to each of them is computed in blocks,
and the labels of the ``neighbours`` nearest vote, weighted by similarity.

The term matrix of the labelled texts is gathered and fitted in one task, so that the driver holds the axes and the vectors only.
Fitting uses at most ``max_labelled`` labelled rows, as many of either label as there are up to half, chosen by a
hash of the id; everything else covers all documents. Labels, language, source and id are no input of a score.

Defined results: a null, empty or blank text scores 0; a very long text is summed up whole, block by block; of equally near
neighbours at the edge of the vote any may count, the same ones on the same machine; a label row without quality is ignored, repeated label rows
count once (the lowest quality); without any labelled text every score is 0; repeated rows score alike; an empty table
gives an empty result; other columns are carried along, whatever their names, but a column ``score`` gives way; a null id
is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan
from .common import documents, released, table

SHAPES, REPEATS, WORDS = 768, 3, 1 << 14
#: Cells of shapes and repeats, which most texts fill, come first; words, which are sparse, after them.
DENSE = SHAPES + REPEATS
TERMS = DENSE + WORDS
THRESHOLD = 0.7

#: Character classes: lower case, upper case, digits, other bytes, space, line break; each ASCII sign is its own.
_CLASS = np.full(256, 3, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[10:14] = 4, 5
for _k, _b in enumerate([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]):
    _CLASS[_b] = 6 + _k
_KINDS = int(_CLASS.max()) + 1
_SHAPE_CELL = (bytescan.mix(np.arange(_KINDS**3, dtype=np.uint64) + np.uint64(17)) % np.uint64(SHAPES)).astype(np.int64)


class Counts:
    """Term counts of texts: dense cells as a matrix, words as (bounds, cell, count) by row; n: words of each text."""

    def __init__(self, dense: np.ndarray, bounds: np.ndarray, cells: np.ndarray, counts: np.ndarray, n: np.ndarray):
        self.dense, self.bounds, self.cells, self.counts, self.n = dense, bounds, cells, counts, n

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), np.diff(self.bounds))

    def part(self, a: int, b: int) -> Counts:
        b = min(b, len(self.n))
        lo, hi = int(self.bounds[a]), int(self.bounds[b])
        return Counts(self.dense[a:b], self.bounds[a : b + 1] - lo, self.cells[lo:hi], self.counts[lo:hi], self.n[a:b])


def term_counts(texts: pa.Array) -> Counts:
    dense = np.zeros((len(texts), DENSE), np.float32)
    size, cells, counts, totals = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    data, offsets = bytescan.buffers(texts)
    for a, b, hashes, bounds in bytescan.words(texts):
        for at in range(int(offsets[a]), int(offsets[b]), 2 * bytescan.BLOCK):  # one round but for a very long text
            to = min(int(offsets[b]), at + 2 * bytescan.BLOCK)
            kind = _CLASS[data[at:to]]
            if len(kind) > 2:
                cell = _SHAPE_CELL[(kind[:-2] * _KINDS + kind[1:-1]) * _KINDS + kind[2:]]
                row = np.repeat(np.arange(b - a), np.diff(np.clip(offsets[a : b + 1], at, to)))
                whole = row[:-2] == row[2:]
                dense[a:b, :SHAPES] += np.bincount(row[:-2][whole] * SHAPES + cell[whole], minlength=(b - a) * SHAPES).reshape(b - a, SHAPES)
        n = np.diff(bounds)
        row = np.repeat(np.arange(b - a), n)
        for k in (1, 2):
            if len(hashes) > k:
                same = (hashes[k:] == hashes[:-k]) & (row[k:] == row[:-k])
                dense[a:b, SHAPES + k - 1] = np.bincount(row[k:][same], minlength=b - a)
        cell = (hashes >> np.uint64(40)).astype(np.int64) % WORDS
        key, n_key = np.unique(row * WORDS + cell, return_counts=True)
        dense[a:b, SHAPES + 2] = n - np.bincount(key // WORDS, minlength=b - a)  # words seen before, up to shared cells
        size.append(np.bincount(key // WORDS, minlength=b - a))
        cells.append(key % WORDS)
        counts.append(n_key)
        totals.append(n)
    return Counts(dense, np.cumsum(np.concatenate(size)), np.concatenate(cells), np.concatenate(counts).astype(np.float32), np.concatenate(totals))


class Terms:
    """Weighted unit rows of a term matrix, dense cells beside sparse words, and products with them."""

    def __init__(self, c: Counts, idf: np.ndarray):
        per = 200 / np.maximum(c.n, 1)  # counts for 200 words, so that length says little
        self.row, self.cells, self.bounds = c.rows(), c.cells, c.bounds
        self.dense = np.log1p(c.dense * per[:, None].astype(np.float32)) * idf[:DENSE]
        self.values = np.log1p(c.counts * per[self.row].astype(np.float32)) * idf[DENSE + c.cells]
        norm = np.sqrt((self.dense**2).sum(axis=1) + np.bincount(self.row, self.values**2, minlength=len(c.n)))
        norm = np.maximum(norm, 1e-12).astype(np.float32)
        self.dense, self.values = self.dense / norm[:, None], self.values / norm[self.row]

    def times(self, axes: np.ndarray, block: int = 8192) -> np.ndarray:
        """The matrix times ``axes`` (TERMS rows); entries by blocks, so that memory follows the block."""
        out = self.dense @ axes[:DENSE]
        for a in range(0, len(self.cells), block):
            row = self.row[a : a + block]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[first]] += np.add.reduceat(axes[DENSE + self.cells[a : a + block]] * self.values[a : a + block, None], first, axis=0)
        return out

    def transposed_times(self, y: np.ndarray, block: int = 8192) -> np.ndarray:
        out = np.zeros((TERMS, y.shape[1]), np.float32)
        out[:DENSE] = self.dense.T @ y
        order = np.argsort(self.cells, kind="stable")
        for a in range(0, len(order), block):
            some = order[a : a + block]
            cell = self.cells[some]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            out[DENSE + cell[first]] += np.add.reduceat(y[self.row[some]] * self.values[some, None], first, axis=0)
        return out


def leading_axes(x: Terms, rank: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of the term matrix, by subspace iteration from a fixed start."""
    axes = np.random.default_rng(7).standard_normal((TERMS, rank + 16)).astype(np.float32)
    for _ in range(rounds):
        axes = np.linalg.qr(x.transposed_times(x.times(axes)).astype(np.float64))[0].astype(np.float32)
    _, _, turn = np.linalg.svd(x.times(axes).astype(np.float64), full_matrices=False)
    return np.ascontiguousarray(axes @ turn.T[:, :rank].astype(np.float32))


class Voters:
    """Labelled latent vectors and how to get there."""

    def __init__(self, counts: Counts, labels: np.ndarray, rank: int = 64):
        total = len(labels)
        seen = np.concatenate([(counts.dense > 0).sum(axis=0), np.bincount(counts.cells, minlength=WORDS)])
        self.idf = (np.log((1 + total) / (1 + seen)) + 0.3).astype(np.float32)
        self.axes = leading_axes(Terms(counts, self.idf), min(rank, max(total, 1)))
        self.vectors = self.project(counts)
        self.labels = labels.astype(np.float32)

    def parts(self) -> dict[str, np.ndarray]:
        return {"idf": self.idf, "axes": self.axes, "vectors": self.vectors, "labels": self.labels}

    @classmethod
    def of(cls, parts: dict[str, np.ndarray]) -> Voters:
        """The same voters from their parts, which may come flat."""
        self = cls.__new__(cls)
        self.idf, self.labels = parts["idf"], parts["labels"]
        self.axes = parts["axes"].reshape(TERMS, -1)
        self.vectors = parts["vectors"].reshape(len(self.labels), self.axes.shape[1])
        return self

    def project(self, counts: Counts) -> np.ndarray:
        y = Terms(counts, self.idf).times(self.axes)
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def vote(self, counts: Counts, neighbours: int, block: int = 512) -> np.ndarray:
        out = np.zeros(len(counts.n))
        k = min(neighbours, len(self.labels))
        for a in range(0, len(counts.n) if k else 0, block):
            cosine = self.project(counts.part(a, a + block)) @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:] if k < cosine.shape[1] else np.tile(np.arange(k), (len(cosine), 1))
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 4
            out[a : a + block] = (weight * self.labels[near]).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-12)
        out[counts.n == 0] = 0
        return np.clip(out, 0, 1)


_FEATURES = ["dense", "cells", "counts", "n_words", "quality", "ordinal"]
_NO_FEATURES = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.list_(pa.float32()), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.int64(), pa.int32(), pa.int64())], _FEATURES)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = term_counts(batch.column(0))
        dense = pa.ListArray.from_arrays(pa.array(np.arange(len(c.n) + 1, dtype=np.int32) * DENSE), pa.array(c.dense.ravel()))
        cells, counts = (pa.ListArray.from_arrays(pa.array(c.bounds.astype(np.int32)), pa.array(x)) for x in (c.cells.astype(np.int32), c.counts))
        yield pa.RecordBatch.from_arrays([dense, cells, counts, pa.array(c.n.astype(np.int64)), batch.column(1), batch.column(2)], _FEATURES)


def _fitted(batches: Iterator[pa.RecordBatch], rank: int) -> Iterator[pa.RecordBatch]:
    """All chosen rows, in order -> a row for each part of their voters."""
    found = pa.Table.from_batches([b for b in batches if len(b)] or [_NO_FEATURES])
    flat = lambda c, t: np.asarray(found.column(c).combine_chunks().flatten(), dtype=t)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(found.column("cells")).to_numpy())]).astype(np.int64)
    counts = Counts(flat("dense", np.float32).reshape(len(found), DENSE), bounds, flat("cells", np.int64), flat("counts", np.float32), found.column("n_words").to_numpy())
    for name, values in Voters(counts, found.column("quality").to_numpy(), rank).parts().items():
        flat_values = pa.array(np.ascontiguousarray(values, np.float32).ravel())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.ListArray.from_arrays(pa.array([0, len(flat_values)], pa.int32()), flat_values)], ["part", "of"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, rank: int = 64) -> Voters:
    """Voters from at most ``max_labelled`` labelled rows that are not held out."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id"))).withColumn("ordinal", F.xxhash64("doc_id"))
    sides = [known.filter(F.col("quality") == q).orderBy("ordinal", "doc_id").limit(max_labelled // 2) for q in (0, 1)]
    chosen = F.broadcast(sides[0].unionByName(sides[1]))  # at most max_labelled rows of 20 bytes
    rows = documents(docs).join(chosen, "doc_id").select("text", "quality", "ordinal")
    types = "dense array<float>, cells array<int>, counts array<float>, n_words long, quality int, ordinal long"
    # A text of very many words fills at most WORDS cells, so at most max_labelled rows of bounded size meet in the task that fits.
    found = rows.mapInArrow(lambda it: released(_features(it)), types).orderBy("ordinal", "quality", "n_words", "dense").limit(max_labelled)
    parts = found.mapInArrow(lambda it: released(_fitted(it, rank)), "part string, of array<float>").toArrow()
    if not len(parts):  # Spark runs no task where it sees that nothing is labelled
        parts = pa.Table.from_batches(list(_fitted(iter(()), rank)))
    return Voters.of({name: np.array(of.values) for name, of in zip(parts.column("part").to_pylist(), parts.column("of"), strict=True)})


def _scores(batches: Iterator[pa.RecordBatch], voters, neighbours: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            score = voters.value.vote(term_counts(part.column(0)), neighbours)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "score"])


def score_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, rank: int = 64, neighbours: int = 15) -> DataFrame:
    """``docs`` with a score of 0 to 1 (column ``score`` of ``docs`` gives way)."""
    spark = docs.sparkSession
    voters = spark.sparkContext.broadcast(fit(docs, labels, max_labelled, rank))
    own = [c for c in docs.columns if c not in ("text", "score")]
    rows = docs.select("text", *own)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", score double"
    return rows.mapInArrow(lambda it: released(_scores(it, voters, neighbours)), schema)


def op9_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    return score_documents(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not rejected, as they came."""
    return score_documents(docs, table(spark, sf_dir, "labels")).filter(F.col("score") >= THRESHOLD).select(*docs.columns)
