"""SimHash near-duplicates by pigeonhole blocks: documents whose 64-bit fingerprints differ in few bits, as components.

A fingerprint bit is set if over half of a text's shingle hashes have it. Shingles are runs of three ASCII-lower-cased words
joined by spaces, repeats included (fewer words: the whole sequence); their hash is XXH64 of the UTF-8 bytes, seed 42, which
is also what Spark's ``xxhash64`` of one string gives.

Blocks. The 64 bits are cut into eight blocks of eight. Two fingerprints that differ in at most two bits differ in at most two
blocks, so for some choice of two blocks the other six agree: each distinct fingerprint goes under 28 keys of 48 bits. A key's
group differs in 16 bits only, so it holds at most 65,536 fingerprints, however many documents there are and however alike:
no group can grow hot. Distances are verified inside a group, pair by pair in a small one and through a table of its 65,536
places in a large one, and a star of edges for each thing that is connected there goes on to the component step. Keys are
in proportion to distinct fingerprints; no pairs of a group are emitted.

Defined results: a null or blank text has fingerprint zero and is linked like any other; equal fingerprints are linked; a null
doc_id names a component only where no member has an id (the component is null then); a repeated id gives a row each time;
a very long text is hashed in pieces, whole; an empty table gives an empty result; other columns are left out, whatever their
names, and ``keep_one`` carries them along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import buffers
from .common import cut, documents, fresh, quoted, released, table
from .components import components

WORDS, SEED, DISTANCE = 3, 42, 2
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Eight blocks of eight bits; every choice of two that may differ. The places of a group are the 16 bits of these two.
OPEN = list(combinations(range(8), DISTANCE))
#: Members up to which a group is compared pair by pair.
PAIRWISE = 256
_ONE_BITS = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)
#: All ways in which two members of a group may differ.
_MASKS = np.array([m for m in range(1, 1 << 16) if _ONE_BITS[m] <= DISTANCE], np.int64)


def _words(data: memoryview) -> Iterator[list[bytes]]:
    """Lower-cased words of a text's bytes, in lists of a bounded size; all ASCII white space separates, nothing else."""
    at, rest = 0, b""
    while at < len(data):
        part = rest + bytes(data[at : at + PIECE])
        at += PIECE
        words = part.lower().split()
        rest = b""
        if at < len(data) and words and not part[-1:].isspace():
            rest = part[len(part.rstrip()) - len(words.pop()) :]
        yield words
    if rest:
        yield [rest.lower()]


def fingerprint(data: memoryview) -> int:
    """The fingerprint of a text given as UTF-8 bytes."""
    ones, total = np.zeros(64, np.int64), 0
    held: list[bytes] = []  # up to two words before the next list
    for words in _words(data):
        held = held + words
        if len(held) >= WORDS:
            line = memoryview(b" ".join(held))
            ends = np.cumsum([len(w) + 1 for w in held]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            spans = zip(starts[: len(held) - WORDS + 1].tolist(), ends[WORDS - 1 :].tolist(), strict=True)
            ones += _ones(np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], np.uint64))
            total += len(held) - WORDS + 1
            held = held[1 - WORDS :]
    if not total and held:
        ones, total = _ones(np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)), 1
    return int(np.packbits(ones * 2 > total).view(">u8")[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        view = memoryview(data)
        marks = [fingerprint(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(marks, np.uint64).view(np.int64))], ["doc_id", "mark"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark: the fingerprint as a long."""
    return documents(docs).mapInArrow(lambda it: released(_scan(it)), "doc_id long, mark long")


def _keys(mark: Column) -> Column:
    """(key, place) of a fingerprint for every choice of open blocks: the choice and the other six blocks; the open ones."""
    byte = [F.shiftrightunsigned(mark, 8 * b).bitwiseAND(F.lit(255)) for b in range(8)]
    out = []
    for k, (x, y) in enumerate(OPEN):
        closed = ~((255 << 8 * x) | (255 << 8 * y)) & ((1 << 64) - 1)
        closed = closed - (1 << 64) if closed >> 63 else closed
        out.append(F.struct(F.lit(k).alias("choice"), mark.bitwiseAND(F.lit(closed)).alias("closed"), (byte[x] + byte[y] * 256).cast("int").alias("place")))
    return F.explode(F.array(*out))


def linked(places: np.ndarray) -> np.ndarray:
    """For each of the distinct places of a group the least one that links of at most ``DISTANCE`` bits lead to."""
    if len(places) <= PAIRWISE:
        near = _ONE_BITS[places[:, None] ^ places[None, :]] <= DISTANCE
        label = places.copy()
        while True:
            new = np.where(near, label[None, :], 1 << 16).min(axis=1)
            if (new == label).all():
                return label
            label = new
    top = np.int64(1 << 16)
    label = np.full(1 << 16, top)
    label[places] = places
    while True:
        new = label.copy()
        for m in _MASKS.tolist():
            new[places] = np.minimum(new[places], label[places ^ m])
        new[places] = np.minimum(new[places], new[new[places]])  # jump to what the label knows
        if (new == label).all():
            return label[places]
        label = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """choice, closed, places of groups -> edges a, b between fingerprints."""
    for batch in batches:
        choice, closed = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        lists = batch.column(2)
        flat, bounds = np.asarray(lists.flatten()).astype(np.int64), np.asarray(lists.offsets)
        bounds = bounds - bounds[0]
        group, place, label = [], [], []
        size = np.diff(bounds)
        two = np.flatnonzero(size == 2)  # most groups by far, all at once
        first, second = flat[bounds[two]], flat[bounds[two] + 1]
        near = _ONE_BITS[first ^ second] <= DISTANCE
        group.append(two[near])
        place.append(first[near])
        label.append(second[near])
        for g in np.flatnonzero(size > 2).tolist():
            own = flat[bounds[g] : bounds[g + 1]]
            to = linked(own)
            far = to != own
            group.append(np.full(int(far.sum()), g))
            place.append(own[far])
            label.append(to[far])
        group, place, label = (np.concatenate(x).astype(np.int64) for x in (group, place, label))
        if len(group):
            shift = np.array(OPEN, np.uint64)[choice[group]] * np.uint64(8)
            base = closed[group].view(np.uint64)
            whole = [base | ((p & 255).astype(np.uint64) << shift[:, 0]) | ((p >> 8).astype(np.uint64) << shift[:, 1]) for p in (place, label)]
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)) for w in whole], ["a", "b"])


def edges_of(marks: DataFrame) -> DataFrame:
    """mark (distinct) -> edges a, b, all between fingerprints of one component, which they connect."""
    keyed = marks.select(_keys(F.col("mark")).alias("k")).select("k.*")
    groups = keyed.groupBy("choice", "closed").agg(F.collect_list("place").alias("places")).filter(F.size("places") > 1)
    return groups.select("choice", "closed", "places").mapInArrow(lambda it: released(_stars(it)), "a long, b long")


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark), one a document; classes (mark, root, component_id), one a fingerprint."""
    rows = cut(fingerprints(docs))
    classes = cut(rows.groupBy("mark").agg(F.min("doc_id").alias("least")))
    roots = components(edges_of(classes.select("mark")))
    placed = classes.join(roots.withColumnRenamed("node", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    firsts = cut(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    return rows, cut(placed.join(firsts, "root").select("mark", "root", "component_id"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, fingerprint (16 hex digits), component_id."""
    rows, known = _named(docs)
    return rows.join(known, "mark").select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose first column is the text, with its fingerprint in place of the last."""
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        view = memoryview(data)
        marks = [fingerprint(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(marks, np.uint64).view(np.int64))], batch.schema.names)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that of its least doc_id (ids before null), of repeated ones that with the least fingerprint and
    hash of text, of equal ones any; all columns of ``docs``. Blank texts are one component, as their fingerprints are."""
    _, known = _named(docs)
    text, mark, root, order = fresh(docs.columns, "text", "mark", "root", "order")
    held = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text), *(quoted(c) for c in docs.columns), F.lit(0).cast("long").alias(mark))
    marked = held.mapInArrow(lambda it: released(_marked(it)), held.schema)
    keyed = marked.join(known.select(F.col("mark").alias(mark), F.col("root").alias(root)), mark)
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col(mark), F.xxhash64(text))
    best = keyed.groupBy(root).agg(F.min_by(F.struct(*(quoted(c) for c in docs.columns)), rank).alias(order))
    return best.select(f"{order}.*")
