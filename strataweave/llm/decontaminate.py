"""Benchmark decontamination by greedy string tiling.

A document and a test item that share a run of ``min_match`` words are compared: running Karp-Rabin hashes find the greatest
length at which words not yet tiled agree, all matches of it are marked without overlap, and so on with shorter ones down to
``min_match``. Tiled words over the item's words is its coverage; since tiles may lie in any order, reordered passages
are caught. Only tiles of at least ``min_match`` words count, so an item whose words under shared runs cannot reach the
threshold is passed over without tiling; nothing is lost by that.

A benchmark of at most ``block_bytes`` of text is broadcast to the scan of the documents, whose only pass this is. A
larger one is joined: its runs are summed into a sieve of fixed size, one scan keeps the documents that pass it with their
runs, these are joined by run with the items', and the pairs that share enough of them are tiled. Nothing but the sieve
comes to the driver there, and a run that very many documents share is split by the adaptive join.

Words are ASCII-lower-cased runs of non-blank characters, compared by 64-bit hashes.

Defined results: a very long text is tiled whole; a null or empty text matches nothing, nor does an item without words; an item of fewer than ``min_match``
words is matched by a document of the same words and no others; a null item_id is an id like others; a repeated item
matches under each of its ids, a repeated document once for each row; of equally long matches the first in the item,
then in the document, is marked; empty tables give no pairs and drop nothing; columns beside those named are carried
along by ``drop_contaminated``, whatever their names, and left out by ``tiled_pairs``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan
from .common import cut, documents, fresh, released, table

MIN_MATCH, COVERAGE = 5, 0.6
BLOCK_BYTES = 8 << 20
_BASE = 0xD1342543DE82EF95
SIEVE = 1 << 20
#: Bits of the sieve that a large benchmark is summed into: 16 MB, whatever its size.
SIEVE_BITS = 27


class Runs:
    """Hashes of runs of any length of one word sequence."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        self.up = np.cumprod(power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.up[:n], out=self.sums[1:])

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Comparable between sequences up to the power of the start, which is taken out by raising all to the longest."""
        return (self.sums[starts + size] - self.sums[starts]) * _inverse(starts)


_inverses: list[np.ndarray] = [np.ones(1, np.uint64)]


def _inverse(starts: np.ndarray) -> np.ndarray:
    most = int(starts.max()) + 1 if len(starts) else 1
    if len(_inverses[0]) < most:
        steps = np.full(2 * most, pow(_BASE, -1, 1 << 64), np.uint64)
        steps[0] = 1
        _inverses[0] = np.cumprod(steps)
    return _inverses[0][starts]


def tile(item: np.ndarray, text: np.ndarray, seeds: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, words). seeds: text positions at which a run of min_match words of the item starts.

    Each round finds the greatest length at which free words of both still agree, by halving: if some length is shared, all
    shorter ones are. All matches of that length are marked in order, each place of the text looked at once, so the next round's
    length is smaller. Lengths differ and add up to the item's words at most: an item of n words takes about sqrt(2 n) rounds,
    each linear in the text, however often words repeat.
    """
    item_runs, text_runs = Runs(item), Runs(text)
    item_free, text_free = np.ones(len(item), bool), np.ones(len(text), bool)
    everywhere = np.arange(len(item))
    tiles: list[tuple[int, int, int]] = []

    def windows(runs: Runs, starts: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of free stretches of ``size`` words, and their hashes."""
        starts = starts[starts + size <= len(free)]
        taken = np.concatenate([[0], np.cumsum(~free)])
        starts = starts[taken[starts + size] == taken[starts]]
        return starts, runs.at(starts, size)

    def shared(size: int) -> bool:
        _, own = windows(item_runs, everywhere, item_free, size)
        return len(own) > 0 and bool(np.isin(windows(text_runs, seeds, text_free, size)[1], own).any())

    most = min(len(item), len(text))
    while most >= min_match and shared(min_match):
        size = min_match
        while size < most:
            middle = (size + most + 1) // 2
            size, most = (middle, most) if shared(middle) else (size, middle - 1)
        places, own = windows(item_runs, everywhere, item_free, size)
        at, hashes = windows(text_runs, seeds, text_free, size)
        there = np.isin(hashes, own)
        where: dict[int, list[int]] = {}  # the last place first
        for h, t in zip(hashes[there][::-1].tolist(), at[there][::-1].tolist(), strict=True):
            where.setdefault(h, []).append(t)
        end = 0
        for h, p in zip(own.tolist(), places.tolist(), strict=True):
            left = where.get(h)
            if p < end or not left:
                continue
            while left and not text_free[left[-1] : left[-1] + size].all():
                left.pop()
            if left and (item[p : p + size] == text[left[-1] : left[-1] + size]).all():
                t = left.pop()
                end = p + size
                item_free[p:end] = False
                text_free[t : t + size] = False
                tiles.append((p, t, size))
        most = size - 1
    return tiles


def covered(item: np.ndarray, seeds: np.ndarray, words: np.ndarray, runs: np.ndarray, held: np.ndarray, min_match: int, coverage: float) -> tuple[int, int] | None:
    """(tiled words, tiles) of the item in the document if it is covered. seeds: the item's runs, in order of place; held:
    those of the document's runs that may be in an item."""
    shared = np.isin(seeds, held)
    under = np.zeros(len(item), bool)
    for k in range(min_match):
        under[np.flatnonzero(shared) + k] = True
    if under.sum() < coverage * len(item):
        return None
    tiles = tile(item, words, np.flatnonzero(np.isin(runs, seeds[shared])), min_match)
    n = sum(t[2] for t in tiles)
    return (n, len(tiles)) if n >= coverage * len(item) else None


class Items:
    """Test items, ready to be sent to every task."""

    def __init__(self, ids: list[int | None], texts: list[str], min_match: int, coverage: float):
        self.ids, self.words, self.runs, self.min_match, self.coverage = [], [], [], min_match, coverage
        self.short: dict[int, list[int]] = {}  # items of too few words, by the hash of the whole
        for a, b, hashes, bounds in bytescan.words(pa.array(texts, pa.string()), lower=True):
            for i in range(a, b):
                w = hashes[bounds[i - a] : bounds[i - a + 1]]
                if len(w):
                    runs = bytescan.shingles(w, min_match)
                    if len(w) < min_match:
                        self.short.setdefault(int(runs[0]), []).append(len(self.ids))
                    self.ids.append(ids[i])
                    self.words.append(w)
                    self.runs.append(runs if len(w) >= min_match else runs[:0])
        flat = np.concatenate(self.runs) if self.runs else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.runs)), [len(r) for r in self.runs])
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[(self.seeds & np.uint64(SIEVE - 1)).astype(np.int64)] = True

    def passes(self, runs: np.ndarray) -> np.ndarray:
        return self.sieve[(runs & np.uint64(SIEVE - 1)).astype(np.int64)]

    def matches(self, words: np.ndarray, runs: np.ndarray) -> list[tuple[int | None, int, int, int]]:
        """(item id, tiled words, item words, tiles) of the items that the document covers."""
        if len(words) < self.min_match:
            return [(self.ids[o], len(words), len(words), 1) for o in (self.short.get(int(runs[0]), ()) if len(runs) else ())]
        maybe = np.unique(runs[self.passes(runs)])
        lo, hi = np.searchsorted(self.seeds, maybe, "left"), np.searchsorted(self.seeds, maybe, "right")
        owners = [self.owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a]
        out = []
        for o in np.unique(np.concatenate(owners)).tolist() if owners else ():
            if found := covered(self.words[o], self.runs[o], words, runs, maybe, self.min_match, self.coverage):
                out.append((self.ids[o], found[0], len(self.words[o]), found[1]))
        return out

    def of_texts(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int | None, int, int, int]]]]:
        """(row, matches) of rows with a match."""
        for i, words, runs in suspects(texts, self.min_match, self.passes, bool(self.short)):
            if found := self.matches(words, runs):
                yield i, found


def suspects(texts: pa.Array, k: int, passes: Callable[[np.ndarray], np.ndarray], short: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, words, runs) of the texts of which a run passes the sieve; short: texts of fewer than ``k`` words as well."""
    for a, b, hashes, bounds in bytescan.words(texts, lower=True):
        rows = np.zeros(b - a, bool)
        runs = bytescan.shingles(hashes, k) if len(hashes) >= k else hashes[:0]  # those over two texts are left out below
        hit = np.flatnonzero(passes(runs))
        row = np.searchsorted(bounds, hit, side="right") - 1
        rows[row[hit + k <= bounds[row + 1]]] = True
        n = np.diff(bounds)
        if short:
            rows |= (n > 0) & (n < k)
        for i in np.flatnonzero(rows).tolist():
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            yield a + i, hashes[lo:hi], runs[lo : hi - k + 1] if hi - lo >= k else bytescan.shingles(hashes[lo:hi], k)


def _items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _small(items: DataFrame, min_match: int, coverage: float, block_bytes: int) -> Items | None:
    """The items if they are small enough to be sent."""
    if (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > block_bytes:
        return None
    rows = items.orderBy("item_id", "text").collect()  # at most block_bytes
    return Items([r["item_id"] for r in rows], [r["text"] for r in rows], min_match, coverage)


def _pairs(batches: Iterator[pa.RecordBatch], items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows = [(ids[i], *m) for i, found in items.value.of_texts(batch.column(1)) for m in found]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "tiled_words", "item_words", "n_tiles"])


def _seeds(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """ikey, text of items -> ikey, seed, least: how many of an item's runs a document has to share at least."""
    for batch in batches:
        keys, seeds, words = [], [], []
        for a, b, hashes, bounds in bytescan.words(batch.column(1), lower=True):
            for i in range(a, b):
                w = hashes[bounds[i - a] : bounds[i - a + 1]]
                runs = np.unique(bytescan.shingles(w, k))
                keys.append(np.repeat(batch.column(0)[i].as_py(), len(runs)).astype(np.int64))
                seeds.append(runs.view(np.int64))
                words.append(np.full(len(runs), len(w), np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, seeds, words)], ["ikey", "seed", "n_words"])


def _held(batches: Iterator[pa.RecordBatch], k: int, sieve) -> Iterator[pa.RecordBatch]:
    """dkey, text -> dkey, text, seeds that pass the sieve, of the documents that have any."""

    def passes(runs: np.ndarray) -> np.ndarray:
        at = (runs & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)
        return (sieve.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    for batch in batches:
        rows, seeds = [], []
        for i, _, runs in suspects(batch.column(1), k, passes, True):
            own = np.unique(runs)
            own = own[passes(own)]
            if len(own):
                rows.append(i)
                seeds.append(own.view(np.int64))
        if rows:
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in seeds])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(seeds)))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), lists], ["dkey", "text", "seeds"])


def _tiled(batches: Iterator[pa.RecordBatch], k: int, coverage: float) -> Iterator[pa.RecordBatch]:
    """dkey, ikey, text, item of pairs -> dkey, ikey and the figures of the pairs that are covered."""
    for batch in batches:
        rows = []
        for d, i, text, item in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            found = list(Items([i], [item], k, coverage).of_texts(pa.array([text], pa.string())))
            rows.extend((d, *m) for _, ms in found for m in ms)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["dkey", "ikey", "tiled_words", "item_words", "n_tiles"])


def _joined(keyed: DataFrame, items: DataFrame, k: int, coverage: float) -> DataFrame:
    """dkey, text of documents and ikey, text of items (a key stands for a text) -> dkey, ikey and figures of covered pairs."""
    spark = keyed.sparkSession
    seeds = cut(items.dropDuplicates(["ikey"]).select("ikey", "text").mapInArrow(lambda it: _seeds(it, k), "ikey long, seed long, n_words long"))
    # 2 ** SIEVE_BITS bits, summed to bytes where the seeds lie: the driver gets at most 2 ** (SIEVE_BITS - 3) small rows.
    at = F.col("seed").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    bits = seeds.select(F.shiftright(at, 3).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1), at.bitwiseAND(F.lit(7)).cast("int")).alias("bit"))
    found = bits.groupBy("at").agg(F.bit_or("bit").cast("short").alias("byte")).toArrow()
    sieve = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    sieve[np.asarray(found.column("at"))] = np.asarray(found.column("byte")).astype(np.uint8)
    sent = spark.sparkContext.broadcast(sieve)
    held = cut(keyed.select("dkey", "text").mapInArrow(lambda it: _held(it, k, sent), "dkey long, text string, seeds array<long>").dropDuplicates(["dkey"]))
    shared = held.select("dkey", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("dkey", "ikey").agg(F.count(F.lit(1)).alias("n"), F.first("n_words").alias("w"))
    # A run puts at most k words under it; a short item has one run, the whole.
    maybe = shared.filter(F.col("n") * k >= F.col("w") * coverage).select("dkey", "ikey")
    both = maybe.join(held.select("dkey", "text"), "dkey").join(items.dropDuplicates(["ikey"]).select("ikey", F.col("text").alias("item")), "ikey")
    return cut(both.select("dkey", "ikey", "text", "item").mapInArrow(lambda it: _tiled(it, k, coverage), "dkey long, ikey long, tiled_words long, item_words long, n_tiles long"))


def tiled_pairs(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, tiled_words, item_words, n_tiles, coverage of all pairs that reach ``coverage``."""
    items, texts = _items_of(benchmark), documents(docs)
    if small := _small(items, min_match, coverage, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(small)
        out = texts.mapInArrow(lambda it: released(_pairs(it, sent)), "doc_id long, item_id long, tiled_words long, item_words long, n_tiles long")
    else:
        texts, items = texts.withColumn("dkey", F.xxhash64("text")), items.withColumn("ikey", F.xxhash64("text"))
        pairs = _joined(texts, items, min_match, coverage)
        out = texts.select("doc_id", "dkey").join(pairs, "dkey").join(items.select("item_id", "ikey"), "ikey").select("doc_id", "item_id", "tiled_words", "item_words", "n_tiles")
    return out.withColumn("coverage", F.round(F.col("tiled_words") / F.col("item_words"), 6))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiled_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _clean(batches: Iterator[pa.RecordBatch], items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(len(batch), bool)
        keep[[i for i, _ in items.value.of_texts(batch.column(0))]] = False
        yield batch.filter(pa.array(keep))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that cover no test item, with all their columns."""
    items = _items_of(benchmark)
    if small := _small(items, min_match, coverage, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(small)
        rows = docs.select("text", *(c for c in docs.columns if c != "text"))
        return rows.mapInArrow(lambda it: released(_clean(it, sent)), rows.schema).select(*docs.columns)
    (key,) = fresh(docs.columns, "dkey")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    texts = keyed.select(F.col(key).alias("dkey"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    leaks = _joined(texts, items.withColumn("ikey", F.xxhash64("text")), min_match, coverage).select(F.col("dkey").alias(key)).distinct()
    return keyed.join(leaks, key, "left_anti").select(*docs.columns)
