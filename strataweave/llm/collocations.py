"""Phrase collocations by merged count-min sketches and an exact second pass.

First pass. Every task counts its n-grams of one to three words, block by block, and adds the counts to a sketch: ``ROWS`` arrays
of ``cells`` counters, one cell of each row for an n-gram's hash. A counter stops at the least count that is asked for, so half a
byte holds it. Tasks pass on the parts of their sketches that hold anything; parts of the same place are added up where the
shuffle brings them together, and only one bit for each cell comes back: whether it reached the least count. A cell
counts all n-grams that fall into it, so an n-gram with a cell below the least count is surely rare, and none that is frequent
gets lost.

Second pass. The bits are sent to every task (``ROWS * cells / 8`` bytes, a size set beforehand). N-grams all of whose cells are
full survive, a phrase only if its shorter parts do; survivors are counted exactly, by their words. Score and subsumption
are joins of these counts with themselves.

Words. Texts are ASCII-lower-cased and cut at ``.,;:!?`` and line ends into pieces, these at spaces and tabs into words; an n-gram
lies within one piece. In a block words are numbers and n-grams exact codes of numbers.

Scale. The sketch decides how much the second pass has to shuffle, never what comes out. At about as many cells as there are
different n-grams few rare ones survive; with far fewer cells than that most do, and the second pass is the plain exact count.
``cells_for`` takes a cell for every eight stored bytes, 2 ** 27 at most: a task holds ``ROWS`` bytes for each. Few tasks make
large sketches, so inputs share them by ``TASK_BYTES``.

Defined results: a null or blank text has no words; a null language is ``und``; repeated rows count each time; a very long text is
one block, counted whole; equal scores go by count, then by the phrase's bytes; an empty table gives an empty result; other columns
are left out, whatever their names. Counts up to 10 ** 15 are exact, and so are scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .bytescan import buffers, mix
from .common import cut, released, stored_bytes, table

LEAST, LONGEST, SUBSUMED, TOP = 10, 3, 50, 2000
ROWS = 2
#: Parts in which a language's phrases are ranked first.
PARTS = 32
#: Cells of a part of a sketch row.
PART = 1 << 16
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 27
#: Bytes of text that are counted at once.
BLOCK = 2 << 20
#: Stored bytes that share a sketch; a sketch has at most half as many bytes when it is passed on.
TASK_BYTES = 256 << 20
BREAK = b"\xff"  # in no UTF-8 text
_FOLD = bytes(0xFF if chr(x) in ".,;:!?\n\x0b\x0c\r" else x + 32 if 65 <= x <= 90 else 0x20 if x == 9 else x for x in range(256))
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def cells_for(stored: int) -> int:
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (stored // 8).bit_length()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts) of runs of rows of one language, folded; a break stands between texts and for every separator."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        view = memoryview(data)
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for lang, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            held.setdefault(lang, []).append(bytes(view[a:b]).translate(_FOLD))
            size[lang] = size.get(lang, 0) + b - a
            if size[lang] >= BLOCK:
                yield lang, BREAK.join(held.pop(lang))
                size[lang] = 0
        for lang, texts in held.items():
            yield lang, BREAK.join(texts)


class Grams:
    """The n-grams of a block: for each size the hashes, counts and first places of the different ones."""

    def __init__(self, lang: str, folded: bytes, longest: int):
        tokens = folded.replace(BREAK, b" \xff ").split(b" ")
        codes: dict[bytes, int] = {b"": 0, BREAK: 1}
        ids = np.fromiter((codes.setdefault(t, len(codes)) for t in tokens), np.int64, len(tokens))
        del tokens
        self.words = list(codes)
        ids = ids[ids != 0]
        self.ids, self.total = ids, int((ids > 1).sum())
        seed = xxhash.xxh64_intdigest(lang.encode(), 1)
        word = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], np.uint64)
        self.sizes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # hash, count, place, and which shorter n-grams: its head and tail
        inner = ids > 1
        code, at = ids[inner], np.flatnonzero(inner)
        shorter: np.ndarray | None = None  # for each place the number of its n-gram, one shorter
        for k in range(1, longest + 1):
            if k > 1:
                at = np.flatnonzero(shorter[:-1] >= 0) if len(shorter) else np.zeros(0, np.int64)
                at = at[shorter[at + 1] >= 0]
                code = shorter[at] * (len(self.words) + 1) + ids[at + k - 1]
            _, first, index, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
            place = at[first]
            h = np.full(len(place), k, np.uint64)
            for j in range(k):
                h = mix(h * _SALT[0] + word[ids[place + j]])
            parts = np.stack([shorter[place], shorter[place + 1]]) if k > 1 else np.zeros((2, len(place)), np.int64)
            self.sizes.append((h, count, place, parts))
            shorter = np.full(len(ids), -1, np.int64)
            shorter[at] = index

    def phrase(self, place: int, k: int) -> str:
        return b" ".join([self.words[i] for i in self.ids[place : place + k].tolist()]).decode()


def _cell(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(hashes ^ _SALT[row + 1]) & np.uint64(cells - 1)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], cells: int, least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """lang, text -> slot, part: counters of the task in half bytes, without parts that are all zero."""
    rows = [np.zeros(cells, np.uint8) for _ in range(ROWS)]
    for lang, folded in _blocks(batches):
        for h, count, *_ in Grams(lang, folded, longest).sizes:
            for r, held in enumerate(rows):
                at = _cell(h, r, cells)
                order = np.argsort(at)
                at, add = at[order], count[order]
                first = np.flatnonzero(np.diff(at, prepend=-1))
                if len(first):
                    at, add = at[first], np.minimum(np.add.reduceat(add, first), least)
                    held[at] = np.minimum(held[at] + add, least)
    size = min(PART, cells)
    for r, held in enumerate(rows):
        for k in range(cells // size):
            part = held[k * size : (k + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([r * (cells // size) + k], pa.int64()), pa.array([(part[0::2] << 4 | part[1::2]).tobytes()], pa.binary())], ["slot", "part"])


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """slot, part of several tasks -> slot, bits: which cells reach ``least``."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            packed = np.frombuffer(part, np.uint8)
            counts = np.empty(2 * len(packed), np.uint8)
            counts[0::2], counts[1::2] = packed >> 4, packed & 15
            sums[slot] = np.minimum(sums[slot] + counts, least) if slot in sums else counts
    if sums:
        bits = [np.packbits(c >= least).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(bits, pa.binary())], ["slot", "bits"])


def _in_tasks(rows: DataFrame, task_bytes: int) -> DataFrame:
    """``rows`` in as few tasks as their size and the cluster's cores allow: each passes on every n-gram once, and one sketch."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-stored_bytes(rows) // task_bytes)))


def heavy_cells(rows: DataFrame, cells: int, least: int = LEAST, longest: int = LONGEST, task_bytes: int = TASK_BYTES) -> np.ndarray:
    """lang, text -> a bit for each cell of the merged sketch, row after row: whether ``least`` n-grams or more fell into it."""
    parts = _in_tasks(rows, task_bytes).mapInArrow(lambda it: released(_sketch(it, cells, least, longest)), "slot long, part binary")
    merged = parts.repartition("slot").mapInArrow(lambda it: released(_merge(it, least)), "slot long, bits binary").toArrow()
    bits = np.zeros(ROWS * cells // 8, np.uint8)
    for slot, part in zip(merged.column(0).to_pylist(), merged.column(1).to_pylist(), strict=True):
        bits[slot * len(part) : (slot + 1) * len(part)] = np.frombuffer(part, np.uint8)
    return bits


def _survivors(batches: Iterator[pa.RecordBatch], sent, cells: int, longest: int) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, size, phrase, n of the block's n-grams that may be frequent; size 0 counts all words."""
    bits = sent.value
    types = [pa.string(), pa.int32(), pa.string(), pa.int64()]
    for lang, folded in _blocks(batches):
        grams = Grams(lang, folded, longest)
        out = [(0, "", grams.total)]
        alive: np.ndarray | None = None
        for k, (h, count, place, parts) in enumerate(grams.sizes, 1):
            keep = alive[parts[0]] & alive[parts[1]] if k > 1 else np.ones(len(h), bool)
            for r in range(ROWS):
                at = _cell(h, r, cells) + r * cells
                keep &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            alive = keep
            out += [(k, grams.phrase(p, k), c) for p, c in zip(place[keep].tolist(), count[keep].tolist(), strict=True)]
        for a in range(0, len(out), 50_000):
            sizes, phrases, counts = zip(*out[a : a + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([lang] * len(sizes), sizes, phrases, counts), types, strict=True)], ["lang", "size", "phrase", "n"])


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cells: int | None = None) -> DataFrame:
    """lang, size, phrase, n: exact counts of all n-grams met ``least`` times in their language; size 0: all words of it."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared_dir(docs.sparkSession)
    cells = cells or cells_for(stored_bytes(rows))
    sent = docs.sparkSession.sparkContext.broadcast(heavy_cells(rows, cells, least, longest))
    counted = _in_tasks(rows, TASK_BYTES).mapInArrow(lambda it: released(_survivors(it, sent, cells, longest)), "lang string, size int, phrase string, n long")
    return cut(counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("size") == 0)))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, subsumed: int = SUBSUMED, top: int = TOP, cells: int | None = None) -> DataFrame:
    """lang, text -> lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words."""
    counts = frequent(docs, least, longest, cells)
    known = counts.filter("size > 0").select("lang", "phrase", "n")
    phrases = counts.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))

    words = F.split("phrase", " ", -1)
    part = lambda lo, size: F.array_join(F.slice(words, lo, size), " ")
    cuts = phrases.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    of = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    # Whole numbers of up to 38 digits; a division of two of them is exact where it drops the fraction.
    score = F.expr("cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))

    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda lo: F.array_join(F.slice(words, lo, s), " ")))))
    inside = phrases.filter("size > 2").select("lang", F.col("a").alias("longer"), inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = best.join(inside, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {int(subsumed)} * a")

    # A language's best come from the best of its parts, so that no task sorts all of its phrases.
    rows = alone.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
        rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("size = 0").select("lang", "n")
    return rows.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same in SQL, exact and slow: all n-grams of all texts.
OP11_SQL = r"""
    WITH pieces AS (
      SELECT lang, doc_id, row_number() OVER () AS piece, text FROM (
        SELECT coalesce(lang, 'und') AS lang, doc_id,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS text FROM documents)),
    lists AS (SELECT lang, piece, regexp_extract_all(text, '[^\x20\x09]+') AS w FROM pieces),
    words AS (SELECT lang, piece, unnest(w) AS w1, unnest(range(1, len(w) + 1)) AS i, w FROM lists),
    grams AS (
      SELECT lang, 1 AS size, w1 AS phrase FROM words
      UNION ALL SELECT lang, 2, w1 || ' ' || w[i + 1] FROM words WHERE i < len(w)
      UNION ALL SELECT lang, 3, w1 || ' ' || w[i + 1] || ' ' || w[i + 2] FROM words WHERE i + 1 < len(w)),
    f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY 1, 2, 3),
    totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY 1),
    c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
    cuts AS (
      SELECT lang, size, phrase, a, w, 1 AS k, w[1] AS first, CASE WHEN size = 2 THEN w[2] ELSE w[2] || ' ' || w[3] END AS rest FROM c
      UNION ALL SELECT lang, size, phrase, a, w, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE size = 3),
    scored AS (
      SELECT cuts.lang, cuts.size, cuts.phrase, a, k, x.n AS l, y.n AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) t WHERE o = 1),
    inside AS (
      SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE size = 3) t GROUP BY 1, 2),
    ranked AS (
      SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, best.a DESC, best.phrase) AS rank, best.phrase, best.a, l, r, score
      FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase WHERE longer IS NULL OR 100 * longer < 50 * best.a)
    SELECT ranked.lang, rank, phrase, a, l, r, totals.n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000"""
