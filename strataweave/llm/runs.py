"""Periodic runs of words, found the way of Ellert and Fischer: Lyndon arrays on an ordered alphabet, no suffix structures, no
hashes.

A run is a stretch of words with smallest period q that no neighbouring word extends keeping q. Each run holds a Lyndon root: the
longest Lyndon word that starts at some place of it, under an order of the words or under the reverse order. So for either
order every place gets its next smaller suffix; from the two suffixes of such an edge the run is read off by extending it to the
right and to the left.

Extensions are reused. While places are visited from left to right, the furthest end that any comparison has reached is
kept with the pair that reached it. A new pair inside that stretch mirrors an earlier pair, whose extension holds for it as well
unless it reaches the end; then comparing goes on there. What the last popped place has in common with the new one and
with the next on the stack decides most other pairs. No word is compared twice behind the furthest end, so either order takes
linear time; any order of the words serves, here that of first appearance.

Left extensions stop below one period. Neighbouring words that recur nowhere near as a pair are in no run of that length,
and the stretches between such pairs are searched by themselves.

Defined results: a null or blank text has no words and no runs; a null doc_id plants nothing; repeated ids and rows give a row
each; a very long text is one task's work, its words kept as numbers; an empty table gives an empty result; other columns
are left out by the query and carried along by ``collapse``, whatever their names; of equally great runs the first start, then the
smallest period is named.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import buffers
from .common import documents, fresh, quoted, released, table

LEAST, REPEATS = 24, 3
PIECE = 1 << 20


def edges(s: list[int]) -> tuple[list[int], list[int]]:
    """(next, common): for each place the next smaller suffix (the empty one is the smallest) and how many symbols both share."""
    n = len(s)
    after, after_common = [n] * n, [0] * n
    before, before_common = [-1] * n, [0] * n
    stack: list[int] = []
    a = b = reach = 0  # s[a:] and s[b:] agree up to ``reach``, the furthest place that was compared
    for j in range(n):
        popped, common = -1, 0
        while stack:
            i = stack[-1]
            if popped >= 0 and before_common[popped] != common:
                smaller = before_common[popped] > common
                common = min(common, before_common[popped])
            elif j + common < n and s[i + common] != s[j + common]:
                smaller = s[j + common] < s[i + common]
            else:
                end = j + common
                if end < reach:
                    end = reach
                    if i >= b:
                        x, y = i - b + a, j - b + a
                        if after[x] == y:
                            end = min(end, j + after_common[x])
                        elif before[y] == x:
                            end = min(end, j + before_common[y])
                if end >= reach:
                    k = i + end - j
                    while end < n and s[k] == s[end]:
                        k += 1
                        end += 1
                    a, b, reach = i, j, end
                common = end - j
                smaller = end == n or s[end] < s[i + common]
            if not smaller:
                before[j], before_common[j] = i, common
                break
            after[i], after_common[i] = j, common
            popped = stack.pop()
        stack.append(j)
    return after, after_common


def runs_of(s: list[int], least: int = LEAST, repeats: int = REPEATS) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` symbols and ``repeats`` (2 or more) periods."""
    found = set()
    top = max(s, default=0)
    for symbols in (s, [top - x for x in s]):
        after, common = edges(symbols)
        for i, c in enumerate(common):
            p = after[i] - i
            if c + 2 * p - 1 < max(least, repeats * p):
                continue
            if i >= p and after[i - p] == i and common[i - p] == c + p:
                continue  # an earlier root of the same run
            begin = i
            while begin and symbols[begin - 1] == symbols[begin - 1 + p]:
                begin -= 1
            length = after[i] + c - begin
            if length >= max(least, repeats * p):
                found.add((begin, length, p))
    return found


def _gaps(codes: np.ndarray) -> np.ndarray:
    """How far the nearest equal code is, on either side; more than there are codes if there is none."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    step = np.diff(order)
    step[codes[order[1:]] != codes[order[:-1]]] = 2 * n + 1
    out = np.full(n, 2 * n + 1)
    out[order[:-1]] = step
    out[order[1:]] = np.minimum(out[order[1:]], step)
    return out


def stretches(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches outside which no run lies, and which no run leaves.

    In a run of n words every pair of neighbours recurs within n / repeats words. A pair that doesn't is in no run that long, so
    what lies between such pairs is looked at again by its own, smaller length.
    """
    if len(ids) < least:
        return
    gaps = _gaps(ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:])
    open_ = [(0, len(gaps))]  # pairs; they hold one word more
    while open_:
        a, b = open_.pop()
        apart = np.flatnonzero(gaps[a:b] > (b - a + 1) // repeats) + a
        if not len(apart):
            yield a, b + 1
            continue
        cuts = np.concatenate([[a - 1], apart, [b]])
        long = np.flatnonzero(np.diff(cuts) >= least)
        open_.extend(zip((cuts[long] + 1).tolist(), cuts[long + 1].tolist(), strict=True))


def word_ids(data: memoryview) -> tuple[list[bytes], np.ndarray]:
    """(distinct words, numbers of all words) of a text's bytes; read piece by piece, so that no list of all words is held."""
    codes: dict[bytes, int] = {}
    parts, at, rest = [], 0, b""
    while at < len(data) or rest:
        part = rest + bytes(data[at : at + PIECE])
        at += PIECE
        words = part.split()
        rest = b""
        if at < len(data) and words and not part[-1:].isspace():
            rest = words.pop()
        parts.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int32, len(words)))
    return list(codes), np.concatenate(parts) if parts else np.zeros(0, np.int32)


def planted(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The query's words: every tenth document, by a hash of its id, repeats a part of itself from some place to its end."""
    if doc_id is None or not len(ids) or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return ids
    n, g = len(ids), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


def find(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """All runs of a text's words, by start, then period."""
    out = set()
    for a, b in stretches(ids, least, repeats):
        out |= {(a + start, length, p) for start, length, p in runs_of(ids[a:b].tolist(), least, repeats)}
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: not if a run contains it after the run's first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        depth[start + p] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def joined(words: list[bytes], ids: np.ndarray) -> Iterator[bytes]:
    """The words joined by one space, in pieces."""
    for k in range(0, len(ids), 100_000):
        yield (b" " if k else b"") + b" ".join([words[i] for i in ids[k : k + 100_000].tolist()])


def _greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    best = runs[0]
    for r in runs[1:]:  # exact: fractions are compared by products
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


#: The query's columns.
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        view, rows = memoryview(data), []
        for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words, ids = word_ids(view[a:b])
            ids = planted(ids, doc_id)
            runs = find(ids)
            listed, text = hashlib.sha256(), hashlib.sha256()
            for r in runs:
                listed.update(b"%d,%d,%d\n" % r)
            for part in joined(words, ids[kept(len(ids), runs)] if runs else ids):
                text.update(part)
            best = (*(r := _greatest(runs)), 1000 * r[1] // r[2]) if runs else (None,) * 4
            rows.append((doc_id, len(runs), *best, listed.hexdigest(), text.hexdigest()))
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k.endswith("sha256") else pa.int64()) for k, c in zip(names, columns, strict=True)], names)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(table(spark, sf_dir, "documents")).mapInArrow(lambda it: released(_digests(it)), DIGEST)


def _found(batches: Iterator[pa.RecordBatch], least: int, repeats: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        view, rows = memoryview(data), []
        for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words, ids = word_ids(view[a:b])
            for start, length, p in find(ids, least, repeats):
                rows.append((doc_id, start, length, p, b"".join(joined(words, ids[start : start + p])).decode(errors="replace")))
        if rows:
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "start", "length", "period", "unit"])


def periodic_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """doc_id, text -> doc_id, start, length, period (in words), unit (the words of the first period) of every run."""
    return documents(docs).mapInArrow(lambda it: released(_found(it, least, repeats)), "doc_id long, start long, length long, period long, unit string")


def _collapsed(batches: Iterator[pa.RecordBatch], least: int, repeats: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        view, texts = memoryview(data), []
        for old, a, b in zip(batch.column(0), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words, ids = word_ids(view[a:b])
            runs = find(ids, least, repeats)
            texts.append(b"".join(joined(words, ids[kept(len(ids), runs)])).decode(errors="replace") if runs else old.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], batch.schema.names)


def collapse(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """``docs``, each run cut to its first period; texts with a run get one space between words, others stay as they are."""
    (new,) = fresh(docs.columns, "text")
    held = docs.select(F.col("text").cast("string").alias(new), *(quoted(c) for c in docs.columns))
    done = held.mapInArrow(lambda it: released(_collapsed(it, least, repeats)), held.schema)
    return done.select(*(F.col(new).alias(c) if c.lower() == "text" else quoted(c) for c in docs.columns))
