"""N-gram Jaccard join with PartEnum signatures: all links between texts whose shingle sets are similar enough.

Signatures. Sets are dealt to size bands [U/2, U); a set that may have a partner in the next band takes part in that one
as well. In a band the shingle domain is cut by hash into ``n1`` groups of ``N2`` parts. Two similar sets differ in at
most k shingles, so in some group at most ``K2`` parts differ, and the projections on one subset of N2 - K2 parts are
equal: each set's signatures are the hashes of its non-empty projections on all such subsets of all groups. A set with too
few groups whose subsets are sure to be non-empty also gives the shingles of its prefix (its least hashes) as signatures;
of two similar sets of that kind the prefixes meet. So no similar pair is missed, whatever the sizes.

From signatures to links. Equal sets are one class from the start. Tasks sort the signatures dealt to them and report
each distinct list of classes that share one. Within a list, counts of shingles by hash bucket bound the
difference of two sets from below, and only pairs within the bound stay connected; what they connect is a family. Texts
are then read again for members of families only. A family is cut into blocks, and a task compares two blocks by exact
intersection counts (products of incidence matrices). Links are counted, and a spanning forest of them goes
on to the component step. Nothing is capped: large lists and families only make more block pairs. No step
emits the pairs of a group or gathers them on the driver.

Shingles are 64-bit hashes of runs of five ASCII-lower-cased words; a text of one to four words is one shingle.

Defined results: a very long text is hashed block by block, whole; a null or blank text has no shingles, no links and itself as component; equal sets are linked; a row
repeated under one id counts as a copy; a null doc_id is linked like others and names a component only where no member
has an id (the component is null then); an empty table gives an empty result; other columns are left out, whatever their
names, and ``keep_one`` carries them along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import bytescan
from .common import WORD, documents, fresh, quoted, released, stored, table, tasks_for
from .components import components

PERCENT = 80
#: Parts of a group and how many of them may differ.
N2, K2 = 3, 1
SUBSETS = list(combinations(range(N2), N2 - K2))
#: Least buckets of a sketch.
SKETCH = 128
#: Signatures that a task holds before it passes them on.
FLUSH = 750_000
LIST_BLOCK, FAMILY_BLOCK, FAMILY_SHINGLES = 1024, 512, 1_000_000
#: Stored bytes of documents for one task; a task holds about ten times as much. Larger executors may take more.
TASK_BYTES = 8 << 20
#: Family members up to which their table is broadcast to the scan of the texts (about 40 bytes each); else they join.
BROADCAST_MEMBERS = 200_000
_SALT = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]

#: For each band what sets its prefix shingles apart.
_PREFIX_SALT = np.arange(1, 65, dtype=np.uint64) * _SALT[2]


def differ_at_most(n: int, percent: int) -> int:
    """Most shingles in which a set of n and a similar set that is no smaller can differ."""
    return n * (100 - percent) // percent


def band(n: int) -> int:
    return max(0, (n // 4).bit_length() - 1)


def groups_of(instance: int, percent: int) -> int:
    top = differ_at_most(8 << instance, percent)
    return -(-(top + 1) * 108 // (100 * (K2 + 1)))


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a set, given as sorted distinct hashes."""
    n = len(s)
    k = differ_at_most(n, percent)
    if not k:
        return np.zeros(0, np.uint64)  # only equal sets are similar, and those are one class
    own = band(n)
    mixed, spot = bytescan.mix(s), bytescan.mix(s ^ _SALT[3]) >> np.uint64(16)
    out = []
    for i in (own, own + 1) if n * 100 >= (8 << own) * percent else (own,):
        n1 = groups_of(i, percent)
        part = (spot % np.uint64(N2 * n1)).astype(np.int64)
        sums = np.zeros(N2 * n1, np.uint64)
        np.add.at(sums, part, mixed)
        sums = sums.reshape(n1, N2)
        full = sums != 0
        tag = bytescan.mix(np.arange(n1, dtype=np.uint64) + np.uint64(i << 40))
        for x, subset in enumerate(SUBSETS):
            some = full[:, subset].any(axis=1)
            h = tag[some] + np.uint64(x)
            for j in subset:
                h = h + bytescan.mix(sums[some, j] ^ _SALT[j])
            out.append(bytescan.mix(h))
        if (full.sum(axis=1) > K2).sum() <= k // (K2 + 1):
            prefix = n - -(-n * percent // 100) + 1
            out.append(bytescan.mix(s[:prefix] + _PREFIX_SALT[i]))
    return np.concatenate(out)


def sketch(s: np.ndarray) -> bytes:
    """Shingles in each of some 4 to 8 times fewer buckets, modulo 16, two to a byte."""
    size = max(SKETCH, 1 << max(0, len(s).bit_length() - 3))
    c = (np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size) & 15).astype(np.uint8)
    return (c[0::2] << 4 | c[1::2]).tobytes()


def unfold(sketches: list[bytes]) -> np.ndarray:
    """Bucket counts of all sketches, with as many buckets as the smallest has."""
    out = np.empty((len(sketches), 2 * min(map(len, sketches))), np.int8)
    lengths = np.array([len(k) for k in sketches])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        raw = np.frombuffer(b"".join(sketches[i] for i in at.tolist()), np.uint8).reshape(len(at), n)
        counts = np.empty((len(at), 2 * n), np.uint8)
        counts[:, 0::2], counts[:, 1::2] = raw >> 4, raw & 15
        while counts.shape[1] > out.shape[1]:
            half = counts.shape[1] // 2
            counts = (counts[:, :half] + counts[:, half:]) & 15
        out[at] = counts
    return out


def set_id(s: np.ndarray) -> int:
    total = bytescan.mix(s ^ _SALT[0]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s))
    return int(bytescan.mix(total).view(np.int64)[0])


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    for a, b, hashes, bounds in bytescan.words(texts, lower=True):
        for i in range(b - a):
            yield np.unique(bytescan.shingles(hashes[bounds[i] : bounds[i + 1]]))


# Rows between the scan and the signature tasks. kind 0, a document: a = doc_id, b = set id, t = hash of its text, n, blob =
# sketch.
# kind 1, signatures of one bucket: blob = members, then their ids and signature counts, then 48 bits of each signature.
# Buckets are the signatures' leading bits, two to four times as many as tasks, so few that a member's id seldom repeats.
RAW = "kind int, bucket long, a long, b long, t long, n long, blob binary"


def _pack(held: list[tuple[int, np.ndarray]], bits: int) -> Iterator[tuple]:
    ids = np.array([h[0] for h in held], np.int64)
    sig = np.concatenate([h[1] for h in held])
    member = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
    bucket = (sig >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sig, member, bucket = sig[order], member[order], bucket[order]
    for lo, hi in zip(starts := np.flatnonzero(np.diff(bucket, prepend=-1)), np.append(starts[1:], len(bucket)), strict=True):
        m = member[lo:hi]
        first = np.flatnonzero(np.diff(m, prepend=-1))
        counts = np.diff(np.append(first, len(m))).astype(np.uint32)
        low = np.ascontiguousarray(sig[lo:hi]).view(np.uint8).reshape(-1, 8)[:, :6]
        yield 1, int(bucket[lo]), None, None, None, None, np.uint32(len(first)).tobytes() + ids[m[first]].tobytes() + counts.tobytes() + low.tobytes()


def _unpack(bucket: int, blob: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (at most 16 leading bits above their 48 low ones) and for each its member's id."""
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    ids, counts = np.frombuffer(blob, np.int64, n, 4), np.frombuffer(blob, np.uint32, n, 4 + 8 * n)
    low = np.frombuffer(blob, np.uint8, -1, 4 + 12 * n).reshape(-1, 6)
    sig = np.zeros((len(low), 8), np.uint8)
    sig[:, :6] = low
    return sig.view(np.uint64).ravel() | np.uint64(bucket >> max(0, bits - 16) << 48), np.repeat(ids, counts)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


_RAW_NAMES = ["kind", "bucket", "a", "b", "t", "n", "blob"]
_RAW_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _scan(batches: Iterator[pa.RecordBatch], percent: int, bits: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # set ids of this task: copies give their signatures once
    turn = 0  # documents go round the buckets, so that copies do not meet in one
    held, count = [], 0
    for batch in batches:
        rows = []
        for doc_id, text_hash, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), sets_of(batch.column(1)), strict=True):
            sid = set_id(s)
            turn += 1
            rows.append((0, turn & ((1 << bits) - 1), doc_id, sid, text_hash, len(s), sketch(s)))
            if len(s) and sid not in seen:
                seen.add(sid)
                if len(sig := signatures(s, percent)):
                    held.append((sid, sig))
                    count += len(sig)
            if count >= FLUSH:
                yield _batch(list(_pack(held, bits)), _RAW_NAMES, _RAW_TYPES)
                held, count = [], 0
        yield _batch(rows, _RAW_NAMES, _RAW_TYPES)
    if held:
        yield _batch(list(_pack(held, bits)), _RAW_NAMES, _RAW_TYPES)


_LISTED_NAMES = ["kind", "a", "b", "t", "n", "blob"]


# Rows after the signature tasks. kind 0 as before; kind 1, a list: a = its hash, n = members, blob = their ids.
def _lists(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    parts = []
    for batch in batches:
        kinds = np.asarray(batch.column(0))
        if (kinds == 0).any():
            yield batch.filter(pa.array(kinds == 0)).select(_LISTED_NAMES)
        for k in np.flatnonzero(kinds == 1).tolist():
            parts.append(_unpack(batch.column(1)[k].as_py(), batch.column(6)[k].as_py(), bits))
    if not parts:
        return
    sig, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    parts.clear()
    order = np.argsort(sig)
    sig, ids = sig[order], ids[order]
    same = sig[1:] == sig[:-1]
    shared = np.zeros(len(sig), bool)
    shared[1:] |= same
    shared[:-1] |= same
    sig, ids = sig[shared], ids[shared]
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])  # the same class from two tasks
    sig, ids = sig[keep], ids[keep]
    if not len(sig):
        return
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig)))
    key = bytescan.mix(np.add.reduceat(bytescan.mix(ids.astype(np.uint64)), first) + size.astype(np.uint64)).astype(np.int64)
    _, once = np.unique(key, return_index=True)
    rows = [(1, int(key[i]), None, None, int(size[i]), ids[first[i] : first[i] + size[i]].tobytes()) for i in once.tolist() if size[i] > 1]
    for a in range(0, len(rows), 10_000):
        yield _batch(rows[a : a + 10_000], _LISTED_NAMES, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists to rows (list, x, y, sid, left): a member of block i takes part in all block pairs of i."""
    for batch in batches:
        out = [[], [], [], [], []]
        for key, n, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ids = np.frombuffer(blob, np.int64)
            for x, y, who, left in block_pairs(ids, -(-n // LIST_BLOCK)):
                for column, value in zip(out, (np.full(len(who), key), np.full(len(who), x), np.full(len(who), y), who, left), strict=True):
                    column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["list", "x", "y", "sid", "left"])


def block_pairs(ids: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(x, y, ids of both blocks, whether of the left one) for all pairs x <= y of n blocks."""
    if n == 1:
        yield 0, 0, ids, np.ones(len(ids), bool)
        return
    block = (bytescan.mix(ids.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    by = [ids[block == b] for b in range(n)]
    for x in range(n):
        for y in range(x, n):
            right = by[y] if y > x else by[y][:0]
            yield x, y, np.concatenate([by[x], right]), np.concatenate([np.ones(len(by[x]), bool), np.zeros(len(right), bool)])


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal values in the first columns; the rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([np.asarray(batch.column(i)) for i in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Which of n things are connected; keeps the edges that connected them."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((x, y))

    def connect(self, linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """Link rows[i] with columns[j] wherever ``linked`` is true."""
        for i, r in enumerate(rows.tolist()):
            for c in columns[linked[i]].tolist():
                self.link(r, c)


def _close(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Members of lists, sorted by list and block pair -> edges that connect those within the sketch bound."""
    up: dict[int, int] = {}  # what the edges of this task connect already
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for group in groups(batches, 3):
        sid, left = np.asarray(group.column("sid")), np.asarray(group.column("left"))
        n = np.asarray(group.column("n"))
        counts = unfold(group.column("sketch").to_pylist())
        rows = np.flatnonzero(left)
        columns = rows if left.all() else np.flatnonzero(~left)
        forest = Forest(len(sid))
        step = max(1, 4_000_000 // (counts.shape[1] * max(1, len(columns))))
        for a in range(0, len(rows), step):
            some = rows[a : a + step]
            gap = np.abs(counts[some][:, None, :] - counts[columns][None, :, :])
            least = np.minimum(gap, 16 - gap).sum(axis=2, dtype=np.int64)
            linked = least * (100 + percent) <= (n[some][:, None] + n[columns][None, :]) * (100 - percent)
            linked &= some[:, None] != columns[None, :]
            forest.connect(linked, some, columns)
        for x, y in forest.edges:
            a, b = root(int(sid[x])), root(int(sid[y]))
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((min(a, b), max(a, b)))
        if len(out) >= 50_000:
            yield _batch(out, ["a", "b"], [pa.int64(), pa.int64()])
            out = []
        if len(up) >= 1_000_000:
            up.clear()
    if out:
        yield _batch(out, ["a", "b"], [pa.int64(), pa.int64()])


def common_counts(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of sets[rows] with sets[columns]."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
    often = seen > 1  # a shingle of one set is in no intersection
    new = np.cumsum(often) - 1
    keep = often[code]
    owner, code = owner[keep], new[code[keep]]
    out = np.zeros((len(rows), len(columns)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = 4096
    for a in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(code, [a, a + width])
        holds = np.zeros((len(sets), width), np.float32)
        holds[owner[lo:hi], code[lo:hi] - a] = 1
        out += holds[rows] @ holds[columns].T
    return out.astype(np.int64)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Families' texts, sorted by family and block pair -> (a, b, 0): forest edges; (a, null, links): linked copies of a."""
    for group in groups(batches, 3):
        table_ = group.combine_chunks()
        sid, copies, left = (np.asarray(table_.column(c)) for c in ("sid", "copies", "left"))
        sets = [s for chunk in table_.column("text").chunks for s in sets_of(chunk)]
        right = np.flatnonzero(np.array([set_id(s) for s in sets]) == sid)  # an id may stand for other texts as well
        once = right[np.unique(sid[right], return_index=True)[1]]
        sid, copies, left, sets = sid[once], copies[once], left[once], [sets[k] for k in once.tolist()]
        if not len(sid):
            continue
        rows = np.flatnonzero(left)
        columns = rows if left.all() else np.flatnonzero(~left)
        n = np.array([len(s) for s in sets], np.int64)
        both = common_counts(sets, rows, columns)
        linked = both * 100 >= (n[rows][:, None] + n[columns][None, :] - both) * percent
        linked &= rows[:, None] != columns[None, :]
        forest = Forest(len(sid))
        forest.connect(linked, rows, columns)
        out = [(int(sid[x]), int(sid[y]), 0) for x, y in forest.edges]
        links = np.zeros(len(sid), np.int64)
        links[rows] += linked @ copies[columns]
        if not left.all():
            links[columns] += linked.T @ copies[rows]
        out += [(int(sid[k]), None, int(links[k])) for k in np.flatnonzero(links).tolist()]
        if out:
            yield _batch(out, ["a", "b", "links"], [pa.int64(), pa.int64(), pa.int64()])


def _linked(docs: DataFrame, percent: int, task_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n, sid), one a document; classes (sid, root, component_id, n_links), one a set with shingles."""
    shared_dir(docs.sparkSession)
    tasks = tasks_for(docs, task_bytes)
    bits = (tasks - 1).bit_length() + 1
    source = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    raw = source.mapInArrow(lambda it: released(_scan(it, percent, bits)), RAW).repartition(tasks, "bucket")
    dealt = stored(raw.mapInArrow(lambda it: released(_lists(it, bits)), "kind int, a long, b long, t long, n long, blob binary"), "dealt")
    sets = dealt.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("t").alias("text_hash"), F.col("b").alias("sid"), "n", "blob")
    # A class is read again by the text of its least id; a class of null ids only by one of its texts.
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash")))
    classes = sets.filter("n > 0").groupBy("sid").agg(least.alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("blob").alias("sketch"))
    lists = dealt.filter("kind = 1").groupBy("a").agg(F.first("n").alias("n"), F.first("blob").alias("blob"))

    pairs = ["list", "x", "y"]
    members = lists.mapInArrow(_members, "list long, x long, y long, sid long, left boolean")
    sized = members.join(classes.select("sid", "n", "sketch"), "sid").select(*pairs, "sid", "left", "n", "sketch")
    close = sized.repartition(tasks, *pairs).sortWithinPartitions(*pairs).mapInArrow(lambda it: released(_close(it, percent)), "a long, b long")
    families = stored(components(close).join(classes.select("sid", "least", "copies", "n"), F.col("node") == F.col("sid")).select("root", "sid", "least", "copies", "n"), "families")

    blocks = stored(families.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / FAMILY_BLOCK), F.ceil(F.sum("n") / FAMILY_SHINGLES)).alias("blocks")), "blocks")
    placed = families.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("sid"), "blocks"))
    wanted = placed.select(F.col("least.doc_id").alias("least_id"), F.col("least.text_hash").alias("least_hash"), "root", "sid", "copies", "blocks", "own")
    wanted = F.broadcast(wanted) if families.count() <= BROADCAST_MEMBERS else wanted
    pairs = ["root", "x", "y"]
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    same = (F.col("text_hash") == F.col("least_hash")) & F.col("doc_id").eqNullSafe(F.col("least_id"))
    texts = (
        source.join(wanted, same).select("root", "sid", "copies", "own", "text", other)
        .select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "sid", "copies", (F.col("own") <= F.col("other")).alias("left"), "text")
    )
    verified = stored(texts.repartition(tasks, *pairs).sortWithinPartitions(*pairs).mapInArrow(lambda it: released(_verify(it, percent)), "a long, b long, links long"), "verified")

    roots = components(verified.filter("b is not null").select("a", "b"))
    links = verified.filter("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    named = classes.select("sid", "least", "copies").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    firsts = stored(named.groupBy("root").agg(F.min("least.doc_id").alias("component_id")), "firsts")
    known = named.join(firsts, "root").join(links, "sid", "left").select("sid", "root", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return sets.select("doc_id", "text_hash", "n", "sid"), stored(known, "known")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, task_bytes: int = TASK_BYTES) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id, n_links (other documents linked, copies included)."""
    rows, known = _linked(docs, percent, task_bytes)
    named = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(known, "sid", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, percent: int = PERCENT, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row of each component, that of its least doc_id (ids before null; of one id the least hash of text, of equal ones
    any); rows without shingles are linked with nothing and all stay."""
    rows, known = _linked(docs, percent, task_bytes)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    best = rows.filter("n > 0").join(known.select("sid", "root"), "sid").groupBy("root").agg(F.min(order).alias("o"))
    of, at, empty = fresh(docs.columns, "of", "at", "empty")
    stay = stored(best.select(F.coalesce("o.doc_id", F.lit(0)).alias(of), F.struct(F.col("o.doc_id").isNull(), F.col("o.text_hash")).alias(at)).distinct(), "stay")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({of: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), at: F.struct(F.col("doc_id").isNull(), F.xxhash64(text)), empty: ~F.rlike(text, F.lit(WORD))})
    one = keyed.filter(~F.col(empty)).join(stay, [of, at], "left_semi").groupBy(of, at).agg(F.first(F.struct(*(quoted(c) for c in docs.columns))).alias("row"))
    return one.select("row.*").unionByName(keyed.filter(empty).select(*(quoted(c) for c in docs.columns)))
