"""Histogram sort: exact splitters from counted histograms, then one exchange (law ``bytes``).

Rows are ordered by (key, hash of the text, place in the input), so that neither a hot key nor many equal rows make a
stretch that cannot be cut. Splitters are found before any row moves. Each round counts, exactly and over all partitions,
the bytes below evenly spaced probes inside every interval that still holds an unsettled splitter; an interval shrinks to
the histogram cell its splitter falls in. A splitter is settled when the bytes below a probe lie within tolerance of what is
wanted. An interval that has shrunk to a single value of the key goes on over the hash, then over the place. Splitters
of shards are tight; between them lie loose ones that cut a shard into stretches of ``task_bytes``. Then one exchange by
stretch number sorts the rows: each task's rows are numbered where they lie, and the per-task counts (one row a task)
turn those into gapless slots.

Only DataFrame functions run here; the driver sees at most ``PROBES`` rows a round and one row a task.

Defined results: a null text has no bytes (size 1); a very long text is one row, and a shard may exceed its share by it; a null key sorts first; rows equal in key and text are
interchangeable and are cut like any others; an empty table gives an empty result; extra columns are carried along, but
``size``, ``shard`` and ``slot`` of the input give way to those found here. The place is where a row was read, so ``docs``
should be a stored table: over one that comes out of a shuffle, shards stay whole but may miss the tolerance.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, new_folder, utf8_size

#: Bits of one histogram level: an interval is cut into at most 2 ** BITS cells a round.
BITS = 8
#: Cells that one round counts in all open intervals together.
PROBES = 1 << 18
LOW, HIGH = -(2**63), 2**63 - 1
ORDER = ("key", "tie", "place")


@dataclass
class Splitter:
    """``want`` bytes should lie below it, ``slack`` fewer at most. Until ``bound`` is settled it lies among the rows whose
    first order columns equal ``prefix`` and whose next one shares the bits above the last ``bits`` with ``lo``."""

    want: int
    slack: int
    lo: int
    bits: int
    below: int = 0
    prefix: tuple[int, ...] = ()
    bound: tuple[int, int, int] | None = None
    cells: list = field(default_factory=list, repr=False)

    def span(self) -> tuple:
        return (*self.prefix, self.lo), self.bits


def _filled(values: tuple[int, ...], by: int) -> tuple[int, int, int]:
    return (*values, *[by] * (len(ORDER) - len(values)))


def block(lo: int, hi: int) -> tuple[int, int]:
    """(start, bits) of the smallest aligned block of 64-bit values that holds lo to hi."""
    a, b = lo - LOW, hi - LOW
    bits = (a ^ b).bit_length()
    return (a >> bits << bits) + LOW, bits


def position(bounds: list[tuple[int, ...]], row: Column, like: str) -> Column:
    """How many of the sorted ``bounds`` (structs of the DDL type ``like``) are at most ``row``, by binary search."""
    if not bounds:
        return F.lit(0)
    names = [x.split(":")[0].strip() for x in like.removeprefix("struct<").rstrip(">").split(",")]
    held = F.from_json(F.lit(json.dumps([dict(zip(names, b, strict=True)) for b in bounds])), f"array<{like}>")

    def step(at: Column, _: Column) -> Column:
        mid = F.shiftright(at["lo"] + at["hi"], 1)
        right = F.get(held, mid) <= row
        return F.when(at["lo"] >= at["hi"], at).when(right, F.struct((mid + 1).alias("lo"), at["hi"].alias("hi"))).otherwise(F.struct(at["lo"].alias("lo"), mid.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, step, lambda at: at["lo"])


ROW = "struct<key: bigint, tie: bigint, place: bigint>"


def _row(*columns: str) -> Column:
    return F.struct(*(F.col(c).alias(n) for c, n in zip(columns, ORDER, strict=True)))


def _histogram(rows: DataFrame, spans: list[tuple], shift: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each of the disjoint sorted spans its non-empty cells as (cell, bytes, rows)."""
    starts = [_filled(values, LOW) for values, _ in spans]
    ends = [_filled((*values[:-1], values[-1] + (1 << bits) - 1), HIGH) for values, bits in spans]
    of = F.from_json(F.lit(json.dumps([{"level": len(v) - 1, "mask": (1 << min(bits - s, 62)) - 1, "shift": s, "end": dict(zip(ORDER, e, strict=True))} for (v, bits), s, e in zip(spans, shift, ends, strict=True)])), f"array<struct<level: int, mask: bigint, shift: int, end: {ROW}>>")
    found = rows.select((position(starts, _row(*ORDER), ROW) - 1).alias("span"), *ORDER, "size").filter("span >= 0").withColumn("of", F.get(of, F.col("span")))
    value = F.when(F.col("of.level") == 0, F.col("key")).when(F.col("of.level") == 1, F.col("tie")).otherwise(F.col("place"))
    # An aligned block: the cell is a run of bits of the value, its sign bit turned so that order is unsigned.
    cell = F.call_function("shiftrightunsigned", value.bitwiseXOR(F.lit(LOW)), F.col("of.shift")).bitwiseAND(F.col("of.mask"))
    counted = (
        found.filter(_row(*ORDER) <= F.col("of.end")).groupBy("span", cell.cast("int").alias("cell")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    )
    out: list[list[tuple[int, int, int]]] = [[] for _ in spans]
    for r in counted.collect():  # at most PROBES rows
        out[r["span"]].append((r["cell"], r["bytes"], r["rows"]))
    return [sorted(x) for x in out]


def _advance(s: Splitter, cells: list[tuple[int, int, int]], shift: int) -> None:
    """Move ``s`` into the cell it falls in, or settle it."""
    for cell, n_bytes, n_rows in cells:
        if s.below + n_bytes <= s.want:
            s.below += n_bytes
            continue
        s.lo, s.bits = s.lo + (cell << shift), shift
        if s.want - s.below <= s.slack:
            s.bound = _filled((*s.prefix, s.lo), LOW)
        elif shift == 0 and n_rows > 1 and len(s.prefix) + 1 < len(ORDER):
            s.prefix, s.lo, s.bits = (*s.prefix, s.lo), LOW, 64
        elif shift == 0:  # one row: the nearer side
            past = s.want - s.below > n_bytes / 2
            s.below += n_bytes if past else 0
            s.bound = _filled((*s.prefix, s.lo + 1 if past and s.lo < HIGH else s.lo), LOW)
        return
    s.bound = _filled((*s.prefix, min(HIGH, s.lo + (1 << s.bits) - 1)), HIGH)  # all of it lies below


def find_splitters(rows: DataFrame, n_shards: int, tolerance: float, stretches: int = 1) -> tuple[list[Splitter], int, int]:
    """Exact splitters of ``rows`` (key, tie, place, size: long) at every ``stretches``-th place; total bytes and rows."""
    total = rows.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    if not total["n"]:
        return [], 0, 0
    parts = n_shards * stretches
    tight, loose = int(total["b"] / n_shards * tolerance), total["b"] // parts // 2
    lo, bits = block(total["lo"], total["hi"])
    found = [Splitter(total["b"] * i // parts, loose if i % stretches else tight, lo, bits) for i in range(1, parts)]
    while todo := [s for s in found if s.bound is None]:
        spans = sorted({s.span() for s in todo})
        cells_bits = max(1, min(BITS, (PROBES // len(spans)).bit_length() - 1))
        shift = [max(0, bits - cells_bits) for _, bits in spans]
        cells = dict(zip(spans, zip(_histogram(rows, spans, shift), shift, strict=True), strict=True))
        for s in todo:
            _advance(s, *cells[s.span()])
    return found, total["b"], total["n"]


#: Stretches that the search for splitters places; beyond, a task gets more bytes and its sort spills.
MOST_STRETCHES = 32_768


def histogram_sort(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", n_shards: int = 8, tolerance: float = 0.0005, task_bytes: int = 64 << 20) -> DataFrame:
    """Write ``docs`` as ``n_shards`` sorted shards of near equal bytes below ``path``; return them with size, shard, slot.

    tolerance: share of a shard's bytes by which a splitter may miss. task_bytes: bytes of text an exchange task gets.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "shards")
    own = docs.drop(*(c for c in ("size", "shard", "slot") if c not in (key, text)))
    k, t, p, part, pos, to = fresh(docs.columns, "key", "tie", "place", "part", "pos", "to")
    keyed = own.select(
        "*", F.coalesce(F.col(key).cast("long"), F.lit(LOW)).alias(k), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias(t),
        F.monotonically_increasing_id().alias(p), utf8_size(F.col(text).cast("string")).alias("size"),
    )
    narrow = cut(keyed.select(F.col(k).alias("key"), F.col(t).alias("tie"), F.col(p).alias("place"), "size"))
    n_bytes = narrow.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // task_bytes))
    stretches = max(1, min(MOST_STRETCHES // n_shards, -(-tasks // n_shards)))
    found, _, _ = find_splitters(narrow, n_shards, tolerance, stretches)
    row = _row(k, t, p)
    bounds = sorted(s.bound for s in found)
    shards = sorted(s.bound for i, s in enumerate(found, 1) if i % stretches == 0)
    place = F.monotonically_increasing_id()
    sorted_ = (
        keyed.select("*", position(shards, row, ROW).alias("shard"), position(bounds, row, ROW).alias(to))
        .repartitionById(n_shards * stretches, to).sortWithinPartitions("shard", k, t, p)
        .withColumn(part, F.shiftright(place, 33)).withColumn(pos, place.bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(k, t, p, to)
    )
    sorted_.write.partitionBy("shard").parquet(path)
    return read_shards(spark, path, sorted_.schema, n_shards * stretches, part, pos)


#: Exchange tasks up to which their counts (24 bytes a task and shard) are broadcast; beyond, they are joined.
BROADCAST_TASKS = 200_000


def read_shards(spark, path: str, schema, tasks: int, part: str, pos: str) -> DataFrame:
    """The shards below ``path``, written by ``tasks`` tasks, with their slots; part, pos: where a task put a row."""
    files = spark.read.schema(schema).parquet(path)
    # A task wrote consecutive rows of the order, so a slot is the rows of the shard in earlier tasks plus the distance
    # from the task's first row in this shard. One row for each task and shard is summed here.
    n, first, base = fresh(schema.names, "n", "first", "base")
    counts = files.groupBy("shard", part).agg(F.count(F.lit(1)).alias(n), F.min(pos).alias(first))
    before = F.sum(n).over(Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("shard", part, (F.coalesce(before, F.lit(0)) - F.col(first)).alias(base))
    bases = F.broadcast(bases) if tasks <= BROADCAST_TASKS else bases
    return files.join(bases, ["shard", part]).withColumn("slot", F.col(pos) + F.col(base)).drop(part, pos, base)


def op8_histogram_sort(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return histogram_sort(docs).select(
        "doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
