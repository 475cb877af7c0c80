"""Token ids in ORC: run-length encoded id lists in ascending document order, with row indexes and Bloom filters.

Documents are range-partitioned by id and sorted where they lie; a task encodes its documents with the tokenizers
library and streams them into one ORC file. Each row holds the document's ids, the file's number and the count of ids
before it in the file; a manifest with one row a file (name, range of ids, ids in the files before it) places the file in
the whole stream. ORC adds integer run-length encoding of the id lists, min/max indexes every ``row_index_stride`` rows and
a Bloom filter on ``doc_id``: a lookup by id opens only the files whose range holds it and skips stripes and row groups
there, and a large file is read stripe by stripe by different tasks.

The vocabulary's pre-tokenizer never joins characters over white space and its normalizer works within words, so a
text's ids are those of its words in turn. Each worker keeps a bounded table of words it has met and passes only
unknown ones to the library.

Defined results: a null or empty text has just the end id; a very long text is encoded in slices of words into one row; a null doc_id sorts first; repeated ids sort by their texts'
hash, then by text; an id or row of any weight is spread over files; an empty table gives an empty file set and manifest;
extra columns are left out of the files, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, new_folder, slices, table, tasks_for

#: Words kept by a worker; a full table is emptied.
KNOWN_WORDS = 500_000
#: Words longer than this go to the library each time.
LONG_WORD = 64

_state: dict = {}


class Words(dict):
    """word -> its ids as bytes, encoded by the library when first met.

    A run of letters, with or without closing punctuation, is two pre-tokens whose normal form is their lower case; the
    library's model encodes these directly. Anything else goes through the whole tokenizer.
    """

    plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:%*$&#]*)").fullmatch

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.runs: dict[str, bytes] = {}
        # The byte alphabet of byte-level BPE: printable bytes stand for themselves, others for code points from 256.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: 256 + k for k, b in enumerate(others)}

    def run(self, letters: str) -> bytes:
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if m := self.plain(word):
            letters, marks = m[1].lower(), m[2]
            ids = self.runs.get(letters)
            if ids is None:
                ids = self.run(letters)
                if len(letters) <= LONG_WORD:
                    self.runs[letters] = ids
            if marks:
                ids += self[marks]
        else:
            ids = array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids


def words_of(path: str) -> Words:
    if _state.get("path") != path:
        _state.update(path=path, words=Words(path))
    return _state["words"]


def cut_at_blanks(text: str) -> str:
    """ASCII white space as spaces; what else the tokenizer takes for white space stays within a word."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ")


def encode_words(texts: list[str], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text, without end ids."""
    words = words_of(path)
    out: list[bytes] = []
    for text in texts:
        if len(words) > KNOWN_WORDS:
            words.clear()
            words.runs.clear()
            words[""] = b""
        out.append(b"".join(map(words.__getitem__, cut_at_blanks(text).split(" "))))
    return out


def _rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text in order -> doc_id, part, part_start, n_tokens, tokens; part_start restarts with each task."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in slices(texts):
            ids = [x + end for x in encode_words(texts[a:b], path)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            bounds = np.concatenate([[0], np.cumsum(n)])
            tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<u4").view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.full(b - a, part)), pa.array(at + bounds[:-1]), pa.array(n), tokens], ["doc_id", "part", "part_start", "n_tokens", "tokens"])
            at += int(bounds[-1])


SCHEMA = "doc_id long, part long, part_start long, n_tokens long, tokens array<int>"


#: Files up to which their places (16 bytes a file) are broadcast to a reader; beyond, they are joined.
BROADCAST_FILES = 1_000_000


def write_token_files(
    docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 2, row_index_stride: int = 1000,
    stripe_bytes: int = 16 << 20, bloom_fpp: float = 0.01, task_bytes: int = 32 << 20,
) -> str:
    """Write ids of ``docs`` (doc_id, text) as ORC files below ``path``, with a manifest of the files; the path.

    task_bytes: stored bytes of ``docs`` that go into one file; the files' number follows the input.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "tokens")
    tokenizer = tokenizer or default_tokenizer()
    # A hot id is cut by its texts' hash, and rows equal in both by where they were read.
    keyed = documents(docs).withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = ["doc_id", "tie", "text", "place"]
    ordered = keyed.repartitionByRange(tasks_for(docs, task_bytes), "doc_id", "tie", "place").sortWithinPartitions(*order)
    rows = ordered.select("doc_id", "text").mapInArrow(lambda it: _rows(it, tokenizer, end_id), SCHEMA)
    options = {
        "compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(bloom_fpp),
        "orc.row.index.stride": str(row_index_stride), "orc.stripe.size": str(stripe_bytes), "orc.encoding.strategy": "COMPRESSION",
    }
    rows.write.options(**options).orc(f"{path}/ids")
    _write_manifest(spark, path)
    return path


def _write_manifest(spark: SparkSession, path: str) -> None:
    """One row a file: its number, name, least and greatest id, and the ids of all files before it."""
    files = spark.read.schema(SCHEMA).orc(f"{path}/ids").select("part", "doc_id", (F.col("part_start") + F.col("n_tokens")).alias("end"), F.col("_metadata.file_name").alias("file"))
    sums = files.groupBy("part").agg(
        F.first("file").alias("file"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max(F.col("doc_id").isNull()).alias("nulls"), F.max("end").alias("n")
    )
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    sums.select("part", "file", "lo", "hi", "nulls", "n", base.alias("base")).coalesce(1).write.orc(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part long, file string, lo long, hi long, nulls boolean, n long, base long").orc(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str, where=None) -> DataFrame:
    """doc_id, start, n_tokens, tokens of the files below ``path``; ``where``: a condition on doc_id, pushed into ORC."""
    bases = manifest(spark, path).select("part", "base")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_FILES else bases
    files = spark.read.schema(SCHEMA).orc(f"{path}/ids")
    wanted = files if where is None else files.filter(where)
    return wanted.join(bases, "part").select("doc_id", (F.col("part_start") + F.col("base")).alias("start"), "n_tokens", "tokens")


def lookup(spark: SparkSession, path: str, doc_id: int | None) -> DataFrame:
    """The rows of one id (null: those without). Only files whose range holds it are opened, only stripes and row groups
    whose bounds and Bloom filter let it pass are read."""
    own = F.col("nulls") if doc_id is None else F.lit(doc_id).between(F.col("lo"), F.col("hi"))
    held = manifest(spark, path).filter(own).select("part", "file", "base")
    names = [f"{path}/ids/{r['file']}" for r in held.collect()]  # the files one id spreads over, by their names alone
    files = spark.read.schema(SCHEMA).orc(names) if names else spark.createDataFrame([], SCHEMA)
    same = F.col("doc_id").isNull() if doc_id is None else F.col("doc_id") == doc_id
    return files.filter(same).join(F.broadcast(held), "part").select("doc_id", (F.col("part_start") + F.col("base")).alias("start"), "n_tokens", "tokens")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("tokens"))
        values = np.asarray(lists.values).astype("<u4", copy=False)
        o = np.asarray(lists.offsets)
        crc = pa.array([zlib.crc32(values[a:b]) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [crc], ["doc_id", "start", "n_tokens", "ids_crc32"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_token_files(table(spark, sf_dir, "documents"))
    return read_token_files(spark, path).mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
