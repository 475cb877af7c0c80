"""What the operators of this subpackage share: the shared folder, input projection, word patterns."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Words of the query contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/strataweave/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there: one job, where a checkpoint takes two and computes what it keeps in
    both, and joins know the size."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text of ``df`` (and columns in ``more``), whatever else it holds; a null text is empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names of our own for ``names`` that none of ``taken`` equals, whatever its case."""
    held = {c.lower() for c in taken}
    tail = ""
    while any(f"__{n}{tail}" in held for n in names):
        tail += "_"
    return [f"__{n}{tail}" for n in names]


def quoted(column: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col(f"`{column.replace('`', '``')}`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_size(text: Column) -> Column:
    """Bytes of the text plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1)).cast("long")


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, after which the worker gives free memory back to the system: workers live on, and stages with large arrays
    would otherwise leave the next ones little room."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def stored_bytes(df: DataFrame) -> int:
    """Size of the input by Catalyst's estimate; 0 if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def tasks_for(df: DataFrame, task_bytes: int) -> int:
    """Tasks for ``df`` at ``task_bytes`` of stored input each; the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(df) // task_bytes))


def slices(texts: list[str], chars: int = 3_000_000):
    """(from, to) of runs of ``texts`` that hold about ``chars`` characters: bounds what one step holds in memory."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
