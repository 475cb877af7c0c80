"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, private data, token ids.

Each stage takes what the one before kept, written as Parquet and read again. All but the last return the columns of
``documents``; the last adds ``ids`` (SentencePiece ids of the whole cleaned text) and ``decoded`` in place of ``text``.

Defined results: a null or blank text scores 0 and goes in the first stage; rows without an id and repeated ids are rows like others, each
judged by its own text; an empty table, or one of which nothing is kept, runs through all stages and gives an empty result with the same
columns; columns beside those named are carried along, but ``ids`` and ``decoded`` of the input give way to those found here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import decontaminate, near_duplicates, pieces, private_data, quality
from strataweave.llm.common import new_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote doesn't reject."""
    return quality.keep_good(spark, docs, sf_dir)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no test item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private_data_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private data replaced by its kind."""
    return private_data.redact(docs)


def sentencepiece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, with what these decode to."""
    return pieces.encode_columns(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("private_data_redaction", private_data_redaction),
    ("sentencepiece_codec", sentencepiece_codec),
]

#: SQL can express neither the vote nor the tiling; tests/llm/test_pipeline.py holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_folder(spark, name)
            out.write.parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
        docs = out
    return docs
