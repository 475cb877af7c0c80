"""Reports as documents of many lines, written where the rows lie: a line is a row, and its place in the document is its sort key.

No section goes through the driver or one task: lines are dealt to ranges of their keys and sorted there, part files follow each other, so
reading them by name gives the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = "document string, section int, key string, line string"


def lines_of(rows: DataFrame, section: int, line: Column, key: Column, document: Column | None = None) -> DataFrame:
    """Rows as lines of one section of a document, in order of ``key``."""
    return rows.select((F.lit("") if document is None else document).cast("string").alias("document"), F.lit(section).alias("section"), key.cast("string").alias("key"), line.alias("line"))


def joined(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def json_document(spark, sections: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Lines of one JSON object: ``counts`` first, then a list for each section (rows, columns to sort by); nulls are left out."""
    parts, counts = [], []
    for k, (name, (rows, order)) in enumerate(sections.items()):
        key = F.concat(F.lit("1"), F.to_json(F.struct(*order)), F.lit("\x01"), F.to_json(F.struct(*rows.columns)))
        held = lines_of(rows, k + 1, F.concat(F.lit("    ,"), F.to_json(F.struct(*rows.columns))), key)
        first = held.agg(F.min("key").alias("first"))  # one row: the first line of a list has no comma before it
        parts.append(held.crossJoin(F.broadcast(first)).select("document", "section", "key", F.when(F.col("key") == F.col("first"), F.regexp_replace("line", "^    ,", "     ")).otherwise(F.col("line")).alias("line")))
        counts.append(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), F.concat(F.lit(f'    "{name}": '), F.col("n").cast("string")).alias("text")))
    total = joined(*counts).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), ",\n").alias("text"))  # a row a section
    parts.append(total.select(F.lit("").alias("document"), F.lit(0).alias("section"), F.lit("").alias("key"), F.concat(F.lit('{\n  "counts": {\n'), "text", F.lit("\n  }")).alias("line")))
    marks = [("", k + 1, "0", f'  ,"{name}": [') for k, name in enumerate(sections)] + [("", k + 1, "2", "  ]") for k in range(len(sections))] + [("", len(sections) + 1, "", "}")]
    return joined(*parts, spark.createDataFrame(marks, LINE))


def write_document(lines: DataFrame, path: str) -> DataFrame:
    """The document as text files below ``path``, in order; what was written, with its lines numbered by file and place."""
    dealt = lines.repartitionByRange("document", "section", "key", "line").sortWithinPartitions("document", "section", "key", "line")
    dealt.select("line").write.mode("overwrite").text(path)
    return lines.sparkSession.read.text(path)
