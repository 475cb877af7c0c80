"""Places of rows in an order, counted without a task that holds all of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def numbered(rows: DataFrame, *order: str, name: str = "number", weight: str | None = None) -> DataFrame:
    """``rows`` with their place in ``order`` from 1, or with the sum of ``weight`` up to and with each row.

    Rows are dealt to ranges of the order and kept there; how much comes before a range is summed over one row a range.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    value = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    if weight is None:
        within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    else:
        within = F.sum(weight).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # a range a task
    path = f"{shared_dir(spark)}/rounds/{uuid.uuid4().hex}"
    dealt.withColumn("__within", within).withColumn("__value", value).write.parquet(path)
    held = spark.read.parquet(path)
    sizes = held.groupBy("__part").agg(F.sum("__value").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return held.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__within")).drop("__part", "__within", "__value", "__before")
