"""Numbers from 1 in a total order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from twinsift.scratch import written


def number_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in the order: ranges of it are numbered apart, after the counts of the ranges before.

    The ranges are written once, so the input is worked out once, and counts and numbers see the same cut.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))  # one row a range
    numbered = ranged.withColumn("__in", F.row_number().over(W.partitionBy("__range").orderBy(*order)))
    return numbered.join(F.broadcast(before), "__range").withColumn(name, (F.col("__in") + F.col("__before")).cast("long")).drop("__range", "__in", "__before")  # a range is a task, so these are few
