"""Running totals over a whole table without one ordered task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearloom.functions.tables import kept


def running_total(df: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """df with name: the sum of ``amount`` over all rows up to and with this one, in that order.

    Rows are dealt out by ranges of the order; each range is summed on its own, and the sums of
    the ranges before it (one row a range) are added. The order has to be without ties.
    """
    ranged = kept(df.withColumn("_amount", amount).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    ranges = ranged.groupBy("_range").agg(F.sum("_amount").alias("_all"))
    before = F.coalesce(F.sum("_all").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = F.broadcast(ranges.select(F.col("_range").alias("_of"), before.alias("_before")))  # a row per shuffle partition
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.join(ranges, F.col("_range") == F.col("_of"))
    return summed.withColumn(name, F.col("_before") + F.sum("_amount").over(own)).drop("_amount", "_range", "_of", "_before")
