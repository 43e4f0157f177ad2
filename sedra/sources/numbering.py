"""Row numbers in an order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedra.sources.shared import cut


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with `name`: 0, 1, ... in the order of the given columns, nulls first. Rows that are equal in all of them are numbered in any order.

    Rows are dealt to ranges of the order and sorted there; the ranges' counts, a row a range, are summed up to offsets.
    """
    own = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())  # the range in the upper bits, the place in it in the lower 33
    own = cut(own).withColumn("_range", F.shiftright("_at", 33))
    counts = own.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return own.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_range", "_before")
