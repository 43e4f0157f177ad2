"""Joins that stay even where one key holds many of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 64  # that a hot key's rows are dealt into
SHARE = 1000  # a key is hot with over a thousandth of all rows, so fewer keys than this are hot


def left_join_hot(left: DataFrame, right: DataFrame, key: str, deal_by: str) -> DataFrame:
    """left with the columns of right, which has a key once at most; left is read twice, for its keys alone the first time.

    Rows of a hot key are dealt into PARTS by a hash of `deal_by` (not by chance: a task that runs again must deal alike), and its row of right is copied into each. A null key matches nothing, and its
    rows are dealt, too. The broadcast list of hot keys has under SHARE rows.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count()
    n = counts.agg(F.sum("count")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("count") > max(SHARE, n / SHARE)).select(key, F.lit(True).alias("_hot")))
    dealt = left.join(hot, key, "left").withColumn("_part", F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(deal_by), F.lit(PARTS)).cast("int")).otherwise(0)).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(hot, key, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return dealt.join(copied, [key, "_part"], "left").drop("_part")
