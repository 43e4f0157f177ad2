"""What the operators share: tables in the shared folder, bounded batches, and ASCII-only lower case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedra.sources.shared import BATCH_BYTES, bound_batches, cut, cut_at, drop, exists, new_table, shared_dir, tables_removed  # noqa: F401
from sedra.sources.tables import table  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def in_batches(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of about BATCH_BYTES at most."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


HOT, SALTS = 1000, 64  # a key of over a HOT-th of all rows is joined in SALTS parts


def join_hot(rows: DataFrame, named: DataFrame, key: str | list[str], total: int | None = None) -> DataFrame:
    """rows.join(named, key) for `named` of a row a key, with n, the key's rows. n is left out.

    Keys of over a HOT-th of all rows (`total`, or what the n add up to) are joined in SALTS parts; fewer than HOT can
    be, so their list is small and is broadcast.
    """
    keys = [key] if isinstance(key, str) else key
    total = named.agg(F.sum("n")).first()[0] or 0 if total is None else total
    hot = F.broadcast(named.where(F.col("n") > total // HOT).select(*keys, F.lit(SALTS).alias("salts")))
    dealt = rows.join(hot, keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    parts = named.drop("n").join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.join(parts, [*keys, "salt"]).drop("salt")
