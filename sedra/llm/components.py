"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedra.llm.shared import cut_at, drop

MOST_ROUNDS = 64


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u of the edge list (u, v) except the least of its component, which is v.

    Each step sends an edge to the least neighbour of one end, found by a partially aggregated minimum; no neighbour list
    is ever gathered, so a hub costs rows, not memory. A round is written to the shared folder, so lineage stays short.
    Self-loops and repeated edges don't matter; no edges give no rows. Edges must not hold nulls.
    """
    spark = edges.sparkSession
    now, path = cut_at(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            return now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = cut_at(small)
        drop(spark, path)
        now, path, before, state = new, new_path, state, _state(new)
        if state == before:
            return now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
