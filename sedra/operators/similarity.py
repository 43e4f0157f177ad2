"""Sentences of documents: their features, the similarity of pairs, and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from sedra.functions import text as T
from sedra.operators.splitters import sentence_clusters, similarity_rows
from sedra.sources.shared import bound_batches

ROWS_OUT = 1 << 21  # bytes of similarities in a batch


def sentence_rows(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, i from 0, sentence)."""
    return df.select(key, F.posexplode(T.sentences(F.col(text))).alias("i", "sentence"))


def featured(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, i, words, noun_phrases, entities, length, word_count, original) for every sentence."""
    return sentence_rows(df, text, key).select(key, "i", T.features(F.col("sentence")).alias("f")).select(key, "i", "f.*")


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (key, parts), a row for each sentence: its similarities with those after it, in batches of up to ROWS_OUT bytes."""
    for batch in batches:
        for at, parts in enumerate(batch["parts"]):
            own = parts.as_py() or []
            row = similarity_rows(own)
            step = max(1, ROWS_OUT // (8 * max(1, len(own))))
            for low in range(0, len(own), step):
                places = list(range(low, min(low + step, len(own))))
                keys = pa.repeat(batch[0][at], len(places))
                yield pa.RecordBatch.from_arrays([keys, pa.array(places, pa.int32()), pa.array([row(i)[i + 1 :] for i in places], pa.list_(pa.float64()))], ["key", "i", "sims"])


def pair_similarities(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, i, j, sim) for the sentence pairs i < j of each document; a null or empty text has none.

    A document's sentences stay in one row, so nothing is shuffled, and its pairs leave a sentence at a time: a task holds
    the sentences, their sets, and a few rows of similarities. The pairs are what is asked for; text.pair_similarity() is
    the same for two columns.
    """
    bound_batches(df.sparkSession)
    own = df.select(F.col(key).alias("key"), T.sentences(F.col(text)).alias("parts"))
    rows = own.mapInArrow(_later, StructType([own.schema["key"], StructField("i", IntegerType()), StructField("sims", ArrayType(DoubleType()))]))
    pairs = rows.select("key", "i", F.posexplode("sims").alias("at", "sim"))
    return pairs.select(F.col("key").alias(key), "i", (F.col("i") + F.col("at") + 1).alias("j"), "sim")


def _clusters(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for rows in batches:
        yield rows.map(lambda parts: sentence_clusters(list(parts)))


def clustered(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, cluster_pos, i): which cluster a sentence is in; clusters are in merge order. A null or empty text has none.

    A document is one task's work, in memory linear in its sentences.
    """
    bound_batches(df.sparkSession)
    own = df.select(key, F.pandas_udf(_clusters, "array<array<int>>")(T.sentences(F.col(text))).alias("c"))
    return own.select(key, F.posexplode("c").alias("cluster_pos", "members")).select(key, "cluster_pos", F.explode("members").alias("i"))
