"""Splitting by a model whose calls are kept: sections become prompts of a CallTable, and are cut where the replies say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedra.operators.splitters import SECTIONED_FROM, Size, grouped, sections, sentences, split_at, validated
from sedra.plans.calls import CallTable, Model
from sedra.plans.prompt import parsed_points, split_prompt
from sedra.sources.shared import bound_batches, cut


def chunk_by_calls(df: DataFrame, calls: CallTable, load: Callable[[], Model], size: Size | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, chunk_pos from 0, chunk) for every chunk of every text, as the `llm` method gives them for the same model.

    Equal sections are asked once, wherever they stand, and never again once `calls` holds a reply. A section whose calls
    all failed is cut in groups of sentences; it is asked again by the next run. Null and blank texts give no chunk; rows
    with equal or null keys are split each for itself. Texts are shuffled as prompts, as sections that meet their replies, and as chunks,
    to be numbered.
    """
    bound_batches(df.sparkSession)
    size = size or Size()
    own = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(text).alias("x")).where("x != ''").withColumn("whole", F.length("x") <= size.chunk)

    @F.pandas_udf("array<string>")
    def cut_up(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for own in texts:
            yield own.map(lambda t: sections(t, size) if t else None)

    long = F.length("x") > SECTIONED_FROM
    parts = F.coalesce(cut_up(F.when(long, F.col("x"))), F.array("x"))
    # Written, so that row numbers and sections are the same for the prompts and for the cuts.
    found = cut(own.select("row", "k", "whole", F.posexplode(parts).alias("n", "x")))
    prompt = F.concat(F.lit(split_prompt("", size.chunk)), "x")
    asked = found.where(~F.col("whole")).select(F.struct("row", "n").alias("query_id"), prompt.alias("prompt"))
    replies = calls.replies(asked, load).select("query_id.row", "query_id.n", "reply")

    @F.pandas_udf("array<string>")
    def cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(x: str, whole: bool, reply: str | None) -> list[str]:
            if whole:
                return [x.strip()] if x.strip() else []
            return grouped(sentences(x), size) if reply is None else validated(split_at(x, parsed_points(reply)), size)

        for columns in batches:
            yield pd.Series([one(*v) for v in zip(*columns, strict=True)], dtype=object)

    chunks = found.join(replies, ["row", "n"], "left").select("row", "k", "n", F.posexplode(cuts("x", "whole", "reply")).alias("at", "chunk"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("n", "at")) - 1
    return chunks.select(F.col("k").alias(key), place.alias("chunk_pos"), "chunk")
