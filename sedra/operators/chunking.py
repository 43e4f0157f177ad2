"""Documents to chunks: one row a document in, one row a chunk out, by any of six methods.

Methods with a closed form are Column expressions. The others carry a position or recurse, and run over Arrow batches;
short texts never reach Python, as a text of at most chunk_size characters is one chunk by every such method but one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedra.functions import text as T
from sedra.functions.text import let
from sedra.operators.splitters import METHODS, Size, grouped, split
from sedra.sources.shared import bound_batches


def _not_blank(chunks: Column) -> Column:
    return F.filter(F.transform(chunks, T.strip), lambda c: c != "")


def small_text(text: Column, size: Size) -> Column:
    """The stripped text as its only chunk where it fits; null where it doesn't."""
    return F.when(F.length(text) <= size.chunk, _not_blank(F.array(text)))


def token_chunks(text: Column, size: Size) -> Column:
    """Windows of words, and what is left after the full ones: with an overlap always something, be it the overlap alone."""
    step = size.chunk - size.overlap

    def windows(words: Column) -> Column:
        n = F.size(words)
        full = F.when(n >= size.chunk, F.floor((n - size.chunk) / step) + 1).otherwise(0).cast("int")
        count = let(full, lambda m: m + F.when(m * step < n, 1).otherwise(0))
        numbers = let(count, lambda m: F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>")))
        return F.transform(numbers, lambda k: F.array_join(F.slice(words, k * step + 1, size.chunk), " "))

    return let(T.tokens(text), windows)


def fixed_chunks(text: Column, size: Size) -> Column:
    """Windows of characters at a fixed stride; the last may lie within the one before."""
    step = size.chunk - size.overlap
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return _not_blank(F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size.chunk))))


def last_words(text: Column, n: int) -> Column:
    """The last n words; the text as it is if it has no more."""
    return F.when(text.isNotNull(), let(T.tokens(text), lambda words: F.when(F.size(words) <= n, text).otherwise(F.array_join(F.slice(words, -n, n), " "))))


def overlapped(previous: Column, chunk: Column, size: Size) -> Column:
    """A chunk after the last words of the one before (null for the first), unless it starts with them or would pass 1.2 times chunk_size."""
    if size.overlap == 0:
        return chunk

    def joined(lead: Column) -> Column:
        both = F.concat(lead, F.lit(" "), chunk)
        return F.when(lead.isNotNull() & (lead != "") & ~F.startswith(chunk, T.strip(lead)) & (F.length(both) <= size.chunk * 1.2), both).otherwise(chunk)

    return let(last_words(previous, size.overlap), joined)


def with_overlap(chunks: DataFrame, size: Size, key: str = "doc_id", pos: str = "chunk_pos", chunk: str = "chunk") -> DataFrame:
    """chunks (key, pos, chunk) with each chunk overlapped by the one before in its document."""
    before = F.lag(chunk).over(Window.partitionBy(key).orderBy(pos))
    return chunks.withColumn("_before", before).withColumn(chunk, overlapped(F.col("_before"), F.col(chunk), size)).drop("_before")


def grouped_sentences(parts: Column, size: Size) -> Column:
    """Sentences that go on with each other, joined while they fit."""
    bound_batches()

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield lists.map(lambda own: grouped(list(own), size))

    return run(parts)


def _splitter(method: str, size: Size, ask: Callable[[str], list[int]] | None) -> Callable:
    bound_batches()

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split(t, method, size, ask))

    return run


def chunks_of(text: Column, method: str = "recursive", size: Size | None = None, ask: Callable[[str], list[int]] | None = None) -> Column:
    """The array of a text's chunks; null gives an empty one. `ask` maps a section to suggested split points for method llm."""
    if method not in METHODS:
        raise ValueError(f"unknown splitting method: {method}")
    size, text = size or Size(), F.coalesce(text, F.lit(""))
    if method == "token":
        return token_chunks(text, size)
    if method == "character":
        return _splitter(method, size, ask)(text)
    small = small_text(text, size)
    return F.coalesce(small, _splitter(method, size, ask)(F.when(small.isNull(), text)))


def chunk(df: DataFrame, method: str = "recursive", size: Size | None = None, text: str = "text", key: str = "doc_id", ask: Callable[[str], list[int]] | None = None) -> DataFrame:
    """(key, chunk_pos from 0, chunk) for every chunk of every text."""
    return df.select(key, F.posexplode(chunks_of(F.col(text), method, size, ask)).alias("chunk_pos", "chunk"))


def formatted(chunks: DataFrame, source: Column, key: str = "doc_id", deterministic: bool = True) -> DataFrame:
    """(id, content, metadata) rows for storage. Ids are digests of document, place and content, so ingesting again gives the same; or random ones.

    source_file and file_name are null where the source is null or empty.
    """
    named = F.when(source.isNotNull() & (source != ""), source)
    own = F.sha2(F.concat_ws(":", F.col(key), F.col("chunk_pos"), F.col("chunk")), 256) if deterministic else F.uuid()
    return chunks.select(
        F.col("chunk").alias("content"),
        F.struct(
            named.alias("source_file"),
            F.element_at(F.split(named, "/"), -1).alias("file_name"),
            F.length("chunk").alias("length"),
            T.count_tokens(F.col("chunk")).alias("token"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
        ).alias("metadata"),
        own.alias("id"),
    ).select("id", "content", "metadata")
