"""Ingest: files to text, cleaned, split, embedded, formatted and stored. Files are read once, and no text is shuffled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedra.functions import text as T
from sedra.operators.chunking import chunk, formatted
from sedra.operators.collection import Collection
from sedra.operators.embedding import HashingEmbedder, ModelEmbedder
from sedra.operators.splitters import METHODS, Size
from sedra.sources.files import checked_name, extract, scan
from sedra.sources.shared import cut_at, drop


@dataclass(frozen=True)
class IngestConfig:
    """Sizes are checked when made; the method must be known."""

    chunk_size: int = 200
    chunk_overlap: int = 30
    method: str = "recursive"
    embedder: HashingEmbedder | ModelEmbedder = field(default_factory=HashingEmbedder)

    def __post_init__(self) -> None:
        Size(self.chunk_size, self.chunk_overlap)
        if self.method not in METHODS:
            raise ValueError(f"unknown splitting method: {self.method}")

    @property
    def size(self) -> Size:
        return Size(self.chunk_size, self.chunk_overlap)


def cleaned(extracted: DataFrame) -> DataFrame:
    """extracted (path, text, ...) with its text cleaned; null stays null."""
    return extracted.withColumn("text", F.when(F.col("text").isNotNull(), T.clean(F.col("text"))))


def collection_rows(documents: DataFrame, config: IngestConfig, source: str = "path", text: str = "text") -> DataFrame:
    """(id, embedding, metadata, document) rows for a collection, from documents (source, text)."""
    chunks = chunk(documents.select(F.col(source).alias("doc_id"), F.col(text).alias("text")), config.method, config.size)
    rows = formatted(chunks, F.col("doc_id"))
    return rows.select("id", config.embedder.embed(F.col("content")).alias("embedding"), "metadata", F.col("content").alias("document"))


def store(found: DataFrame, collection: Collection, config: IngestConfig, replace: bool = True) -> DataFrame:
    """Store cleaned files (path, text, error) in a collection; (path, n_chunks, error) for each. The files are read, once, before that: their texts are written to the shared folder."""
    found, path = cut_at(found)
    rows = collection_rows(found.where("text is not null"), config)
    stored = collection.replace_sources(rows, found.select(F.col("path").alias("source_file"))) if replace else collection.append(rows)
    counts = stored.groupBy(F.col("metadata.source_file").alias("path")).agg(F.count("*").alias("n_chunks"))
    report, _ = cut_at(found.select("path", "error").join(counts, "path", "left").select("path", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "error"))
    drop(found.sparkSession, path)
    return report


def ingest(spark: SparkSession, folder: str, collection: Collection, config: IngestConfig | None = None, name: str | None = None, replace: bool = True, pages_of: Callable[[bytes], list[str]] | None = None, ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """Store the files of a folder, or the named one; returns (path, n_chunks, error) for each.

    A file that can't be read gives an error row and stores nothing. With `replace`, what earlier ingests of the same
    files stored goes, also where a file is empty or unreadable now; without it, it stays beside the new rows.
    `pages_of` and `ocr` are extract()'s.
    """
    config = config or IngestConfig()
    if collection.embedder != config.embedder.id:
        raise ValueError(f"the collection was made with embedder {collection.embedder}, not {config.embedder.id}")
    files = scan(spark, folder)
    if name is not None:
        files = files.where(F.element_at(F.split("path", "/"), -1) == checked_name(name))
        if files.select("path").isEmpty():
            raise FileNotFoundError(f"{folder}/{name}")
    return store(cleaned(extract(files, pages_of, ocr)), collection, config, replace)
