"""Ingest as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sedra.operators.collection import Collection
from sedra.plans.ingest import IngestConfig, cleaned, store
from sedra.sources.files import extract


def ingest_stream(spark: SparkSession, folder: str, collection: Collection, checkpoint: str, config: IngestConfig | None = None) -> StreamingQuery:
    """Store what is new in a folder, then stop. Run again, it goes on where it was: the checkpoint knows the files.

    A batch that is run twice after a failure stores its files' rows once, since they replace their sources'. A batch
    costs its own size, whatever the collection holds.
    """
    config = config or IngestConfig()
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def each(batch: DataFrame, _: int) -> None:
        store(cleaned(extract(batch)), collection, config)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
