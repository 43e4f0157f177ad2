"""Tables in the folder that driver and executors share, which cut a plan's lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}  # folders of local sessions, by application
_written: list[tuple[SparkSession, str]] = []  # tables that are not yet dropped
_depth: list[int] = []  # of _written, where each open tables_removed() began


def shared_dir(spark: SparkSession, name: str = "") -> str:
    """The folder that driver and executors share, or `sedra-{name}` in it: spark.checkpoint.dir. Where that is unset, a session of local threads takes a temporary folder of its own; on a cluster it is refused, as machines share no such folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _local.get(spark.sparkContext.applicationId)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _local[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='sedra-')}"
    return f"{folder.rstrip('/')}/sedra-{name}" if name else folder.rstrip("/")


def new_table(spark: SparkSession) -> str:
    """A path in the shared folder for a table of one's own."""
    path = shared_dir(spark, uuid.uuid4().hex)
    if _depth:
        _written.append((spark, path))
    return path


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """cut(), and the path, for drop()."""
    spark = df.sparkSession
    path = new_table(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and an executor's loss costs no rerun of what came before."""
    return cut_at(df)[0]


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession | None = None) -> None:
    """Bounds the batches that go to Python to about BATCH_BYTES, so that long rows don't make large ones: a worker holds some copies of a batch, so its memory grows with neither the rows of a task nor their length.

    Spark takes the bound from the session (the active one, if none is given), when the plan runs; so it is set there, and stays, unless another was set.
    """
    spark, name = spark or SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and spark.conf.get(name) == "67108864b":  # the default; a value that was set stays
        spark.conf.set(name, f"{BATCH_BYTES}b")


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's content."""
    fs, target = file_system(spark, path)
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, content: bytes) -> bool:
    """Put a small file in a place that must be free: False if it is taken. It is there whole or not at all.

    The file is written beside its place and moved there: by a hard link on a local disk, elsewhere by the file system's
    rename without overwriting, which is atomic on HDFS and its like.
    """
    fs, target = file_system(spark, path)
    beside = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp"
    hidden = file_system(spark, beside)[1]
    out = fs.create(hidden, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    jvm = spark._jvm
    try:
        if fs.getScheme() == "file":
            place = lambda p: jvm.java.nio.file.Path.of(p.toUri())
            jvm.java.nio.file.Files.createLink(place(fs.makeQualified(target)), place(fs.makeQualified(hidden)))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(hidden, target, none)
        return True
    except Exception:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(hidden, False)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of cut_at() that no later plan reads."""
    fs, target = file_system(spark, path)
    fs.delete(target, True)


@contextmanager
def tables_removed() -> Iterator[None]:
    """Removes the tables that are written to the shared folder while it is open, when it closes. Write results, which may read them, before that."""
    _depth.append(len(_written))
    try:
        yield
    finally:
        since = _depth.pop()
        for spark, path in _written[since:]:
            drop(spark, path)
        del _written[since:]


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query that runs while it is open has shuffled goes when the query ends, not when the driver happens to collect its garbage. For queries that are written, whose plans no later one shares."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
