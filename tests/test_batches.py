"""Batches that go to Python are bounded in bytes by every step that hands it texts or vectors."""

import re
from contextlib import suppress
from pathlib import Path

import psutil
import pytest
from pyspark.sql import functions as F

from sedra.functions import text as T
from sedra.operators import chunking, similarity, vectors
from sedra.operators.embedding import HashingEmbedder
from sedra.operators.splitters import Size
from sedra.sources import files, shared

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
STEPS = {
    "nfc": lambda df: df.select(T.nfc(F.col("text"))),
    "chunk": lambda df: chunking.chunk(df, "semantic", Size(50, 5)),
    "embed": lambda df: df.select(HashingEmbedder().embed(F.col("text"))),
    "pairs": similarity.pair_similarities,
    "clusters": similarity.clustered,
    "lsh": lambda df: vectors.nearest_lsh(df.select(F.col("doc_id").alias("query_id"), "embedding"), df, 2),
    "extract": lambda df: files.extract(df.select(F.lit("a.txt").alias("path"), F.col("text").cast("binary").alias("content"))),
}


@pytest.mark.parametrize("step", STEPS)
def test_batches_are_bounded(spark, step):
    df = spark.createDataFrame([(1, "é one", [1.0, 2.0])], "doc_id long, text string, embedding array<double>")
    before = spark.conf.get(BOUND)
    try:
        spark.conf.unset(BOUND)
        STEPS[step](df)
        assert spark.conf.get(BOUND) == f"{shared.BATCH_BYTES}b"
        spark.conf.set(BOUND, "1000b")
        STEPS[step](df)
        assert spark.conf.get(BOUND) == "1000b"
    finally:
        spark.conf.set(BOUND, before)


def _no_answer(section):
    raise ValueError(section[:10])


def _workers() -> dict[Path, dict[str, float]]:
    """The MB that each Python process of Spark has in memory, and had at most."""
    found = {}
    for p in psutil.Process().children(recursive=True):
        own = Path(f"/proc/{p.pid}")
        with suppress(OSError, TypeError, psutil.Error):  # it may end meanwhile
            if "python" in p.name():
                status = (own / "status").read_text()
                found[own] = {k: int(re.search(rf"{k}:\s+(\d+)", status)[1]) / 1e3 for k in ("VmRSS", "VmHWM")}
    return found


@pytest.mark.parametrize(("method", "ask"), [("semantic", None), ("llm", _no_answer)])
def test_a_worker_holds_no_more_for_more_rows(spark, method, ask):
    """One task of 60 MB of text: its worker's memory grows by some copies of a batch, not by copies of all rows."""
    before = spark.conf.get(BOUND)

    def chunked(n):
        df = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("one word "), 667).alias("text"))
        return chunking.chunk(df, method, Size(5000, 0), ask=ask).agg(F.count("*"), F.sum(F.length("chunk"))).first()

    try:
        spark.conf.unset(BOUND)
        chunked(10)
        held = _workers()
        for p in held:
            with suppress(OSError):
                (p / "clear_refs").write_text("5")  # what was held at most is counted from here
        rows, chars = chunked(10000)
        assert rows >= 10000 and chars >= 10000 * 6000
        most = max(w["VmRSS"] for w in held.values())
        grown = [w["VmHWM"] - (held[p]["VmRSS"] if p in held else most) for p, w in _workers().items()]
        assert grown and max(grown) < 100
    finally:
        spark.conf.set(BOUND, before)


def test_long_texts_of_short_files_leave_in_parts(spark, monkeypatch):
    """Files whose texts add up to more than a batch come out in several, whole and in order."""
    monkeypatch.setattr(files, "BATCH_BYTES", 10)
    rows = [(f"{i}.txt", b"x" * n) for i, n in enumerate((3, 20, 0, 4, 8, 1))]
    got = files.extract(spark.createDataFrame(rows, "path string, content binary").coalesce(1)).collect()
    assert [(r.path, r.text, r.error) for r in got] == [(p, c.decode(), None) for p, c in rows]
