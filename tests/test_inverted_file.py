"""The inverted file: recall and bytes read at two sizes, later writes, many queries, odd vectors."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sedra.operators import inverted_file, vectors
from sedra.operators.collection import SCHEMA, Collection
from sedra.operators.embedding import HashingEmbedder
from sedra.queries import TOKEN_INGEST, _as_files
from sedra.plans.ingest import collection_rows



def _bytes(files: set[str], columns: tuple[str, ...]) -> int:
    """What the named columns take in Parquet files, compressed."""
    total = 0
    for f in files:
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        total += sum(g.column(c).total_compressed_size for g in (meta.row_group(i) for i in range(meta.num_row_groups)) for c in range(g.num_columns) if g.column(c).path_in_schema.split(".")[0] in columns)
    return total


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_bytes(spark, tmp_path, sf):
    """Some 10,000 and 100,000 stored chunks: for each of twenty benchmark texts, recall against exact search, and bytes read, one query at a time, of those that exact search reads."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").repartition(4)
    own = Collection(spark, f"file://{tmp_path}/store")
    own.append(collection_rows(_as_files(docs), TOKEN_INGEST))
    asked = spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), HashingEmbedder().embed(F.col("text")).alias("embedding")).orderBy("query_id").limit(20).cache()
    exact = {(r.query_id, r.doc_id) for r in own.nearest(asked).collect()}
    assert own.index()
    found = {(r.query_id, r.doc_id) for r in own.nearest(asked).collect()}
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)
    path = next((tmp_path / "store" / "documents").glob("step-*/model.json")).parent
    model, files = inverted_file.load(spark, f"file://{path}"), lambda cells: {str(f) for c in cells for f in (path / "cells" / f"cell={c}").glob("*.parquet")}
    whole = _bytes(files(model.cells), ("id", "v"))  # which exact search reads
    read = []
    for q in asked.collect():
        one = spark.createDataFrame([(q.query_id, q.embedding)], "query_id long, embedding array<double>")
        near = inverted_file.candidates(one, f"file://{path}", 10).collect()
        read.append((_bytes(files(model.probed(np.array([q.embedding]))[0]), ("code",)) / whole, _bytes(files({r.cell for r in near}), ("id", "v", "source_file")) / whole))
    assert np.mean(read, axis=0).sum() < 0.1


ROWS = [(f"r{i}", [float(np.cos(i * k)) for k in range(1, 7)], (f"s{i % 7}", "", 0, 0, ""), "") for i in range(300)]


def test_later_writes_are_seen(spark, tmp_path):
    own = Collection(spark, f"file://{tmp_path}/store")
    own.append(spark.createDataFrame([*ROWS, ("null", None, None, "")], SCHEMA))
    assert own.index(inverted_file.Config(probes=1.0, per=40, parts=4))
    own.replace_sources(spark.createDataFrame([("new", ROWS[0][1], ("s0", "", 0, 0, ""), "")], SCHEMA), spark.createDataFrame([("s0",)], "source_file string"))
    own.append(spark.createDataFrame([("again", ROWS[8][1], ("s1", "", 0, 0, ""), "")], SCHEMA))
    asked = spark.createDataFrame([(i, ROWS[i][1]) for i in (0, 8, 100)] + [(7, None), (9, [1.0])], "query_id long, embedding array<double>")
    rows = lambda df: sorted((r.query_id, r.doc_id, round(r.distance, 9), r.retrieval_rank) for r in df.collect())
    live = own.rows().where(F.size("embedding") == 6).select(F.col("id").alias("doc_id"), "embedding")
    want = rows(vectors.nearest(asked.where("query_id not in (7, 9)"), live, 5))
    assert rows(own.nearest(asked, 5)) == want and (0, "new", 0.0, 1) in want and (8, "again", 0.0, 1) in want
    asked = asked.where("query_id not in (7, 9)")
    own.compact()
    assert rows(own.nearest(asked, 5)) == want
    assert own.index() and len(rows(own.nearest(asked, 5))) == 15
    assert own.nearest(asked.where("false")).count() == 0


def test_many_queries_equal_few(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/x"
    df = spark.createDataFrame(ROWS, SCHEMA)
    odd = spark.createDataFrame([("null", None, None, ""), ("short", [1.0], None, "")], SCHEMA)
    monkeypatch.setattr(inverted_file, "FILE_ROWS", 5)
    inverted_file.build(df.unionByName(odd), path, inverted_file.Config(cells=9, parts=5))
    asked = df.select(F.col("id").alias("query_id"), "embedding")
    rows = lambda: sorted((r.query_id, r.doc_id, round(r.distance, 9)) for r in inverted_file.search(asked, path, 4).collect())
    few = rows()
    assert len(few) == 300 * 16 and len([1 for q, d, x in few if q == d and x == 0]) >= 295
    monkeypatch.setattr(inverted_file, "BROADCAST_QUERIES", 50)
    assert rows() == few


def test_no_vectors(spark, tmp_path):
    own = Collection(spark, f"file://{tmp_path}/store")
    assert not own.index()
    with pytest.raises(ValueError):
        inverted_file.Config(probes=0)
    assert Path(tmp_path).exists()


def test_cells_are_bounded():
    """A row is compared with every centroid, and a cell is a folder: both stay as they are in large collections."""
    assert [inverted_file.cells_for(n) for n in (0, 1, 10_000, 100_000, 24_000_000, 10**9)] == [1, 8, 800, 2530, 8192, 8192]
