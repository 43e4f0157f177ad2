"""An inverted file of vectors: rows lie by the coarse centroid that is nearest, and carry a code of what is left.

A sample of bounded size trains the centroids and, on the residuals, a product quantiser. Every row is then written to the
folder of its cell, with its code and its vector. A query ranks the cells, reads the codes of its nearest ones, and
nothing else of them; its best candidates by code are fetched with their vectors, from the cells that hold them, and
ranked by exact distance. So of a cell that is probed a column of PARTS bytes a row is read, and of few cells the vectors.

The more cells, the shorter each: 8 sqrt(n) of them up to CELLS_BY_ROWS, so that from a million rows on the work of a row and
the number of folders stay as they are. A cell grows then, in files of FILE_ROWS, and a query reads the same share of the codes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sedra.operators.vectors import BROADCAST_BYTES, BROADCAST_QUERIES, l2sq
from sedra.sources.shared import cut, put_new, read_bytes

SAMPLE_BYTES = 64 << 20  # of the vectors that centroids and codes are trained on; the bound of what the driver holds
MOST_CELLS = 1 << 17
CELLS_BY_ROWS = 1 << 13  # that a number of rows calls for at most; more must be asked for
MOST_FOR_BOOKS = 1 << 15  # vectors of the sample that codes are trained on: 128 for each of 256 entries
FILE_ROWS = 1 << 18  # of a cell's file, about
ROUNDS = 10  # of k-means


@dataclass(frozen=True)
class Config:
    """cells: None for cells_for(rows). probes: the share of the cells that a query reads codes of. per: candidates for each of k neighbours."""

    cells: int | None = None
    parts: int = 16
    entries: int = 256
    probes: float = 0.12
    per: int = 4
    seed: int = 11

    def __post_init__(self) -> None:
        if self.parts < 1 or not 1 <= self.entries <= 256 or not 0 < self.probes <= 1 or self.per < 1 or (self.cells is not None and self.cells < 1):
            raise ValueError(f"{self}: need parts, cells and per of at least 1, 1 to 256 entries, and 0 < probes <= 1")


def cells_for(rows: int) -> int:
    return max(1, min(CELLS_BY_ROWS, round(8 * math.sqrt(rows))))


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of equals."""
    half = (centres * centres).sum(axis=1) / 2
    step = max(1, (1 << 22) // max(1, len(centres)))
    return np.concatenate([np.empty(0, np.int64), *((half - x[i : i + step] @ centres.T).argmin(axis=1) for i in range(0, len(x), step))])


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Up to k centres of the rows of x by Lloyd's rounds, begun at distinct rows; an empty centre stays where it is."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(ROUNDS if len(centres) < len(distinct) else 0):
        own = _closest(x, centres)
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        centres[used] = np.add.reduceat(x[order], first, axis=0) / np.diff(first, append=len(x))[:, None]
    return centres


@dataclass
class Model:
    """What a query and a row need: centroids (cells x dim) and the codebooks of residuals (parts x entries x width)."""

    config: Config
    dim: int
    centroids: np.ndarray
    books: np.ndarray
    cells: list[int] = field(default_factory=list)  # that have rows, once written

    @classmethod
    def train(cls, sample: np.ndarray, cells: int, config: Config) -> Model:
        centroids = kmeans(sample, cells, config.seed)
        some = sample[np.random.default_rng(config.seed).permutation(len(sample))[:MOST_FOR_BOOKS]]
        left = _split(some - centroids[_closest(some, centroids)], config.parts)
        books = [kmeans(left[p], config.entries, config.seed + 1 + p) for p in range(config.parts)]
        most = max(map(len, books))
        return cls(config, sample.shape[1], centroids, np.stack([np.pad(b, ((0, most - len(b)), (0, 0)), mode="edge") for b in books]))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code: uint8 by part) of each row."""
        cell = _closest(x, self.centroids)
        left = _split(x - self.centroids[cell], self.config.parts)
        return cell, np.stack([_closest(left[p], self.books[p]) for p in range(self.config.parts)], axis=1).astype(np.uint8)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """The cells with rows that each query reads, the nearest first."""
        here = np.array(self.cells, np.int64)
        apart = (self.centroids[here] ** 2).sum(axis=1) - 2 * q @ self.centroids[here].T
        return here[np.argsort(apart, axis=1, kind="stable")[:, : max(1, math.ceil(self.config.probes * len(here)))]]

    def estimates(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of the queries from a cell's rows, by code: sums of table entries."""
        left = _split(q - self.centroids[cell], self.config.parts)
        gap = left[:, :, None, :] - self.books[:, None, :, :]
        table = (gap * gap).sum(axis=-1)
        return sum(table[p][:, codes[:, p]] for p in range(self.config.parts))


def _split(x: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, width) of rows, padded with zeros."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width).swapaxes(0, 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def build(rows: DataFrame, path: str, config: Config | None = None, key: str = "id", vector: str = "embedding", more: tuple[str, ...] = ()) -> Model | None:
    """Write the inverted file of rows (key, vector, *more) to a folder; None, and nothing written, if there is no vector.

    Vectors of another length than the longest, and null ones, are left out, as no query can meet them.
    """
    config, spark = config or Config(), rows.sparkSession
    own = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), *more)
    dim, _ = own.agg(F.max(F.size("v")), F.count("v")).first()
    if not dim or dim < 1:
        return None
    own = own.where(F.size("v") == dim)
    n = own.count()
    most = SAMPLE_BYTES // (8 * dim)
    share = F.lit(min(1.0, 0.9 * most / n)) * (1 << 30)
    sample = own.where(F.pmod(F.xxhash64("id", F.lit(config.seed)), F.lit(1 << 30)) < share).select("v").limit(most).collect()
    sample = np.array([r["v"] for r in sample or own.select("v").limit(most).collect()], np.float64)
    model = Model.train(sample, min(MOST_CELLS, config.cells or cells_for(n)), config)
    shipped = spark.sparkContext.broadcast(model)  # MOST_CELLS vectors at most, and entries

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, code = shipped.value.encode(_matrix(b["v"], dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=[*b.schema.names, "cell", "code"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    placed = cut(own.mapInArrow(encoded, f"{kinds}, cell int, code binary"))
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row a cell
    model.cells = sorted(counts)
    files = spark.createDataFrame([(c, -(-k // FILE_ROWS)) for c, k in counts.items() if k > FILE_ROWS], "cell int, files int")
    salted = placed.join(F.broadcast(files), "cell", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("files", F.lit(1)))).drop("files")
    salted.repartition("cell", "salt").sortWithinPartitions("cell", "id").drop("salt").write.partitionBy("cell").parquet(f"{path}/cells")
    told = {"config": asdict(config), "dim": dim, "cells": model.cells, "centroids": model.centroids.tolist(), "books": model.books.tolist()}
    put_new(spark, f"{path}/model.json", json.dumps(told).encode())
    return model


def load(spark: SparkSession, path: str) -> Model:
    told = json.loads(read_bytes(spark, f"{path}/model.json"))
    return Model(Config(**told["config"]), told["dim"], np.array(told["centroids"]), np.array(told["books"]), told["cells"])


def _cells(spark: SparkSession, path: str, cells: list[int]) -> DataFrame:
    """The rows of some cells: their folders alone are listed and read."""
    return spark.read.option("basePath", f"{path}/cells").parquet(*[f"{path}/cells/cell={c}" for c in cells])


def _best(q: np.ndarray, ids: pa.Array, asks: dict[int, np.ndarray], model: Model, n: int, cell: np.ndarray, code: pa.Array, file: pa.Array, row: pa.Array) -> Iterator[pa.RecordBatch]:
    """The n best of each query and cell, of rows that lie by cell; `asks` has the numbers of a cell's queries."""
    codes = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(code), -1)
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    for i, j in zip(starts, [*starts[1:], len(cell)], strict=True):
        own = asks.get(int(cell[i]), np.empty(0, np.int64))
        for k in range(0, len(own), 256):
            apart = model.estimates(q[own[k : k + 256]], int(cell[i]), codes[i:j])
            first = np.argsort(apart, axis=1, kind="stable")[:, :n]
            at = pa.array((i + first).ravel())
            who = pa.array(np.repeat(own[k : k + 256], first.shape[1]))
            yield pa.RecordBatch.from_arrays([ids.take(who), pa.array(cell, pa.int32()).take(at), file.take(at), row.take(at), pa.array(np.take_along_axis(apart, first, axis=1).ravel())], names=["q", "cell", "file", "row", "apart"])


def candidates(queries: DataFrame, path: str, k: int, query: str = "query_id", vector: str = "embedding", model: Model | None = None) -> DataFrame:
    """(q, cell, file, row): the k * per best rows by code for each query, of the cells that it probes.

    Up to BROADCAST_QUERIES queries of BROADCAST_BYTES are sent along to the codes, which are not moved. More are dealt to
    the cells that they probe, in blocks, and meet the codes there.
    """
    spark, model = queries.sparkSession, model or load(queries.sparkSession, path)
    n, dim = k * model.config.per, model.dim
    own = queries.select(F.col(query).alias("q"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dim)
    kind = own.schema["q"].dataType
    schema = f"q {kind.simpleString()}, cell int, file string, row long, apart double"
    most = min(BROADCAST_QUERIES, BROADCAST_BYTES // (8 * dim))
    asked = own.limit(most + 1).collect()
    if not asked:
        return spark.createDataFrame([], schema).drop("apart")
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    if len(asked) <= most:
        q, ids = np.array([r["v"] for r in asked], np.float64), pa.array([r["q"] for r in asked], to_arrow_type(kind))
        probed = model.probed(q)
        flat = probed.ravel()
        order = np.argsort(flat, kind="stable")
        used, first = np.unique(flat[order], return_index=True)
        asks = dict(zip(used.tolist(), np.split(order // probed.shape[1], first[1:]), strict=True))
        shipped = spark.sparkContext.broadcast((q, asks, model))
        codes = _cells(spark, path, used.tolist()).select("cell", "code", *where)

        def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, asks, model = shipped.value
            for b in batches:
                if b.num_rows:
                    yield from _best(q, ids, asks, model, n, np.asarray(b["cell"]), b["code"], b["file"], b["row"])

        found = codes.mapInArrow(few, schema)
    else:
        shipped = spark.sparkContext.broadcast(model)

        def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cells = shipped.value.probed(_matrix(b["v"], dim))
                    at = pa.array(np.repeat(np.arange(len(cells)), cells.shape[1]))
                    yield pa.RecordBatch.from_arrays([b["q"].take(at), b["v"].take(at), pa.array(cells.ravel(), pa.int32())], names=["q", "v", "cell"])

        dealt = cut(own.mapInArrow(probes, f"q {kind.simpleString()}, v array<double>, cell int"))
        blocks = dealt.groupBy("cell").agg(F.ceil(F.count("*") / BROADCAST_QUERIES).cast("int").alias("blocks"))
        left = dealt.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).drop("blocks")
        right = _cells(spark, path, model.cells).select("cell", "code", *where).join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

        def pair(a: pa.Table, b: pa.Table) -> pa.Table:
            none = pa.RecordBatch.from_arrays([pa.array([], t) for t in (to_arrow_type(kind), pa.int32(), pa.string(), pa.int64(), pa.float64())], names=["q", "cell", "file", "row", "apart"])
            if not a.num_rows or not b.num_rows:
                return pa.Table.from_batches([none])
            a, b = a.combine_chunks(), b.combine_chunks()
            one = lambda t, c: t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c]
            cell = np.asarray(one(b, "cell"))
            return pa.Table.from_batches([none, *_best(_matrix(one(a, "v"), dim), one(a, "q"), {int(cell[0]): np.arange(a.num_rows)}, shipped.value, n, cell, one(b, "code"), one(b, "file"), one(b, "row"))])

        found = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(pair, schema)
    place = F.row_number().over(Window.partitionBy("q").orderBy("apart", "file", "row"))
    return found.withColumn("place", place).where(F.col("place") <= n).select("q", "cell", "file", "row")


def search(queries: DataFrame, path: str, k: int = 10, query: str = "query_id", vector: str = "embedding", more: tuple[str, ...] = ()) -> DataFrame:
    """(query, doc_id, distance, *more): the candidates of each query with their squared Euclidean distance, k * per of them; vectors are read of the cells that hold candidates alone."""
    spark = queries.sparkSession
    model = load(spark, path)
    near = cut(candidates(queries, path, k, query, vector, model))
    cells = [r["cell"] for r in near.select("cell").distinct().collect()]  # MOST_CELLS at most
    asked = queries.select(F.col(query).alias("q"), F.col(vector).alias("_q"))
    if not cells:
        rows = spark.createDataFrame([], spark.read.parquet(f"{path}/cells").schema).withColumns({"file": F.lit(""), "row": F.lit(0).cast("long")})
    else:
        rows = _cells(spark, path, cells).select("id", "v", *more, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    met = rows.join(near.drop("cell"), ["file", "row"]).join(asked, "q")
    return met.select(F.col("q").alias(query), F.col("id").alias("doc_id"), l2sq(F.col("_q"), F.col("v")).alias("distance"), *more)
