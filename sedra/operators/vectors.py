"""Distances between vectors, and the nearest of a collection for each query."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField

from sedra.sources.shared import bound_batches

BROADCAST_QUERIES = 4096  # queries that are sent to every executor, if they have
BROADCAST_BYTES = 64 << 20  # bytes of vectors at most; more are dealt in blocks
BLOCK_ROWS = 65536  # collection rows of a block


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def score_of(distance: Column) -> Column:
    """1 / (1 + distance); 0 for none."""
    return F.when(distance.isNull(), 0.0).otherwise(1 / (1 + distance))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"l2": l2sq, "cosine": lambda a, b: F.greatest(F.lit(0.0), 1 - cosine(a, b))}


def nearest(queries: DataFrame, collection: DataFrame, k: int = 10, metric: str = "l2", query: str = "query_id", doc: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(query, doc, distance, retrieval_rank from 1): for each query its k nearest, ties to the smaller doc. Null vectors take no part.

    Up to BROADCAST_QUERIES queries of BROADCAST_BYTES are broadcast and the collection is read once, each batch passing on k
    rows a query at most. More queries are dealt in blocks against blocks of the collection.
    """
    bound_batches(queries.sparkSession)
    own = queries.select(query, _doubles(F.col(vector)).alias("v"))
    first = own.where("v is not null").limit(1).collect()
    most = min(BROADCAST_QUERIES, BROADCAST_BYTES // (8 * max(1, len(first[0]["v"])))) if first else BROADCAST_QUERIES
    asked = own.limit(most + 1).collect()
    if len(asked) > most:
        return ranked(_in_blocks(queries, collection, k, metric, query, doc, vector), k, query, doc)
    return ranked(_against_few(asked, queries.schema[query], collection, k, metric, query, doc, vector), k, query, doc)


def _apart(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of q and c, summed dimension by dimension as METRICS does, so that equal rows stay equal."""
    inner = lambda x, y: functools.reduce(lambda s, i: s + x[:, i, None] * y[None, :, i], range(x.shape[1]), np.zeros((len(x), len(y))))
    if metric == "l2":
        out = np.zeros((len(q), len(c)))
        for i in range(q.shape[1]):
            gap = q[:, i, None] - c[None, :, i]
            out += gap * gap
        return out
    length = lambda x: np.sqrt(functools.reduce(lambda s, i: s + x[:, i] * x[:, i], range(x.shape[1]), np.zeros(len(x))))
    size = length(q)[:, None] * length(c)
    return np.maximum(0.0, 1 - np.divide(inner(q, c), size, out=np.zeros_like(size), where=size > 0))


def _against_few(asked: list, key: StructField, collection: DataFrame, k: int, metric: str, query: str, doc: str, vector: str) -> DataFrame:
    """At most BROADCAST_QUERIES queries, sent along, against each batch of the collection: k rows a query and batch go on."""
    asked = [r for r in asked if r[1] is not None]
    ids = pa.array([r[0] for r in asked], to_arrow_type(key.dataType))
    shipped = collection.sparkSession.sparkContext.broadcast(np.array([r[1] for r in asked], np.float64).reshape(len(asked), -1 if asked else 0))  # BROADCAST_BYTES at most
    right = collection.select(F.col(doc).alias("d"), _doubles(F.col(vector)).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shipped.value
        for b in batches:
            b = b.filter(pc.is_valid(b["v"]))  # here, as a filter in the plan would work out the vectors twice
            if not b.num_rows or not len(q):
                continue
            b = b.take(pc.sort_indices(b["d"]))  # so that a stable sort by distance breaks ties
            c = np.asarray(b["v"].flatten()).reshape(b.num_rows, -1)
            for i in range(0, len(q), 64):
                apart = _apart(q[i : i + 64], c, metric)
                first = np.argsort(apart, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(i, i + len(apart)), first.shape[1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), b["d"].take(pa.array(first.ravel())), pa.array(np.take_along_axis(apart, first, axis=1).ravel())], names=["q", "d", "distance"])

    out = right.mapInArrow(run, f"q {key.dataType.simpleString()}, d {right.schema['d'].dataType.simpleString()}, distance double")
    return out.select(F.col("q").alias(query), F.col("d").alias(doc), "distance")


def ranked(pairs: DataFrame, k: int, query: str, doc: str) -> DataFrame:
    """pairs with retrieval_rank, the k nearest of each query."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy("distance", doc))
    return pairs.withColumn("retrieval_rank", rank).where(F.col("retrieval_rank") <= k)


def _in_blocks(queries: DataFrame, collection: DataFrame, k: int, metric: str, query: str, doc: str, vector: str) -> DataFrame:
    groups, stripes = max(1, -(-queries.count() // BROADCAST_QUERIES)), max(1, -(-collection.count() // BLOCK_ROWS))
    number = lambda df, key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    left = queries.select(F.col(query).alias("q"), _doubles(F.col(vector)).alias("v")).withColumn("g", number(queries, "q", groups)).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    right = collection.select(F.col(doc).alias("d"), _doubles(F.col(vector)).alias("v")).withColumn("s", number(collection, "d", stripes)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    kinds = {"q": left.schema["q"].dataType.simpleString(), "d": right.schema["d"].dataType.simpleString()}

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        rows, near, far = [], [], []
        a, b = (t.filter(pc.is_valid(t["v"])) for t in (a, b))
        if a.num_rows and b.num_rows:
            b = b.take(pc.sort_indices(b["d"].combine_chunks()))  # so that a stable sort by distance breaks ties
            x, y = (np.asarray(t["v"].combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (a, b))
            for i in range(0, len(x), 64):
                apart = _apart(x[i : i + 64], y, metric)
                first = np.argsort(apart, axis=1, kind="stable")[:, :k]
                rows.append(np.repeat(np.arange(i, i + len(apart)), first.shape[1]))
                near.append(first.ravel())
                far.append(np.take_along_axis(apart, first, axis=1).ravel())
        at = [np.concatenate([np.empty(0, t), *p]) for t, p in ((np.int64, rows), (np.int64, near), (np.float64, far))]
        return pa.table([a["q"].take(pa.array(at[0])), b["d"].take(pa.array(at[1])), pa.array(at[2])], names=["q", "d", "distance"])

    out = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(run, f"q {kinds['q']}, d {kinds['d']}, distance double")
    return out.select(F.col("q").alias(query), F.col("d").alias(doc), "distance")


SKETCH_BITS = 512
QUERY_ROWS = 64  # queries whose candidates leave a task at once
PER_NEIGHBOUR = 10  # candidates of a query for each of its k neighbours


def _sketched(df: DataFrame, key: str, vector: str, name: str, planes: np.ndarray) -> DataFrame:
    """(name, code): on which side of each plane a vector lies, packed. Null vectors and those of another size are left out."""
    bound_batches(df.sparkSession)
    dim = planes.shape[0]
    source = df.select(F.col(key).alias(name), _doubles(F.col(vector)).alias("v")).where(F.size("v") == dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side = np.asarray(b["v"].flatten()).reshape(-1, dim) @ planes >= 0
            yield pa.RecordBatch.from_arrays([b[name], pa.array([r.tobytes() for r in np.packbits(side, axis=1)], pa.binary())], names=[name, "code"])

    return source.mapInArrow(run, f"{name} {source.schema[name].dataType.simpleString()}, code binary")


def _codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _closest(q: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, differing bits): the n rows of each query's fewest differing bits, the first of equals."""
    parts = []
    for i in range(len(q)):
        apart = np.bitwise_count(q[i] ^ c).sum(axis=1)
        first = np.argsort(apart, kind="stable")[:n]
        parts.append((np.full(len(first), i), first, apart[first]))
    return tuple(np.concatenate([np.empty(0, np.int64), *(p[x] for p in parts)]).astype(np.int64) for x in range(3))


def nearest_lsh(queries: DataFrame, collection: DataFrame, k: int = 10, query: str = "query_id", doc: str = "doc_id", vector: str = "embedding", bits: int = SKETCH_BITS, per: int = PER_NEIGHBOUR, seed: int = 7) -> DataFrame:
    """nearest() by cosine distance among the k * per rows whose random-hyperplane sketches differ least from the query's: approximate.

    The sketch of a vector is `bits` sides of random planes, an eighth of its 64 floats' bytes. Only ids and sketches are
    compared and moved; vectors are fetched for the candidates alone. Up to BROADCAST_QUERIES queries' sketches are sent
    along to every task; more are dealt in blocks. The size of vectors is the collection's largest; others take no part.
    """
    dim = collection.agg(F.max(F.size(vector))).first()[0] or 1
    planes = np.random.default_rng(seed).standard_normal((max(1, dim), bits))
    n = k * per
    left, right = _sketched(queries, query, vector, "q", planes), _sketched(collection, doc, vector, "d", planes)
    kinds = {name: df.schema[name].dataType.simpleString() for name, df in (("q", left), ("d", right))}
    schema = f"q {kinds['q']}, d {kinds['d']}, apart long"

    def found(ids: pa.Array, q: np.ndarray, docs: pa.Array, c: np.ndarray) -> list:
        at, row, apart = _closest(q, c, n)
        return [ids.take(pa.array(at)), docs.take(pa.array(row)), pa.array(apart)]

    asked = left.limit(BROADCAST_QUERIES + 1).collect()
    if len(asked) <= BROADCAST_QUERIES:
        ids, codes = pa.array([r["q"] for r in asked], to_arrow_type(left.schema["q"].dataType)), [bytes(r["code"]) for r in asked]

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = _codes(pa.array(codes, pa.binary())) if codes else None
            for b in batches:
                if b.num_rows and codes:
                    b = b.take(pc.sort_indices(b["d"]))  # so that a stable sort by bits breaks ties
                    c = _codes(b["code"])
                    for i in range(0, len(q), QUERY_ROWS):
                        yield pa.RecordBatch.from_arrays(found(ids.slice(i, QUERY_ROWS), q[i : i + QUERY_ROWS], b["d"], c), names=["q", "d", "apart"])

        near = right.mapInArrow(each, schema)
    else:
        groups, stripes = -(-queries.count() // BROADCAST_QUERIES), max(1, -(-collection.count() // BLOCK_ROWS))
        number = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        own = left.withColumn("g", number("q", groups)).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
        rows = right.withColumn("s", number("d", stripes)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

        def pair(a: pa.Table, b: pa.Table) -> pa.Table:
            b = b.take(pc.sort_indices(b["d"].combine_chunks()))
            return pa.table(found(a["q"].combine_chunks(), _codes(a["code"]), b["d"].combine_chunks(), _codes(b["code"])), names=["q", "d", "apart"])

        near = own.groupBy("g", "s").cogroup(rows.groupBy("g", "s")).applyInArrow(pair, schema)
    place = F.row_number().over(Window.partitionBy("q").orderBy("apart", "d"))
    kept = near.withColumn("place", place).where(F.col("place") <= n).select(F.col("q").alias(query), F.col("d").alias(doc))
    pairs = kept.join(queries.select(query, F.col(vector).alias("_q")), query).join(collection.select(doc, F.col(vector).alias("_c")), doc)
    return ranked(pairs.select(query, doc, METRICS["cosine"](F.col("_q"), F.col("_c")).alias("distance")), k, query, doc)


def linkage(vectors: DataFrame, cluster: str = "label", vector: str = "embedding") -> DataFrame:
    """(a, b, linkage) for cluster pairs a < b: the average cosine similarity over their pairs of members.

    The average over all pairs of unit vectors is the inner product of the clusters' mean unit vectors, so a cluster of
    any size is one sum, and no pair of members is made. Zero vectors count as similarity 0.
    """
    unit = vectors.select(F.col(cluster).alias("c"), _doubles(F.col(vector)).alias("v")).withColumn("n", norm(F.col("v")))
    parts = unit.select("c", F.posexplode(F.transform("v", lambda x: F.coalesce(F.try_divide(x, F.col("n")), F.lit(0.0)))).alias("i", "x"))
    mean = parts.groupBy("c", "i").agg(F.avg("x").alias("m"))
    a, b = mean.select(F.col("c").alias("a"), "i", F.col("m").alias("x")), mean.select(F.col("c").alias("b"), "i", F.col("m").alias("y"))
    return a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("linkage"))
