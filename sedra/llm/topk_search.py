"""Exact top-k inner products over vectors sorted by length.

Candidates are dealt by descending length into blocks, and neighbouring blocks form stripes, so stripes are ranges of
length, the longest first. Each query's k-th score among the longest vectors is a first bound; queries with like bounds
form groups, and a group meets only the stripes whose longest vector can, by Cauchy-Schwarz, reach the least bound of the
group: the first so many stripes, so neither side is sent further. A group stops within a stripe at the first block that
can't reach any of its queries' k-th scores so far. Within a block, vectors and queries are rotated onto the right
singular vectors of a sample: the sum over the first HEAD coordinates plus the product of the lengths of the rest bounds
the score, and only pairs whose bound reaches the k-th score are multiplied out. The rotation's choice affects speed only.

Bounds are floating point with room for rounding; scores are exact integers. Products and sums stay below 2^53 where the
vectors' lengths say so, and are then exact in float64. Beyond that they are sums in int64, which wrap around, so that a
score that fits in a long comes out exact whatever its parts were; pairs that might not fit take Python integers, and a
score beyond the range of a long counts as the nearest long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedra.llm.shared import cut

HEAD = 24  # rotated coordinates that are multiplied out first
BLOCK = 1024  # vectors of a block
STRIPE = 16  # blocks of a stripe
GROUP = 4096  # queries of a group at most
SPAN = 8  # groups at least, while they have 64 queries
SEEDS = 4  # blocks of the longest vectors that give the first bounds
SAMPLE = 4096  # vectors that the rotation is computed from
EXACT = 2.0**52  # bound on scores below which float64 is exact
FITS = 2.0**62  # bound on components and scores below which int64 is exact
LEAST, MOST = -(1 << 63), (1 << 63) - 1  # of a long


def scaled(vector: Column, by: float = 64.0) -> Column:
    """floor(by * x) for each component, as whole doubles; null where the vector is null or holds a null or non-finite component."""
    parts = F.transform(vector, lambda x: F.lit(by) * x.cast("double"))
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(parts, lambda x: F.rint(x) - F.when(F.rint(x) > x, 1.0).otherwise(0.0)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    column = column if isinstance(column, pa.Array) else column.combine_chunks()
    lens = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(lens), dim))
    out[np.arange(dim) < lens[:, None]] = np.asarray(column.flatten())
    return out


def _pack(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows into blocks, numbered within their part of the sorted rows."""

    made = 0

    def block(ids: np.ndarray, rows: np.ndarray, norm: np.ndarray) -> pa.RecordBatch:
        nonlocal made
        made += 1
        kind = np.int16 if np.abs(rows).max(initial=0) < 1 << 15 else np.float64
        return pa.RecordBatch.from_arrays([pa.array([float(norm.max())]), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([made - 1], pa.int64()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([rows.astype(kind).tobytes()], pa.binary()), pa.array([kind is np.int16])], names=["longest", "part", "block", "ids", "rows", "narrow"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, norm = np.empty(0, np.int64), np.empty((0, dim)), np.empty(0)
        for b in batches:
            ids, rows, norm = np.concatenate((ids, np.asarray(b["id"]))), np.concatenate((rows, _matrix(b["v"], dim))), np.concatenate((norm, np.asarray(b["norm"])))
            while len(ids) >= BLOCK:
                yield block(ids[:BLOCK], rows[:BLOCK], norm[:BLOCK])
                ids, rows, norm = ids[BLOCK:], rows[BLOCK:], norm[BLOCK:]
        if len(ids):
            yield block(ids, rows, norm)

    return run


def _bounded(dim: int, seeds: list, rotation: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries (id, v) with the k-th score that the seed blocks give them (LEAST for fewer) and the length that a vector needs to reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b["v"], dim)
            bound = search_group(np.asarray(b["id"]), q, seeds, rotation, k).least
            length = np.sqrt((q**2).sum(axis=1))
            need = np.divide(bound, length, out=np.zeros(len(q)), where=(length > 0) & (bound > 0)) * (1 - 1e-9)
            yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(bound), pa.array(need)], names=["id", "v", "bound", "need"])

    return run


class Best:
    """The k best candidates of each query so far: ties go to the smaller id. `least` is the score that a candidate must reach."""

    def __init__(self, n: int, k: int, bound: np.ndarray | None = None) -> None:
        self.k = k
        self.query, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(n, LEAST, np.int64) if bound is None else bound.astype(np.int64)

    def reach(self) -> np.ndarray:
        """`least` in floating point; no bound yet is minus infinity."""
        return np.where(self.least == LEAST, -np.inf, self.least.astype(np.float64))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        q, s, i = np.concatenate((self.query, query)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((i, ~s, q))  # ~s falls as s grows, and has no overflow
        q, s, i = q[order], s[order], i[order]
        start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        kept = place < self.k
        self.query, self.score, self.id = q[kept], s[kept], i[kept]
        full = place == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])


def _pairwise(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of a[row] and b[col], some tens of thousands of pairs at a time, in the arrays' own arithmetic."""
    parts = [np.einsum("ij,ij->i", a[row[x : x + 65536]], b[col[x : x + 65536]]) for x in range(0, len(row), 65536)]
    return np.concatenate([np.empty(0, a.dtype), *parts])


def exact_scores(q: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The integer inner products of q[row] and c[col] (whole doubles of any size) as longs; beyond a long's range, the nearest long."""
    if not len(row):
        return np.empty(0, np.int64)
    length = lambda x: np.sqrt((x**2).sum(axis=1)).max(initial=0.0)
    if length(q) * length(c) < EXACT:
        return ((q @ c.T)[row, col] if 4 * len(row) > len(q) * len(c) else _pairwise(q, c, row, col)).astype(np.int64)
    # Wrapped sums are right where the score fits, which sums of absolute products in floating point tell well enough.
    narrow_q, narrow_c = (np.abs(q).max(axis=1, initial=0.0) < FITS)[row], (np.abs(c).max(axis=1, initial=0.0) < FITS)[col]
    size = np.abs(_pairwise(q, c, row, col))
    room = np.sqrt((q**2).sum(axis=1))[row] * np.sqrt((c**2).sum(axis=1))[col] * 1e-9
    fits = narrow_q & narrow_c & (size + room < FITS)
    out = np.empty(len(row), np.int64)
    whole = lambda x: np.where(np.abs(x) < FITS, x, 0).astype(np.int64)
    with np.errstate(over="ignore"):
        out[fits] = _pairwise(whole(q), whole(c), row[fits], col[fits])
    for at in np.flatnonzero(~fits):
        out[at] = min(MOST, max(LEAST, sum(int(a) * int(b) for a, b in zip(q[row[at]], c[col[at]], strict=True))))
    return out


def search_group(q_ids: np.ndarray, q: np.ndarray, blocks: list[tuple[float, np.ndarray, np.ndarray]], rotation: np.ndarray, k: int, bound: np.ndarray | None = None) -> Best:
    """The k best of the blocks' vectors for each query but those of its own id, without scores below a query's bound."""
    best = Best(len(q), k, bound)
    with np.errstate(over="ignore", invalid="ignore"):  # a bound that overflows rules nothing out
        turned = q @ rotation
        head, tail = turned[:, :HEAD], np.sqrt((turned[:, HEAD:] ** 2).sum(axis=1))
        length = np.sqrt((q**2).sum(axis=1))
        for longest, ids, rows in sorted(blocks, key=lambda b: -b[0]):
            reach, slack = best.reach(), 1e-9 * length * longest + 1e-6
            live = np.flatnonzero(~(length * longest + slack < reach))
            if not len(live):
                break
            c = rows @ rotation
            c_tail = np.sqrt((c[:, HEAD:] ** 2).sum(axis=1))
            most = head[live] @ c[:, :HEAD].T
            most += tail[live, None] * c_tail
            row, col = np.nonzero(~(most < (reach[live] - slack[live])[:, None]))
            score = exact_scores(q[live], rows, row, col)
            fits = (score >= best.least[live[row]]) & (ids[col] != q_ids[live[row]])
            best.add(live[row[fits]], score[fits], ids[col[fits]])
    return best


OUT = "query_id long, vec_id long, score long"


def top_k(df: DataFrame, is_query: Callable[[Column], Column], k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of scaled() vectors over all rows of other ids, all if there are fewer.

    Vectors that are null or hold a null or non-finite component, and rows with a null key, take no part. Shorter vectors
    count as padded with zeros. Every row is a candidate: a row that is there twice can take two ranks. A query is a
    distinct pair of key and vector; several vectors of one key share its k ranks, and rows of a query's own key are never
    its candidates. Ties go to the smaller key. An empty table gives none; other columns are not read.
    """
    spark = df.sparkSession
    vectors = df.select(F.col(key).cast("long").alias("id"), scaled(F.col(vector)).alias("v")).where("id is not null and v is not null")
    vectors = vectors.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    found = vectors.agg(F.max(F.size("v")).alias("dim"), F.count_if(is_query(F.col("id"))).alias("queries")).first()
    dim, groups = found["dim"] or 0, max(1, -(-found["queries"] // GROUP), min(SPAN, found["queries"] // 64))
    if dim == 0 or not found["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = [r["v"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
    drawn = np.zeros((len(sample), dim))
    for r, v in zip(drawn, sample, strict=True):
        r[: len(v)] = v
    rotation = np.linalg.svd(drawn / max(1.0, np.abs(drawn).max()), full_matrices=True)[2].T

    dealt = vectors.repartitionByRange(F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    blocks = cut(dealt.select("id", "v", "norm").mapInArrow(_pack(dim), "longest double, part int, block long, ids binary, rows binary, narrow boolean"))
    unpack = lambda r: (r["longest"], np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["rows"], np.int16 if r["narrow"] else np.float64).reshape(-1, dim).astype(np.float64))
    seeds = [unpack(r) for r in blocks.orderBy(F.desc("longest"), "part", "block").limit(SEEDS).collect()]
    queries = cut(vectors.where(is_query(F.col("id"))).select("id", "v").distinct().mapInArrow(_bounded(dim, seeds, rotation, k), "id long, v array<double>, bound long, need double"))
    # Groups of queries of like needs: up to SPAN levels, each dealt to several groups by hash.
    edges = sorted(set(queries.approxQuantile("need", [i / SPAN for i in range(1, SPAN)], 0.01)))
    level = sum((F.when(F.col("need") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    within = max(1, -(-groups // (len(edges) + 1)))
    queries = queries.withColumn("level", level)
    needs = {r["level"]: r["need"] for r in queries.groupBy("level").agg(F.min("need").alias("need")).collect()}
    # A block's stripe is its place in the order of length by rows before it; a level reaches the first so many. One row a part comes here, and there are no more parts than shuffle partitions.
    reached = [F.count_if(F.col("longest") >= need).alias(f"level{n}") for n, need in needs.items()]
    parts = sorted(blocks.groupBy("part").agg(F.sum(F.octet_length("ids") / 8).cast("long").alias("rows"), *reached).collect(), key=lambda r: r["part"])
    starts = np.concatenate(([0], np.cumsum([r["rows"] for r in parts])))[:-1].tolist()
    reach = {n: max(((at + (r[f"level{n}"] - 1) * BLOCK) // (BLOCK * STRIPE) for at, r in zip(starts, parts, strict=True) if r[f"level{n}"]), default=0) + 1 for n in needs}
    numbers = F.broadcast(spark.createDataFrame([(r["part"], at) for r, at in zip(parts, starts, strict=True)], "part int, before long"))
    stripe = F.floor((F.col("before") + F.col("block") * BLOCK) / (BLOCK * STRIPE)).cast("long").alias("stripe")
    blocks = blocks.join(numbers, "part").select("longest", "ids", "rows", "narrow", stripe, F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(r).alias("reach")) for n, r in reach.items()])).alias("to")).where("stripe < to.reach")
    blocks = blocks.withColumn("group", F.explode(F.sequence(F.col("to.level") * within, F.col("to.level") * within + F.lit(within - 1)))).drop("to")
    own = F.element_at(F.create_map(*[F.lit(x) for n, r in reach.items() for x in (n, r)]), F.col("level"))
    queries = queries.withColumn("group", F.col("level") * within + F.pmod(F.xxhash64("id"), F.lit(within)).cast("int"))
    queries = queries.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), own.cast("long") - 1))).drop("level")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            ids = np.asarray(left["id"].combine_chunks())
            parts = [unpack(r) for r in right.select(["longest", "ids", "rows", "narrow"]).to_pylist()]
            best = search_group(ids, _matrix(left["v"], dim), parts, rotation, k, np.asarray(left["bound"].combine_chunks()))
            out = [ids[best.query], best.id, best.score]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    near = queries.groupBy("group", "stripe").cogroup(blocks.groupBy("group", "stripe")).applyInArrow(run, OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_sql(every: int = 20, k: int = 20) -> str:
    """The same for DuckDB, pair by pair."""
    return f"""
    with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
      where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
      from (select distinct vec_id, e from v where vec_id % {every} = 0) q join v c on q.vec_id <> c.vec_id),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
    select query_id, rank, vec_id, score from r where rank <= {k}"""
