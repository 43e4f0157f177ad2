"""Product-quantised codes of integer vectors, exact although the distances are screened in float32.

A vector is cut into PARTS equal parts; each part position has a codebook of ENTRIES entries, which starts as that part of
the vectors of the least keys and is moved to the means of its parts in ROUNDS rounds. The nearest entry is found so: a
float32 matrix product gives all inner products of a block of parts with the entries, and a bound on its rounding error
makes an interval of each distance. Entries whose interval reaches below the least upper end are worked out again in
int64; the least of those is the nearest, ties going to the lower index. So no distance that could matter is left to
floating point, and nearly all entries are multiplied out by matrix products only.

Parts beyond what int64 can square are worked out in Python integers, so that results are exact at any size. What the
driver holds is the codebooks: ENTRIES vectors. Tasks sum their own parts by entry before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedra.llm.shared import cut, in_batches, join_hot
from sedra.llm.topk_search import scaled

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
ROWS = 1024  # vectors that are screened at once
LEAST, MOST = -(1 << 63), (1 << 63) - 1  # of a long


def _fits(parts: np.ndarray, books: np.ndarray) -> bool:
    """Whether squared distances between rows of whole numbers stay below 2^62."""
    top = max((float(np.abs(x).max()) for x in (parts, books) if x.size), default=0.0)
    return parts.shape[-1] * (2 * top) ** 2 < 2.0**62


def _whole(x: np.ndarray, fits: bool) -> np.ndarray:
    """Whole numbers as int64, or as Python integers."""
    return x.astype(np.int64) if fits else np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def screened(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, row, entry) of every entry that may be nearest, sorted, for parts (positions, rows, width) and books (positions, entries, width) of doubles.

    The squared distance less the part's own square is |c|^2 - 2 x.c. In float32, with unit roundoff u = 2^-24, the inputs
    are off by a factor of 1 + u each and a sum of `width` products by one of (1 + u)^width, in any order, fused or not. So
    the product is off by at most g(width + 2) |x||c|, g(n) = n u / (1 - n u), by the Cauchy-Schwarz inequality; a little more
    pays for the float64 steps, and for entries that were rounded to doubles. Both sides are scaled by a power of two, so
    that none exceeds 2^30 and nothing overflows; an input that underflows then is below 2^-126, a term's error below 2^-94.
    """
    width = parts.shape[-1]
    top = max(1.0, float(np.abs(parts).max(initial=0)), float(np.abs(books).max(initial=0)))
    shrink = 2.0 ** -max(0, int(np.ceil(np.log2(top))) - 30)
    x, c = parts * shrink, books * shrink  # exact
    product = np.matmul(x.astype(np.float32), c.astype(np.float32).swapaxes(1, 2)).astype(np.float64)
    length = lambda v: np.sqrt((v * v).sum(axis=-1))
    square = (c * c).sum(axis=-1)[:, None, :]
    u = 2.0**-24
    off = (width + 2) * u / (1 - (width + 2) * u) * length(x)[:, :, None] * length(c)[:, None, :] * (1 + 1e-6) + width * 2.0**-94
    value = square - 2 * product
    off = 2 * off + (width + 8) * 2.0**-51 * (square + 2 * np.abs(product))
    least_end = (value + off).min(axis=-1, keepdims=True)
    return np.nonzero(value - off <= least_end)


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry's index and squared distance (int64, or Python integers) for each (position, row), for parts of whole doubles and books of integers: screened(), then exact."""
    fits = _fits(parts, books)
    at, row, entry = screened(parts, books.astype(np.float64))
    apart = _whole(parts[at, row], fits) - _whole(books, fits)[at, entry]
    exact = (apart * apart).sum(axis=-1)
    own = at * parts.shape[1] + row  # sorted, and every (position, row) is there
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    best = np.minimum.reduceat(exact, starts)
    hit = np.flatnonzero(exact == np.repeat(best, np.diff(starts, append=len(own))))
    first = hit[np.unique(own[hit], return_index=True)[1]]
    return entry[first].reshape(parts.shape[:2]), best.reshape(parts.shape[:2])


def _parts(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """List rows, padded with zeros, as (position, row, width)."""
    lens = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(lens), width * parts))
    out[np.arange(width * parts) < lens[:, None]] = np.asarray(column.flatten())
    return out.reshape(len(lens), parts, width).swapaxes(0, 1)


def _batched(column: pa.Array, width: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    for i in range(0, len(column), ROWS):
        yield i, _parts(column.slice(i, ROWS), width, parts)


def _books(entries: list[list[list[int]]]) -> np.ndarray:
    """Integers (position, entry, width) as int64, or as Python integers where a long might not do."""
    out = np.array(entries, object)
    return out.astype(np.int64) if not out.size or np.abs(out).max() < 1 << 62 else out


def _moved(source: DataFrame, books: np.ndarray) -> np.ndarray:
    """The books with every used entry at the floor of its parts' mean, componentwise."""
    positions, entries, width = books.shape
    shipped = source.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task's parts add up to: a row for each (position, entry) that it has, sums as decimal text."""
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            for _, parts in _batched(b["v"], width, positions):
                which, _ = nearest(parts, shipped.value)
                flat = _whole(parts, bool(np.abs(parts).max(initial=0) < 2.0**62 / ROWS))
                for p in range(positions):
                    order = np.argsort(which[p], kind="stable")
                    used, starts, counts = np.unique(which[p][order], return_index=True, return_counts=True)
                    added = np.add.reduceat(flat[p][order], starts, axis=0)
                    for j, n, s in zip(used.tolist(), counts.tolist(), added.tolist(), strict=True):
                        old = total.get((p, j))
                        total[p, j] = [n, s] if old is None else [old[0] + n, [x + y for x, y in zip(old[1], s, strict=True)]]
        rows = [(p, j, n, [str(x) for x in s]) for (p, j), (n, s) in total.items()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["p", "j", "n", "s"])

    def merged(group: pa.Table) -> pa.Table:
        n = sum(group["n"].to_pylist())
        total = [sum(map(int, column)) // n for column in zip(*group["s"].to_pylist(), strict=True)]
        return pa.table([group["p"][:1], group["j"][:1], pa.array([[str(x) for x in total]])], names=["p", "j", "mean"])

    means = in_batches(source, sums, "p int, j int, n long, s array<string>").groupBy("p", "j").applyInArrow(merged, "p int, j int, mean array<string>")
    out = books.tolist()
    for r in means.collect():  # ENTRIES vectors at most
        out[r["p"]][r["j"]] = [int(x) for x in r["mean"]]
    return _books(out)


def _digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) for each row of df whose vector holds finite components only.

    Components become floor(scale * x). Vectors shorter than the longest, and one whose length is no multiple of `parts`,
    go on with zeros. The first codebooks are the vectors of the least keys, null keys last and equal keys by their
    vectors; if there are fewer than `entries` rows, so are the entries. Repeated rows stay repeated. label_error is the
    error summed over all rows of a label, nulls together; without a label column, over all rows. Sums beyond a long are
    the greatest long. An empty table gives none. Other columns are not read.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError(f"{entries} entries, {parts} parts: need 1 to 256 entries, for two digits each, and a part")
    spark = df.sparkSession
    of_label = F.lit(None).cast("string") if label is None else F.col(label).cast("string")
    source = df.select(F.col(key).alias("k"), F.coalesce(F.concat(F.lit("="), of_label), F.lit("")).alias("l"), scaled(F.col(vector), float(scale)).alias("v")).where("v is not null")
    kind = source.schema["k"].dataType.simpleString()
    longest = source.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = source.select("k", "v").orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()  # `entries` vectors
    padded = [[int(x) for x in r["v"]] + [0] * (width * parts - len(r["v"])) for r in first]
    books = _books([[v[p * width : (p + 1) * width] for v in padded] for p in range(parts)])
    for _ in range(rounds if first else 0):
        books = _moved(source.select("v"), books)
    digest = _digest(books)
    shipped = spark.sparkContext.broadcast(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, own in _batched(b["v"], width, parts):
                which, apart = nearest(own, shipped.value)
                text = ["".join(f"{j:02x}" for j in row) for row in which.T.tolist()]
                error = [min(MOST, sum(row)) for row in apart.T.tolist()]
                yield pa.RecordBatch.from_arrays([b["k"].slice(i, ROWS), b["l"].slice(i, ROWS), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["k", "l", "code", "error"])

    rows = cut(in_batches(source, codes, f"k {kind}, l string, code string, error long"))
    most = F.lit(MOST).cast("decimal(38,0)")
    labels = cut(rows.groupBy("l").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"), F.count("*").alias("n")))
    return join_hot(rows, labels, "l").select(F.col("k").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def compress_sql(scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the query's rows, over all distances."""
    own = f"""v as materialized (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::hugeint) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
    x as materialized (select r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as x from v, range({parts}) as t(p)),
    c0 as (select p, r - 1 as j, x as c from x where r <= {entries})"""
    square = "list_sum(list_transform(list_zip(x.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(rounds + 1):
        own += f""",
    d{k} as (select x.r, x.p, c.j, {square}::hugeint as d from x join c{k} as c on x.p = c.p),
    a{k} as materialized (select r, p, (arg_min(j, d * 1000 + j))::bigint as j, min(d) as d from d{k} group by r, p)"""
        if k < rounds:
            own += f""",
    m{k} as (select p, j, list(m order by i) as c from (select p, j, i, (s - ((s % n) + n) % n) // n as m from (select a.p, a.j, i, sum(x.x[i])::hugeint as s, count(*)::hugeint as n
        from a{k} as a join x on x.r = a.r and x.p = a.p, unnest(range(1, len(x.x) + 1)) as t(i) group by a.p, a.j, i)) group by p, j),
    c{k + 1} as materialized (select c.p, c.j, coalesce(m.c, c.c) as c from c{k} as c left join m{k} as m on m.p = c.p and m.j = c.j)"""
    return f"""with {own},
    h as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, j)) as codebooks_sha256 from c{rounds}),
    e as (select r, string_agg(printf('%02x', j), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by r)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from e join v using (r), h"""
