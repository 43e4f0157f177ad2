"""Links between texts that share most of their five-word shingles, found by bands of one-permutation MinHash bins.

Texts that agree in all bins of a band share a bucket. Each member of a bucket is tried against the bucket's least one,
which links almost all of a group of copies. Only members that it does not link are apart, and these are tried against
every member of the bucket, in cells of about CELL rows a side; a bucket whose members are all linked costs a row each.
Likeness is estimated from the packed bins. A cell gives a spanning forest of its links, never its pairs.

So every pair of a bucket that is alike is linked, whatever the bucket's size. Texts that share a template, but not
LIKENESS, share buckets by the thousand, and trying them is quadratic in them: a pair takes some ten nanoseconds, as it is
left once the first half of its bins differs too much, and the cells are spread over all tasks. Where that is too much,
MOST_PAIRS bounds a bucket's pairs at the cost of links: a bucket above it is dealt again, by SUB_BANDS bands of ten further
bins that its own key chooses, up to twice, and a pair of likeness 0.8 meets in a part of its bucket with probability 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedra.llm import minhash
from sedra.llm.hashing import mix
from sedra.llm.shared import cut, in_batches, join_hot

LIKENESS = 0.8
BANDS, ROWS = 20, 5  # a pair of likeness 0.8 agrees in some band with probability 0.9996
CELL = 4096  # rows of a side of a cell, give or take what hashing does
MOST_PAIRS: int | None = None  # that a bucket is tried for before it is dealt again, which loses links; None: all pairs are tried
LEVELS = 3  # times that rows are dealt to buckets
SUB_BANDS, SUB_BYTES = 14, 5  # bands of a bucket's parts, and the bytes of two bins each

_AGREE = np.array([(b >> 4 == 0) + (b & 15 == 0) for b in range(256)], np.uint8)  # of two bins in a byte, those that differ in no bit


def sketch(texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
    """(band keys, packed bins) for each text; null for a text without words."""
    least, some = minhash.bins(texts)
    low = minhash.low_bits(least)
    keys = minhash.band_keys(least, BANDS, ROWS).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()), mask=pa.array(~some))
    return lists, pa.array([((r[0::2] << 4) | r[1::2]).tobytes() if s else None for r, s in zip(low, some, strict=True)], pa.binary())


SKETCH = "keys array<long>, bins binary"


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of packed bins (uint8, BINS / 2 a row) are of LIKENESS by estimate."""
    chance = 2.0**-minhash.LOW
    return (_AGREE[a ^ b].sum(axis=-1, dtype=np.int64) / minhash.BINS - chance) / (1 - chance) >= LIKENESS


def _matrix(bins: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(bins.to_pylist()), np.uint8).reshape(-1, minhash.BINS // 2)


#: Bins that may differ in a pair which alike() accepts.
MOST_APART = max(d for d in range(minhash.BINS + 1) if ((minhash.BINS - d) / minhash.BINS - 2.0**-minhash.LOW) / (1 - 2.0**-minhash.LOW) >= LIKENESS)
_WORDS = minhash.BINS // 64
_TILE = 2048  # rows that are tried at once, so that what they need stays in a core's cache


def _planes(bins: np.ndarray) -> np.ndarray:
    """Rows of packed bins as bits: uint64 of shape LOW x BINS / 64 x rows, the k-th bit of 64 bins a word."""
    own = np.stack([bins >> 4, bins & 15], axis=-1).reshape(len(bins), -1)
    return np.stack([np.ascontiguousarray(np.packbits(own >> k & 1, axis=1).view(np.uint64).T) for k in range(minhash.LOW)])


def _differ(planes: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many bins rows of _planes() differ from one row of them."""
    return np.bitwise_count(np.bitwise_or.reduce(planes ^ one[:, :, None], axis=0)).sum(axis=0, dtype=np.uint16)


def _near(tiles: list[tuple[np.ndarray, np.ndarray]], one: np.ndarray) -> np.ndarray:
    """The rows, given by halves of their words in tiles, that are alike() to one row: those that differ too much in the first half are not looked at further."""
    found, half = [], _WORDS // 2
    for k, (head, tail) in enumerate(tiles):
        apart = _differ(head, one[:, :half])
        left = np.flatnonzero(apart <= MOST_APART)
        if len(left):
            apart = apart[left] + _differ(tail[:, :, left], one[:, half:])
            found.append(k * _TILE + left[apart <= MOST_APART])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def forest(apart: np.ndarray, bins: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows of `bins` that connect what links from the rows `apart` to any row connect. `label` numbers what is connected already, and is brought up to date."""
    out, planes, half = [], _planes(bins), _WORDS // 2
    tiles = [(np.ascontiguousarray(planes[:, :half, i : i + _TILE]), np.ascontiguousarray(planes[:, half:, i : i + _TILE])) for i in range(0, len(bins), _TILE)]
    for r in apart:
        near = _near(tiles, planes[:, :, r])
        if len(near) < 2:  # itself
            continue
        known, first = np.unique(label[near], return_index=True)
        if len(known) > 1:
            out += [(r, x) for x in near[first] if label[x] != label[r]]
            label[np.isin(label, known)] = label[r]
    return out


def links(sketches: DataFrame) -> DataFrame:
    """Edges (u, v) of ids that connect texts which are alike, for sketches (id: distinct longs, keys, bins)."""
    bins = sketches.select("id", "bins")
    told, edges = _starred(sketches.select("id", F.explode("keys").alias("key"), F.lit(True).alias("apart"), F.lit(None).cast("long").alias("hub")), bins)  # keys differ between bands
    for level in range(LEVELS):
        buckets = told.groupBy("key").agg(F.count("*").alias("n"), F.count_if("apart").alias("m"), F.sum(F.xxhash64("id", "apart").cast("decimal(38,0)")).alias("same"))
        # Two members have been tried; of buckets with the same members, one is enough.
        todo = cut(buckets.where("m > 0 and n > 2").groupBy("n", "m", "same").agg(F.min("key").alias("key")).select("key", "n", "m"))
        if MOST_PAIRS is None or level == LEVELS - 1:
            return edges.unionByName(_all_pairs(told, todo, bins))
        large = F.col("m") * F.col("n") > MOST_PAIRS
        edges = edges.unionByName(_all_pairs(told, todo.where(~large), bins))
        again = todo.where(large)
        if again.isEmpty():
            return edges
        told, more = _starred(_dealt_again(join_hot(told, again.select("key", "n"), "key"), bins, level), bins)
        edges = edges.unionByName(more)
    return edges


def _starred(rows: DataFrame, bins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (key, id, apart, hub) of buckets that hold a member apart, for rows of the same columns, and the edges (u, v) from a bucket's members to its least. Those are not apart any more: `hub` is what they hang on."""
    rows = cut(rows)
    shared = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.count_if("apart").alias("m")).where("n > 1 and m > 0").drop("m"))
    members = cut(join_hot(rows, shared, "key").select("key", "id", "least", "apart", "hub"))
    star = cut(members.where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct())
    hubs = star.groupBy("v").agg(F.count("*").alias("n")).join(bins.select(F.col("id").alias("v"), F.col("bins").alias("b")), "v")
    both = join_hot(star.join(bins.select(F.col("id").alias("u"), F.col("bins").alias("a")), "u"), hubs, "v")

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["u", "v"]).filter(pa.array(alike(_matrix(b["a"]), _matrix(b["b"]))))

    near = cut(in_batches(both.select("u", "v", "a", "b"), tried, "u long, v long"))
    told = members.join(near.select(F.col("u").alias("id"), F.col("v").alias("least"), F.lit(True).alias("linked")), ["id", "least"], "left")
    return cut(told.select("key", "id", F.expr("apart and id <> least and linked is null").alias("apart"), F.expr("coalesce(hub, if(id = least or linked, least, null))").alias("hub"))), near


def sub_keys(keys: np.ndarray, bins: np.ndarray, level: int) -> np.ndarray:
    """SUB_BANDS keys (int64) for each row of packed bins: of what it has in SUB_BYTES bytes each, which a bucket's key chooses."""
    out = np.empty((len(keys), SUB_BANDS), np.uint64)
    order = np.argsort(keys, kind="stable")
    own, starts = np.unique(keys[order], return_index=True)
    numbers = np.arange(1, SUB_BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for key, rows in zip(own.tolist(), np.split(order, starts[1:]), strict=True):
            at = np.random.default_rng([key & (1 << 63) - 1, key < 0, level]).permutation(bins.shape[1])[: SUB_BANDS * SUB_BYTES].reshape(SUB_BANDS, SUB_BYTES)
            value = np.zeros((len(rows), SUB_BANDS), np.uint64)
            for k in range(SUB_BYTES):
                value = (value << np.uint64(8)) | bins[rows][:, at[:, k]]
            out[rows] = mix(mix(np.uint64(key & (1 << 64) - 1) + numbers) ^ value * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _dealt_again(members: DataFrame, bins: DataFrame, level: int) -> DataFrame:
    """(key, id, apart, hub) by sub_keys(), for members of large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = sub_keys(np.asarray(b["key"]), _matrix(b["bins"]), level)
                row = pa.array(np.repeat(np.arange(len(keys)), SUB_BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(b[c].take(row) for c in ("id", "apart", "hub"))], names=["key", "id", "apart", "hub"])

    return in_batches(members.select("key", "id", "apart", "hub").join(bins, "id"), run, "key long, id long, apart boolean, hub long")


def _all_pairs(told: DataFrame, todo: DataFrame, bins: DataFrame) -> DataFrame:
    """Edges (u, v) that connect each member apart with all of its bucket that are alike, for members (key, id, apart, hub) and the buckets (key, n, m) to do."""
    parts = lambda of: F.ceil(F.col(of) / CELL).cast("int")
    part = lambda of: F.pmod(F.xxhash64("id", F.lit(of)), F.col(of)).cast("int")
    own = join_hot(told, todo.select("key", "n", parts("m").alias("down"), parts("n").alias("across")), "key")
    # A member apart stands in a row of cells, and every member in a column.
    down = F.when(F.col("apart"), F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda j: F.struct(part("down").alias("i"), j.alias("j"), F.lit(True).alias("asks"))))
    across = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: F.struct(i.alias("i"), part("across").alias("j"), F.lit(False).alias("asks")))
    dealt = own.select("key", "id", "hub", F.explode(F.concat(F.coalesce(down, F.array().cast("array<struct<i:int,j:int,asks:boolean>>")), across)).alias("at"))
    cells = dealt.groupBy("key", "at.i", "at.j", "id", "hub").agg(F.bool_or("at.asks").alias("asks")).join(bins, "id").groupBy("key", "i", "j").agg(F.collect_list(F.struct("id", F.coalesce("hub", "id").alias("hub"), "asks", "bins")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b["rows"]:
                rows = cell.values
                ids, hubs, asks = (np.asarray(rows.field(c).to_numpy(zero_copy_only=False)) for c in ("id", "hub", "asks"))
                label = np.unique(hubs, return_inverse=True)[1]  # what hangs on one hub is connected; in a bucket that was dealt again there are several
                pairs = np.array(forest(np.flatnonzero(asks), _matrix(rows.field("bins")), label), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, k]]) for k in (0, 1)], names=["u", "v"])

    return in_batches(cells.select("rows"), run, "u long, v long")
