"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit b is set if over half of the text's shingle hashes have it set. Two fingerprints link at
RADIUS or fewer differing bits. Each bit position i gets a code c(i) of RADIUS + 1 bits, and each non-zero vector v of as
many bits a table, whose mask holds the positions with <c(i), v> = 1 (mod 2). The codes of RADIUS positions span at most
RADIUS dimensions, so some v is orthogonal to all of them: in its table two linked fingerprints agree on the whole mask
and share a bucket. No linked pair is missed.

Only distinct fingerprints go into the tables. Buckets are counted first; one of more than MOST fingerprints is dealt out
again by a second family of masks over the bits that its own mask leaves free, with the same guarantee. What both masks
leave free is at most FREE bits, so such a bucket holds at most 2^FREE fingerprints whatever the input.
A bucket gives a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sedra.llm import near_copies
from sedra.llm.components import components
from sedra.llm.hashing import chunks, shingle_hashes, within
from sedra.llm.shared import cut, in_batches, join_hot

BITS, RADIUS, WORDS, SEED = 64, 3, 3, 42
MOST = 1024  # fingerprints of a bucket that are compared with each other


def masks(codes: list[int], bits: int = BITS, dims: int = RADIUS + 1) -> list[int]:
    """One mask for each non-zero vector of `dims` bits."""
    return [sum(1 << i for i in range(bits) if (codes[i] & v).bit_count() & 1) for v in range(1, 1 << dims)]


#: Codes of both families: every position has a non-zero code, and positions alike in the first family differ in the second.
FIRST = [1 + i % 15 for i in range(BITS)]
SECOND = [1 + (11 * i + 9 * (i // 15) + 7 * (i * i // 7)) % 15 for i in range(BITS)]  # of such formulas, the one that leaves the fewest bits free: 18
FREE = max(BITS - (a | b).bit_count() for a in masks(FIRST) for b in masks(SECOND))

_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprints_of(texts: list[str | None], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The texts' fingerprints (uint64); zero for null or no words."""
    ones, counts = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    for doc, h in shingle_hashes(texts, words, seed):
        if not len(h):
            continue
        # Each hash becomes eight words with a bit in each byte; up to 255 of them add up without a carry.
        spread = _SPREAD[h.view(np.uint8).reshape(-1, 8)]
        own, first, n = np.unique(doc, return_index=True, return_counts=True)
        blocks = -(-n // 255)
        starts = np.repeat(first, blocks) + 255 * within(blocks)
        sums = np.add.reduceat(spread, starts, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
        ones[own] += np.add.reduceat(sums, np.cumsum(blocks) - blocks, axis=0)
        counts[own] += n
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp) for each row of df: the fingerprint of the whole text as a signed long. Other columns are not read."""
    source = df.select(F.col(key).alias("k"), F.col(text).alias("x"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["x"].to_pylist()
            fp = np.concatenate([np.empty(0, np.uint64), *(fingerprints_of(texts[i:j]) for i, j in chunks(texts))])
            yield pa.RecordBatch.from_arrays([b["k"], pa.array(fp.view(np.int64))], names=["k", "fp"])

    return in_batches(source, run, f"k {kind}, fp long").withColumnRenamed("k", key)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(fp: Column, family: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(family)])


_CLOSE = np.array([0, *(sum(1 << b for b in c) for r in range(1, RADIUS + 1) for c in combinations(range(FREE), r))], np.int64)


def forest(fps: np.ndarray) -> np.ndarray:
    """For distinct fingerprints (uint64): the index of a representative, equal for all that links connect."""
    n = len(fps)
    label = np.arange(n)
    if n <= MOST:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS
        while True:
            new = np.where(near, label[None, :], n).min(axis=1)
            new = new[new]
            if (new == label).all():
                return label
            label = new
    # A large bucket varies in at most FREE bits: look each fingerprint's neighbours up in a table of all patterns.
    vary = np.bitwise_or.reduce(fps ^ fps[0])
    own = [i for i in range(BITS) if int(vary) >> i & 1]
    if len(own) > FREE:
        raise ValueError("a bucket varies in more bits than its masks leave free")
    short = np.zeros(n, np.int64)
    for k, i in enumerate(own):
        short |= ((fps >> np.uint64(i)) & np.uint64(1)).astype(np.int64) << k
    place = np.full(1 << len(own), -1, np.int64)
    place[short] = np.arange(n)
    patterns = _CLOSE[_CLOSE < 1 << len(own)]
    while True:
        new = label.copy()
        for p in patterns:
            other = place[short ^ p]
            new = np.where(other >= 0, np.minimum(new, label[other]), new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucket_edges(buckets: DataFrame) -> DataFrame:
    """(u, v) for buckets (fps: array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["fps"]
            ends = np.asarray(lists.offsets)
            flat = np.asarray(lists.values).view(np.uint64)
            size = np.diff(ends)
            two = ends[:-1][size == 2]
            two = two[np.bitwise_count(flat[two] ^ flat[two + 1]) <= RADIUS]
            us, vs = [flat[two]], [flat[two + 1]]
            for i in np.flatnonzero(size > 2):
                fps = np.sort(flat[ends[i] : ends[i + 1]])
                label = forest(fps)
                child = np.flatnonzero(label != np.arange(len(fps)))
                us.append(fps[child])
                vs.append(fps[label[child]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"])

    return in_batches(buckets.select("fps"), run, "u long, v long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints (fp: distinct longs) that a chain of links connects."""
    tables = fps.select("fp", F.explode(_tables(F.col("fp"), masks(FIRST))).alias("at")).select("fp", "at.t", "at.key")
    sizes = cut(tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    cold = tables.join(sizes.where(F.col("n") <= MOST).select("t", "key"), ["t", "key"]).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    hot = join_hot(tables, sizes.where(F.col("n") > MOST), ["t", "key"]).select("fp", "t", "key", F.explode(_tables(F.col("fp"), masks(SECOND))).alias("at"))
    hot = hot.groupBy("t", "key", F.col("at.t").alias("t2"), F.col("at.key").alias("key2")).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return _bucket_edges(cold.select("fps").unionByName(hot.select("fps")))


def _sketched(df: DataFrame, text: str, key: str) -> DataFrame:
    """(k, fp, keys, bins) for each row of df: its fingerprint, and what near_copies.links() takes."""
    source = df.select(F.col(key).alias("k"), F.col(text).alias("x"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["x"].to_pylist()
            for i, j in chunks(texts):
                yield pa.RecordBatch.from_arrays([b["k"].slice(i, j - i), pa.array(fingerprints_of(texts[i:j]).view(np.int64)), *near_copies.sketch(texts[i:j])], names=["k", "fp", "keys", "bins"])

    return in_batches(source, run, f"k {kind}, fp long, {near_copies.SKETCH}")


def _copy_edges(docs: DataFrame) -> DataFrame:
    """Edges (u, v) between fingerprints for (fp, id, keys, bins), a row a text, where id stands for the bins: of texts with the same bins, and of those that near_copies.links() finds. Every distinct sketch takes part, also where several texts share a fingerprint."""
    sketches = cut(docs.groupBy("id", "keys", "bins").agg(F.min("fp").alias("fp"), F.max("fp").alias("most")))
    least = sketches.select("id", "fp")
    same = docs.select("fp", "id").join(sketches.where("fp <> most").select("id", F.col("fp").alias("v")), "id").select(F.col("fp").alias("u"), "v").where("u <> v").distinct()
    near = cut(near_copies.links(sketches.select("id", "keys", "bins")))
    hubs = near.groupBy("v").agg(F.count("*").alias("n")).join(least.toDF("v", "fv"), "v")
    ends = join_hot(near.join(least.toDF("u", "fu"), "u"), hubs, "v").select(F.col("fu").alias("u"), F.col("fv").alias("v"))
    return same.unionByName(ends)


def _components(df: DataFrame, text: str, key: str, copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """(k, fp) for each row of df, and (fp, least, n, rep) for each fingerprint: its least key, its rows, and a fingerprint that stands for its component. With `copies`, near copies by their shingles are linked too."""
    docs = cut(_sketched(df, text, key) if copies else fingerprints(df, text, key).withColumnRenamed(key, "k"))
    classes = docs.groupBy("fp").agg(F.min("k").alias("least"), F.count("*").alias("n"))
    edges = links(classes.select("fp"))
    if copies:
        edges = edges.unionByName(_copy_edges(docs.where("keys is not null").select("fp", F.xxhash64("bins").alias("id"), "keys", "bins")))
    roots = components(edges).select(F.col("u").alias("fp"), F.col("v").alias("rep"))
    return docs.select("k", "fp"), cut(classes.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("rep", "fp").alias("rep")))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) for each row of df; component_id is the least key that a chain of links reaches.

    A null text has no words, like an empty one: fingerprint zero, which links like any other. Equal texts share a
    fingerprint and so a component. Repeated rows stay repeated. A null key is kept; it names a component only where no
    other key can. An empty table gives none. Columns other than key and text are not read.
    """
    docs, named = _components(df, text, key)
    of_rep = named.groupBy("rep").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    by_fp = cut(join_hot(named, of_rep, "rep").select("fp", "n", "component_id"))
    out = join_hot(docs, by_fp, "fp")
    return out.select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_fingerprint(df: DataFrame, name: str, text: str) -> DataFrame:
    """df and each row's fingerprint as a signed long."""
    at, names = df.columns.index(text), [*df.columns, name]
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # names with dots can't be handed over

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            fp = np.concatenate([np.empty(0, np.uint64), *(fingerprints_of(texts[i:j]) for i, j in chunks(texts))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=[*b.schema.names, "fp"])

    return in_batches(plain, run, StructType([*plain.schema.fields, StructField("fp", LongType())])).toDF(*names)


def representatives(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of df for each group of links: one of the least key, and of its least fingerprint there. A null key stays only where no other key is in the group.

    Texts link as in near_duplicates(), or where they share near_copies.LIKENESS of their five-word shingles: such copies
    often differ in more than RADIUS bits.
    """
    name, own = "_kept", "_fp"
    while name in df.columns:
        name += "_"
    while own in df.columns:
        own += "_"
    docs, named = _components(df, text, key, copies=True)
    least = named.groupBy("rep").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("m"))
    kept = cut(least.select(F.col("m.least").alias(name), F.col("m.fp").alias("fp")))
    # Most keys are kept, so their table grows with the documents: never broadcast, whatever its size. Keys are spread evenly.
    if docs.groupBy("k").count().where("count > 1").isEmpty():
        return df.join(kept.select(name).hint("merge"), F.col(key).eqNullSafe(F.col(name)), "left_semi")
    # A key (or null) of several rows doesn't tell which of them is meant: their fingerprints do.
    kept = kept.withColumnRenamed("fp", f"{name}fp").hint("merge")
    out = _with_fingerprint(df, own, text).join(kept, F.col(key).eqNullSafe(F.col(name)) & (F.col(own) == F.col(f"{name}fp")), "left_semi")
    return out.dropDuplicates([key, own]).drop(own)
