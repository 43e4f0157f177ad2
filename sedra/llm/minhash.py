"""Document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once. The top bits name one of BINS bins and the rest is the value; a bin keeps its
least value. An empty bin copies a full one by optimal densification: it tries the bins of its own universal hash
sequence, the same for every text, until it meets one that is full. Of each bin, LOW low-order bits are stored, packed
and in hexadecimal. Two bins agree by chance with probability 2^-LOW, which the likeness corrects for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedra.llm.hashing import chunks, mix, shingle_hashes
from sedra.llm.shared import in_batches

WORDS, SEED = 5, 42
BIN_BITS, LOW = 9, 4
BINS = 1 << BIN_BITS
TRIES = 4096  # of an empty bin's sequence; after that, the next full bin in order
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _densify(least: np.ndarray) -> np.ndarray:
    """Fill empty bins of the rows, each of which has a full one, from the full ones."""
    full = least != _NONE
    out = least.copy()
    row, col = np.nonzero(~full)
    own = col.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, TRIES + 1):
        if not len(row):
            return out
        with np.errstate(over="ignore"):
            other = (mix(own + np.uint64(k)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)
        hit = full[row, other]
        out[row[hit], col[hit]] = least[row[hit], other[hit]]
        row, col, own = row[~hit], col[~hit], own[~hit]
    for r, c in zip(row, col, strict=True):
        out[r, c] = least[r, (c + 1 + np.argmax(np.roll(full[r], -c - 1))) % BINS]
    return out


def bins(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(the bins' values after densification, of shape texts x BINS, whether the text has any word)."""
    least = np.full((len(texts), BINS), _NONE, np.uint64)
    for doc, h in shingle_hashes(texts, WORDS, SEED):
        np.minimum.at(least.ravel(), doc * BINS + (h >> np.uint64(64 - BIN_BITS)).astype(np.int64), h & np.uint64((1 << (64 - BIN_BITS)) - 1))
    some = (least != _NONE).any(axis=1)
    least[some] = _densify(least[some])
    return least, some


def low_bits(least: np.ndarray) -> np.ndarray:
    """The LOW bits that are kept of each bin. They are mixed with the bin's number, so that bins which copied one value agree with another text's by chance independently."""
    with np.errstate(over="ignore"):
        low = mix(least + np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (low & np.uint64((1 << LOW) - 1)).astype(np.uint8)


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(LOW-bit values of shape texts x BINS, whether the text has any word)."""
    least, some = bins(texts)
    return low_bits(least), some


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each of `bands` groups of `rows` bins (uint64, texts x bands): texts that agree in a group share its key."""
    out = np.empty((len(least), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(least), b + 1, np.uint64)
            for r in range(rows):
                key = mix((key + least[:, (b * rows + r) * BINS // (bands * rows)]) * np.uint64(0x9E3779B97F4A7C15))
            out[:, b] = key
    return out


def packed(values: np.ndarray, some: np.ndarray) -> list[str]:
    """Hexadecimal, two bins a byte; empty for a text without words."""
    rows = (values[:, 0::2] << 4) | values[:, 1::2]
    return [r.tobytes().hex() if s else "" for r, s in zip(rows, some, strict=True)]


def unpacked(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.stack((raw >> 4, raw & 15), axis=1).ravel()


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity, row by row, in 0 to 1: without words, 1 to another such text and 0 to any else."""
    agree = (a == b).mean(axis=1)
    chance = 2.0**-LOW
    return np.where(some_a & some_b, np.clip((agree - chance) / (1 - chance), 0.0, 1.0), (some_a == some_b).astype(float))


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint) for each row of df. Null or no words: an empty string. Equal texts have equal fingerprints; other columns are not read."""
    source = df.select(F.col(key).alias("k"), F.col(text).alias("x"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["x"].to_pylist()
            out = [f for i, j in chunks(texts) for f in packed(*signatures(texts[i:j]))]
            yield pa.RecordBatch.from_arrays([b["k"], pa.array(out, pa.string())], names=["k", "fingerprint"])

    return in_batches(source, run, f"k {kind}, fingerprint string").withColumnRenamed("k", key)


def edited(text: str, other: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many, or all, of the other text."""
    n = len(text)
    return text[: n - n // 2] + other[: n // 2]


@dataclass
class _Row:
    bucket: int
    guest: bool
    key: int | None
    text: str


def _compared(rows: list[_Row]) -> pa.RecordBatch:
    """For the rows but the last: fingerprints of each and of its edited text, and how like they are, where the next row is of the same bucket."""
    cols: list[list] = [[], [], [], [], [], [], []]
    texts = [r.text for r in rows]
    own = [k for k in range(len(rows) - 1) if not rows[k].guest and rows[k].bucket == rows[k + 1].bucket]
    fp, some = signatures(texts)
    hexed = packed(fp, some)
    nxt = [k + 1 for k in own]
    new = [edited(texts[k], texts[k + 1]) for k in own]
    if own:
        fp2, some2 = signatures(new)
        cols = [
            [rows[k].key for k in own],
            [len(texts[k]) for k in own],
            [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in new],
            [hexed[k] for k in own],
            packed(fp2, some2),
            likeness(fp[own], fp2, some[own], some2),
            likeness(fp[own], fp[nxt], some[own], some[nxt]),
        ]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared_with_edited(df: DataFrame) -> DataFrame:
    """The fingerprints of every text and of its edited text, which ends with the start of the next document by descending doc_id (after the last: the first).

    A null text is empty, a null doc_id sorts as the least, and repeated doc_ids go by text; one row per row of df. A
    table of one row is its own next; an empty table gives none. Other columns are not read.

    Documents are dealt once, by ranges of doc_id; the first row of a range also goes to the range before it. The
    bounds are quantiles of the slim doc_id column, a few for each shuffle partition, and all that the driver holds.
    """
    from pyspark.ml.feature import Bucketizer  # here, as executors import this module too

    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("ord"), F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("x"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("ord").cast("double").alias("at"))
    cuts = sorted(set(ids.approxQuantile("at", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) or [0.0]
    deal = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="b")
    bucketed = deal.transform(docs.withColumn("at", F.col("ord").cast("double"))).select("ord", "key", "x", F.col("b").cast("int").alias("bucket"))
    tops = bucketed.groupBy("bucket").agg(F.max("ord").alias("top")).orderBy(F.desc("bucket")).collect()
    # Range i is followed by range i + 1, the last by the first. One row per range, so the broadcast is bounded by `ranges`.
    heads = spark.createDataFrame([(tops[(i + 1) % len(tops)]["top"], r["bucket"]) for i, r in enumerate(tops)], "ord long, before int")
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    dealt = bucketed.join(F.broadcast(heads), "ord", "left").withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))))))
    dealt = dealt.select("to.bucket", "to.guest", "ord", "key", "x").repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("ord"), "x").select("bucket", "guest", "key", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[_Row] = []
        for b in batches:
            rows = [_Row(*r) for r in zip(b["bucket"].to_pylist(), b["guest"].to_pylist(), b["key"].to_pylist(), b["x"].to_pylist(), strict=True)]
            for i, j in chunks([r.text for r in rows]):
                part = last + rows[i:j]
                yield _compared(part)
                last = part[-1:]

    return in_batches(dealt, run, OUT)
