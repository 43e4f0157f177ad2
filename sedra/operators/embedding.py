"""Texts to vectors. The default embedder hashes words to buckets; a model can take its place.

The words come from JVM functions; Python hashes each distinct word of a batch once, and counts integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sedra.functions import text as T
from sedra.sources.shared import bound_batches


def bucket(word: str, dim: int) -> int:
    """The bucket of a word: the first 32 bits of its MD5 modulo dim."""
    return int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:4], "big") % dim


def _counter(dim: int) -> Callable:
    bound_batches()

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            n = len(lists)
            row = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
            words = lists.flatten().dictionary_encode()
            hashed = np.fromiter((bucket(w, dim) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
            counts = np.bincount(row * dim + hashed[np.asarray(words.indices)], minlength=n * dim).reshape(n, dim).astype(np.float64)
            length = np.sqrt((counts**2).sum(axis=1, keepdims=True))
            counts = np.divide(counts, length, out=counts, where=length > 0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(counts.ravel()))

    return run


@dataclass(frozen=True)
class HashingEmbedder:
    """Word counts by hash bucket, of length 1; a text without words is the zero vector."""

    dim: int = 64

    @property
    def id(self) -> str:
        return f"hashing-{self.dim}"

    def embed(self, text: Column) -> Column:
        return _counter(self.dim)(T.words(F.lower(F.coalesce(text, F.lit("")))))


@dataclass(frozen=True)
class ModelEmbedder:
    """A model loaded once a task: load() gives a function from texts to a matrix."""

    id: str
    dim: int
    load: Callable[[], Callable[[list[str]], np.ndarray]]

    def embed(self, text: Column) -> Column:
        load = self.load
        bound_batches()

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series(list(np.asarray(model(texts.fillna("").tolist()), np.float64)), index=texts.index)

        return run(text)
