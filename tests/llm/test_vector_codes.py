"""Vector codes: against plain integers, ties, odd vectors, and the screen's guarantee."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedra.llm import vector_codes

MOST = (1 << 63) - 1


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """The query's rows for (key, vector, label), in Python integers."""
    own = [(k, [math.floor(scale * x) for x in v], lab) for k, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in own), default=0) // parts))
    own = [(k, v + [0] * (width * parts - len(v)), lab) for k, v, lab in own]
    first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(cut(v, p), c, strict=True)), j) for j, c in enumerate(books[p])) for p in range(parts)] for _, v, _ in own]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), a in zip(own, at, strict=True) if a[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    at = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [min(MOST, sum(d for d, _ in a)) for a in at]
    of_label = {}
    for (_, _, lab), e in zip(own, errors, strict=True):
        of_label[lab] = of_label.get(lab, 0) + e
    return sorted(((k, "".join(f"{j:02x}" for _, j in a), e, min(MOST, of_label[lab]), digest) for (k, _, lab), a, e in zip(own, at, errors, strict=True)), key=repr)


def rows_of(df, **more):
    return sorted(map(tuple, vector_codes.compress(df, **more).collect()), key=repr)


@pytest.mark.parametrize("size", [0.02, 1.0, 2.0**18, 2.0**30, 2.0**45, 2.0**100])
def test_equals_plain_integers(spark, size):
    rng = random.Random(3)
    near = [[rng.choice((-1.0, 0.5, 0.503, 1.0)) for _ in range(6)] for _ in range(8)]
    rows = [(i, [float(np.float32(size * x)) for x in rng.choice(near)] if i % 3 else [float(np.float32(size * rng.uniform(-1, 1))) for _ in range(6)], rng.choice((None, 1, 2))) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    assert rows_of(df, parts=3, entries=9) == brute(rows, 3, 9)
    assert rows_of(df, parts=4, entries=256, rounds=1) == brute(rows, 4, 256, 1)  # padded, and fewer rows than entries


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(4, [1.0, 2.0, 3.0], 1), (4, [1.0, 2.0, 3.0], 1), (2, [0.1], None), (None, [5.0, 5.0], 7), (None, [4.0], None), (1, None, 1), (0, [1.0, nan], 1), (3, [None, 1.0], 1), (5, [-inf], 1), (6, [], 1), (7, [-0.001, 9.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("k", "l", "v", "n", "code", "salt", "a.b"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("own"))
    assert rows_of(df) == brute(rows)
    assert rows_of(df, entries=2, parts=2) == brute(rows, 2, 2)
    assert rows_of(df.where("false")) == [] and rows_of(df.where("vec_id = 6")) == brute([(6, [], 1)])
    one = vector_codes.compress(df, label=None).collect()
    assert {r.label_error for r in one} == {sum(r.error for r in one)}
    with pytest.raises(ValueError):
        vector_codes.compress(df, entries=257)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 40), 1 << 40), min_size=3, max_size=3), min_size=1, max_size=20), st.integers(0, 60), st.integers(0, 3))
def test_screen_keeps_every_nearest_entry(books, shift, near):
    """Rows close to the entries, so that many distances are almost or just equal."""
    books = [[x << shift for x in b] for b in books]
    rows = [[float(x + d) for x in b] for b in books for d in (0, near, -near)]
    parts, exact = np.array([rows]), vector_codes._books([books])
    index, apart = vector_codes.nearest(parts, exact)
    for r, i, d in zip(rows, index[0].tolist(), apart[0].tolist(), strict=True):
        assert (d, i) == min((sum((int(x) - y) ** 2 for x, y in zip(r, b, strict=True)), j) for j, b in enumerate(books))


def test_screen_settles_most_rows():
    """On random vectors float32 leaves one entry for nearly every part, so that int64 has little to do."""
    rng = np.random.default_rng(0)
    parts, books = (np.floor(256 * rng.standard_normal((16, n, 4))) for n in (1000, 64))
    assert len(vector_codes.screened(parts, books)[0]) < 1.01 * 16_000
