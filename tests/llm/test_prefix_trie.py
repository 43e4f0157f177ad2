"""The prefix trie: against plain dictionaries, odd rows, deep and wide tries, and its rounds."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sedra.llm import prefix_trie


def sha(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def brute(rows):
    """The query's rows for (conv_id, turn, role, text) without ties of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = abs(c) % 20 * (1 if c >= 0 else -1)
        built[c] = own.get(c - rest, [])[:h] + t[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[n] for n in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[n] for n in children[node])
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], sha(ends[n])) for n, m in members.items()), key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    out = prefix_trie.trie(df)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for name in ("node", "parent", "pos", "words", "n", "h", "base", "head", "up", "next", "a.b"):
        df = df.withColumn(name, F.lit("own"))
    return df


def test_equals_plain_dictionaries(spark):
    """Few texts, so that many prefixes are shared; some conversations are long, and ids go below zero."""
    rng = random.Random(2)
    rows = []
    for c in [*range(-45, 120), 10**15, 10**15 + 7]:
        kept = sorted(rng.sample(range(60), rng.choice((1, 1, 2, 3, 5, 9, 40))))
        rows += [(c, t if k or rng.random() < 0.8 else None, rng.choice(("user", "a", None, "")), rng.choice(("hi", "hi  there\n", "", None, "x" * 50, "é ß \tz"))) for k, t in enumerate(kept)]
    assert rows_of(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "none"), (3, 1, "user", "a"), (3, 1, "user", "a"), (3, 1, "user", "a"), (3, 1, "user", "a"), (3, 1, "user", "a"), (7, None, None, None), (20, 5, "u", "long " * 200_000)]
    assert rows_of(frame(spark, rows)) == brute(rows)
    assert rows_of(frame(spark, rows).where("false")) == [] and rows_of(frame(spark, rows[:1])) == []


def test_turnless_conversations_are_at_the_root(spark):
    """Ids whose own turns are all replaced, by a conversation that isn't there."""
    bare = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0][:3]
    rows = [(c, 0, "user", "a") for c in bare]
    assert rows_of(frame(spark, rows)) == [(bare[0], 0, None, 3, 0, 1, 0, sha(bare))] == brute(rows)


@pytest.mark.parametrize("depth", [1, 2, 3, 64, 65, 300])
def test_rounds_follow_the_depths_digits(spark, monkeypatch, depth):
    """A chain with a fork at its end takes logarithmically many rounds."""
    nodes = [(bytes([0]), None, 0, 0)] + [(b"n%d" % k, b"n%d" % (k - 1) if k > 1 else bytes([0]), 0, 1) for k in range(1, depth + 1)] + [(b"l%d" % k, b"n%d" % depth, 1, 10) for k in range(5)]
    calls = []
    whole = prefix_trie.join_hot
    monkeypatch.setattr(prefix_trie, "join_hot", lambda *a: calls.append(1) or whole(*a))
    df = spark.createDataFrame(nodes, "node binary, parent binary, n_leaves long, saved_tokens long")
    got = {bytes(r.node): (r.n_leaves, r.saved_tokens) for r in prefix_trie.subtree_sums(df, ["n_leaves", "saved_tokens"]).collect()}
    assert len(got) == depth + 6
    assert got[bytes([0])] == (5, depth + 50) and got[b"n%d" % depth] == (5, 51) and got[b"l0"] == (1, 10) and got[b"n1"] == (5, depth + 50)
    assert len(calls) == (depth + 1).bit_length()


def test_ends_of_a_node_that_many_share(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ends = spark.range(-300, 700).select(F.when(F.col("id") % 3 == 0, F.lit(b"a")).otherwise(F.lit(b"b")).alias("node"), F.col("id").alias("conv_id"))
    got = {bytes(r.node): r.ends_sha256 for r in prefix_trie.digests_of_ends(ends).collect()}
    assert got == {b"a": sha(i for i in range(-300, 700) if i % 3 == 0), b"b": sha(i for i in range(-300, 700) if i % 3)}
