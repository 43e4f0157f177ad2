"""BM25 over a collection: against all documents scored, ties and odd texts, postings that are skipped, and row numbers."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sedra.operators import lexical
from sedra.sources.numbering import numbered


def brute(docs, queries, k, k1=1.2, b=0.75):
    words = {i: Counter((t or "").split()) for i, t in docs}
    size = {i: sum(c.values()) for i, c in words.items()}
    mean = sum(size.values()) / len(size)
    df = Counter(w for c in words.values() for w in c)
    out = []
    for q, text in queries:
        scores = {}
        for w, asked in Counter((text or "").split()).items():
            for i, c in words.items():
                if w in c:
                    idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    scores[i] = scores.get(i, 0) + asked * idf * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * size[i] / mean))
        best = sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))[:k]
        out += [(q, i, round(s, 6), r + 1) for r, (i, s) in enumerate(best)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("size", [1, 5, 64])
def test_equals_all_documents_scored(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(lexical, "RANGE", size)
    rng = random.Random(4)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), 300)}"
    docs = [(i, " ".join(word() for _ in range(rng.choice((0, 1, 3, 10, 40))))) for i in range(400)] + [(900, None), (901, "w1 w1 w2"), (902, "w1 w1 w2")]
    queries = [(i, " ".join(word() for _ in range(rng.randrange(1, 6)))) for i in range(30)] + [(50, "unknown words"), (51, None), (52, ""), (53, "w1 w1 w2")]
    path = f"file://{tmp_path}/x"
    lexical.build(spark.createDataFrame(docs, "doc_id long, document string").repartition(3), path)
    asked = spark.createDataFrame(queries, "query_id long, query string")
    assert rows_of(lexical.search(asked, path, 7)) == brute(docs, queries, 7)
    monkeypatch.setattr(lexical, "MOST_TERMS", 3)
    assert rows_of(lexical.search(asked, path, 500)) == brute(docs, queries, 500)
    with pytest.raises(ValueError):
        lexical.Config(b=2)


def test_no_documents(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    lexical.build(spark.createDataFrame([], "doc_id long, document string"), path)
    assert lexical.search(spark.createDataFrame([(1, "w")], "query_id long, query string"), path).count() == 0


def test_most_postings_are_skipped(spark, tmp_path):
    """Three words of each of 40 benchmark texts over the documents of sf0.01: postings read, of all that the words have."""
    path, folder = f"file://{tmp_path}/x", "/root/testdata/sf0.01"
    lexical.build(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.col("text").alias("document")), path)
    words = F.array_join(F.slice(F.array_sort(F.array_distinct(lexical.terms(F.col("text"))), lambda a, b: F.length(b) - F.length(a)), 1, 3), " ")
    asked, blocks, _, rest = lexical.plan(spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("query_id"), words.alias("query")), path, 3)
    whole = asked.join(blocks, "term").agg(F.sum("n")).first()[0]
    late = rest.join(asked, "query_id").join(blocks, ["term", "range"]).agg(F.sum("n")).first()[0] or 0
    assert late < 0.3 * whole


def test_what_is_shuffled_goes_when_the_index_is_written(spark, tmp_path):
    ids = lambda: {str(b) for b in spark._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if "shuffle_" in b}
    before = ids()
    lexical.build(spark.createDataFrame([(i, f"w{i} w{i % 7} both") for i in range(200)], "doc_id long, document string").repartition(3), f"file://{tmp_path}/x")
    until = time.monotonic() + 20
    while ids() - before and time.monotonic() < until:  # removed beside what the driver does next
        time.sleep(0.1)
    assert not ids() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_many_queries_are_dealt_out(spark, tmp_path, monkeypatch):
    """Ids that are strings, and terms of queries that no task is given as a whole."""
    monkeypatch.setattr(lexical, "MOST_ASKED", 0)
    docs = [(f"d{i:03}", " ".join(f"w{j}" for j in range(i % 13) if i % (j + 2))) for i in range(150)]
    queries = [(i, f"w{i} w{i % 3} w{i + 4}") for i in range(9)]
    lexical.build(spark.createDataFrame(docs, "doc_id string, document string"), f"file://{tmp_path}/x")
    assert rows_of(lexical.search(spark.createDataFrame(queries, "query_id long, query string"), f"file://{tmp_path}/x", 4)) == brute(docs, queries, 4)


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice((None, *range(50))), i) for i in range(2000)]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.number)] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(r.number for r in got) == list(range(2000))
    assert numbered(spark.createDataFrame([], "a int"), "a").collect() == []
