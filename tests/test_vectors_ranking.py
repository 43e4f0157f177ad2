"""Vectors, ranking, TF-IDF, prompts: small cases with known results."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedra.operators import ranking as R
from sedra.operators import vectors as V
from sedra.operators.embedding import HashingEmbedder, ModelEmbedder
from sedra.operators.ranking import Reranking
from sedra.plans import prompt
from sedra.plans.search import Retriever

CANDIDATES = "query_id long, query string, doc_id long, document string, retrieval_score double, retrieval_rank int, rerank_scores map<string,double>"


def candidates(spark, rows):
    return spark.createDataFrame(rows, CANDIDATES)


def three(spark, scores=({}, {}, {})):
    return candidates(spark, [(1, "red apple", k, d, 1.0 - k / 10, k, s) for k, d, s in zip((1, 2, 3), ("red apple", "green apple", "blue car"), scores, strict=True)])


def test_nearest_in_blocks_equals_broadcast(spark, data, monkeypatch):
    all_ = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = all_.where("doc_id % 7 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    for metric in ("l2", "cosine"):
        want = {(r.query_id, r.retrieval_rank): r.doc_id for r in V.nearest(asked, all_, 5, metric).collect()}
        monkeypatch.setattr(V, "BROADCAST_QUERIES", 20)
        monkeypatch.setattr(V, "BLOCK_ROWS", 100)
        assert {(r.query_id, r.retrieval_rank): r.doc_id for r in V.nearest(asked, all_, 5, metric).collect()} == want
        monkeypatch.undo()


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    from sedra.operators.ranking import STOP_WORDS

    assert set(STOP_WORDS) == set(StopWordsRemover.loadDefaultStopWords("english"))


def test_nearest_of_nothing_and_ties(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.doc_id for r in V.nearest(asked, df, 2).orderBy("retrieval_rank").collect()] == [1, 3]
    assert V.nearest(asked, df.where("false"), 2).count() == 0
    nulls = df.unionByName(spark.createDataFrame([(0, None)], df.schema))
    assert V.nearest(asked, nulls, 9).count() == 3 and V.nearest(asked.withColumn("embedding", F.lit(None).cast("array<float>")), df, 2).count() == 0


def test_lsh_reads_few_and_finds_most(spark, data, monkeypatch):
    """At 2,000 vectors: 5 % of all pairs are candidates, and recall is 0.9 or more; many queries in blocks find the same; any size of vector."""
    all_ = spark.read.parquet(f"{data}/../sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = all_.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    want = {(r.query_id, r.doc_id) for r in V.nearest(asked, all_, 10, "cosine").collect()}
    few = {(r.query_id, r.doc_id) for r in V.nearest_lsh(asked, all_, 10).collect()}
    assert len(want & few) / len(want) >= 0.9 and 10 * V.PER_NEIGHBOUR <= 0.05 * all_.count()
    monkeypatch.setattr(V, "BROADCAST_QUERIES", 30)
    monkeypatch.setattr(V, "BLOCK_ROWS", 300)
    assert {(r.query_id, r.doc_id) for r in V.nearest_lsh(asked, all_, 10).collect()} == few
    short = spark.createDataFrame([(i, [float(i % 7), 1.0, -float(i % 3)]) for i in range(40)] + [(40, None), (41, [1.0])], "doc_id long, embedding array<float>")
    own = short.where("doc_id < 3").select(F.col("doc_id").alias("query_id"), "embedding")
    assert V.nearest_lsh(own, short, 3).count() == 9 and V.nearest_lsh(own, short.where("false"), 3).count() == 0 and V.nearest_lsh(own.where("false"), short, 3).count() == 0


def test_lsh_queries_leave_in_parts(spark, data, monkeypatch):
    """A few queries' candidates at a time give what all at once give."""
    all_ = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = all_.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    found = []
    for rows in (1 << 20, 3):
        monkeypatch.setattr(V, "QUERY_ROWS", rows)
        found.append(sorted((r.query_id, r.retrieval_rank, r.doc_id) for r in V.nearest_lsh(asked, all_, 10).collect()))
    assert found[0] == found[1] and len(found[0]) > 0


def test_lsh_recall(spark, data):
    all_ = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = all_.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    want = {(r.query_id, r.doc_id) for r in V.nearest(asked, all_, 10, "cosine").collect()}
    got = {(r.query_id, r.doc_id) for r in V.nearest_lsh(asked, all_, 10).collect()}
    assert len(want & got) / len(want) >= 0.9


def test_linkage_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(int(c), rng.standard_normal(3).tolist()) for c in (0, 0, 0, 1, 1, 2)] + [(2, [0.0, 0.0, 0.0])]
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for r in V.linkage(spark.createDataFrame(rows, "label int, embedding array<double>")).collect():
        assert math.isclose(r.linkage, np.mean([unit(x) @ unit(y) for a, x in rows for b, y in rows if (a, b) == (r.a, r.b)]), abs_tol=1e-12)


def test_embedders(spark):
    df = spark.createDataFrame([("a a b",), ("",), (None,)], "t string")
    rows = [r.e for r in df.select(HashingEmbedder(8).embed(F.col("t")).alias("e")).collect()]
    assert math.isclose(sum(x * x for x in rows[0]), 1.0) and rows[1] == rows[2] == [0.0] * 8
    own = ModelEmbedder("lengths", 1, lambda: lambda texts: np.array([[len(t)] for t in texts]))
    assert [r.e for r in df.select(own.embed(F.col("t")).alias("e")).collect()] == [[5.0], [0.0], [0.0]]


def test_min_max_of_one(spark):
    one = candidates(spark, [(1, "q", 1, "d", 0.4, 1, {"m": 7.0})])
    assert one.select(R.min_max(F.col("retrieval_score")).alias("x")).first().x == 0.4
    assert R.fused(one, ["m"]).first().rerank_scores["combined"] == 1.0


def test_fusion_modes(spark):
    both = Reranking(["cross_encoder", "bi-encoder"])
    compat = Reranking(["cross_encoder", "bi-encoder"], "compat")
    fixed = {r.doc_id: r.rerank_scores for r in both.rerank_fused(three(spark), ["cross_encoder", "bi-encoder"]).collect()}
    old = {r.doc_id: r.rerank_scores for r in compat.rerank_fused(three(spark), ["cross_encoder", "bi-encoder"]).collect()}
    assert "combined" in fixed[1] and fixed[2]["combined"] != old[2]["combined"]
    # The cross reranker's score is not looked up, so nothing is fused: the best of any method decides.
    alone = compat.rerank_fused(three(spark), ["cross_encoder"]).orderBy("rank").collect()
    assert all("combined" not in r.rerank_scores for r in alone) and alone[0].doc_id == 1 and alone[0].score == 1.0


def test_unknown_methods(spark):
    own = Reranking(["cross_encoder"])
    with pytest.raises(KeyError):
        own.rerank(three(spark), "no such")
    with pytest.raises(ValueError):
        own.rerank_fused(three(spark), ["cross_encoder"], [1.0, 2.0])
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert own.rerank_fused(three(spark), ["no such", "cross_encoder"]).count() == 3
        Reranking(["no such"])
        own.remove("no such")
    assert len(said) == 3
    own.remove("cross_encoder")
    assert own.methods() == []


def test_ties_and_top_k(spark):
    same = three(spark, ({"m": 0.5},) * 3)
    assert [r.doc_id for r in R.ranked(same, R.best_score("m")).orderBy("rank").collect()] == [1, 2, 3]
    for k, n in ((0, 3), (None, 3), (2, 2), (9, 3)):
        assert R.ranked(same, R.best_score("m"), k).count() == n
    mixed = three(spark, ({"x": 0.1}, {"y": 0.9, "z": 0.95}, {}))
    assert [round(r.s, 2) for r in mixed.orderBy("doc_id").select(R.best_score("x").alias("s")).collect()] == [0.1, 0.95, 0.7]


def test_tfidf_by_hand(spark):
    rows = {r.doc_id: r.tfidf for r in R.tfidf_scores(three(spark)).collect()}
    idf = {"apple": math.log(4 / 3) + 1, "red": math.log(4 / 2) + 1}
    a = np.array([idf["red"], idf["apple"]])
    assert math.isclose(rows[1], 1.0) and rows[3] == 0.0
    green = math.log(4 / 2) + 1
    assert math.isclose(rows[2], idf["apple"] / np.linalg.norm([green, idf["apple"]]) * a[1] / np.linalg.norm(a), rel_tol=1e-9)


def test_model_scorer(spark):
    own = R.CrossReranker(R.model_scorer(lambda: lambda pairs: np.array([len(d) for _, d in pairs])), "length")
    assert [r.doc_id for r in R.ranked(own.score(three(spark)), R.best_score("length")).orderBy("rank").collect()] == [2, 1, 3]


def test_search_and_prompt(spark):
    library = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "a car 100%")], "doc_id long, document string")
    asked = spark.createDataFrame([(1, "red apple"), (2, "car %s")], "query_id long, query string")
    own = Retriever(library)
    found = own.search(asked, n_retrieve=2, n_final=1).collect()
    assert {(r.query_id, r.doc_id) for r in found} == {(1, 1), (2, 3)}
    assert own.search(asked, n_final=0).count() == 6 and own.search(asked, n_final=0, method="none").count() == 0
    made = {r.query_id: r.prompt for r in prompt.prompts(asked, prompt.augment(own, asked, 2)).collect()}
    assert made[1].count("\n") == 3 and made[1].split("\n")[1].endswith(": red apple pie") and "car %s" in made[2]
    said = prompt.replies(spark.createDataFrame(list(made.items()), "query_id long, prompt string"))
    assert {r.query_id: r.reply for r in said.collect()} == {1: "red apple pie", 2: "a car 100%"}

    def broken():
        def model(texts):
            raise RuntimeError("no model")

        return model

    assert {r.error for r in prompt.replies(spark.createDataFrame([(1, "x")], "query_id long, prompt string"), broken).collect()} == {"no model"}
    assert {r.query_id: r.reply for r in prompt.answer(own, asked, 2).collect()} == {1: "red apple pie", 2: "a car 100%"}
    assert own.info().first().n == 3
    assert "SPLIT_POINTS" in prompt.split_prompt("text", 200)
