"""Reranking of candidates by scorers, alone or fused.

Candidates are rows (query_id, query, doc_id, document, retrieval_score, retrieval_rank, rerank_scores): the scores are a
map from a method's name to its score. A reranker adds its entry; ranking sorts by the best score, ties by retrieval rank.
A query's candidates are few, so every window here is over one query's handful of rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedra.functions import text as T
from sedra.functions.patterns import GROUPING_STOP_WORDS, JAVA_WORD
from sedra.operators.embedding import HashingEmbedder, ModelEmbedder
from sedra.operators.vectors import cosine, score_of

EPSILON = 1e-8
MOST_TERMS = 10_000
#: English words that TF-IDF leaves out, the default list of Spark's StopWordsRemover.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him",
    "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further",
    "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd",
    "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've", "you've", "they've",
    "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't",
    "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's", "ought", "that's",
    "there's", "what's", "when's", "where's", "who's", "why's", "would",
)

Scorer = Callable[[Column, Column], Column]


def _query():
    return Window.partitionBy("query_id")


def word_overlap(query: Column, document: Column) -> Column:
    """The default pair scorer: the Jaccard similarity of the content words; 0 if neither has any."""
    return F.coalesce(T.jaccard(T.content_words(query, GROUPING_STOP_WORDS), T.content_words(document, GROUPING_STOP_WORDS)), F.lit(0.0))


def model_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]]) -> Scorer:
    """A pair scorer from a model that is loaded once a task and scores batches of (query, document)."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, d in batches:
            yield pd.Series(np.asarray(model(list(zip(q.fillna(""), d.fillna(""), strict=True))), np.float64))

    return lambda query, document: run(query, document)


def min_max(score: Column, alone: Column | None = None) -> Column:
    """(x - min) / (max - min + 1e-8) over a query's candidates; a single candidate gets `alone`, or keeps its score."""
    low, high = F.min(score).over(_query()), F.max(score).over(_query())
    return F.when(F.count(score).over(_query()) > 1, (score - low) / (high - low + EPSILON)).otherwise(score if alone is None else alone)


def terms(text: Column) -> Column:
    """Lower-case words of two characters or more, without stop words; repeats stay."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"{JAVA_WORD}{{2,}}"), 0), lambda t: ~t.isin(*STOP_WORDS))


def tfidf_terms(candidates: DataFrame) -> DataFrame:
    """(query_id, doc_id, term, tf, df, idf, weight): TF-IDF of each document, fitted on its query's candidates, rows of length 1.

    Candidates are dealt by query once; all counts after that are within a query's few documents.
    """
    by = lambda *keys: Window.partitionBy("query_id", *keys)
    sized = candidates.select("query_id", "doc_id", "document").withColumn("n", F.count("*").over(_query()))
    tf = sized.select("query_id", "doc_id", "n", F.explode(terms(F.col("document"))).alias("term")).groupBy("query_id", "doc_id", "n", "term").agg(F.count("*").alias("tf"))
    counted = tf.withColumn("df", F.count("*").over(by("term"))).withColumn("total", F.sum("tf").over(by("term")))
    known = counted.withColumn("place", F.dense_rank().over(_query().orderBy(F.desc("total"), "term"))).where(F.col("place") <= MOST_TERMS)
    raw = known.withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(by("doc_id")))
    return raw.select("query_id", "doc_id", "term", "tf", "df", "idf", (F.col("w") / length).alias("weight"))


def tfidf_scores(candidates: DataFrame) -> DataFrame:
    """(query_id, doc_id, tfidf): the product of the query's vector with each candidate's; terms that no candidate has are ignored."""
    asked = candidates.groupBy("query_id").agg(F.first("query").alias("query")).select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("asked"))
    hit = tfidf_terms(candidates).join(asked, ["query_id", "term"]).withColumn("q", F.col("asked") * F.col("idf"))
    # A term that several candidates have is one of the query's vector.
    unit = F.sqrt(F.sum(F.col("q") * F.col("q") / F.col("df")).over(_query()))
    own = hit.withColumn("unit", unit).groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("q") / F.col("unit")), 12).alias("tfidf"))  # rounded, as sums of equal documents may differ in their order
    return candidates.select("query_id", "doc_id").join(own, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"))


def with_score(candidates: DataFrame, method: str, score: Column) -> DataFrame:
    """candidates with one more entry of rerank_scores."""
    old = F.map_filter("rerank_scores", lambda name, _: name != method)
    return candidates.withColumn("rerank_scores", F.map_concat(old, F.create_map(F.lit(method), score.cast("double"))))


def best_score(method: str | None = None) -> Column:
    """The method's score, or else the highest of any method, or else the retrieval score."""
    scores = F.col("rerank_scores")
    own = F.try_element_at(scores, F.lit(method)) if method else F.lit(None).cast("double")
    return F.coalesce(own, F.array_max(F.map_values(scores)), F.col("retrieval_score"))


def ranked(candidates: DataFrame, by: Column, top_k: int | None = None) -> DataFrame:
    """candidates with `score` and `rank` from 1, the best first, ties by retrieval rank; top_k of 0 or None keeps all."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "retrieval_rank")
    out = candidates.withColumn("score", by).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= top_k) if top_k else out


@dataclass(frozen=True)
class CrossReranker:
    """Scores each pair of query and document; not normalised."""

    scorer: Scorer = word_overlap
    method: str = "cross-encoder"

    def score(self, candidates: DataFrame) -> DataFrame:
        return with_score(candidates, self.method, self.scorer(F.col("query"), F.col("document")))


@dataclass(frozen=True)
class BiReranker:
    """Weighs the normalised similarity of embeddings and the normalised pair score."""

    embedder: HashingEmbedder | ModelEmbedder = field(default_factory=HashingEmbedder)
    scorer: Scorer = word_overlap
    bi_weight: float = 0.5
    cross_weight: float = 0.5
    method: str = "bi-encoder"

    def score(self, candidates: DataFrame) -> DataFrame:
        own = candidates.withColumn("_bi", cosine(self.embedder.embed(F.col("query")), self.embedder.embed(F.col("document")))).withColumn("_cross", self.scorer(F.col("query"), F.col("document")))
        return with_score(own, self.method, self.bi_weight * min_max(F.col("_bi")) + self.cross_weight * min_max(F.col("_cross"))).drop("_bi", "_cross")


@dataclass(frozen=True)
class HybridReranker:
    """Weighs the normalised TF-IDF score and the normalised similarity of embeddings."""

    embedder: HashingEmbedder | ModelEmbedder = field(default_factory=HashingEmbedder)
    tfidf_weight: float = 0.3
    semantic_weight: float = 0.7
    method: str = "hybrid"

    def score(self, candidates: DataFrame) -> DataFrame:
        own = candidates.join(tfidf_scores(candidates), ["query_id", "doc_id"]).withColumn("_semantic", cosine(self.embedder.embed(F.col("query")), self.embedder.embed(F.col("document"))))
        return with_score(own, self.method, self.tfidf_weight * min_max(F.col("tfidf")) + self.semantic_weight * min_max(F.col("_semantic"))).drop("tfidf", "_semantic")


Reranker = CrossReranker | BiReranker | HybridReranker


def fused(candidates: DataFrame, methods: Sequence[str], weights: Sequence[float] | None = None) -> DataFrame:
    """candidates with the entry `combined`: the weighted mean of the normalised scores of those methods that a row has.

    A method that only one of a query's candidates has counts as 1 there. Rows without any keep no `combined`.
    """
    weights = [1.0] * len(methods) if weights is None else list(weights)
    if len(weights) != len(methods):
        raise ValueError("as many weights as methods, please")
    total, weight, out = F.lit(0.0), F.lit(0.0), candidates
    for k, (method, w) in enumerate(zip(methods, weights, strict=True)):
        out = out.withColumn(f"_s{k}", F.try_element_at("rerank_scores", F.lit(method)))
        part = min_max(F.col(f"_s{k}"), F.lit(1.0))
        out = out.withColumn(f"_n{k}", F.when(F.col(f"_s{k}").isNotNull(), part))
        total = total + F.coalesce(w * F.col(f"_n{k}"), F.lit(0.0))
        weight = weight + F.when(F.col(f"_n{k}").isNotNull(), float(w)).otherwise(0.0)
    out = out.withColumn("_combined", F.when(weight > 0, total / weight))
    added = F.when(F.col("_combined").isNotNull(), F.map_concat(F.map_filter("rerank_scores", lambda n, _: n != "combined"), F.create_map(F.lit("combined"), "_combined"))).otherwise(F.col("rerank_scores"))
    return out.withColumn("rerank_scores", added).drop("_combined", *[f"_{x}{k}" for k in range(len(methods)) for x in "sn"])


#: Rerankers by the names that a pipeline is set up with. The name of the cross reranker is not its method's.
KNOWN: dict[str, Callable[[], Reranker]] = {"cross_encoder": CrossReranker, "bi-encoder": BiReranker, "hybrid": HybridReranker}


class Reranking:
    """Rerankers by name. mode 'fixed' fuses the scores a reranker gave; 'compat' looks them up by the reranker's name, so the cross reranker's is never found."""

    def __init__(self, names: Sequence[str] = ("cross_encoder", "bi-encoder"), mode: str = "fixed") -> None:
        if mode not in ("fixed", "compat"):
            raise ValueError(f"no such mode: {mode}")
        self.mode = mode
        self.rerankers: dict[str, Reranker] = {}
        for name in names:
            if name in KNOWN:
                self.add(name, KNOWN[name]())
            else:
                warnings.warn(f"no such reranker: {name}", stacklevel=2)
        self.default = names[0] if names else None

    def add(self, name: str, reranker: Reranker) -> None:
        self.rerankers[name] = reranker

    def remove(self, name: str) -> None:
        if self.rerankers.pop(name, None) is None:
            warnings.warn(f"no such reranker: {name}", stacklevel=2)

    def methods(self) -> list[str]:
        return list(self.rerankers)

    def rerank(self, candidates: DataFrame, name: str, top_k: int | None = None) -> DataFrame:
        """By one reranker; an unknown name is an error."""
        own = self.rerankers[name]
        return ranked(own.score(candidates), best_score(own.method), top_k)

    def rerank_fused(self, candidates: DataFrame, names: Sequence[str], weights: Sequence[float] | None = None, top_k: int | None = None) -> DataFrame:
        """By several, fused; unknown names are left out with a warning."""
        if weights is not None and len(weights) != len(names):
            raise ValueError("as many weights as methods, please")
        keys, out = [], candidates
        for name in names:
            if name not in self.rerankers:
                warnings.warn(f"no such reranker: {name}", stacklevel=2)
                keys.append(name)
                continue
            out = self.rerankers[name].score(out)
            keys.append(name if self.mode == "compat" else self.rerankers[name].method)
        return ranked(fused(out, keys, weights), best_score("combined"), top_k)


def candidates_of(found: DataFrame, queries: DataFrame, documents: DataFrame, few: bool = False) -> DataFrame:
    """Candidate rows from nearest(): found (query_id, doc_id, distance, retrieval_rank), queries (query_id, query), documents (doc_id, document).

    `few` says that the rows of found are known to be few: they are sent to the documents then, which stay where they are.
    Only ids and numbers are sent; the queries' texts, of any length, are joined to what is found.
    """
    near = found.select("query_id", "doc_id", "distance", "retrieval_rank")
    joined = documents.select("doc_id", "document").join(F.broadcast(near) if few else near, "doc_id").join(queries.select("query_id", "query"), "query_id")
    return joined.select("query_id", "query", "doc_id", "document", score_of(F.col("distance")).alias("retrieval_score"), "retrieval_rank", F.create_map().cast("map<string,double>").alias("rerank_scores"))
