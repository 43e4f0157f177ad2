"""Search: the nearest chunks of a collection for each query, reranked."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedra.operators.embedding import HashingEmbedder, ModelEmbedder
from sedra.operators.ranking import Reranking, candidates_of, ranked
from sedra.operators.vectors import BROADCAST_QUERIES, nearest
from sedra.sources.shared import cut

MOST_FOR_FEW = 32  # candidates of a query up to which those of BROADCAST_QUERIES queries are broadcast


def retrieve(queries: DataFrame, documents: DataFrame, k: int = 10, metric: str = "l2", embedder: HashingEmbedder | ModelEmbedder | None = None) -> DataFrame:
    """Candidates: for each query (query_id, query) its k nearest documents (doc_id, document, and embedding, or else they are embedded here)."""
    embedder = embedder or HashingEmbedder()
    vectors = documents if "embedding" in documents.columns else documents.select("doc_id", embedder.embed(F.col("document")).alias("embedding"))
    asked = queries.select("query_id", embedder.embed(F.col("query")).alias("embedding"))
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES and k <= MOST_FOR_FEW
    # Rerankers read the candidates several times: they are k rows a query, and written once.
    return cut(candidates_of(nearest(asked, vectors, k, metric), queries, documents, few))


@dataclass
class Retriever:
    """Search over documents (doc_id, document[, embedding]). Documents are a collection's rows, or any table like it."""

    documents: DataFrame
    reranking: Reranking = field(default_factory=Reranking)
    embedder: HashingEmbedder | ModelEmbedder = field(default_factory=HashingEmbedder)
    name: str = "documents"

    @classmethod
    def of(cls, collection, reranking: Reranking | None = None, embedder: HashingEmbedder | ModelEmbedder | None = None) -> Retriever:
        """Over a collection; the embedder must be the one that made it."""
        embedder = embedder or HashingEmbedder()
        if collection.embedder != embedder.id:
            raise ValueError(f"the collection was made with embedder {collection.embedder}, not {embedder.id}")
        rows = collection.rows().select(F.col("id").alias("doc_id"), "document", "embedding", "metadata")
        return cls(rows, reranking or Reranking(), embedder, collection.name)

    def search(self, queries: DataFrame, n_retrieve: int = 10, n_final: int = 3, method: str | None = None) -> DataFrame:
        """The best n_final of n_retrieve candidates by a reranker, the default one if none is named; by retrieval score if there is no such reranker."""
        found = retrieve(queries, self.documents, n_retrieve, embedder=self.embedder)
        name = method or self.reranking.default
        if name in self.reranking.methods():
            return self.reranking.rerank(found, name, n_final)
        return ranked(found, F.col("retrieval_score")).where(F.col("rank") <= n_final)

    def search_fused(self, queries: DataFrame, methods: Sequence[str], weights: Sequence[float] | None = None, n_retrieve: int = 10, n_final: int = 3) -> DataFrame:
        return self.reranking.rerank_fused(retrieve(queries, self.documents, n_retrieve, embedder=self.embedder), methods, weights, n_final)

    def info(self) -> DataFrame:
        """(collection, n, rerankers, default_reranker): one row."""
        return self.documents.agg(F.count("*").alias("n")).select(F.lit(self.name).alias("collection"), "n", F.array(*map(F.lit, self.reranking.methods())).cast("array<string>").alias("rerankers"), F.lit(self.reranking.default).alias("default_reranker"))
