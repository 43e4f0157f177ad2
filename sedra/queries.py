"""Queries by name: each applies operators to whole tables of a data set folder."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedra.functions import text as T
from sedra.operators import chunking, lexical, ranking, similarity, vectors
from sedra.operators.collection import Collection, stats, vectorized_status, without_sources
from sedra.operators.embedding import HashingEmbedder
from sedra.operators.ranking import Reranking
from sedra.operators.splitters import Size
from sedra.plans import chats, prompt
from sedra.plans.calls import CallTable
from sedra.plans.ingest import IngestConfig, collection_rows, store
from sedra.plans.model_split import chunk_by_calls
from sedra.plans.search import Retriever, retrieve
from sedra.sources import files, pdf
from sedra.sources.shared import BATCH_BYTES, bound_batches, new_table
from sedra.sources.tables import table

#: Put before each text that is cleaned, as the tables hold few of the patterns.
NOISE = (
    "Café zero​width﻿ \"q\" `b` ´a´ ‚low “curly” a–b—c−1 wait…  two   spaces \t tab nbsp  \n"
    "\n \n\n\nI don't x U.S. 3x a-b é trailing \t\n end.... no!!! why??? mixed?!?!\n  42  \n17\n--- Page 12 ---\nafter page --- Page 3 --- same line\n"
    "see http://a.b/c?d=1#f~g (https://q.r/s) end mail john.doe+x@mail.example.com, x@y.zz| <bad> #tag @at ~ * = © 中文。 Đà Nẵng\n\n   \nlast "
)

SIZE = Size(200, 30)
TOKEN_SIZE = Size(50, 10)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _cleaning(name: str, *stages: Callable[[Column], Column]) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        docs = _documents(spark, folder).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.concat(F.lit(NOISE), "text").alias("text"))
        pages = table(spark, folder, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.concat(F.lit(NOISE), "html").alias("text"))
        out = F.col("text")
        for stage in stages:
            out = stage(out)
        return docs.unionByName(pages).select("kind", "id", out.alias("cleaned"))

    QUERIES[name] = run


_cleaning("clean_nfc", T.nfc)
_cleaning("clean_zero_width", T.strip_zero_width)
_cleaning("clean_quotes_dashes", T.straight_quotes, T.straight_low_quote, T.plain_dashes, T.plain_ellipsis)
_cleaning("clean_spaces_newlines", T.single_spaces, T.two_newlines)
_cleaning("clean_rtrim_lines", T.rtrim_lines)
_cleaning("clean_single_letters", T.drop_single_letters)
_cleaning("clean_punct_runs", T.short_punctuation)
_cleaning("clean_page_lines", T.drop_number_lines, T.drop_page_marks)
_cleaning("clean_urls", T.drop_urls)
_cleaning("clean_emails", T.drop_emails)
_cleaning("clean_charset", T.allowed_characters)
_cleaning("clean_blank_lines", T.drop_blank_lines, T.strip)
_cleaning("clean_full", T.clean)


def _chunked(name: str, method: str, size: Size = SIZE) -> None:
    QUERIES[name] = lambda spark, folder: chunking.chunk(_documents(spark, folder), method, size)


_chunked("chunk_token", "token", TOKEN_SIZE)
_chunked("chunk_token_plain", "token", Size(50, 0))
_chunked("chunk_character", "character")
_chunked("chunk_recursive", "recursive")
_chunked("chunk_semantic", "semantic")
_chunked("chunk_cluster_semantic", "cluster_semantic")


@query
def chunk_llm_stub(spark: SparkSession, folder: str) -> DataFrame:
    """Split where a stand-in for a model suggests: it answers the prompt in words, and its answer is parsed."""
    return chunking.chunk(_documents(spark, folder), "llm", SIZE, ask=prompt.asking(prompt.every_hundred, SIZE.chunk))


@query
def chunk_llm_kept(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_llm_stub's rows through a table of calls: sections are prompts, equal ones are asked once."""
    calls = CallTable(new_table(spark), model="every hundred")
    return chunk_by_calls(_documents(spark, folder), calls, lambda: lambda prompts: [prompt.every_hundred(p) for p in prompts], SIZE)

@query
def chunk_fixed_stride(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.posexplode(chunking.fixed_chunks(F.col("text"), SIZE)).alias("chunk_pos", "chunk"))


@query
def chunk_small_text(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.posexplode(chunking.small_text(F.col("text"), Size(1500, 0))).alias("chunk_pos", "chunk"))


@query
def chunk_overlap_prefix(spark: SparkSession, folder: str) -> DataFrame:
    plain = chunking.chunk(_documents(spark, folder), "token", Size(50, 0))
    return chunking.with_overlap(plain, Size(400, 10))


@query
def sentences(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.sentence_rows(_documents(spark, folder))


@query
def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    count = lambda kind, ids, df: df.select(F.lit(kind).alias("kind"), *ids, F.size(T.sentences(F.col("text"))).alias("n_sentences"), T.count_tokens(F.col("text")).alias("n_tokens"))
    chat = count("chat", [F.col("conv_id").alias("id"), F.col("turn")], table(spark, folder, "conversations"))
    return count("document", [F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn")], _documents(spark, folder)).unionByName(chat)


@query
def sentence_should_group(spark: SparkSession, folder: str) -> DataFrame:
    parts = _documents(spark, folder).select("doc_id", T.sentences(F.col("text")).alias("s"))
    rows = parts.select("doc_id", "s", F.posexplode("s").alias("i", "now")).where("i > 0")
    return rows.select("doc_id", "i", T.should_group(F.get("s", F.col("i") - 1), F.col("now")).alias("goes_on"))


@query
def sentence_group_greedy(spark: SparkSession, folder: str) -> DataFrame:
    parts = _documents(spark, folder).select("doc_id", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return parts.select("doc_id", F.posexplode(chunking.grouped_sentences(F.col("s"), SIZE)).alias("chunk_pos", "chunk"))


@query
def sentence_features(spark: SparkSession, folder: str) -> DataFrame:
    sets = [F.array_join(F.array_sort(c), "|").alias(c) for c in ("words", "noun_phrases", "entities")]
    return similarity.featured(_documents(spark, folder)).select("doc_id", "i", *sets, "length", "word_count")


@query
def sentence_pair_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.pair_similarities(_documents(spark, folder)).select("doc_id", "i", "j", T.rounded(F.col("sim"), 9).alias("sim"))


@query
def cluster_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.clustered(_documents(spark, folder))


@query
def cluster_pair_linkage(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.linkage(table(spark, folder, "embeddings")).select("a", "b", F.round("linkage", 6).alias("linkage"))


@query
def chunk_metadata(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    chunks = chunking.chunk(docs, "token", TOKEN_SIZE).join(docs.select("doc_id", "source"), "doc_id")
    rows = chunking.formatted(chunks, F.concat(F.lit("/data/files/"), F.col("source"), F.lit(".txt")))
    return rows.select("id", "content", "metadata.source_file", "metadata.file_name", "metadata.length", "metadata.token")


@query
def chunk_stats_by_source(spark: SparkSession, folder: str) -> DataFrame:
    own = _documents(spark, folder).select("source", F.explode(chunking.token_chunks(F.col("text"), TOKEN_SIZE)).alias("chunk"))
    return own.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"), F.max(T.count_tokens(F.col("chunk"))).alias("most_tokens"))


@query
def hash_embed(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).select("doc_id", HashingEmbedder().embed(F.col("text")).alias("e"))
    return docs.select("doc_id", F.posexplode("e").alias("i", "x")).select("doc_id", "i", F.round("x", 6).alias("x"))


@query
def vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


def _knn(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    """Queries: the vectors whose id is divisible by 100; each is among its own candidates."""
    all_ = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = all_.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    return vectors.nearest(asked, all_, 10, metric)


@query
def knn_l2(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder, "l2").select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "retrieval_rank")


@query
def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder, "cosine").select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "retrieval_rank")


@query
def knn_score(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder, "l2").select("query_id", F.col("doc_id").cast("string").alias("doc_id"), F.round(vectors.score_of(F.col("distance")), 6).alias("score"))


@query
def knn_lsh(spark: SparkSession, folder: str) -> DataFrame:
    all_ = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vectors.nearest_lsh(all_.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding"), all_, 10)


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _library(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.col("text").alias("document"))


def _found(spark: SparkSession, folder: str) -> DataFrame:
    """Ten candidates for each benchmark text."""
    return retrieve(_asked(spark, folder), _library(spark, folder), 10)


@query
def retrieve_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder).select("query_id", "doc_id", F.round("retrieval_score", 6).alias("retrieval_score"), "retrieval_rank")


@query
def tfidf_terms(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.tfidf_terms(_found(spark, folder)).select("query_id", "doc_id", "term", "tf", "df", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight"))


@query
def tfidf_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.tfidf_scores(_found(spark, folder)).select("query_id", "doc_id", F.round("tfidf", 6).alias("tfidf"))


@query
def rerank_minmax(spark: SparkSession, folder: str) -> DataFrame:
    return _found(spark, folder).select("query_id", "doc_id", F.round(ranking.min_max(F.col("retrieval_score")), 6).alias("normalised"))


def _reranked(name: str) -> Query:
    return lambda spark, folder: Reranking(list(ranking.KNOWN)).rerank(_found(spark, folder), name).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


QUERIES["rerank_cross_stub"] = _reranked("cross_encoder")
QUERIES["rerank_bi"] = _reranked("bi-encoder")
QUERIES["rerank_hybrid"] = _reranked("hybrid")


def _fused(mode: str) -> Query:
    return lambda spark, folder: Reranking(list(ranking.KNOWN), mode).rerank_fused(_found(spark, folder), ["cross_encoder", "bi-encoder", "hybrid"], [1.0, 2.0, 1.0]).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


QUERIES["rerank_fusion_fixed"] = _fused("fixed")
QUERIES["rerank_fusion_compat"] = _fused("compat")


@query
def best_score(spark: SparkSession, folder: str) -> DataFrame:
    """The named score, any method's, or the retrieval score: each decides for a third of the rows."""
    found = _found(spark, folder)
    shares = F.pmod("doc_id", F.lit(3))
    named = F.when(shares == 0, F.create_map(F.lit("x"), F.lit(0.25), F.lit("y"), F.lit(0.75))).when(shares == 1, F.create_map(F.lit("y"), F.lit(0.5), F.lit("z"), F.lit(0.125))).otherwise(F.col("rerank_scores"))
    return found.withColumn("rerank_scores", named).select("query_id", "doc_id", F.round(ranking.best_score("x"), 6).alias("score"))


@query
def search_two_stage(spark: SparkSession, folder: str) -> DataFrame:
    found = Retriever(_library(spark, folder)).search(_asked(spark, folder))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query
def multi_method_search(spark: SparkSession, folder: str) -> DataFrame:
    own = Retriever(_library(spark, folder), Reranking(list(ranking.KNOWN)))
    return own.search_fused(_asked(spark, folder), ["bi-encoder", "hybrid"]).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query
def no_rerank_topn(spark: SparkSession, folder: str) -> DataFrame:
    found = Retriever(_library(spark, folder)).search(_asked(spark, folder), method="none such")
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as a collection stores them, without vectors: a row a token chunk, its source the document's."""
    own = _documents(spark, folder).select("source", F.explode(chunking.token_chunks(F.col("text"), TOKEN_SIZE)).alias("document"))
    return own.select(F.struct(F.col("source").alias("source_file")).alias("metadata"), "document")


@query
def collection_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats(_stored(spark, folder), "documents")


@query
def system_info(spark: SparkSession, folder: str) -> DataFrame:
    return Retriever(_library(spark, folder)).info().select("collection", "n", F.array_join("rerankers", ",").alias("rerankers"), "default_reranker")


@query
def vectorized_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files: the sources, and one for each toxic label that was never stored."""
    files = _documents(spark, folder).select("source").distinct().select(F.col("source").alias("name"), F.col("source").alias("url"))
    more = table(spark, folder, "labels").where("toxic = 1").select(F.concat(F.lit("file"), "doc_id").alias("name")).select("name", F.col("name").alias("url"))
    return vectorized_status(files.unionByName(more), _stored(spark, folder))


@query
def delete_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each source when those of documents with a toxic label are deleted."""
    toxic = table(spark, folder, "labels").where("toxic = 1").join(_documents(spark, folder), "doc_id").select(F.col("source").alias("source_file"))
    left = without_sources(_stored(spark, folder), toxic)
    return left.groupBy(F.col("metadata.source_file").alias("source")).agg(F.count("*").alias("n"))


TOKEN_INGEST = IngestConfig(TOKEN_SIZE.chunk, TOKEN_SIZE.overlap, "token")


def _as_files(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, text) as extracted files."""
    return documents.select(F.concat(F.lit("/data/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", F.lit(None).cast("string").alias("error"))


@query
def ingest_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """A collection of all documents, after those with a toxic label came again with their first 200 characters, and others of low quality without any."""
    docs, own = _documents(spark, folder), Collection(spark, name="upserts")
    store(_as_files(docs), own, TOKEN_INGEST)
    again = docs.join(table(spark, folder, "labels"), "doc_id").where("toxic = 1 or quality = 0")
    store(_as_files(again.withColumn("text", F.when(F.col("toxic") == 1, F.substring("text", 1, 200)).otherwise(""))), own, TOKEN_INGEST)
    return own.rows().select("id", "metadata.source_file", "metadata.token", "document")


@query
def search_collection(spark: SparkSession, folder: str) -> DataFrame:
    """Two-stage search over the stored chunks of all documents."""
    own = Collection(spark, name="chunks")
    own.append(collection_rows(_as_files(_documents(spark, folder)), TOKEN_INGEST))
    return Retriever.of(own).search(_asked(spark, folder)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query
def search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest stored chunks of all documents for each benchmark text, by the collection's inverted file."""
    own = Collection(spark, name="indexed")
    own.append(collection_rows(_as_files(_documents(spark, folder)), TOKEN_INGEST))
    own.index()
    asked = _asked(spark, folder).select("query_id", HashingEmbedder().embed(F.col("query")).alias("embedding"))
    return own.nearest(asked).select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "retrieval_rank")


@query
def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best of all documents for each benchmark text by BM25, from an index with block maxima."""
    path = new_table(spark)
    lexical.build(_library(spark, folder), path)
    return lexical.search(_asked(spark, folder), path).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query
def file_table(spark: SparkSession, folder: str) -> DataFrame:
    """The numbered table of files, one for each document, in folders by source and of three types."""
    kind = F.element_at(F.array(F.lit("txt"), F.lit("PDF"), F.lit("odd")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    path = F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), kind)
    listed = _documents(spark, folder).select(path.alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"))
    return files.file_table(listed).select("id", "name", "file", "file_type")


@query
def files_extracted(spark: SparkSession, folder: str) -> DataFrame:
    """Sources uploaded as text files of their counts, a picture, an empty file, and one that is deleted again: what the folder's files hold."""
    landing = f"{new_table(spark)}/landing"
    for r in _documents(spark, folder).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).toLocalIterator():  # a row a source
        files.upload(spark, landing, f"{r['source']}.txt", f"{r['source']}: {r['n']} documents\n{r['chars']} characters".encode())
    for name, content in (("picture.PNG", b"\x89PNG"), ("empty.txt", b""), ("gone.txt", b"gone")):
        files.upload(spark, landing, name, content)
    files.delete(spark, landing, "gone.txt")
    read = files.extract(files.scan(spark, landing))
    return read.select(F.element_at(F.split("path", "/"), -1).alias("name"), "file_type", "text", F.col("error").isNotNull().alias("failed"))


@query
def pdf_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a PDF file with a page a line, made by tasks, and the text that is read from it: each line and a newline."""
    bound_batches(spark)
    own = _documents(spark, folder).select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            own, size = [], 0
            for path, text in zip(b["path"], b["text"], strict=True):
                own.append((path, pdf.written(text.split("\n"))))
                size += len(own[-1][1])
                if size > BATCH_BYTES:  # files are many times as long as their texts
                    yield pd.DataFrame(own, columns=["path", "content"])
                    own, size = [], 0
            yield pd.DataFrame(own, columns=["path", "content"])

    read = files.extract(own.mapInPandas(run, "path string, content binary"))
    return read.select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("doc_id"), F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "error")


@query
def prompt_build(spark: SparkSession, folder: str) -> DataFrame:
    asked = _asked(spark, folder)
    return prompt.prompts(asked, prompt.augment(Retriever(_library(spark, folder)), asked))


@query
def reply_stub(spark: SparkSession, folder: str) -> DataFrame:
    return prompt.replies(prompt_build(spark, folder))


@query
def replies_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The stand-in's reply to every user turn, each different prompt asked once, through a table of calls."""
    own = table(spark, folder, "conversations").where("role = 'user'")
    asked = own.select(F.struct("conv_id", "turn").alias("query_id"), F.concat(F.lit("Repeat:\n1: "), F.col("text")).alias("prompt"))
    calls = CallTable(new_table(spark), model="extractive")
    return calls.replies(asked, lambda: prompt.extractive).select("query_id.conv_id", "query_id.turn", "reply")


@query
def chat_turns_update(spark: SparkSession, folder: str) -> DataFrame:
    """A chat opened, a question and an answer added to each chat that ends with the user, chats of one turn deleted."""
    own = table(spark, folder, "conversations")
    opened = chats.start(own, spark.createDataFrame([("user", "Hello")], "role string, text string"))
    last = opened.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"))
    ask = last.where("role = 'user'").select("conv_id", F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(r).alias("role"), F.lit(t).alias("text")) for k, r, t in ((1, "assistant", "Yes?"), (2, "user", "Go on"))])).alias("m")).select("conv_id", "m.*")
    sent = chats.send(opened, ask)
    return chats.delete(sent, sent.groupBy("conv_id").agg(F.count("*").alias("n")).where("n = 1"))


@query
def chat_titles(spark: SparkSession, folder: str) -> DataFrame:
    named = chats.titles(table(spark, folder, "conversations"))
    return chats.rename(named, named.where("n_turns > 6").select("conv_id", F.concat(F.lit("Long: "), "title").alias("title")))


@query
def parse_split_points(spark: SparkSession, folder: str) -> DataFrame:
    n, d = F.col("n_chars").cast("string"), F.col("doc_id").cast("string")
    answer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Cut here. SPLIT_POINTS: ["), n, F.lit(", 7,\n"), d, F.lit("] or 99"))).otherwise(F.concat(F.lit("At 5, "), n, F.lit(" and x"), d, F.lit(" or 100,200 300 400 500 600 700 800 900 1000 1100")))
    return _documents(spark, folder).select("doc_id", F.array_join(T.split_points(answer), ",").alias("points"))
