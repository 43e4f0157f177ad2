"""Lexical retrieval over a whole collection: BM25, exact, with postings skipped by block maxima.

Texts are dealt to tasks by length, and RANGE documents of a task with like numbers of words are a range. The postings of a term in a range are a
block: a row with the term's greatest count and the least length, and its documents with their counts and lengths. Documents
of a range are of like length, so that weights of a term vary little there and what a block's greatest count weighs at its
least length is a close bound. A task writes the blocks of its own documents, by term: postings are never dealt again, and
all of a range lie in one file. What
was dealt is removed once it is written. Weights are worked out when a search reads a block, so that a posting takes a few bytes.

A search adds up the bounds of a query's terms by range, which needs no posting. The ranges of the highest sums are scored
first, and the k-th best score there is a threshold: a range whose bounds add up to less can hold none of the k best. Only
the rest is scored. So results equal those over all documents, whatever is skipped.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedra.operators.ranking import terms
from sedra.sources.shared import bound_batches, cut, shuffles_removed

RANGE = 16  # documents of a range
FIRST = 32  # ranges of a query that give the threshold, for each k documents of a range's size
MOST_TERMS = 10_000  # terms that a scan of postings is asked for by name; more are found by a join alone
MOST_ASKED = 100_000  # terms of all queries together that every task is given; more are dealt out
DIGITS = 9  # of scores; sums of the same parts in another order may differ beyond
ROWS = 10_000  # blocks that leave a task at a time


@dataclass(frozen=True)
class Config:
    """BM25's k1 (saturation of term counts) and b (weight of length)."""

    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self) -> None:
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError(f"{self}: need k1 >= 0 and 0 <= b <= 1")


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _range_blocks(number: int, docs: pa.Array, sizes: list[int], words: list[str]) -> pa.RecordBatch:
    """The blocks of a range, and a row without a term that has the lengths of all its documents."""
    met: dict[str, list[int]] = defaultdict(list)
    for place, text in enumerate(words):
        for term, count in Counter(text.split(" ")).items() if text else ():
            met[term].append(place << 32 | count)
    lengths = np.fromiter(map(len, met.values()), np.int32, len(met))
    both = np.fromiter(chain.from_iterable(met.values()), np.int64, int(lengths.sum()))
    places, counts, own = both >> 32, (both & 0xFFFFFFFF).astype(np.int32), np.asarray(sizes, np.int32)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    most = np.maximum.reduceat(counts, starts[:-1]) if met else counts
    least = np.minimum.reduceat(own[places], starts[:-1]) if met else counts
    at, all_at = np.concatenate([[0], starts]).astype(np.int32), np.concatenate([[0], starts + len(own)]).astype(np.int32)
    return pa.RecordBatch.from_pydict({
        "term": pa.array([None, *met], pa.string()),
        "range": pa.array(np.full(len(met) + 1, number, np.int64)),
        "n": pa.array(np.concatenate([[len(own)], lengths]).astype(np.int32)),
        "most": pa.array(np.concatenate([[0], most]).astype(np.int32)),
        "least": pa.array(np.concatenate([[0], least]).astype(np.int32)),
        "docs": pa.ListArray.from_arrays(pa.array(at), docs.take(pa.array(places))),
        "counts": pa.ListArray.from_arrays(pa.array(at), pa.array(counts)),
        "sizes": pa.ListArray.from_arrays(pa.array(all_at), pa.array(np.concatenate([own, own[places]]))),
    })


def _blocks_of(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(term, range, n, most, least, docs, counts, sizes): the blocks of all documents, those of a range in one task, and its row without a term."""
    words = terms(F.coalesce("text", F.lit("")))
    dealt = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")).repartitionByRange(F.length("text"), "doc")  # as texts: the bounds of the ranges take a pass over them
    own = dealt.select("doc", words.alias("words")).select("doc", F.size("words").alias("size"), F.array_join("words", " ").alias("words"))
    width, kind = RANGE, own.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made, held = TaskContext.get().partitionId() << 32, [], None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            while held is not None and held.num_rows >= (width if batch is not None else 1):
                now, held = held.slice(0, width), held.slice(width)
                made.append(_range_blocks(number, now["doc"].combine_chunks(), now["size"].to_pylist(), now["words"].to_pylist()))
                number += 1
                if sum(m.num_rows for m in made) >= ROWS:
                    yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                    made = []
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    bound_batches(documents.sparkSession)
    kinds = f"term string, range long, n int, most int, least int, docs array<{kind}>, counts array<int>, sizes array<int>"
    return own.sortWithinPartitions("size", "doc").mapInArrow(run, kinds)


def build(documents: DataFrame, path: str, config: Config | None = None, doc: str = "doc_id", text: str = "document") -> None:
    """Write the index of documents (doc: unique, text) to a folder: blocks, a row a term in `terms`, and a row in `stats`. A null text has no terms."""
    config, spark = config or Config(), documents.sparkSession
    with shuffles_removed(spark):
        _blocks_of(documents, doc, text).sortWithinPartitions("term", "range").write.parquet(f"{path}/blocks")
        blocks = spark.read.parquet(f"{path}/blocks")
        total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
        n, size = blocks.where(F.col("term").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(total), F.lit(0))).first()
        spark.createDataFrame([(n, size / n if size else 1.0, float(config.k1), float(config.b))], "n long, mean double, k1 double, b double").write.parquet(f"{path}/stats")
        known = blocks.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("df"))
        known.select("term", "df", idf(F.lit(n), F.col("df")).alias("idf")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")


def _asked(queries: DataFrame, path: str) -> DataFrame:
    """(query_id, term, gain): the distinct known terms of each query, with how often it has them times their idf."""
    own = queries.select("query_id", F.explode(terms(F.coalesce("query", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("asked"))
    known = queries.sparkSession.read.parquet(f"{path}/terms")
    return own.join(known, "term").select("query_id", "term", (F.col("asked") * F.col("idf")).alias("gain"))


def _weight(spark: SparkSession, path: str):
    """What a term weighs in a document by its count there and the document's length."""
    stats = spark.read.parquet(f"{path}/stats").first()
    k1, b, mean = stats["k1"], stats["b"], stats["mean"]
    return lambda count, size: count * (k1 + 1) / (count + k1 * (1 - b + b * size / F.lit(mean)))


def _blocks(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The blocks, filtered by the queries' terms if these are few enough to name; a file's rows lie by term."""
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("term").isNotNull())
    named = [r["term"] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    return blocks.where(F.col("term").isin(named)) if len(named) <= MOST_TERMS else blocks


def _scored(met: DataFrame, weight) -> DataFrame:
    """(query_id, doc, score) of all documents in the blocks of queries' ranges (query_id, range, met, threshold) that reach the threshold. A document is of one range."""
    rows = met.select("query_id", "range", "threshold", F.explode("met").alias("m")).select("query_id", "range", "threshold", "m.gain", F.explode(F.arrays_zip("m.docs", "m.counts", "m.sizes")).alias("d"))
    score = F.round(F.sum(F.col("gain") * weight(F.col("d.counts"), F.col("d.sizes"))), DIGITS)
    scored = rows.groupBy("query_id", "range", "threshold", F.col("d.docs").alias("doc")).agg(score.alias("score"))
    return scored.where(F.col("score") >= F.col("threshold")).select("query_id", "doc", "score")


def plan(queries: DataFrame, path: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(asked, blocks, the scores of the first ranges, the ranges that are to be scored besides, each with its blocks and the threshold) of a search."""
    spark = queries.sparkSession
    weight, asked = _weight(spark, path), cut(_asked(queries, path))
    blocks = _blocks(spark, path, asked)
    few = asked.count() <= MOST_ASKED
    given = F.broadcast(asked) if few else asked
    most = F.sum(F.col("gain") * weight(F.col("most"), F.col("least"))).alias("bound")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
    bound = blocks.select("term", "range", "most", "least").join(given, "term").groupBy("query_id", "range").agg(most)
    first = cut(bound.withColumn("place", place).where(F.col("place") <= FIRST * -(-k // RANGE)).select("query_id", "range"))
    met = F.collect_list(F.struct("gain", "docs", "counts", "sizes")).alias("met")
    early = blocks.join(given, "term").join(first, ["query_id", "range"], "left_semi").groupBy("query_id", "range").agg(met)
    scored = cut(_scored(early.withColumn("threshold", F.lit(0.0)), weight))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    least = scored.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("score").alias("threshold"))
    held = cut(asked.join(least, "query_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0))))
    # Blocks are dealt by range once: sums, postings and scores of a range are then of one task, whatever the queries are.
    # Sums of floats: a bound that is a little under the threshold might still reach it.
    late = blocks.repartition("range").join(F.broadcast(held) if few else held, "term")
    sums = late.groupBy("query_id", "range", "threshold").agg(most, met).where(F.col("threshold") <= F.col("bound") * (1 + 1e-9) + 10.0**-DIGITS)
    return asked, blocks, scored, sums.join(first, ["query_id", "range"], "left_anti").select("query_id", "range", "met", "threshold")


def search(queries: DataFrame, path: str, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query (query_id: unique, query) by BM25, ties to the smaller document; those without any term of the query are none."""
    _, _, scored, rest = plan(queries, path, k)
    both = scored.unionByName(_scored(rest, _weight(queries.sparkSession, path)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("doc").alias("doc_id"), "score", "rank")
