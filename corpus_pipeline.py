"""The corpus pipeline: four stages over the documents table, each by one operator of sedra.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedra.llm import language_id, mixing, sentencepiece_codec, simhash
from sedra.llm.queries import TOKENIZERS
from sedra.llm.shared import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the language found in the text, or to `und` where no labelled text can be learned from; only a document without a letter goes."""
    model = language_id.fit(*language_id.training_sample(docs))
    tagged = language_id.tag(docs.select(*COLUMNS), model, letters="letter").where("letter")
    return tagged.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of linked fingerprints."""
    return simhash.representatives(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each leaf's documents as often as its budget has epochs for."""
    return mixing.mix_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text decoded from them."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.load(f"{TOKENIZERS}/piece_bpe_32k.model"), verify=True)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: XXH64, the kernel machine and the tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's rows written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
