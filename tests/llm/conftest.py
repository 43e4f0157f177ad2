"""A table with every odd case, and clashing names."""

from __future__ import annotations

import pytest

LONG = ("Lorem ipsum dolor sit amet " * 12_000).strip()
ODD = [
    (1, "", "en", "src0"), (2, None, "de", "src1"), (3, "word", None, "src0"), (4, "word", "en", None), (5, LONG, "en", "src0"), (5, LONG, "en", "src0"),
    (6, "?!.. 123", "fr", "src2"), (None, "a text without an id of its own", "en", "src0"), (7, "日本語のテキスト 😀 Ünï\u0301 ﬁ\x00\t\n x", "ja", "src3"),
    (8, "the mit license, the MIT License and the GNU General Public License", "en", "src0"), (9, "   \n\t ", "en", "src0"), (10, "x" * 5000, "en", "src0"),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").repartition(3)
    for name in ("k", "x", "fp", "score", "labels", "lang_pred", "row", "ord", "bucket", "epoch", "domain", "key", "u", "v", "_words", "_row", "_kept", "n_tokens", "component_id", "a.b"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
