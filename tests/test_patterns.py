"""Java's own spellings of the patterns find what the shared spellings find."""

import random

import pytest
from pyspark.sql import functions as F

from sedra.functions import patterns as P
from sedra.functions import text as T

#: Java's spelling, and the shared one.
PAIRS = {
    "words": (f"{P.JAVA_WORD}+", f"[{P.WORD}]+"),
    "tokens": (f"[^{P.JAVA_WS}]+", f"[^{P.WS}]+"),
    "two newlines": (rf"\n{P.JAVA_WS}*\n{P.JAVA_WS}*\n+", rf"\n[{P.WS}]*\n[{P.WS}]*\n+"),
    "single letters": (P.JAVA_SINGLE_LETTER, rf"(?<![{P.WORD}])[A-Za-z](?![{P.WORD}])"),
    "number lines": (rf"(?md)^{P.JAVA_WS}*{P.JAVA_DIGIT}+{P.JAVA_WS}*$", rf"(?md)^[{P.WS}]*\p{{Nd}}+[{P.WS}]*$"),
    "emails": (P.JAVA_EMAIL, P.bounded(P.EMAIL)),
    "disallowed": (P.JAVA_DISALLOWED, P.DISALLOWED),
    "sentence ends": (P.JAVA_AFTER_SENTENCE, rf"(?<=[{P.SENTENCE_END}])[{P.WS}]+"),
    "numbers": (P.JAVA_NUMBER, P.bounded(P.NUMBER)),
    "dates": (P.JAVA_DATE, P.bounded(P.DATE)),
    "names": (P.JAVA_NAME, P.bounded(P.NAME)),
    "phrases": (P.JAVA_PHRASE, P.bounded(P.PHRASE)),
}
PIECES = [*"abzAZ09_-/.,!?@%+|()[]{}\"'\\~* \t\n\r\x1c\x1f", "\x85", "\xa0", " ", "　", " ", "​", "é", "đ", "ạ", "Ạ", "ß", "é", "٣", "½", "中", "。", "ab", "Don", "12", "3/4/2024", "x@y.zz", "\x80", "\xff", "퟿", "\n\n", "\n \n\n", "\n7\n", " q "]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000)]))
    rows = ["".join(rng.choices(PIECES, k=rng.randrange(1, 40))) for _ in range(4000)] + [every, " ".join(every), ""]
    return spark.createDataFrame([(r,) for r in rows], "text string").cache()


@pytest.mark.parametrize("name", PAIRS)
def test_same_matches(texts, name):
    own, shared = (F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in PAIRS[name])
    assert texts.where(F.size(own) > 0).count() > 10
    assert texts.where(~own.eqNullSafe(shared)).count() == 0


def test_tokens_are_those_of_a_split(texts):
    assert texts.where(~T.tokens(F.col("text")).eqNullSafe(F.filter(F.split("text", f"[{P.WS}]+"), lambda t: t != ""))).count() == 0


def test_ascii_is_looked_up_at_once():
    """Each spelling tries no more than a table and a range for an ASCII character: members below U+0080 are listed one by one, first."""
    for p in (P.JAVA_WS, P.JAVA_WORD, P.JAVA_DIGIT, P.JAVA_PHRASE_LETTER):
        assert p.startswith("[[") and r"&&[" in p.split("]", 1)[1]


def test_letters_and_digits_beyond_the_basic_plane_are_words(spark):
    """The shared spellings look back by UTF-16 units in Java, and took half a letter for none."""
    df = spark.createDataFrame([("𝒜b a𝟗 𝟗𝟗 𝒜12 12𝒜 x 😀y 😀7",)], "text string")
    got = df.select(T.drop_single_letters(F.col("text")), T.numbers(F.col("text")), T.words(F.col("text"))).first()
    assert list(got) == ["𝒜b a𝟗 𝟗𝟗 𝒜12 12𝒜  😀 😀7", ["𝟗𝟗", "7"], ["𝒜b", "a𝟗", "𝟗𝟗", "𝒜12", "12𝒜", "x", "y", "7"]]
