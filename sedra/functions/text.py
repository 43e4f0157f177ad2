"""Text as Column expressions: cleaning stages, words, sentences, features.

Everything but NFC stays in the JVM. NFC goes to Python only for texts that hold a character which composition can touch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sedra.functions import patterns as P
from sedra.sources.shared import bound_batches


def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode normal form C. Characters below U+0300 are in it already, so other texts only are handed to Python."""
    bound_batches()
    return F.coalesce(F.pandas_udf(_nfc, "string")(F.when(text.rlike(r"[^\x{0}-\x{2ff}]"), text)), text)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once: a lambda that names an expression works it out for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rounded(value: Column, digits: int) -> Column:
    """F.round() of a double, which goes by way of its decimal digits: for these only where the value is near a tie, or large; else the nearest whole number of units is clear."""
    units = value * 10.0**digits
    clear = (F.abs(units) < 2.0**32) & (F.abs(units - F.rint(units)) < 0.4999)
    return F.when(clear, F.rint(units) / 10.0**digits + 0.0).otherwise(F.round(value, digits))


def strip(text: Column) -> Column:
    """Without white space (all of Unicode's, not just spaces) at both ends."""
    return F.btrim(text, F.lit(P.WS_CHARS))


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, P.ZERO_WIDTH, "")


def straight_quotes(text: Column) -> Column:
    """ASCII quote, backtick and acute become a double quote. Curly quotes stay."""
    return F.translate(text, P.DOUBLE_QUOTES, '"' * len(P.DOUBLE_QUOTES))


def straight_low_quote(text: Column) -> Column:
    return F.translate(text, P.LOW_QUOTE, "'")


def plain_dashes(text: Column) -> Column:
    return F.translate(text, P.DASHES, "-" * len(P.DASHES))


def plain_ellipsis(text: Column) -> Column:
    return F.replace(text, F.lit("…"), F.lit("..."))


def single_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " +", " ")


def two_newlines(text: Column) -> Column:
    return F.regexp_replace(text, rf"\n{P.JAVA_WS}*\n{P.JAVA_WS}*\n+", "\n\n")


def rtrim_lines(text: Column) -> Column:
    """Each line without white space at its end; a line ends at a newline only."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.rtrim(line, F.lit(P.WS_CHARS))), "\n")


def drop_single_letters(text: Column) -> Column:
    """Every ASCII letter that stands alone goes: the t of don't as well."""
    return F.regexp_replace(text, P.JAVA_SINGLE_LETTER, "")


def short_punctuation(text: Column) -> Column:
    """Four dots or more become three; runs of ! or ? become one."""
    dots = F.regexp_replace(text, r"\.{4,}", "...")
    return F.regexp_replace(F.regexp_replace(dots, "!{2,}", "!"), r"\?{2,}", "?")


def drop_number_lines(text: Column) -> Column:
    """Lines of digits alone go, with white space around them, newlines included."""
    return F.regexp_replace(text, rf"(?md)^{P.JAVA_WS}*{P.JAVA_DIGIT}+{P.JAVA_WS}*$", "")


def drop_page_marks(text: Column) -> Column:
    return F.regexp_replace(text, P.PAGE_MARK, "")


def drop_urls(text: Column) -> Column:
    return F.regexp_replace(text, P.URL, "")


def drop_emails(text: Column) -> Column:
    return F.regexp_replace(text, P.JAVA_EMAIL, "")


def allowed_characters(text: Column) -> Column:
    """Anything but word characters, white space and common punctuation becomes a space."""
    return F.regexp_replace(text, P.JAVA_DISALLOWED, " ")


def drop_blank_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


#: The cleaning stages in their fixed order.
CLEANING: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("nfc", nfc),
    ("zero_width", strip_zero_width),
    ("quotes", straight_quotes),
    ("low_quote", straight_low_quote),
    ("dashes", plain_dashes),
    ("ellipsis", plain_ellipsis),
    ("spaces", single_spaces),
    ("newlines", two_newlines),
    ("rtrim_lines", rtrim_lines),
    ("single_letters", drop_single_letters),
    ("punctuation", short_punctuation),
    ("number_lines", drop_number_lines),
    ("page_marks", drop_page_marks),
    ("urls", drop_urls),
    ("emails", drop_emails),
    ("characters", allowed_characters),
    ("spaces_again", single_spaces),
    ("blank_lines", drop_blank_lines),
    ("strip", strip),
)


def clean(text: Column) -> Column:
    """All cleaning stages; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for _, stage in CLEANING:
        out = stage(out)
    return out


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(f"{P.JAVA_WORD}+"), 0)


def tokens(text: Column) -> Column:
    """What white space separates; no empty ones. By a pattern that is compiled once: split() compiles its own for every text."""
    return F.regexp_extract_all(text, F.lit(f"[^{P.JAVA_WS}]+"), 0)


def count_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def sentences(text: Column) -> Column:
    """Split after sentence ends that white space follows; stripped, without empty ones. Null gives none."""
    parts = F.split(F.coalesce(text, F.lit("")), P.JAVA_AFTER_SENTENCE)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def starts_with_connector(sentence: Column) -> Column:
    """A bare prefix test: a longer word that starts like a connector counts."""
    return F.exists(_strings(P.CONNECTORS), lambda c: F.startswith(F.lower(sentence), c))


def content_words(sentence: Column, stop_words: tuple[str, ...]) -> Column:
    """Distinct lower-case words but the stop words."""
    return F.array_except(words(F.lower(sentence)), _strings(stop_words))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0))


def should_group(previous: Column, current: Column) -> Column:
    """Whether a sentence goes on with the one before: it starts with a connector, either has no content words, or over a fifth of them are shared."""
    pair = F.struct(content_words(previous, P.GROUPING_STOP_WORDS).alias("a"), content_words(current, P.GROUPING_STOP_WORDS).alias("b"))
    shared = let(pair, lambda p: (F.size(p["a"]) == 0) | (F.size(p["b"]) == 0) | F.coalesce(jaccard(p["a"], p["b"]) > 0.2, F.lit(True)))
    return starts_with_connector(current) | shared


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.JAVA_NUMBER), 0)


def dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.JAVA_DATE), 0)


def names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(P.JAVA_NAME), 0)


def phrases(lowered: Column) -> Column:
    """Pairs of words that don't overlap, from lower-case text. Names can't occur in it, so there is no pattern for them."""
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(P.JAVA_PHRASE), 0))


def entities(text: Column) -> Column:
    return F.array_union(F.array_union(numbers(text), dates(text)), names(text))


def features(sentence: Column) -> Column:
    """The struct of a sentence's features; its arrays are sets."""
    return F.struct(
        content_words(sentence, P.FEATURE_STOP_WORDS).alias("words"),
        phrases(F.lower(sentence)).alias("noun_phrases"),
        entities(sentence).alias("entities"),
        F.length(sentence).alias("length"),
        count_tokens(sentence).alias("word_count"),
        sentence.alias("original"),
    )


def pair_similarity(a: Column, b: Column) -> Column:
    """Of two feature structs: half from words, a quarter from phrases, the rest from entities and length; sets that are both empty count as unlike."""
    part = lambda field: F.coalesce(jaccard(a[field], b[field]), F.lit(0.0))
    longest = F.greatest(a["length"], b["length"])
    apart = F.when(longest > 0, F.abs(a["length"] - b["length"]) / longest).otherwise(0.0)
    return F.lit(0.5) * part("words") + F.lit(0.25) * part("noun_phrases") + F.lit(0.15) * part("entities") + F.lit(0.1) * (F.lit(1.0) - apart)


def split_points(answer: Column) -> Column:
    """Sorted positions from a model's answer: the list after SPLIT_POINTS, or else the first ten numbers of two digits or more."""
    listed = F.regexp_extract(answer, rf"SPLIT_POINTS:[{P.WS}]*\[([\p{{Nd}},{P.WS}]+)\]", 1)
    found = F.when(listed != "", F.regexp_extract_all(listed, F.lit(r"(\p{Nd}+)"), 1)).otherwise(F.slice(F.regexp_extract_all(answer, F.lit(f"({P.bounded(r'\p{Nd}{2,}')})"), 1), 1, 10))
    return F.array_sort(F.transform(found, lambda x: x.try_cast("int")))
