"""Licence scan by a positional index of rare tokens, in DataFrame functions alone.

A template is a licence's text or a phrase, as a sequence of words. Words are ranked by inverse document frequency over
the set of templates; each template's highest, up to RARE, go into the index with their offsets. A file's words are looked up in
it, and each posting proposes a start of its template: the word's place less its offset. Proposals that agree are one, and
the postings that stand at their relative positions from it are counted, so any share of a template's rare words can find
it, whichever of them were changed. A template is found where enough of them are in place and its mandatory key phrase
stands whole near where it should. A base phrase has all its words in the index, all required: it is found exactly where
they stand consecutively.

Everything is row-local: no shuffle, no Python, and no state that grows with the corpus.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedra.llm.shared import UPPER, ascii_lower

#: What separates words, in lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEXTS = Path(__file__).with_name("data") / "licences.txt"  # templates that add labels of the method's own
RARE = 12  # indexed words of a template at most, and half of a shorter one's, so that its common words stay out
ENOUGH = 0.5  # share of them that must stand in place in a text with more words than that,
ENOUGH_SHORT = 0.7  # and in a shorter phrase
SLACK = 8  # words by which a key phrase may be off its place, where words before it were put in or left out
_SHIFT = 1 << 16  # more than any template's words


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  # mandatory phrase, part of the text
    base: bool = False


#: The base phrases and their labels.
BASE = (Template("mit", "mit license", "mit license", True), Template("apache", "apache license", "apache license", True), Template("gpl", "general public license", "general public license", True))


def words_of(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.translate(str.maketrans(UPPER, UPPER.lower()))) if w]


@cache
def templates() -> tuple[Template, ...]:
    """The base phrases, and the texts of the resource file."""
    out, head = list(BASE), None
    for line in [*TEXTS.read_text(encoding="utf-8").splitlines(), "== end | end"]:
        if line.startswith("== "):
            if head:
                out.append(Template(head[0], " ".join(words_of(" ".join(body))), head[1]))
            head, body = [x.strip() for x in line[3:].split("|")], []
        elif head:
            body.append(line)
    return tuple(out)


@dataclass(frozen=True)
class Indexed:
    template: Template
    rare: tuple[tuple[int, str], ...]  # offset, word
    key: tuple[str, ...]
    key_at: int  # its offset
    needed: int


def index(texts: tuple[Template, ...] | None = None) -> list[Indexed]:
    """Each template's distinct words by IDF over the templates, the highest first; equal IDF: in an order that spreads over the text."""
    texts = templates() if texts is None else texts
    split = [t.text.split() for t in texts]
    df: dict[str, int] = {}
    for words in split:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = []
    for t, words in zip(texts, split, strict=True):
        key = t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        if t.base:
            rare, needed = list(range(len(words))), len(words)
        else:
            first = sorted({w: i for i, w in reversed(list(enumerate(words)))}.values(), key=lambda i: (-math.log(len(texts) / df[words[i]]), zlib.crc32(words[i].encode()), i))
            rare = sorted(first[: min(RARE, max(3, len(words) // 2))])
            needed = math.ceil((ENOUGH if len(words) > RARE else ENOUGH_SHORT) * len(rare))
        out.append(Indexed(t, tuple((i, words[i]) for i in rare), tuple(key), at, needed))
    return out


def _postings(idx: list[Indexed]) -> dict[str, list[tuple[int, int]]]:
    """By word: (template number, offset)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(idx):
        for off, w in t.rare:
            out.setdefault(w, []).append((k, off))
    return out


def scan(df: DataFrame, text: str = "text", texts: tuple[Template, ...] | None = None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score to every row of df; a column of df with such a name is replaced.

    A null text counts as empty: no words, no labels, score 0. A text of any length is scanned whole; each place of an
    indexed word is looked at once for each of its postings, so repeated words cost their own number. score is the
    largest share of a found template's indexed words that stand in place. Repeated rows get equal results.
    """
    idx = index(texts)
    posts = _postings(idx)
    # A proposal is one number: the template's, and the start moved up so that it isn't negative.
    by_word = F.create_map(*[x for w, own in sorted(posts.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(k).cast("long").alias("tid"), F.lit(off).alias("off")) for k, off in own]))])
    about = F.array(*[
        F.struct(F.array(*[F.struct(F.lit(i).alias("off"), F.lit(w).alias("word")) for i, w in t.rare]).alias("rare"), F.array(*map(F.lit, t.key)).alias("key"), F.lit(t.key_at).alias("at"), F.lit(t.needed).alias("needed"), F.lit(float(len(t.rare))).alias("n"), F.lit(t.template.label).alias("label"), F.lit(t.template.base).alias("base"))
        for t in idx
    ])
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = [c for c in df.columns if c not in added]
    # df's columns travel in one struct, so that no name of theirs meets one used here.
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("_")).alias("_row"), F.array_remove(F.split(ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), GAP), "").alias("_words"))
    words = F.col("_words")
    places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: x["word"].isin(sorted(posts)))
    # Files without an indexed word skip the search.
    out = out.withColumn("_places", places).withColumn("_index", F.when(F.size("_places") > 0, by_word)).withColumn("_about", F.when(F.size("_places") > 0, about))
    proposed = F.array_distinct(F.flatten(F.transform(F.col("_places"), lambda p: F.transform(F.element_at(F.col("_index"), p["word"]), lambda q: (q["tid"] * (1 << 32)) + p["pos"] - q["off"] + _SHIFT))))
    started = F.transform(F.when(F.size("_places") > 0, proposed), lambda c: F.struct((F.pmod(c, F.lit(1 << 32)) - _SHIFT).cast("int").alias("start"), F.element_at(F.col("_about"), F.shiftright(c, 32).cast("int") + 1).alias("t")))
    counted = F.transform(started, lambda c: F.struct(c["start"].alias("start"), c["t"].alias("t"), F.size(F.filter(c["t"]["rare"], lambda r: F.get(words, c["start"] + r["off"]) == r["word"])).alias("hits")))
    enough = F.filter(counted, lambda c: c["hits"] >= c["t"]["needed"])

    def keyed(c: Column) -> Column:
        from_ = c["start"] + c["t"]["at"] - F.when(c["t"]["base"], 0).otherwise(SLACK)
        tries = F.sequence(F.greatest(F.lit(0), from_), F.greatest(F.lit(0), from_ + F.when(c["t"]["base"], 0).otherwise(2 * SLACK)))
        return F.exists(tries, lambda s: F.slice(words, s + 1, F.size(c["t"]["key"])) == c["t"]["key"])

    found = F.transform(F.filter(enough, keyed), lambda c: F.struct(c["start"].alias("start"), c["t"]["label"].alias("label"), c["t"]["base"].alias("base"), (c["hits"] / c["t"]["n"]).alias("share")))
    out = out.withColumn("_found", F.coalesce(found, F.array().cast("array<struct<start:int,label:string,base:boolean,share:double>>")))
    base = F.filter(F.col("_found"), lambda c: c["base"])
    starts = F.transform(F.col("_base"), lambda c: c["start"].cast("long"))
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda c: c["label"]))), ",")
    return out.withColumn("_base", base).select(
        *[F.col("_row").getField(c).alias(c) for c in kept],
        F.size(words).cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(F.col("_base")).alias("base_labels"),
        names(F.col("_found")).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.col("_found"), lambda c: c["share"])), F.lit(0.0)).alias("score"),
    )


def scan_sql() -> str:
    """The same definition for DuckDB: places and postings joined on the word, counted by template and start."""
    idx = index()
    low = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
    posts = ", ".join(f"({k}, {off}, '{w}')" for k, t in enumerate(idx) for off, w in t.rare)
    about = ", ".join(f"({k}, '{t.template.label}', {str(t.template.base).lower()}, {t.needed}, {len(t.rare)}, {t.key_at}, {list(t.key)}, {0 if t.template.base else SLACK})" for k, t in enumerate(idx))
    return f"""
    with split_text as materialized (select row_number() over () as rid, doc_id, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
    posts(tid, off, word) as (values {posts}), about(tid, label, base, needed, n, key_at, key, slack) as (values {about}),
    places as (select rid, unnest(w) as word, unnest(range(len(w))) as pos from split_text),
    counted as (select rid, tid, pos - off as start, count(*) as hits from places join posts using (word) group by all),
    found as (select rid, start, label, base, hits / n::double as share from counted join about using (tid) join split_text using (rid)
      where hits >= needed and len(list_filter(range(greatest(0, start + key_at - slack), greatest(0, start + key_at + slack) + 1), lambda s: w[s + 1 : s + len(key)] = key)) > 0),
    told as (select rid, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
      array_to_string(list_sort(list(distinct label) filter (base)), ',') as base_labels, array_to_string(list_sort(list(distinct label)), ',') as labels, max(share) as score from found group by rid)
    select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
      coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
    from split_text left join told using (rid)"""
