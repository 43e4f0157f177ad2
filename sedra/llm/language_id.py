"""Language identification by a string kernel.

The kernel of two texts is the number of n-grams of 1 to 4 characters that both contain, presence only, over the root of
the numbers that each contains. Landmark texts span a Nyström approximation of it, and a one-versus-rest kernel ridge
regression on the Nyström features gives each language a function. A landmark's kernel with a text is a sum over the
text's n-grams, so landmarks and regression fold into one matrix of n-gram weights: a batch is scored by the product of
its presence matrix with that matrix.

Texts are lower-cased, and each run of other characters than letters is one space. N-grams are hashed to 2^20 buckets.
The landmarks' n-grams are kept as one bit for each landmark and bucket: 32 MB at most for 256 landmarks. The model holds
4 bytes for each bucket and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from sedra.llm.hashing import chunks
from sedra.llm.shared import in_batches

SIZES = 4  # longest n-gram
BUCKET_BITS = 20
SAMPLE = 2400  # texts that the model is fitted on, in equal shares for the languages, and so the most languages that are learned, the most frequent first; this bound does not grow with the input
SAMPLE_CHARS = 20_000  # longer texts are fitted on only for a language that has no others; every text is predicted whole
LANDMARKS = 256
RIDGE = 1e-2
SEED = 17
UNKNOWN = "und"
_CHUNK = 400_000  # characters
_ROWS = 1 << 14  # of the landmarks' bits that are unpacked at once

_tables: dict[str, np.ndarray] = {}


def _folding() -> np.ndarray:
    """By code point: the lower-case letter, or a space for anything but letters."""
    if "fold" not in _tables:
        top = 0x110000
        fold = np.full(top, 32, np.uint32)
        for c in range(0x32400):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                low = chr(c).lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _tables["fold"] = fold
    return _tables["fold"]


def _ngrams(c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, the bucket of the n-gram that begins at each place) for n of 1 to SIZES, in a stream of folded code points."""
    h = np.zeros(len(c), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, min(SIZES, len(c)) + 1):
            h = (h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            yield n, (h * np.uint32(0x85EBCA77 + 2 * n)) >> np.uint32(32 - BUCKET_BITS)


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text numbers, buckets): each distinct n-gram bucket of each text, sorted; and whether a text has a letter. At most 4096 texts."""
    if len(texts) == 1 and texts[0] and len(texts[0]) > _CHUNK:
        return _presence_of_long(texts[0])
    padded = [f" {t} " if t else "  " for t in texts]
    lens = np.fromiter(map(len, padded), np.int64, len(padded))
    raw = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint32), lens)
    c = _folding()[raw]
    letter = c != 32
    has = np.bincount(doc, weights=letter, minlength=len(texts)) > 0
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    c, doc = c[keep], doc[keep]
    out = [((doc[: len(key)] << np.uint32(BUCKET_BITS)) | key)[doc[: len(key)] == doc[n - 1 :]] for n, key in _ngrams(c)]
    keys = np.sort(np.concatenate(out)) if out else np.empty(0, np.uint32)
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return (keys >> np.uint32(BUCKET_BITS)).astype(np.int64), (keys & np.uint32((1 << BUCKET_BITS) - 1)).astype(np.int64), has


def _presence_of_long(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """presence() of one long text, in pieces that carry the end of the folded stream over: memory of a piece and of a mark a bucket."""
    marks, has = np.zeros(1 << BUCKET_BITS, bool), False
    held, after_letter = np.empty(0, np.uint32), True  # the stream's first space counts
    for i in range(0, len(text), _CHUNK):
        piece = " " * (i == 0) + text[i : i + _CHUNK] + " " * (i + _CHUNK >= len(text))
        c = _folding()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        letter = c != 32
        has = has or bool(letter.any())
        keep = letter | np.concatenate(([after_letter], letter[:-1]))
        after_letter = bool(letter[-1])
        stream = np.concatenate((held, c[keep]))
        for _, key in _ngrams(stream):
            marks[key] = True
        held = stream[max(0, len(stream) - SIZES + 1) :]
    own = np.flatnonzero(marks)
    return np.zeros(len(own), np.int64), own, np.array([has])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    for i, j in chunks(texts, _CHUNK):
        for k in range(i, j, 4096):
            yield k, min(j, k + 4096)


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # sorted buckets
    weights: np.ndarray  # grams x languages
    bias: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages, whether a text has a letter)."""
        place = np.zeros(1 << BUCKET_BITS, np.int32)
        place[self.grams] = np.arange(1, len(self.grams) + 1)
        out, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        for i, j in _groups(texts):
            doc, gram, letters[i:j] = presence(texts[i:j])
            own = np.bincount(doc, minlength=j - i)
            at = place[gram]
            doc, at = doc[at > 0], at[at > 0] - 1
            if len(doc):
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                out[i + doc[first]] = np.add.reduceat(self.weights[at], first, axis=0, dtype=np.float64)
            out[i:j] /= np.sqrt(np.maximum(own, 1))[:, None]
        return out + self.bias, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The best language, the first by name on ties, and its function's value taken from -1..1 to 0..1; `und` and 0 for null or no letter."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        f, letters = self.scores(texts)
        best = f.argmax(axis=1)
        score = np.clip((f.max(axis=1) + 1) / 2, 0.0, 1.0)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def fit(texts: list[str], langs: list[str]) -> Model:
    """Kernel ridge regression on Nyström features; the landmarks are the first texts of each language, in equal shares."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.empty(0, np.int64), np.empty((0, 0)), np.empty(0))
    label = np.searchsorted(names, langs)
    share = -(-LANDMARKS // len(names))
    marks = np.sort(np.concatenate([np.flatnonzero(label == c)[:share] for c in range(len(names))]))
    found = [(np.searchsorted(marks, marks[i:j]), *presence([texts[t] for t in marks[i:j]])[:2]) for i, j in _groups([texts[t] for t in marks])]
    grams = np.unique(np.concatenate([g for _, _, g in found]))
    bits = np.zeros((len(grams), -(-len(marks) // 8)), np.uint8)  # which landmarks hold a gram
    norm = np.ones(len(marks))
    for own, doc, gram in found:
        np.bitwise_or.at(bits, (np.searchsorted(grams, gram), own[doc] >> 3), (128 >> (own[doc] & 7)).astype(np.uint8))
        norm[own] = np.sqrt(np.maximum(np.bincount(doc, minlength=len(own)), 1))
    held = lambda rows: np.unpackbits(bits[rows], axis=1, count=len(marks))
    kernel = np.zeros((len(texts), len(marks)))
    for i, j in _groups(texts):
        doc, gram, _ = presence(texts[i:j])
        edge = np.searchsorted(doc, np.arange(j - i + 1))
        at = np.searchsorted(grams, gram).clip(max=len(grams) - 1)
        known = grams[at] == gram
        for t in range(j - i):
            own = at[edge[t] : edge[t + 1]][known[edge[t] : edge[t + 1]]]
            both = sum((held(own[x : x + _ROWS]).sum(axis=0, dtype=np.int64) for x in range(0, len(own), _ROWS)), np.zeros(len(marks), np.int64))
            kernel[i + t] = both / (norm * np.sqrt(max(1, edge[t + 1] - edge[t])))
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    mean_f, mean_t = features.mean(axis=0), target.mean(axis=0)
    centred = features - mean_f
    solved = np.linalg.solve(centred.T @ centred + RIDGE * len(texts) / len(names) * np.eye(features.shape[1]), centred.T @ (target - mean_t))
    if len(names) == 1:
        mean_t = np.ones(1)
    folded = (root @ solved) / norm[:, None]
    weights = np.concatenate([(held(slice(x, x + _ROWS)) @ folded).astype(np.float32) for x in range(0, len(grams), _ROWS)])
    return Model(names, grams, weights, mean_t - mean_f @ solved)


def held_out(key: Column) -> Column:
    """crc32 of the key as text, mod 4, is 2; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list[str], list[str]]:
    """Up to SAMPLE labelled texts that are not held out, in equal shares for the languages, chosen by a hash of the key; rows without key, lang or letter take no part.

    A language's texts of up to SAMPLE_CHARS are taken. One that gets none by that gets its shortest distinct texts: the
    first, and more as long as they fit in what its share may hold.
    """
    pick = (F.pmod(F.xxhash64("k", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("at")
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("x"), F.col(lang).alias("l"))
    rows = rows.where(F.col("k").isNotNull() & F.col("l").isNotNull() & F.col("x").rlike(r"\p{L}") & ~held_out(F.col("k"))).select("k", "x", "l", pick, F.length("x").alias("size"))
    short = F.col("size") <= SAMPLE_CHARS
    counts = {r["l"]: r["short"] for r in rows.groupBy("l").agg(F.count("*").alias("n"), F.count_if(short).alias("short")).orderBy(F.desc("n"), "l").limit(SAMPLE).collect()}
    if not counts:
        return [], []
    share = max(1, SAMPLE // len(counts))
    most = F.create_map(*[F.lit(v) for name, n in counts.items() for v in (name, min(1.0, (1.5 * share + 20) / max(n, 1)))])
    own = rows.where(short & (F.col("at") < F.element_at(most, F.col("l")))).withColumn("place", F.row_number().over(Window.partitionBy("l").orderBy("at", "k", "x")))
    found = own.where(F.col("place") <= share).select("at", "k", "x", "l").collect()
    lacking = sorted(set(counts) - {r["l"] for r in found})
    if lacking:
        found += _shortest(rows.where(F.col("l").isin(lacking)), share).select("at", "k", "x", "l").collect()
    found.sort(key=lambda r: (r["at"], r["k"], r["x"]))
    return [r["x"] for r in found], [r["l"] for r in found]


def _shortest(rows: DataFrame, share: int) -> DataFrame:
    """The shortest distinct texts of each language: one at least, and up to share while they have share * SAMPLE_CHARS characters at most. They are chosen by size before any text is moved."""
    rows = rows.withColumn("digest", F.xxhash64("x"))
    by = Window.partitionBy("l").orderBy("size", "at", "k", "digest")
    placed = rows.select("l", "k", "at", "size", "digest").distinct().withColumn("place", F.row_number().over(by)).where(F.col("place") <= share)
    taken = placed.withColumn("sum", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("place") == 1) | (F.col("sum") <= share * SAMPLE_CHARS))
    names = ["l", "k", "size", "digest"]
    return rows.join(F.broadcast(taken.select(*names)), names, "left_semi").dropDuplicates(names)


def tag(df: DataFrame, model: Model, text: str = "text", letters: str | None = None) -> DataFrame:
    """df with lang_pred and score, from the whole text alone, and whether it has a letter as `letters` if that is given; a column of df with such a name is replaced."""
    more = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), *([StructField(letters, BooleanType())] if letters else [])]
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in {f.name for f in more}])
    at, names = kept.columns.index(text), [*kept.columns, *(f.name for f in more)]
    kept = kept.toDF(*[f"c{k}" for k in range(len(kept.columns))])  # names with dots can't be handed over
    shipped = df.sparkSession.sparkContext.broadcast(model)  # bounded by the n-grams of LANDMARKS texts and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            langs, score = shipped.value.predict(texts)
            found = [pa.array(langs, pa.string()), pa.array(score, pa.float64()), *([pa.array(map(has_letter, texts), pa.bool_())] if letters else [])]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], names=[*b.schema.names, *(f.name for f in more)])

    return in_batches(kept, run, StructType([*kept.schema.fields, *more])).toDF(*names)


def identify(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score) for each row of df, from its whole text alone; other columns are not read."""
    out = tag(df.select(F.col(key).alias("k"), F.col(text).alias("x")), model, "x")
    return out.select(F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "lang_pred", "score")


def fit_and_identify(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """identify() by a model fitted on training_sample(). Without labelled rows every prediction is `und`. An empty table gives none; repeated rows get equal results."""
    return identify(df, fit(*training_sample(df, text, lang, key)), text, key)
