"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut where no piece holds the two characters next to each other, which cuts it at least into words with the
spaces before them. Each distinct part of a batch is encoded once, and parts are told apart by 64-bit hash and length.
Parts of equal length stand in one matrix and advance together: hashes of all their substrings, from prefix hashes, probe
the sorted keys of the pieces, and at each position a maximum over the pieces that end there stores a backpointer.

For a unigram model the maximum is over the summed scores; paths whose sums differ by rounding alone are ties. A BPE model does not maximise a sum: there a piece scores only
if merging would keep it and the piece before it apart. For each prefix exactly one last piece does, and the path
through these is the result of the merges. Parts that may hold pieces of tied scores (runs of spaces) or of over LONG
characters are merged by an agenda instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedra.llm.hashing import chunks, within
from sedra.llm.sentencepiece_model import BASE, BPE, NEVER, SPACE, Tables, Vocabulary, finish
from sedra.llm.shared import in_batches

LONG = 64
CACHE = 1_000_000  # parts whose ids a worker keeps
_CHUNK = 1_000_000  # characters
_CELLS = 100_000  # characters of equal-length words that advance together


def load(path: str) -> Tables:
    with open(path, "rb") as f:
        return Tables(Vocabulary.parse(f.read()))


class Encoder:
    def __init__(self, tables: Tables) -> None:
        self.t = tables
        self.tied = tables.tied if tables.model_type == BPE else []
        # The ids of the parts met lately: sorted keys, and where in the pool.
        self.keys = np.empty(0, np.uint64)
        self.at, self.lens = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)
        self.asked = np.full(1 << 20, -1, np.int64)
        self.answers = np.zeros(1 << 20, bool)

    # -- parts of equal length ------------------------------------------------------------------------------------

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_stay_apart(), with an array of earlier answers: words share most of their pairs."""
        key = a.astype(np.int64) << 32 | b
        slot = (key ^ key >> 20) * 0x2545F491 >> 7 & (len(self.asked) - 1)
        out = self.answers[slot]
        new = np.flatnonzero(self.asked[slot] != key)
        if len(new):
            out[new] = self._stay_apart(a[new], b[new])
            self.asked[slot[new]] = key[new]
            self.answers[slot[new]] = out[new]
        return out

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of symbols a and b leaves just these two: whether no symbol on a's right edge ever joins one on b's left edge.

        Going back in time from a and b, the later of the two merges is undone; before that the edges x and y were
        neighbours until the next merge took either, at tx or ty, and their own merge would have had to come earlier.
        """
        t = self.t
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        tx = np.full(len(a), NEVER)
        ty = np.full(len(a), NEVER)
        while len(live):
            join = t.join_rank(x, y)
            bad = (join < tx) & (join <= ty) & (join < NEVER)
            ok[live[bad]] = False
            rx, ry = t.rank[x], t.rank[y]
            on = ~bad & ((rx > 0) | (ry > 0))
            live, x, y, tx, ty, rx, ry = (v[on] for v in (live, x, y, tx, ty, rx, ry))
            # Of two merges of one rank the left came first.
            back_y = ry >= rx
            ty = np.where(back_y, ry, ty)
            tx = np.where(back_y, tx, rx)
            x, y = np.where(back_y, x, t.right[x]), np.where(back_y, t.left[y], y)
        return ok

    def _matches(self, chars: np.ndarray) -> np.ndarray:
        """(words, ends, lengths): the symbol of that length that ends there, or -1; at length 1, a character that is no symbol has the number after the last."""
        t = self.t
        w, n = chars.shape
        most = min(t.longest, n)
        with np.errstate(over="ignore"):
            h = np.zeros((w, n + 1), np.uint64)
            for i in range(n):
                h[:, i + 1] = h[:, i] * BASE + chars[:, i] + np.uint64(1)
            out = np.full((w, n + 1, most + 1), -1, np.int32)
            power = np.uint64(1)
            for k in range(1, most + 1):
                power = power * BASE
                own = finish(h[:, k:] - h[:, :-k] * power)
                row, col = np.nonzero(t.maybe[own >> np.uint64(44)])
                probe = own[row, col]
                at = np.searchsorted(t.keys, probe).clip(max=len(t.keys) - 1)
                hit = t.keys[at] == probe
                out[row[hit], col[hit] + k, k] = t.key_symbols[at[hit]]
        single = out[:, 1:, 1]
        single[single < 0] = len(t.symbol_ids)
        return out

    def _viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words of equal length, word after word, and how many each has."""
        t = self.t
        w, n = chars.shape
        match = self._matches(chars)
        most = match.shape[2] - 1
        best = np.full((w, n + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back = np.zeros((w, n + 1), np.int64)
        last = np.full((w, n + 1), -1, np.int64)
        scores = np.append(t.symbol_scores, t.unknown_score)
        rows = np.arange(w)
        for i in range(1, n + 1):
            top = min(most, i)
            lens = np.arange(top, 0, -1)  # the longest first: it wins ties
            own = match[:, i, top:0:-1]
            found = own >= 0
            if t.model_type == BPE:
                value = np.full(own.shape, -np.inf, np.float32)
                r, c = np.nonzero(found & np.isfinite(best[:, i - lens]))
                before = last[r, i - lens[c]]
                fits = before < 0
                fits[~fits] = self._apart(before[~fits], own[r[~fits], c[~fits]])
                value[r[fits], c[fits]] = 0
            else:
                value = np.where(found, best[:, i - lens] + scores[own], np.float32(-np.inf))
            pick = value.argmax(axis=1)
            best[:, i] = value[rows, pick]
            back[:, i] = lens[pick]
            last[:, i] = own[rows, pick]
        if not np.isfinite(best[:, n]).all():
            raise AssertionError("a word has no segmentation")
        marks = np.zeros((w, n + 1), bool)
        pos = np.full(w, n)
        live = rows
        while len(live):
            marks[live, pos[live]] = True
            pos[live] -= back[live, pos[live]]
            live = live[pos[live] > 0]
        return last[marks], marks.sum(axis=1)

    # -- texts ----------------------------------------------------------------------------------------------------

    def _encode_parts(self, c: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts c[at:at+size], one after the other, and how many each has."""
        t = self.t
        counts = np.zeros(len(at), np.int64)
        runs: list[tuple[np.ndarray, np.ndarray]] = []  # parts, and their ids one after the other
        alone = size > LONG if t.model_type == BPE else np.zeros(len(at), bool)
        if t.model_type == BPE and len(self.tied):
            # A part with two characters that only meet in tied pieces, such as two space marks, may use one.
            met = np.flatnonzero(t.pair_flags(c)[1])
            inside = np.searchsorted(at, met + 1, side="right") - 1
            ok = (inside >= 0) & (met + 1 < (at + size)[inside]) & (met >= at[inside])
            alone[inside[ok]] = True
        for n in np.unique(size[~alone]).tolist():
            own = np.flatnonzero((size == n) & ~alone)
            step = max(1, _CELLS // n)
            for k in range(0, len(own), step):
                some = own[k : k + step]
                symbols, number = self._viterbi(c[at[some][:, None] + np.arange(n)].astype(np.uint64))
                ids = np.append(t.symbol_ids, np.int32(-1))[symbols]
                odd = np.unique(np.searchsorted(np.cumsum(number), np.flatnonzero(ids < 0), side="right"))
                if len(odd):
                    ends = np.cumsum(number)
                    for r in odd.tolist():
                        lo, hi = int(ends[r] - number[r]), int(ends[r])
                        spelled = self._spelled(c[at[some[r]] : at[some[r]] + n], symbols[lo:hi])
                        counts[some[r]] = len(spelled)
                        runs.append((some[r : r + 1], spelled))
                    plain = np.ones(len(some), bool)
                    plain[odd] = False
                    ids, some, number = ids[np.repeat(plain, number)], some[plain], number[plain]
                counts[some] = number
                runs.append((some, ids))
        for i in np.flatnonzero(alone).tolist():
            text = c[at[i] : at[i] + size[i]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            ids = np.array([x for part in t.merged(text) for x in t.text_ids(part)], np.int32)
            counts[i] = len(ids)
            runs.append((np.array([i]), ids))
        start = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for some, ids in runs:
            out[np.repeat(start[some], counts[some]) + within(counts[some])] = ids
        return out, counts

    def _spelled(self, chars: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The ids of a part some of whose symbols are no pieces: those are spelled in bytes."""
        out: list[int] = []
        at = 0
        for s in symbols.tolist():
            n = self.t.symbol_lens[s]
            own = int(self.t.symbol_ids[s]) if s < len(self.t.symbol_ids) else -1
            out += [own] if own >= 0 else self.t.text_ids(chars[at : at + n].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"))
            at += n
        return np.array(out, np.int32)

    def _known(self, c: np.ndarray, at: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pool has the ids of distinct parts with these sorted keys, and how many; new parts are added to it."""
        place = np.searchsorted(self.keys, keys)
        hit = self.keys[np.minimum(place, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~hit)
        if len(new):
            by_place = new[np.argsort(at[new])]
            ids, counts = self._encode_parts(c, at[by_place], size[by_place])
            if len(self.keys) + len(new) > CACHE:
                # Only the parts of this chunk stay.
                own = place[hit]
                n = self.lens[own]
                self.pool = self.pool[np.repeat(self.at[own], n) + within(n)]
                self.keys, self.at, self.lens = self.keys[own], np.cumsum(n) - n, n
            added = np.empty((2, len(keys)), np.int64)
            added[0, by_place] = len(self.pool) + np.cumsum(counts) - counts
            added[1, by_place] = counts
            self.pool = np.concatenate((self.pool, ids))
            merged = np.concatenate((self.keys, keys[new]))
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.at = np.concatenate((self.at, added[0, new]))[order]
            self.lens = np.concatenate((self.lens, added[1, new]))[order]
            place = np.searchsorted(self.keys, keys)
        return self.at[place], self.lens[place]

    def _encode_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """encode() for texts that are not empty: each gets a space mark first, spaces become marks."""
        t = self.t
        c = np.frombuffer("".join([SPACE + x for x in texts]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        c[c == 32] = ord(SPACE)
        first = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        first = np.cumsum(first) - first
        cut = np.ones(len(c), bool)
        cut[1:] = ~t.pair_flags(c)[0]
        cut[first] = True
        at = np.flatnonzero(cut)
        size = np.diff(np.append(at, len(c)))
        keys = t.part_keys(c, at, size)
        distinct, one, number = np.unique(keys, return_index=True, return_inverse=True)
        place, n = self._known(c, at[one], size[one], distinct)
        each = n[number]
        ids = self.pool[np.repeat(place[number], each) + within(each)]
        return ids, np.add.reduceat(each, np.searchsorted(at, first))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, and how many each has; none for null or empty."""
        counts = np.zeros(len(texts), np.int64)
        ids = [np.empty(0, np.int32)]
        for i, j in chunks(texts, _CHUNK):
            own = [k for k in range(i, j) if texts[k]]
            if own:
                found, counts[own] = self._encode_chunk([texts[k] for k in own])
                ids.append(found)
        return np.concatenate(ids), counts


def decode(tables: Tables, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of id sequences that stand one after the other: pieces and bytes joined, space marks made spaces, the first space dropped."""
    out = []
    size = tables.spell_len[ids]
    edge = np.concatenate(([0], np.cumsum(counts)))
    for a, b in pairwise(edge.tolist()):
        n = size[a:b]
        raw = tables.spell[np.repeat(tables.spell_at[ids[a:b]], n) + within(n)].tobytes()
        out.append(raw.decode("utf-8", "replace").removeprefix(" "))
    return out


_latest: list[Encoder] = []


def _encoder(tables: Tables) -> Encoder:
    """The worker's encoder for these tables, with the parts that its earlier tasks met."""
    if not _latest or _latest[0].t is not tables:
        _latest[:] = [Encoder(tables)]
    return _latest[0]


def _ships(df: DataFrame, tables: Tables):
    return df.sparkSession.sparkContext.broadcast(tables)  # bounded by the vocabulary


def encode(df: DataFrame, tables: Tables, text: str = "text", key: str = "doc_id", verify: bool = False) -> DataFrame:
    """(key, n_tokens, token_ids) for each row of df, and with verify decoded_sha256, of the text decoded from the ids.

    A null or empty text has no tokens. Whole texts of any length; repeated rows get equal results; an empty table gives
    none. A text that holds the space mark U+2581 itself decodes to a space there, as the model cannot tell them apart.
    Columns other than key and text are not read.
    """
    source = df.select(F.col(key).alias("k"), F.col(text).alias("x"))
    kind = source.schema["k"].dataType.simpleString()
    shipped = _ships(df, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                ids, counts = encoder.encode(b["x"].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))
                cols, names = [b["k"], pa.array(counts, pa.int64()), lists], ["k", "n_tokens", "token_ids"]
                if verify:
                    cols.append(pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decode(shipped.value, ids, counts)], pa.string()))
                    names.append("decoded_sha256")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"k {kind}, n_tokens long, token_ids array<int>" + ", decoded_sha256 string" * verify
    return in_batches(source, run, schema).withColumnRenamed("k", key)


def decode_table(df: DataFrame, tables: Tables, ids: str = "token_ids", key: str = "doc_id") -> DataFrame:
    """(key, text) for each row of df; null ids give null, no ids an empty text."""
    source = df.select(F.col(key).alias("k"), F.col(ids).cast("array<int>").alias("x"))
    kind = source.schema["k"].dataType.simpleString()
    shipped = _ships(df, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b["x"].to_pylist()
            counts = np.array([len(r or ()) for r in rows], np.int64)
            flat = np.fromiter((i for r in rows for i in r or ()), np.int64)
            texts = [None if r is None else t for r, t in zip(rows, decode(shipped.value, flat, counts), strict=True)]
            yield pa.RecordBatch.from_arrays([b["k"], pa.array(texts, pa.string())], names=["k", "text"])

    return in_batches(source, run, f"k {kind}, text string").withColumnRenamed("k", key)
