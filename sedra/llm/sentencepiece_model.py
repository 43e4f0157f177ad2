"""The tables of a SentencePiece model file: pieces, scores, kinds, and the order of merges."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SPACE = "▁"
#: Fixed values of the file format: kinds of pieces, and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
NEVER = np.int64(1) << 40
BASE = np.uint64(0x9E3779B97F4A7C15)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = raw[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
        elif wire == 2:
            n, at = varint(at)
            value, at = raw[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[wire]
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int

    @classmethod
    def parse(cls, raw: bytes) -> Vocabulary:
        """From a model file's bytes. Only the identity normaliser is known, with a space put first and no white space removed."""
        pieces, scores, kinds, model_type = [], [], [], UNIGRAM
        norm: dict[int, int | bytes] = {}
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                model_type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(_fields(value))
        if norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError("this normaliser is not supported: identity with a dummy prefix, white space kept and escaped")
        if model_type not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a BPE model")
        return cls(pieces, scores, kinds, model_type)


class Tables:
    """What encoding and decoding need, in arrays. A symbol is a piece that text can match, or a character that pieces hold but the vocabulary lacks.

    For BPE, `rank` is the place of a symbol's merge in the order of merges (0: a character), `left` and `right` the two
    symbols that its last merge joins, and `pair_keys` and `pair_ranks` every pair whose joined text is a symbol.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = vocabulary
        self.model_type = v.model_type
        self.ids = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k in (NORMAL, USER)}
        self.scores = {p: np.float32(v.scores[i]) for p, i in self.ids.items()}
        self.byte_ids = np.full(256, -1, np.int32)
        for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)):
            if k == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
        self.unknown = next(i for i, k in enumerate(v.kinds) if k == UNKNOWN)
        self.by_byte = bool((self.byte_ids >= 0).all())
        self.unknown_score = np.float32(min(self.scores.values(), default=0.0) - 10.0)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes on after a space: words can't be told apart")
        names = sorted(self.ids)
        names += sorted({c for p in names for c in p} - set(names))
        if self.model_type == BPE:
            # Pieces of one score have no order among themselves; words that could use them are merged one by one.
            seen: dict[float, int] = {}
            for p in self.ids:
                if len(p) > 1:
                    seen[float(self.scores[p])] = seen.get(float(self.scores[p]), 0) + 1
            self.tied = sorted(p for p in self.ids if len(p) > 1 and seen[float(self.scores[p])] > 1)
            order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.scores[p])
            self.order = {p: k + 1 for k, p in enumerate(order)}
            tied = set(self.tied)
            last = {p: s for p in order if p not in tied and (s := self._last_merge(p))}
            names = [p for p in names if len(p) == 1 or p in last]
        number = {p: k for k, p in enumerate(names)}
        self.symbol_ids = np.array([self.ids.get(p, -1) for p in names], np.int32)
        self.symbol_scores = np.array([self.scores.get(p, self.unknown_score) for p in names], np.float32)
        self.longest = max(map(len, names), default=1)
        hashes = np.array([text_hash(p) for p in names], np.uint64)
        by_hash = np.argsort(hashes)
        self.keys, self.key_symbols = hashes[by_hash], by_hash.astype(np.int32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True
        # Characters that stand next to each other in a piece: bit 0; in one of tied score: bit 1.
        beside: dict[tuple[str, str], int] = {}
        tied_pieces = set(self.tied) if self.model_type == BPE else set()
        for p in self.ids:
            for ab in zip(p, p[1:], strict=False):
                beside[ab] = beside.get(ab, 0) | (3 if p in tied_pieces else 1)
        letters = sorted({x for ab in beside for x in ab})
        self.small = np.zeros(0x110000, np.uint16)
        self.small[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)
        width = len(letters) + 1
        self.beside = np.zeros((width, width), np.uint8)
        for (x, y), flag in beside.items():
            self.beside[self.small[ord(x)], self.small[ord(y)]] = flag
        self.symbol_lens = [*map(len, names), 1]
        if self.model_type == BPE:
            self.rank = np.array([self.order[p] if len(p) > 1 else 0 for p in names] + [0], np.int64)
            self.left = np.array([number[last[p][0]] if len(p) > 1 else -1 for p in names] + [-1], np.int64)
            self.right = np.array([number[last[p][1]] if len(p) > 1 else -1 for p in names] + [-1], np.int64)
            pairs = sorted((number[p[:k]] << 32 | number[p[k:]], r) for p, r in self.order.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
            self.pair_keys = np.array([p[0] for p in pairs] + [NEVER << 20], np.int64)
            self.pair_ranks = np.array([p[1] for p in pairs] + [NEVER], np.int64)
            self.maybe_pair = np.zeros(1 << 20, bool)
            self.maybe_pair[_short(self.pair_keys[:-1] >> 32, self.pair_keys[:-1] & 0xFFFFFFFF)] = True
        # For decoding: the bytes of every id.
        spell = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.spell_len = np.array([len(s) for s in spell], np.int64)
        self.spell_at = np.cumsum(self.spell_len) - self.spell_len
        self.spell = np.frombuffer(b"".join(spell), np.uint8)

    def pair_flags(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of neighbours: whether a piece holds it, and whether one of tied score does."""
        x = self.small[c]
        flag = self.beside[x[:-1], x[1:]]
        return flag > 0, flag > 1

    def part_keys(self, c: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of each part c[at:at+size], where the parts follow each other: sums of mixed characters and places."""
        place = np.arange(len(c), dtype=np.int64) - np.repeat(at, size)
        with np.errstate(over="ignore"):
            mixed = finish((c.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)) * BASE)
            return finish(np.add.reduceat(mixed, at) + size.astype(np.uint64) * BASE)

    def join_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of the merge of symbols x and y, NEVER if their joined text is no symbol."""
        out = np.full(len(x), NEVER)
        own = np.flatnonzero(self.maybe_pair[_short(x, y)])
        key = x[own] << 32 | y[own]
        at = np.searchsorted(self.pair_keys, key)
        hit = self.pair_keys[at] == key
        out[own[hit]] = self.pair_ranks[at[hit]]
        return out

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two symbols that the last merge of a piece's characters joins, or None if merging does not end in the piece."""
        parts = list(piece)
        while len(parts) > 2:
            best = min((self.order.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == NEVER:
                return None
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (parts[0], parts[1]) if parts[0] + parts[1] in self.order else None

    def merged(self, text: str) -> list[str]:
        """BPE by an agenda: the best-scored adjacent pair first, the leftmost among equals."""
        n = len(text)
        part, nxt, prv = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, str]] = []

        def propose(a: int, b: int) -> None:
            if 0 <= a and b < n and (joined := part[a] + part[b]) in self.ids:
                heapq.heappush(agenda, (-float(self.scores[joined]), a, b, joined))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, a, b, joined = heapq.heappop(agenda)
            if not part[a] or b >= n or not part[b] or nxt[a] != b or part[a] + part[b] != joined:
                continue
            part[a], part[b] = joined, ""
            nxt[a] = nxt[b]
            if nxt[a] < n:
                prv[nxt[a]] = a
            propose(prv[a], a)
            propose(a, nxt[a])
        return [p for p in part if p]

    def text_ids(self, part: str) -> list[int]:
        """The ids of a symbol's text: its own, or its bytes', or unknown."""
        if part in self.ids:
            return [self.ids[part]]
        return self.byte_ids[list(part.encode("utf-8", "surrogatepass"))].tolist() if self.by_byte else [self.unknown]


def _short(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * 0x9E3B5 + y * 0x2C1B3) & 0xFFFFF


def text_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return finish(np.array([h], np.uint64))[0]


def finish(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))
