"""Words, shingles and their XXH64 values for many texts at once, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_PAD = 40  # readable bytes after the last word

CHUNK_BYTES = 1_000_000  # of text that are worked on at once


CHUNK_TEXTS = 1024  # that are worked on at once
LONG = 1 << 16  # bytes of a shingle from which the library hashes it alone


def chunks(texts: list[str | None], size: int = CHUNK_BYTES, most: int = CHUNK_TEXTS) -> Iterator[tuple[int, int]]:
    """Ranges of up to `most` texts of about `size` characters in all; a longer text is a range of its own."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i - start == most or (total and total + n > size):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def mix(h: np.ndarray) -> np.ndarray:
    """The final mixing of XXH64, a bijection of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the slices buf[start:start+len]; buf (uint8) must go on for 40 bytes after the last slice."""
    long = np.flatnonzero(lens > LONG)
    if len(long):
        import xxhash

        out, short = np.empty(len(lens), np.uint64), lens <= LONG
        out[short] = xxh64(buf, starts[short], lens[short], seed)
        out[long] = [xxhash.xxh64_intdigest(buf[a : a + n].data, seed) for a, n in zip(starts[long].tolist(), lens[long].tolist(), strict=True)]
        return out
    lane64 = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    lane32 = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
    order = np.argsort(lens.astype(np.uint16) if lens.size and lens.max() < 65536 else lens, kind="stable")
    at, n = starts[order].astype(np.int64), lens[order].astype(np.int64)
    s = np.uint64(seed)
    h = np.full(len(at), s + _P5, np.uint64)
    with np.errstate(over="ignore"):
        big = int(np.searchsorted(n, 32))
        if big < len(n):
            v = [np.full(len(n) - big, x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            pos, stripes = at[big:], n[big:] >> 5
            for k in range(int(stripes[-1])):
                live = int(np.searchsorted(stripes, k, side="right"))
                for j in range(4):
                    v[j][live:] = _round(v[j][live:], lane64[pos[live:] + (32 * k + 8 * j)])
            x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for j in range(4):
                x = (x ^ _round(np.uint64(0), v[j])) * _P1 + _P4
            h[big:] = x
            at = at.copy()
            at[big:] += stripes << 5
        h += n.astype(np.uint64)
        rest = n & 31
        for k in range(3):
            live = np.flatnonzero(rest >= 8 * (k + 1))
            if not len(live):
                break
            h[live] = _rotl(h[live] ^ _round(np.uint64(0), lane64[at[live] + 8 * k]), 27) * _P1 + _P4
        at = at + (rest & 24)
        live = np.flatnonzero(rest & 4)
        h[live] = _rotl(h[live] ^ (lane32[at[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at = at + (rest & 4)
        for k in range(3):
            live = np.flatnonzero((rest & 3) > k)
            h[live] = _rotl(h[live] ^ (buf[at[live] + k].astype(np.uint64) * _P5), 11) * _P1
        h = mix(h)
    out = np.empty_like(h)
    out[order] = h
    return out


def shingle_hashes(texts: list[str | None], k: int, seed: int = 42) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers in rising order, XXH64 values) of the texts' k-word shingles, in pieces of about CHUNK_BYTES of text; a longer text comes in several.

    Words: A-Z lower-cased, split at ASCII white space; a shingle's words are joined by a space. A text of fewer words
    has one shingle, one without words or null none.
    """
    for i, j in chunks(texts, CHUNK_BYTES):
        if j - i == 1 and texts[i] and len(texts[i]) > CHUNK_BYTES:
            for words in _word_pieces(texts[i], k):
                yield np.full(max(1, len(words) - k + 1), i), _hashes([words], k, seed)[0]
        else:
            h, counts = _hashes([_words(t) for t in texts[i:j]], k, seed)
            yield np.repeat(np.arange(i, j), counts), h


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _word_pieces(text: str, k: int) -> Iterator[list[bytes]]:
    """The words of a long text, so that each shingle is in just one piece: a piece begins with the last k - 1 words of the one before."""
    held: list[bytes] = []
    found = False
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + CHUNK_BYTES)
        stop = gap.start() if gap else len(text)
        words = held + _words(text[at:stop])
        at = stop
        if len(words) >= k:
            found = True
            yield words
            words = words[len(words) - k + 1 :]
        held = words
    if held and not found:
        yield held


_GAP = re.compile("[\\x20\\x09-\\x0D]")


def _hashes(split: list[list[bytes]], k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles' values, text after text, and how many each text has. The words stand joined in one buffer, so a shingle is a slice of it."""
    counts = np.fromiter(map(len, split), np.int64, len(split))
    per_text = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    if not counts.sum():
        return np.empty(0, np.uint64), per_text
    buf = np.frombuffer(b" ".join(chain.from_iterable(split)) + bytes(_PAD), np.uint8)
    gaps = np.flatnonzero(buf[:-_PAD] == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(buf) - _PAD]))
    first = np.repeat(np.cumsum(counts) - counts, per_text) + within(per_text)
    last = first + np.repeat(np.minimum(counts, k) - 1, per_text)
    return xxh64(buf, starts[first], ends[last] - starts[first], seed), per_text


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
