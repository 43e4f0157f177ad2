"""Hashes, SimHash, MinHash and components against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sedra.llm import components, hashing, minhash, near_copies, queries, simhash


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=90), min_size=1, max_size=20))
def test_xxh64(parts):
    buf = np.frombuffer(b"".join(parts) + bytes(40), np.uint8)
    lens = np.array([len(p) for p in parts])
    assert hashing.xxh64(buf, np.cumsum(lens) - lens, lens).tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def brute_words(text):
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def brute_simhash(text):
    w = brute_words(text)
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows (id, fp): the least id of each one's component, by all pairs."""
    root = {f: f for _, f in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 3:
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(lambda: None)
    for i, f in rows:
        if i is not None:
            least[find(f)] = i if least[find(f)] is None else min(i, least[find(f)])
    return {(i, f): least[find(f)] for i, f in rows}


def test_long_texts_come_in_pieces(monkeypatch):
    """Cut into pieces of any size, a text has the same shingles."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("ab", "Cd", "é", "x" * 70, "\u00a0")) for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", " \n", "a" * 200_000, f"b {'c' * 70_000} d e f", "one two"]
    for size in (1, 10, 100, hashing.CHUNK_BYTES):
        monkeypatch.setattr(hashing, "CHUNK_BYTES", size)
        for k in (1, 3, 5):
            found = [(int(d), int(h)) for docs, hs in hashing.shingle_hashes(texts, k) for d, h in zip(docs, hs, strict=True)]
            want = []
            for i, t in enumerate(texts):
                w = brute_words(t)
                want += [(i, xxhash.xxh64_intdigest(b" ".join(w[a : a + k]), 42)) for a in range(max(len(w) - k + 1, min(1, len(w))))]
            assert found == want
        assert simhash.fingerprints_of(texts).tolist() == [brute_simhash(t) for t in texts]


def brute_minhash(text):
    """One-permutation MinHash in Python integers."""
    w = brute_words(text)
    if not w:
        return ""
    rest_bits, full = 64 - minhash.BIN_BITS, (1 << 64) - 1
    least = {}
    for p in [b" ".join(w[i : i + 5]) for i in range(len(w) - 4)] or [b" ".join(w)]:
        h = xxhash.xxh64_intdigest(p, 42)
        b, v = h >> rest_bits, h & ((1 << rest_bits) - 1)
        least[b] = min(v, least.get(b, v))

    def mixed(x):
        x = (x ^ x >> 33) * 0xC2B2AE3D27D4EB4F & full
        x = (x ^ x >> 29) * 0x165667B19E3779F9 & full
        return x ^ x >> 32

    digits = []
    for b in range(minhash.BINS):
        at, k = b, 0
        while at not in least:
            k += 1
            at = mixed(b * 0x9E3779B97F4A7C15 + k & full) >> rest_bits
        digits.append(mixed(least[at] + b * 0x9E3779B97F4A7C15 & full) & 15)
    return "".join(f"{d:x}" for d in digits)


def test_minhash_equals_plain_python():
    rng = random.Random(9)
    texts = [None, "", "a", "The the THE", "a b c d e f", " ".join(str(rng.randrange(50)) for _ in range(3000)), "x " * 900] + [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (3, 5, 6, 20, 200)]
    assert minhash.packed(*minhash.signatures(texts)) == [brute_minhash(t) for t in texts]


def brute_groups(texts):
    """texts {id: text}: the least id of each one's group, by all pairs of fingerprints and of packed bins."""
    ids, root = sorted(texts), {i: i for i in texts}
    fps, (low, some) = simhash.fingerprints_of([texts[i] for i in ids]), minhash.signatures([texts[i] for i in ids])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, i in enumerate(ids):
        near = np.bitwise_count(fps ^ fps[a]) <= 3
        if some[a]:
            near |= some & (((low == low[a]).mean(axis=1) - 1 / 16) / (15 / 16) >= near_copies.LIKENESS)
        for b in np.flatnonzero(near):
            x, y = find(i), find(ids[b])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_groups_equal_all_pairs(spark, data):
    """Over 1,000 documents: one of each group stays, and true shingle likeness of 0.8 or more puts a pair in one group."""
    docs = spark.read.parquet(f"{data}/../sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    least = brute_groups(texts)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({*least.values()})
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, brute_words(t)) for i, t in texts.items()) if w}
    alike = [(a, b) for a, b in combinations(sorted(sets), 2) if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert len(alike) > 50 and sum(least[a] == least[b] for a, b in alike) >= 0.9 * len(alike)


def drifting(rng, n, words=300, step=12):
    """n texts, each the one before with `step` words in a row replaced: neighbours are alike, ends are not, and many share a bucket with a least one that is not like them."""
    own = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        at = rng.randrange(words - step)
        own = [*own[:at], *(f"w{rng.randrange(5000)}" for _ in range(step)), *own[at + step :]]
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("cell", [1024, 4])
def test_no_pair_of_a_bucket_is_left_out(spark, monkeypatch, cell):
    """Chains of copies, in one cell a bucket and in many: groups equal those of all pairs."""
    monkeypatch.setattr(near_copies, "CELL", cell)
    rng = random.Random(8)
    texts = dict(enumerate([*drifting(rng, 40), *drifting(rng, 25), *drifting(rng, 12, 80, 4), "", "one", "one", *("clean text " + " ".join(f"v{rng.randrange(9999)}" for _ in range(50)) for _ in range(10))]))
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == sorted({*brute_groups(texts).values()})


def templated(rng, n, shared=180, own=120):
    """n texts that share 60 % of their words in one run, so that many agree in whole bands, but none are alike."""
    template = " ".join(f"t{k}" for k in range(shared))
    return [template + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(own)) for _ in range(n)]


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    """Copies hidden among texts of one template are found: pairs of a true likeness of 0.8 or more, at a recall of 0.9 or more, with few pairs tried."""
    rng = random.Random(12)
    texts = templated(rng, 1500)
    for t in texts[:150]:  # each with a copy in which a few words in a row differ
        w = t.split()
        at = rng.randrange(180, 280)
        texts.append(" ".join([*w[:at], *(f"z{rng.randrange(10**6)}" for _ in range(18)), *w[at + 18 :]]))
    keys, bins = near_copies.sketch(texts)
    rows = [(i, k, bytes(b)) for i, (k, b) in enumerate(zip(keys.to_pylist(), bins.to_pylist(), strict=True))]
    sketches = spark.createDataFrame(rows, "id long, keys array<long>, bins binary")
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    true = [i for i in range(150) if len(sets[i] & sets[1500 + i]) >= 0.8 * len(sets[i] | sets[1500 + i])]
    assert len(true) > 100
    found = {}
    for most in (1 << 40, 1 << 8):
        tried = []
        monkeypatch.setattr(near_copies, "MOST_PAIRS", most)
        monkeypatch.setattr(near_copies, "_all_pairs", lambda told, todo, bins, run=near_copies._all_pairs: tried.append(todo.selectExpr("sum(m * n)").first()[0] or 0) or run(told, todo, bins))
        found[most] = {(min(r.u, r.v), max(r.u, r.v)) for r in near_copies.links(sketches).collect()}, sum(tried)
        monkeypatch.undo()
    (whole, pairs), (dealt, fewer) = found[1 << 40], found[1 << 8]
    assert sum((i, 1500 + i) in dealt for i in true) >= 0.95 * sum((i, 1500 + i) in whole for i in true) > 0.9 * 0.95 * len(true)
    assert fewer < pairs / 20


def test_large_buckets_lose_no_link(spark):
    """A bucket of 1,700 unlike texts, 2.9 million pairs: every planted pair that just reaches LIKENESS is linked, and no other."""
    rng = np.random.default_rng(3)
    nibbles = rng.integers(0, 16, (1700, minhash.BINS), np.uint8)
    for i in range(120):
        nibbles[1500 + i] = nibbles[i]
        nibbles[1500 + i, rng.permutation(minhash.BINS)[: near_copies.MOST_APART + i % 2]] ^= 1  # each second pair is one bin short
    bins = (nibbles[:, 0::2] << 4) | nibbles[:, 1::2]
    assert near_copies.alike(bins[1500:1620], bins[:120]).tolist() == [True, False] * 60
    sketches = spark.createDataFrame([(i, [7], b.tobytes()) for i, b in enumerate(bins)], "id long, keys array<long>, bins binary")
    assert {(min(r.u, r.v), max(r.u, r.v)) for r in near_copies.links(sketches).collect()} == {(i, 1500 + i) for i in range(0, 120, 2)}


def test_one_member_connects_two_hubs(spark):
    """In a bucket that was dealt again, members that are not apart may hang on different hubs: one that is like both connects them."""
    a = np.zeros(minhash.BINS // 2, np.uint8)
    b, c = a.copy(), a.copy()
    b[:96], c[:48] = 0x11, 0x11  # a and b differ in 192 bins, c from either in 96
    bins = spark.createDataFrame([(i, x.tobytes()) for i, x in ((1, a), (2, b), (3, c))], "id long, bins binary")
    told = spark.createDataFrame([(7, 1, False, 1), (7, 2, False, 2), (7, 3, True, None)], "key long, id long, apart boolean, hub long")
    todo = spark.createDataFrame([(7, 3, 1)], "key long, n long, m long")
    assert near_copies.MOST_APART == 96
    assert {tuple(sorted(r)) for r in near_copies._all_pairs(told, todo, bins).collect()} == {(1, 3), (2, 3)}


def test_texts_of_one_fingerprint_all_take_part(spark):
    """Two texts of one fingerprint have sketches of their own: what is like the second is linked, too."""
    low, some = minhash.signatures(["a b c d e f", "a b c d e g"])
    a, c = (bytes((r[0::2] << 4) | r[1::2]) for r in low)
    rows = [(7, 1, [1], a), (7, 2, [2], c), (9, 2, [2], c), (11, 3, [2], c[:-1] + bytes([c[-1] ^ 1])), (12, 4, [9], a)]
    got = simhash._copy_edges(spark.createDataFrame(rows, "fp long, id long, keys array<long>, bins binary")).collect()
    assert some.all() and {(max(r.u, r.v), min(r.u, r.v)) for r in got} == {(9, 7), (11, 7)}


def test_masks_cover_every_pair():
    for family in (simhash.FIRST, simhash.SECOND):
        tables = simhash.masks(family)
        assert len(tables) == 15
        assert all(any(not m & bits for m in tables) for c in combinations(range(64), 3) for bits in (sum(1 << i for i in c),))
    assert simhash.FREE <= 18


def test_simhash_query_equals_brute_force(spark, data, documents):
    rows = [(r.doc_id, brute_simhash(r.text)) for r in documents.collect()]
    want = brute_components(rows)
    got = queries.op3_simhash_dedup(spark, data).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want[r.doc_id, int(r.fingerprint, 16)]


def test_forest_small_and_large(monkeypatch):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = np.unique(np.array([base ^ sum(1 << b for b in {rng.randrange(0, 60, 4) for _ in range(rng.randrange(6))}) for _ in range(500)], np.uint64))
    want = simhash.forest(fps)
    monkeypatch.setattr(simhash, "MOST", 10)
    assert (simhash.forest(fps) == want).all()
    pairs = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert all(want[a] == want[b] for a, b in pairs)


def test_hot_buckets_take_the_second_family(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 4)
    rng = random.Random(4)
    base = 0x0123456789ABCDEF
    fps = {base ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randrange(4))}) for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)}
    signed = [simhash._signed(f) for f in fps]
    found = components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    rep = {f: f for f in signed} | {r.u: r.v for r in found}
    want = brute_components([(f, f) for f in fps])
    groups = defaultdict(set)
    for f in fps:
        groups[want[f, f]].add(rep[simhash._signed(f)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(rep.values()))


def test_components_of_a_path_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (0, 1)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.fingerprint, r.component_id))
    assert {by[i][0] for i in (1, 2, 9)} == {("0" * 16, 1)}  # no words: one component
    assert by[3][0] == by[4][0] and by[4][0][1] == 3 and len(by[5]) == 2 and by[None][0][1] is None
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 3, 5, 6, 7, 8, 10, None]
    assert simhash.near_duplicates(none).count() == 0 and simhash.representatives(none).count() == 0


def test_representatives_of_null_and_repeated_keys(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(300)) for w in "abcd")
    near = "B" + b[1:] + "!"  # the same words but for case and the mark
    rows = [(1, a), (None, a), (None, c), (None, c), (2, b), (2, near), (3, a), (3, d), (4, d)]
    assert simhash.fingerprints_of([b])[0] == simhash.fingerprints_of([near])[0]
    kept = sorted(((r.doc_id, r.text) for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert len(kept) == 4 and {(1, a), (None, c), (3, d)} < set(kept) and sum(r in ((2, b), (2, near)) for r in kept) == 1


def shingles(text):
    w = brute_words(text)
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_minhash_query_equals_brute_force(spark, data, documents):
    docs = sorted(((r.doc_id, r.text) for r in documents.collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op2_minhash_fingerprint(spark, data).collect()}
    assert len(got) == len(docs)
    off = []
    for k, (i, text) in enumerate(docs):
        other = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + other[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        fp, some = minhash.signatures([text, new, other])
        assert [r.fingerprint, r.edited_fingerprint] == minhash.packed(fp, some)[:2] and (minhash.unpacked(r.fingerprint) == fp[0]).all()
        off += [r.near_edited - likeness(shingles(text), shingles(new)), r.near_next - likeness(shingles(text), shingles(other))]
    assert abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.15


def test_minhash_odd_rows(odd, none, spark):
    rows = minhash.compared_with_edited(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[1][0].fingerprint == by[2][0].fingerprint == by[9][0].fingerprint == "" and by[1][0].n_chars == 0
    assert by[3][0].fingerprint == by[4][0].fingerprint and by[5][0].fingerprint == by[5][1].fingerprint
    assert by[4][0].near_next == 1.0 and all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    assert by[None][0].n_chars == 31
    assert minhash.compared_with_edited(none).count() == 0
    one = minhash.compared_with_edited(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).collect()
    assert [r.edited_sha256 for r in one] == [hashlib.sha256(b"abab").hexdigest()] and one[0].near_next == 1.0
    assert {r.doc_id: r.fingerprint for r in minhash.fingerprints(odd).collect()}[3] == by[3][0].fingerprint


def test_short_texts_do_not_agree_by_chance():
    texts = [f"w{i}" for i in range(300)]
    fp, some = minhash.signatures(texts)
    assert max(minhash.likeness(fp[:1].repeat(299, 0), fp[1:], some[:1].repeat(299), some[1:])) < 0.2


def test_densifying_one_bin_fills_all():
    fp, some = minhash.signatures(["one two"])
    assert some.all() and fp.shape == (1, minhash.BINS)


def test_shared_tables_are_removed(spark):
    from sedra.llm import shared

    with shared.tables_removed():
        kept, path = shared.cut_at(spark.range(3))
        assert kept.count() == 3 and shared.exists(spark, path)
    assert not shared.exists(spark, path)
    kept, path = shared.cut_at(spark.range(3))
    assert shared.exists(spark, path) and path.startswith(shared.shared_dir(spark))
    shared.drop(spark, path)
