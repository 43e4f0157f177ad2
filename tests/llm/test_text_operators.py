"""Language ID, licences, URLs and chats."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedra.llm import chat_format, language_id, license_scan, queries, topk_search, url_filter
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, data, name):
    assert check(spark, duck, data, queries.QUERIES[name], queries.ORACLES[name]()) > 0


GOOD = """used-cars/ford-escort wiki/Trojan_War slots/booking doorway/door recipes/spam-musubi cracked-pepper cheap-teen-books hotel-casino-monaco
    security/ransomware-report health/viagra-side-effects free-online-courses buy-online-tickets adult-education hot-sauce news/poker-champion
    sex-education-for-schools/x-ray essex/history middlesex/weather torrent-river/hiking odds-and-ends lottery-results museum/nude-in-art crack-in-the-wall
    dating-of-fossils webcam-driver coupon-book discount-furniture mature-cheddar farm-bonus-scheme binary-search serial-port bet-shemesh
    pharmacy-opening-hours popup-restaurant affiliate-professor loan-calculator crypto-museum hooked-on-books docs/hacks.html weed-control""".split()
BAD = """free-porn-videos xxx-movies pornhub-mirror milf-gallery hentai/online sexcam-chat live/camgirls bdsm-clips upskirt-pics nsfw/gallery
    onlinecasino-bonus best-sportsbook free-online-slots casino-roulette-online poker/betting-tips buy-viagra-online cialis-pills buyviagra-now levitra-shop
    xanax-pharmacy phentermine keygen-download warez/apps serialz crackz cracked-torrents replica-rolex paydayloans payday-lender
    hot-nude-babes sexy-webcam escort-dating naked-cams erotic-adult-stories gambling-odds jackpot-lottery-online linkfarm affiliate-spam hookup-sex""".split()


def test_vocabulary_on_a_labelled_sample(spark):
    """Ordinary urls with words of two senses stay, rejected kinds go: precision and recall over a sample made by hand."""
    urls = [(f"https://site.org/{u}", bad) for own, bad in ((GOOD, False), (BAD, True)) for u in own]
    got = {r.page_id: r.verdict == "block" for r in url_filter.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")).collect()}
    hits = sum(got[i] for i, (_, bad) in enumerate(urls) if bad)
    wrong = [u for i, (u, bad) in enumerate(urls) if got[i] and not bad]
    assert hits >= 0.9 * len(BAD) and hits >= 0.9 * (hits + len(wrong)), ([u for i, (u, bad) in enumerate(urls) if bad and not got[i]], wrong)


def test_long_texts_have_the_same_ngrams_in_pieces(monkeypatch):
    """Pieces of any size give what the whole text gives, and twenty million characters take little more memory than a piece."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("abZé ß.,1\n😀語", k=rng.randrange(30, 200))) for _ in range(60)] + ["   . ", "x" * 40, ". a" * 20, "1 2 3 " * 9]
    whole = [language_id.presence([t]) for t in texts]
    for size in (1, 2, 3, 7, 29):
        monkeypatch.setattr(language_id, "_CHUNK", size)
        for t, (doc, gram, has) in zip(texts, whole, strict=True):
            got = language_id.presence([t])
            assert np.array_equal(got[0], doc) and np.array_equal(got[1], gram) and np.array_equal(got[2], has)
    monkeypatch.undo()
    text = "abcde fghij " * (20_000_000 // 12)
    language_id.presence([text[:1000]])
    tracemalloc.start()
    language_id.presence([text])
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_topk_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, nan]), (2, [inf, 1.0]), (3, None), (4, [None, 1.0]), (5, [1.0]), (None, [9.0, 9.0]), (6, [-0.01, 0.0]), (6, [-0.01, 0.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in topk_search.top_k(df, lambda i: i % 20 == 0, 3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    square = 64 * 64 * 5
    assert got[0] == [(1, 20, square), (2, 5, 64 * 64), (3, 40, 0)]  # the two rows of 6 score -64
    assert got[20][0] == (1, 0, square) and got[40][0] == (1, 0, 0)
    assert topk_search.top_k(df.where("false"), lambda i: i % 20 == 0).count() == 0
    assert topk_search.top_k(df.where("vec_id = 0"), lambda i: i % 20 == 0).count() == 0


def brute_top_k(rows, k):
    """Integer scores in Python, for rows (id, vector)."""
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    out = {}
    for i in {i for i, _ in whole if i % 20 == 0}:
        scores = [(sum(a * b for a, b in zip(q, c, strict=True)), j) for q in {tuple(v) for n, v in whole if n == i} for j, c in whole if j != i]
        out[i] = [(r + 1, j, max(-(1 << 63), min((1 << 63) - 1, s))) for r, (s, j) in enumerate(sorted(scores, key=lambda p: (-max(-(1 << 63), min((1 << 63) - 1, p[0])), p[1]))[:k])]
    return out


@pytest.mark.parametrize("size", [1.0, 2.0**24, 2.0**40, 2.0**52, 2.0**120])
def test_topk_is_exact_at_any_size(spark, duck, monkeypatch, size):
    """Scores that float64 rounds, rows that are there twice, ties, and small blocks and stripes."""
    for name, value in (("BLOCK", 8), ("STRIPE", 2), ("GROUP", 3), ("SEEDS", 1)):
        monkeypatch.setattr(topk_search, name, value)
    rng = random.Random(5)
    rows = [(i, [size * rng.uniform(-1, 1) * rng.choice((1, 1e-3)), 5.015625 * rng.random(), rng.uniform(-3, 3)]) for i in range(120)]
    rows += [(7, rows[7][1]), (300, rows[7][1]), (301, rows[7][1]), (40, rows[40][1]), (60, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = defaultdict(list)
    for r in topk_search.top_k(df, lambda i: i % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert got == brute_top_k(rows, 20)
    if size == 2.0**24:
        duck.execute("create or replace temp table embeddings as select unnest($1) as vec_id, unnest($2) as embedding", [[i for i, _ in rows], [v for _, v in rows]])
        try:
            assert sorted(duck.sql(topk_search.top_k_sql()).fetchall()) == sorted((q, r, v, s) for q, own in got.items() for r, v, s in own)
        finally:
            duck.execute("drop table temp.embeddings")


def test_topk_groups_and_pruning():
    rng = np.random.default_rng(0)
    v = np.floor(64 * rng.standard_normal((3000, 32)) * rng.exponential(1, (3000, 1)))
    v[500:900] = v[500]  # equal vectors: ties by id
    ids = rng.permutation(3000)
    rotation = np.linalg.svd(v[:200], full_matrices=True)[2].T
    order = np.argsort(-(v**2).sum(axis=1), kind="stable")
    parts = [(float(np.sqrt((v[o] ** 2).sum(axis=1)).max()), ids[o], v[o]) for o in np.array_split(order, 12)]
    best = topk_search.search_group(ids[:50], v[:50], parts, rotation, 20)
    scores = v[:50] @ v.T
    for k in range(50):
        want = sorted(((-s, i) for s, i in zip(scores[k], ids, strict=True) if i != ids[k]))[:20]
        own = best.query == k
        assert list(zip(-best.score[own], best.id[own], strict=True)) == want


def test_language_held_out_accuracy(spark, data, documents):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    rows = queries.op4_language_id(spark, data).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_language_does_not_see_labels(documents):
    from pyspark.sql import functions as F

    model = language_id.fit(*language_id.training_sample(documents))
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(documents, model).collect()}
    other = documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(other, model).collect()} == plain


def brute_grams(text):
    """The distinct n-grams of 1 to 4 characters of the folded text."""
    folded = re.sub(" +", " ", "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in f" {text or ''} "))
    return {folded[i : i + n] for n in range(1, 5) for i in range(len(folded) - n + 1)}


def test_language_grams_equal_plain_sets():
    """As many n-grams as plain sets have, shared by as many texts, but for a few that share a bucket."""
    texts = ["The cat, and THE dog!", "", None, "?!", "Straße İstanbul ǅ 日本語", " a  b ", "x" * 3000, "ab" * 50, "a\n\tb", "été été"] * 3
    doc, gram, has = language_id.presence(texts)
    own = [set(gram[doc == i].tolist()) for i in range(len(texts))]
    plain = [brute_grams(t) for t in texts]
    for i in range(10):
        assert len(own[i]) == len(plain[i]) and own[i] == own[i + 10] and has[i] == any(c.isalpha() for c in texts[i] or "")
        for j in range(10):
            assert len(own[i] & own[j]) == len(plain[i] & plain[j])


def test_language_scores_equal_the_kernel():
    """The folded weights give what kernels with each landmark give."""
    texts = ["the cat and the dog", "der Hund und die Katze", "the bird sings", "die Vögel singen", "a house", "ein Haus"]
    langs = ["en", "de"] * 3
    model = language_id.fit(texts, langs)
    sets = [brute_grams(t) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = gram @ root
    target = np.where(np.array(langs)[:, None] == np.array(["de", "en"]), 1.0, -1.0)
    centred = features - features.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + language_id.RIDGE * 3 * np.eye(keep.sum()), centred.T @ (target - target.mean(axis=0)))
    fresh = "the dogs sing"
    own = brute_grams(fresh)
    want = np.array([kernel(own, s) for s in sets]) @ root @ w + target.mean(axis=0) - features.mean(axis=0) @ w
    assert np.allclose(model.scores([fresh])[0][0], want, atol=1e-5)


def test_language_odd_rows(odd, none, spark):
    rows = {(r.doc_id, r.lang_pred) for r in language_id.fit_and_identify(odd).collect()}
    assert {(1, "und"), (2, "und"), (6, "und"), (9, "und")} <= rows and not any(p == "und" for i, p in rows if i in (3, 5, 7, 8, None))
    assert language_id.fit_and_identify(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.fit_and_identify(unlabelled).first().lang_pred == "und"
    tagged = language_id.tag(odd, language_id.fit(["some text", "ein Text"], ["en", "de"]))
    assert tagged.count() == odd.count() and set(tagged.columns) == set(odd.columns)
    assert tagged.where("doc_id = 3").first().k == "own k"


def test_language_of_long_texts_only(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 60)
    rows = [(i, "the cat and the dog sing", "en") for i in range(40)] + [(i, "der Hund und die Katze singen " * (3 + i % 3), "de") for i in range(40, 80)]
    rows += [(i, "...", "de") for i in range(80, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = language_id.training_sample(df)
    assert {t for t, la in zip(texts, langs, strict=True) if la == "de"} == {r[1] for r in rows[40:80]}
    assert all(r.lang_pred == rows[r.doc_id][2] for r in language_id.fit_and_identify(df).collect() if r.doc_id < 80)
    alone = language_id.fit_and_identify(df.where("doc_id between 40 and 79")).collect()
    assert len(alone) == 40 and all(r.lang_pred == "de" for r in alone)


def test_rare_languages_of_many_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 70)
    rows = [(i, f"text {i}", f"l{i % 65}") for i in range(6500)] + [(i, f"text {i}", f"rare{i % 5}") for i in range(6500, 6520)]
    langs = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))[1]
    assert sorted(langs) == sorted({r[2] for r in rows})


def test_many_languages_keep_their_share(spark):
    """120 languages, 20 of them rare: each has as many texts as it has or as its share allows."""
    rows = [(i, f"text number {i} of language l{i % 100}", f"l{i % 100}") for i in range(12_000)] + [(i, f"rare {i}", f"rare{i % 20}") for i in range(12_000, 12_400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = language_id.training_sample(df)
    share = language_id.SAMPLE // 120
    free = [la for i, _, la in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    for la in set(free):
        assert langs.count(la) == min(share, free.count(la))
    model = language_id.fit(texts, langs)
    assert len(model.langs) == 120 and model.weights.dtype == np.float32


def test_license_places(odd, none, spark):
    rows = {r.doc_id: r for r in license_scan.scan(odd.select("doc_id", "text", "_words", "_row", "labels", "`a.b`")).collect()}
    r = rows[8]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (12, 3, 1, 9, "gpl,mit", "gpl,mit", 1.0)
    assert rows[8]._words == "own _words" and rows[8]["a.b"] == "own a.b"
    empty = rows[2]
    assert (empty.n_words, empty.n_base, empty.first_word, empty.labels, empty.score) == (0, 0, None, "", 0.0)
    assert license_scan.scan(none).count() == 0
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    cases = {text: "mit", text.replace("hereby", "herewith"): "mit", text.replace("person", "one"): "", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "mit mit license license": "mit", "amit license": "", "MİT license": "", "mit\nlicense": "mit", "license mit": ""}
    got = {r.text: r.labels for r in license_scan.scan(spark.createDataFrame([(t,) for t in cases], "text string")).collect()}
    assert got == cases


def brute_licences(text):
    """Labels and score by trying every start of every template."""
    w, labels, score = license_scan.words_of(text), set(), 0.0
    for t in license_scan.index():
        for start in range(-600, len(w)):
            hits = sum(0 <= start + i < len(w) and w[start + i] == x for i, x in t.rare)
            at, slack = start + t.key_at, 0 if t.template.base else license_scan.SLACK
            if hits >= t.needed and any(tuple(w[s : s + len(t.key)]) == t.key for s in range(max(0, at - slack), max(0, at + slack) + 1)):
                labels.add(t.template.label)
                score = max(score, hits / len(t.rare))
    return ",".join(sorted(labels)), score


def test_license_texts_whole_and_changed(spark):
    """Every licence text is found, also with its two rarest words changed, in the middle of other text, and with words put in."""
    texts = {}
    for t in license_scan.index():
        if t.template.base:
            continue
        words = t.template.text.split()
        texts[" ".join(words)] = t.template.label
        if len(words) > license_scan.RARE:
            changed = list(words)
            for i, _ in t.rare[:2]:
                if not t.key_at <= i < t.key_at + len(t.key):
                    changed[i] = "altered"
            texts["Some code here. " + " ".join(changed) + " and more"] = t.template.label
            half = len(words) // 2 if len(words) // 2 >= t.key_at + len(t.key) or len(words) // 2 <= t.key_at else t.key_at
            texts[" ".join([*words[:half], "put", "in", *words[half:]])] = t.template.label
    plain = "the software is provided with a copy of the public notice, free of charge, to any person and without warranty " * 20
    rows = license_scan.scan(spark.createDataFrame([(t,) for t in [*texts, plain]], "text string")).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.labels, r.score) == brute_licences(r.text)
        assert texts.get(r.text, "") in r.labels.split(",")


def test_license_many_places(spark):
    r = license_scan.scan(spark.createDataFrame([("mit license " * 2000,)], "text string")).first()
    assert (r.n_base, r.first_word, r.last_word) == (2000, 0, 3998)


def test_url_rules(spark):
    cases = {
        "https://a.example.com/en/x": ("example.com/en/", "block"), "https://www.example.com/en/x": ("www.example.com/en/", "allow"), "http://m.www.example.com/en/": ("www.example.com/en/", "allow"),
        "HTTP://Foo.COM/x?y": ("com/", "allow"), "http://foo.com": (None, "allow"), "http://x.net/fr/spam": ("net/fr/", "block"), "http://x.org/my-casino/": (None, "block"),
        "http://x.org/casinox": (None, "allow"), "http://x.org/poker?bonus=1": (None, "block"), "http://x.org/poker/poker": (None, "allow"), "http://x.org/free?click=win&ads=track": (None, "allow"), "no host": (None, "allow"), None: (None, "allow"), "": (None, "allow"), "a://b.org://c/spam": (None, "block"), "http://foo.com:80/x": (None, "allow"),
    }
    df = spark.createDataFrame([(k, u, "own") for k, u in enumerate(cases)] + [(None, "http://q.com/", "own")], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for k, (u, (rule, verdict)) in enumerate(cases.items()):
        assert (got[k].rule, got[k].verdict) == (rule, verdict), u
    assert (got[3].host, got[3].path, got[11].host, got[12].path) == ("foo.com", "/x", "", "") and got[None].rule == "com/"
    assert url_filter.judge(df.where("false")).count() == 0


def test_url_terms(spark):
    """Percent codes, counts, long urls, repeated rows."""
    cases = {
        "http://x.org/%63asino": ("block", 1, 0, 1), "http://x.org/a%2Fcasino%2fb": ("block", 1, 0, 1), "http://x.org/%2563asino": ("allow", 0, 0, 0), "http://x.org/%%63asino%": ("block", 1, 0, 1), "http://x.org/%C3%A9casino": ("allow", 0, 0, 0),
        "http://x.org/POKER-poker_Bonus": ("block", 0, 2, 3), "http://x.org/" + "poker/" * 100_000: ("allow", 0, 1, 100_000), "http://x.org/" + "a" * 1_000_000 + "/porn": ("block", 1, 0, 1), "http://essex.org/sextant/adultery": ("allow", 0, 0, 0),
    }
    got = url_filter.judge(spark.createDataFrame([(k, u) for k, u in enumerate(cases)] * 2, "page_id long, url string")).collect()
    assert sorted((r.page_id, r.verdict, r.n_strict, r.n_soft, r.n_hits) for r in got) == sorted([(k, *want) for k, want in enumerate(cases.values())] * 2)
    terms = url_filter.vocabulary()
    assert not set(terms["strict"]) & set(terms["soft"]) and min(map(len, terms.values())) > 50 and all(re.fullmatch("[a-z0-9]+", t) for own in terms.values() for t in own)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("%0123456789abcdefABCDEF/-"), max_size=30))
def test_url_decoding(url):
    out, i = "", 0
    while i < len(url):
        code = url[i + 1 : i + 3]
        if url[i] == "%" and len(code) == 2 and not set(code) & set("%/-") and 0x20 <= int(code, 16) <= 0x7E:
            out, i = out + chr(int(code, 16)), i + 3
        else:
            out, i = out + url[i], i + 1
    assert url_filter.decoded(url) == "".join(c.lower() if "A" <= c <= "Z" else c for c in out)


TRICKY = st.text(alphabet=st.sampled_from("\\#<>/ :|tunrAsi\n😀"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TRICKY, TRICKY)
def test_turns_read_back(role, text):
    segment, lo, hi, _ = chat_format.format_turn(role, [{"type": "text", "text": text}])
    assert chat_format.read_turn(segment) == (role, text)
    inner = segment[len(chat_format.OPEN) : -len(chat_format.CLOSE)]
    for control in ("###", "</turn>", "<|"):
        assert control not in re.sub(r"\\.", "", inner, flags=re.S)
    if role == "assistant":
        assert chat_format.unescape(segment[lo:hi]) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b# "]), TRICKY), max_size=5), st.lists(st.integers(0, 300), max_size=6))
def test_output_is_read_wherever_it_is_cut(turns, cuts):
    output, spans = "", []
    for role, text in turns:
        segment, lo, hi, _ = chat_format.format_turn(role, [{"type": "text", "text": text}, {"type": "image", "ref": "a"}])
        spans += [(len(output) + lo, len(output) + hi)] if hi > lo else []
        output += segment
    reader, edges = chat_format.Reader(), [0, *sorted(min(c, len(output)) for c in cuts), len(output)]
    for a, b in zip(edges, edges[1:], strict=False):
        reader.feed(output[a:b], [s for s in spans if a < s[1] <= b])
    reader.close()
    said = "".join(f"{t}<|image:0|>" for r, t in turns if r == "assistant")
    assert (reader.turns, reader.placeholders, reader.chars) == (len(turns), len(turns), len(output))
    assert reader.all_sha.hexdigest() == hashlib.sha256("".join(f"{r}\n{t}<|image:0|>\n" for r, t in turns).encode()).hexdigest()
    assert (reader.loss_chars, reader.loss_sha.hexdigest()) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    if output:
        broken = chat_format.Reader()
        broken.feed(output[:-1], [])
        with pytest.raises(ValueError):
            broken.close()


@pytest.mark.parametrize("unit", ["a", "\\", "# <|image:0|> </turn>\n", "\n"])
def test_memory_of_a_long_turn(unit):
    """20 MB of text, formatted and read back, in at most 8 bytes a character of the output."""
    text = unit * (20_000_000 // len(unit))
    tracemalloc.start()
    segment, lo, hi, _ = chat_format.format_turn("assistant", [{"type": "text", "text": text}])
    reader = chat_format.Reader()
    reader.feed(segment, [(lo, hi)])
    reader.close()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert reader.loss_sha.hexdigest() == hashlib.sha256(text.encode()).hexdigest() and reader.turns == 1
    assert most < 8 * len(segment)


def test_parts():
    segment, lo, hi, found = chat_format.format_turn("assistant", [{"type": "text", "text": "see <|image:0|>"}, {"type": "image", "ref": "a.png", "size": 2}, {"type": "audio", "ref": "b.wav"}, {"type": "document", "ref": None, "size": 3}])
    assert segment.replace("\\<", "").count("<|image:0|>") == 1 and [a["tokens"] for a in found] == [512, 25, 1536] and [a["type"] for a in found] == ["image", "audio", "document"]
    assert chat_format.read_turn(segment)[1] == "see <|image:0|><|image:0|><|audio:1|><|document:2|>"
    with pytest.raises(ValueError):
        chat_format.format_turn("user", [{"type": "video"}])


def test_chat_query_equals_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    talks = defaultdict(list)
    for c, t, r, x in sorted(rows):
        talks[c].append((r, x or ""))
    got = {r.conv_id: r for r in queries.op9_chat_format(spark, data).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        said = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{x}\n" for a, x in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat_format.format_turn(a, [{"type": "text", "text": x}])[0]) for a, x in turns)


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, segment string, parts array<struct<type:string,text:string,ref:string,size:int>>"
    rows = [(1, 0, None, None, "own", None), (1, None, "user", "first", "own", None), (1, 0, "assistant", "x" * 300_000, "own", None), (None, 0, "user", "lost", "own", None), (2, 0, "user", "a", "own", [("image", None, "i.png", 1)]), (2, 0, "user", "a", "own", [("image", None, "i.png", 1)])]
    df = spark.createDataFrame(rows, schema)
    turns = chat_format.format_turns(df)
    assert turns.where("conv_id = 2").first().expanded_tokens == 256
    got = {r.conv_id: r for r in chat_format.digests(turns).collect()}
    assert (got[2].n_attachments, got[2].expanded_tokens, got[1].n_attachments) == (2, 512, 0)
    assert got[1].n_turns == 3 and got[1].loss_chars == 300_000 and got[None].n_turns == 1 and got[2].n_turns == 2
    assert chat_format.digests(chat_format.format_turns(df.where("false"))).count() == 0
