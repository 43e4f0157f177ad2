"""Kept model calls: how often a model is asked, failures, odd rows."""

from __future__ import annotations

import os
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sedra.operators.chunking import chunk
from sedra.operators.joins import left_join_hot
from sedra.operators.splitters import Size, grouped, sentences
from sedra.plans import prompt
from sedra.plans.calls import CallTable
from sedra.plans.model_split import chunk_by_calls
from sedra.queries import QUERIES


def counting(folder, broken: str = ""):
    """A model that answers in capitals, notes each prompt that it is asked in a file of its own, and fails for batches with `broken` in a prompt."""

    def load():
        def model(prompts):
            for p in prompts:
                with open(f"{folder}/{os.getpid()}", "a") as f:
                    f.write(p + "\n")
            if broken and any(broken in p for p in prompts):
                raise RuntimeError("no answer")
            return [p.upper() for p in prompts]

        return model

    return load


def seen(folder) -> Counter:
    return Counter(line for p in folder.iterdir() for line in p.read_text().splitlines())


@pytest.fixture
def places(tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    return notes, f"file://{tmp_path}/calls"


def test_equal_prompts_are_asked_once(spark, places):
    notes, path = places
    asked = spark.createDataFrame([*[(i, f"p{i % 7}") for i in range(100)], (100, None), (101, ""), (None, "p1")], "query_id long, prompt string")
    calls = CallTable(path, per_round=3, in_flight=2, batch=2)
    got = {r.query_id: (r.reply, r.error) for r in calls.replies(asked, counting(notes)).collect()}
    assert got == {**{i: (f"P{i % 7}", None) for i in range(100)}, 100: (None, None), 101: ("", None), None: ("P1", None)}
    assert seen(notes) == Counter([*[f"p{i}" for i in range(7)], ""])
    more = spark.createDataFrame([(1, "p1"), (2, "new")], "query_id long, prompt string")
    assert sorted(tuple(r) for r in calls.replies(more, counting(notes)).collect()) == [(1, "P1", None), (2, "NEW", None)]
    assert seen(notes)["p1"] == 1 and seen(notes)["new"] == 1
    other = CallTable(path, model="other", in_flight=1)
    assert other.replies(more, counting(notes)).count() == 2 and seen(notes)["p1"] == 2
    assert calls.replies(asked.limit(0), counting(notes)).count() == 0


def test_failures_are_repeated_reported_and_asked_again(spark, places):
    notes, path = places
    asked = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "query_id int, prompt string")
    calls = CallTable(path, in_flight=2, batch=1, tries=3, wait=0.01)
    got = sorted(tuple(r) for r in calls.replies(asked, counting(notes, "bad")).collect())
    assert got == [(1, "GOOD", None), (2, None, "no answer"), (3, "FINE", None)]
    assert seen(notes) == Counter(good=1, fine=1, bad=3)
    assert sorted(tuple(r) for r in calls.replies(asked, counting(notes)).collect()) == [(1, "GOOD", None), (2, "BAD", None), (3, "FINE", None)]
    assert seen(notes) == Counter(good=1, fine=1, bad=4)


def test_a_failed_job_goes_on_after_its_stored_rounds(spark, places, tmp_path):
    """The model's load fails from the second round on; what the first one stored is not asked again."""
    notes, path = places
    asked = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "query_id int, prompt string")
    calls = CallTable(path, per_round=10, in_flight=1)
    gate, load = tmp_path / "gate", counting(notes)

    def fails_later():
        if gate.exists():
            raise OSError("no model")
        gate.touch()
        return load()

    with pytest.raises(Exception, match="no model"):
        calls.replies(asked, fails_later)
    stored = seen(notes)
    assert 0 < len(stored) < 40
    assert {r.query_id: r.reply for r in calls.replies(asked, load).collect()} == {i: f"P{i}" for i in range(40)}
    assert seen(notes) == Counter({f"p{i}": 1 for i in range(40)})


def test_jobs_side_by_side(spark, places):
    notes, path = places
    asked = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "query_id int, prompt string")
    calls = CallTable(path, per_round=5, in_flight=1)
    with ThreadPoolExecutor(2) as pool:
        for got in pool.map(lambda _: calls.replies(asked, counting(notes)).collect(), range(2)):
            assert {r.query_id: r.reply for r in got} == {i: f"P{i}" for i in range(20)}


def test_wrong_numbers_of_replies_are_errors(spark, places):
    asked = spark.createDataFrame([(1, "a")], "query_id int, prompt string")
    calls = CallTable(places[1], tries=1)
    assert calls.replies(asked, lambda: lambda prompts: []).first().error == "1 prompts, 0 replies"
    with pytest.raises(ValueError):
        CallTable(places[1], batch=0)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_splitting_by_kept_calls_equals_the_method(spark, data):
    assert rows(QUERIES["chunk_llm_kept"](spark, data)) == rows(QUERIES["chunk_llm_stub"](spark, data))


def test_split_sections_are_asked_once(spark, places):
    notes, path = places
    size, long = Size(60, 2), "\n\n".join("A sentence here. " * 40 + f"Part {k % 3}." for k in range(20))
    texts = [(1, "Short. "), (2, None), (3, ""), (None, "  \n "), (None, "One sentence. Another one follows it here. " * 4), (4, "One sentence. Another one follows it here. " * 4), (4, long), (4, long), (2**60 + 1, "x" * 300)]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in texts], "doc_id long, text string, chunk string")
    note = counting(notes)

    def load():
        model = note()

        def answer(prompts):
            model([str(hash(p)) for p in prompts])
            return [prompt.every_hundred(p) for p in prompts]

        return answer

    calls = CallTable(path, in_flight=2, batch=3)
    want = rows(chunk(docs, "llm", size, ask=prompt.asking(prompt.every_hundred, size.chunk)))
    assert rows(chunk_by_calls(docs, calls, load, size)) == want and {r[0] for r in want} == {1, None, 4, 2**60 + 1}
    first = seen(notes)
    assert set(first.values()) == {1}
    assert rows(chunk_by_calls(docs, calls, load, size)) == want and seen(notes) == first
    assert chunk_by_calls(docs.limit(0), calls, load, size).count() == 0


def test_sections_without_a_reply_are_cut_by_sentences(spark, places):
    size, text = Size(60, 0), "One sentence stands here. " * 10
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")

    def load():
        def model(prompts):
            raise RuntimeError("down")

        return model

    got = chunk_by_calls(docs, CallTable(places[1], in_flight=1, tries=1), load, size).orderBy("chunk_pos").collect()
    assert [r.chunk for r in got] == grouped(sentences(text), size) and [r.chunk_pos for r in got] == list(range(len(got)))
    assert chunk_by_calls(docs, CallTable(places[1], in_flight=1), lambda: lambda prompts: [prompt.every_hundred(p) for p in prompts], size).count() > 0


def test_hot_keys_are_dealt(spark):
    left = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("none", 3), (None, 4)], "k string, v int")
    got = {r.id: (r.k, r.v) for r in left_join_hot(left, right, "k", "id").collect()}
    assert got == {i: [("hot", 1), (str(i), 2 if i == 1 else None), (None, None)][i % 3] for i in range(20_000)}
    assert left_join_hot(left.limit(0), right, "k", "id").count() == 0 and left_join_hot(left, right.limit(0), "k", "id").count() == 20_000
