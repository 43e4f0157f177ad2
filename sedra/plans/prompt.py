"""Prompts from ranked context, and replies from a pluggable model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedra.plans.search import Retriever

# The prompt's head and its numbered lines.
HEAD = "Dựa vào các thông tin sau đây, hãy trả lời câu hỏi %s một cách ngắn gọn và chính xác:\n"
LINE = "Thông tin %d: %s\n"


def augment(retriever: Retriever, queries: DataFrame, top_k: int = 5) -> DataFrame:
    """The context of each query: the best top_k of ten candidates."""
    return retriever.search(queries, n_retrieve=10, n_final=top_k)


def prompts(queries: DataFrame, context: DataFrame, head: str = HEAD, line: str = LINE) -> DataFrame:
    """(query_id, prompt): the head with the question, then the documents by rank, numbered. A query without context gets the head alone."""
    # A query's context is its few ranked rows, so the list is small.
    lines = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.format_string(line, F.col("rank"), F.col("document")).alias("line")))).alias("lines"))
    body = F.array_join(F.transform(F.coalesce("lines", F.array().cast("array<struct<rank:int,line:string>>")), lambda x: x["line"]), "")
    return queries.join(lines, "query_id", "left").select("query_id", F.concat(F.format_string(head, F.col("query")), body).alias("prompt"))


def extractive(texts: list[str]) -> list[str]:
    """The stand-in for a model: the first line of context, or nothing."""
    return [(t.split("\n") + [""])[1].partition(": ")[2] for t in texts]


def replies(asked: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]] = lambda: extractive) -> DataFrame:
    """(query_id, reply, error) for asked (query_id, prompt): the model is loaded once a task, and a failing batch gives errors, not a failed job."""
    kind = asked.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            try:
                yield pd.DataFrame({"query_id": b["query_id"], "reply": model(b["prompt"].tolist()), "error": None})
            except Exception as e:
                yield pd.DataFrame({"query_id": b["query_id"], "reply": None, "error": str(e)})

    return asked.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, reply string, error string")


def answer(retriever: Retriever, queries: DataFrame, top_k: int = 5, load: Callable[[], Callable[[list[str]], list[str]]] = lambda: extractive) -> DataFrame:
    """(query_id, reply, error) for each message: search, prompt, model."""
    return replies(prompts(queries, augment(retriever, queries, top_k)), load)


def split_prompt(section: str, chunk_size: int) -> str:
    """What a model is asked for split points of a section."""
    return (
        "Find where the topic of the text below changes, so that it can be cut into parts of about "
        f"{chunk_size} characters. Answer with one line: SPLIT_POINTS: [p1, p2, ...], the character positions of the cuts.\n\n{section}"
    )


_LISTED = re.compile(r"SPLIT_POINTS:\s*\[([\d,\s]+)\]")


def parsed_points(answer: str) -> list[int]:
    """The positions that an answer lists, in order; without a list, the first ten numbers of two digits or more. text.split_points() is the same for a column."""
    listed = _LISTED.search(answer)
    return sorted(int(x) for x in (re.findall(r"\d+", listed[1]) if listed else re.findall(r"\b\d{2,}\b", answer)[:10]))


def asking(model: Callable[[str], str], chunk_size: int) -> Callable[[str], list[int]]:
    """What the llm splitting method asks with: a section to the positions in the model's answer to split_prompt()."""
    return lambda section: parsed_points(model(split_prompt(section, chunk_size)))


def every_hundred(prompt: str) -> str:
    """The stand-in for a model that suggests split points: one every 100 characters of the section."""
    section = prompt.partition("\n\n")[2]
    return f"The topic changes often. SPLIT_POINTS: [{', '.join(str(p) for p in range(100, len(section), 100))}]"
