"""URL filter: host and path rules, and a weighted vocabulary counted by an Aho-Corasick automaton.

Rules are strings `host/path`; a rule fits its host and all its subdomains where the url's path starts with the rule's
path, and the longest fitting rule decides. Where none fits, the vocabulary does: one strict term or SOFT_HITS distinct
soft terms reject the url. A term counts only between boundaries: no ASCII letter or digit may touch it. Terms are looked
for after percent-decoding of printable ASCII, once, and in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedra.llm.shared import UPPER, ascii_lower, in_batches

#: Rules as (verdict, host/path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
TERMS = Path(__file__).with_name("data") / "url_terms.txt"
SOFT_HITS = 2


@cache
def vocabulary(path: Path = TERMS) -> dict[str, tuple[str, ...]]:
    """The strict and soft terms of a resource file."""
    out: dict[str, list[str]] = {"strict": [], "soft": []}
    kind = None
    for line in path.read_text(encoding="utf-8").splitlines():
        if line.startswith("== "):
            kind = line[3:].strip()
        elif kind:
            out[kind] += line.split()
    return {k: tuple(dict.fromkeys(v)) for k, v in out.items()}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end. Null or no `://`: both empty."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`_url`"))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_index(rules: tuple[tuple[str, str], ...]) -> dict[str, list[tuple[str, str, str]]]:
    """By host: (path, rule, verdict)."""
    out: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, rule, verdict))
    return out


def matching_rule(index: dict[str, list[tuple[str, str, str]]], host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule for the host or a domain above it, and its verdict."""
    best: tuple[str | None, str | None] = (None, None)
    domain = host
    while True:
        for start, rule, verdict in index.get(domain, ()):
            if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                best = (rule, verdict)
        _, dot, domain = domain.partition(".")
        if not dot:
            return best


def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for t in terms:
            out.add_word(t, (t, weight))
    out.make_automaton()
    return out


_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_CODE = re.compile(r"%([2-6][0-9A-Fa-f]|7[0-9A-Ea-e])")
_LOWER = str.maketrans(UPPER, UPPER.lower())


def decoded(url: str) -> str:
    """The url with percent-codes of printable ASCII decoded, once, and A-Z lower-cased."""
    return _CODE.sub(lambda m: chr(int(m[1], 16)), url).translate(_LOWER)


def term_hits(auto, url: str) -> tuple[dict[str, int], dict[str, int]]:
    """The strict and soft terms that stand between boundaries in a decoded url, with their counts."""
    strict: dict[str, int] = {}
    soft: dict[str, int] = {}
    for end, (term, weight) in auto.iter(url):
        start = end - len(term)
        if (start < 0 or url[start] not in _WORD) and (end + 1 == len(url) or url[end + 1] not in _WORD):
            own = strict if weight == 2 else soft
            own[term] = own.get(term, 0) + 1
    return strict, soft


def judge(df: DataFrame, url: str = "url", key: str = "page_id", rules=RULES, strict: Sequence[str] | None = None, soft: Sequence[str] | None = None, soft_hits: int = SOFT_HITS) -> DataFrame:
    """One row for each row of df: key, host, path, rule, verdict, n_strict, n_soft (distinct terms) and n_hits (all places).

    A null url has empty host and path and no terms, so it is allowed. Repeated rows stay repeated; other columns of df,
    whatever their names, are not read. The automaton and the rules are constants of the job, built once in each task.
    """
    source = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    source = source.select("_key", host.alias("_host"), path.alias("_path"), F.coalesce("_url", F.lit("")).alias("_whole"))
    kind = source.schema["_key"].dataType.simpleString()
    strict, soft = (tuple(vocabulary()[name] if own is None else own) for name, own in (("strict", strict), ("soft", soft)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, index = automaton(strict, soft), rule_index(rules)
        for b in batches:
            found_rule, verdicts, n_strict, n_soft, n_hits = [], [], [], [], []
            for host, path, whole in zip(b["_host"].to_pylist(), b["_path"].to_pylist(), b["_whole"].to_pylist(), strict=True):
                rule, verdict = matching_rule(index, host, path)
                hard, weak = term_hits(auto, decoded(whole))
                found_rule.append(rule)
                verdicts.append(verdict or ("block" if hard or len(weak) >= soft_hits else "allow"))
                n_strict.append(len(hard))
                n_soft.append(len(weak))
                n_hits.append(sum(hard.values()) + sum(weak.values()))
            yield pa.RecordBatch.from_arrays(
                [b["_key"], b["_host"], b["_path"], pa.array(found_rule, pa.string()), pa.array(verdicts, pa.string()), pa.array(n_strict, pa.int32()), pa.array(n_soft, pa.int32()), pa.array(n_hits, pa.int64())],
                names=["key", "host", "path", "rule", "verdict", "n_strict", "n_soft", "n_hits"],
            )

    out = in_batches(source, run, f"key {kind}, host string, path string, rule string, verdict string, n_strict int, n_soft int, n_hits long")
    return out.withColumnRenamed("key", key)


def judge_sql() -> str:
    """The same for DuckDB: the words between boundaries, counted against the vocabulary, and each rule tried in turn from the longest."""
    low = lambda x: f"translate({x}, '{UPPER}', '{UPPER.lower()}')"
    names = lambda kind: "[" + ", ".join(f"'{t}'" for t in vocabulary()[kind]) + "]"
    # What follows each per cent sign is decoded on its own, so nothing is decoded twice.
    code = "case when regexp_matches(p, '^([2-6][0-9A-Fa-f]|7[0-9A-Ea-e])') then chr(('0x' || substr(p, 1, 2))::int) || substr(p, 3) else '%' || p end"
    whole = f"(string_split(coalesce(url, ''), '%')[1] || array_to_string(list_transform(string_split(coalesce(url, ''), '%')[2:], lambda p: {code}), ''))"
    cases = {}
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        cases[rule] = (f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}')", verdict)
    pick = lambda out: "case " + " ".join(f"when {test} then '{out(rule, verdict)}'" for rule, (test, verdict) in cases.items()) + " end"
    return f"""
    with rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r, regexp_extract_all({low(whole)}, '[a-z0-9]+') as words from pages),
    parts as (select page_id, {low("regexp_extract(r, '^([^/?#]*)', 1)")} as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path,
      list_filter(words, lambda w: list_contains({names('strict')}, w)) as hard, list_filter(words, lambda w: list_contains({names('soft')}, w)) as weak from rest),
    counted as (select *, len(list_distinct(hard))::int as n_strict, len(list_distinct(weak))::int as n_soft, (len(hard) + len(weak))::bigint as n_hits from parts)
    select page_id, host, path, {pick(lambda r, v: r)} as rule,
      coalesce({pick(lambda r, v: v)}, case when n_strict > 0 or n_soft >= {SOFT_HITS} then 'block' else 'allow' end) as verdict, n_strict, n_soft, n_hits
    from counted"""
