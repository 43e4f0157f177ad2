"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from sedra.functions import patterns as P
from sedra.operators.ranking import STOP_WORDS
from sedra.plans.prompt import HEAD, LINE
from sedra.queries import NOISE

WS, WORD = P.WS, P.WORD


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def lines(x: str, each: str) -> str:
    return f"list_transform(string_split({x}, chr(10)), lambda line: {each})"


def _letters(x: str) -> str:
    once = lambda e: sub(e, rf"(^|[^{WORD}])[A-Za-z]($|[^{WORD}])", r"\1\2")
    return once(once(x))


CLEAN = {
    "nfc": lambda x: f"nfc_normalize({x})",
    "zero_width": lambda x: f"translate({x}, {q(P.ZERO_WIDTH)}, '')",
    "quotes": lambda x: f"translate({x}, {q(P.DOUBLE_QUOTES)}, {q(chr(34) * 3)})",
    "low_quote": lambda x: f"replace({x}, {q(P.LOW_QUOTE)}, '''')",
    "dashes": lambda x: f"translate({x}, {q(P.DASHES)}, '---')",
    "ellipsis": lambda x: f"replace({x}, '…', '...')",
    "spaces": lambda x: sub(x, " +", " "),
    "newlines": lambda x: f"regexp_replace({x}, '\\n[{WS}]*\\n[{WS}]*\\n+', chr(10) || chr(10), 'g')",
    "rtrim_lines": lambda x: f"array_to_string({lines(x, sub('line', f'[{WS}]+$'))}, chr(10))",
    "letters": _letters,
    "punctuation": lambda x: sub(sub(sub(x, r"\.{4,}", "..."), "!{2,}", "!"), r"\?{2,}", "?"),
    "number_lines": lambda x: sub(x, rf"(?m)^[{WS}]*\p{{Nd}}+[{WS}]*$"),
    "page_marks": lambda x: sub(x, P.PAGE_MARK),
    "urls": lambda x: sub(x, P.URL),
    "emails": lambda x: sub(x, rf"\b{P.EMAIL}\b"),
    "characters": lambda x: sub(x, P.DISALLOWED, " "),
    "blank_lines": lambda x: f"array_to_string(list_filter({lines(x, strip('line'))}, lambda line: line <> ''), chr(10))",
    "strip": strip,
}


def cleaning(*stages: str) -> str:
    """Each stage in a subquery of its own, so that none is written out twice."""
    inner = f"select 'document' as kind, doc_id as id, {q(NOISE)} || text as t from documents union all select 'page', page_id, {q(NOISE)} || html from pages"
    for s in stages:
        inner = f"select kind, id, {CLEAN[s]('t')} as t from ({inner})"
    return f"select kind, id, t as cleaned from ({inner})"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> '')"


def sentence_list(x: str) -> str:
    cut = rf"regexp_replace({x}, '([{P.SENTENCE_END}])[{WS}]+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def posexplode(select: str, items: str, source: str, pos: str, value: str) -> str:
    return f"select {select}, (unnest(range(len({items}))))::int as {pos}, unnest({items}) as {value} from {source}"


def names(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def content(x: str, stop: tuple[str, ...]) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[{WORD}]+')), lambda w: not list_contains({names(stop)}, w))"


def jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0)::double)"


def token_chunks(size: int, overlap: int, source: str = "documents") -> str:
    step = size - overlap
    return f"""w as (select *, {tokens('text')} as words from {source}),
    m as (select *, case when len(words) >= {size} then (len(words) - {size}) // {step} + 1 else 0 end as full_ones from w),
    c as (select *, list_transform(range(full_ones + (full_ones * {step} < len(words))::int), lambda k: array_to_string(words[k * {step} + 1 : k * {step} + {size}], ' ')) as chunks from m)"""


def overlap_words(x: str, n: int) -> str:
    return f"case when len({tokens(x)}) <= {n} then {x} else array_to_string({tokens(x)}[-{n}:], ' ') end"


def goes_on(previous: str, now: str) -> str:
    a, b = content(previous, P.GROUPING_STOP_WORDS), content(now, P.GROUPING_STOP_WORDS)
    starts = " or ".join(f"starts_with(lower({now}), {q(c)})" for c in P.CONNECTORS)
    return f"({starts} or len({a}) = 0 or len({b}) = 0 or {jaccard(a, b)} > 0.2)"


def bm25(k: int = 10, k1: float = 1.2, b: float = 0.75) -> str:
    """The k best of all documents for each benchmark text, all of them scored."""
    words = lambda x: f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[{WORD}]{{2,}}'), lambda w: not list_contains({names(STOP_WORDS)}, w))"
    return f"""with d as (select doc_id, {words('text')} as words from documents),
    s as (select count(*) as n, avg(len(words)) as mean from d),
    t as (select doc_id, len(words) as size, unnest(words) as term from d),
    c as (select doc_id, size, term, count(*) as tf from t group by all),
    f as (select term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from c, s group by term),
    q as (select query_id, term, count(*) as asked from (select item_id as query_id, unnest({words('text')}) as term from benchmark) group by all),
    r as (select query_id, doc_id, round(sum(asked * idf * (tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * size / mean)))), 9) as score from q join f using (term) join c using (term), s group by all),
    o as (select *, (row_number() over (partition by query_id order by score desc, doc_id))::int as rank from r)
    select query_id, doc_id, round(score, 6) as score, rank from o where rank <= {k}"""


def marked(x: str) -> str:
    """With chr(2) before and chr(3) after each run of word characters: RE2 has no Unicode word edges, so they are written out."""
    return f"regexp_replace({x}, '([{WORD}]+)', chr(2) || '\\1' || chr(3), 'g')"


def found(x: str, pattern: str) -> str:
    """Distinct matches in marked text of a pattern in which < and > stand for the marks."""
    whole = pattern.replace("<", "\x02").replace(">", "\x03")
    return f"list_distinct(list_transform(regexp_extract_all({x}, {q(whole)}), lambda m: translate(m, chr(2) || chr(3), '')))"


_D = r"\p{Nd}"
FEATURED = f"""s as (select doc_id, {sentence_list('text')} as s from documents), r as ({posexplode('doc_id', 's', 's', 'i', 'sentence')}),
    k as (select *, {marked('sentence')} as here, {marked('lower(sentence)')} as low from r),
    featured as (select doc_id, i, {content('sentence', P.FEATURE_STOP_WORDS)} as words, {found('low', f'<[{P.PHRASE_LETTERS}]+>[{WS}]+<[{P.PHRASE_LETTERS}]+>')} as noun_phrases,
      list_distinct(list_concat(list_concat({found('here', f'<{_D}+>(?:[.,]<{_D}+>)*')}, {found('here', f'<{_D}{{1,2}}>[/-]<{_D}{{1,2}}>[/-]<{_D}{{2,4}}>')}), {found('here', '<[A-Z][a-z]+>')})) as entities,
      len(sentence)::int as length, len({tokens('sentence')})::int as word_count from k)"""


def buckets(x: str) -> str:
    return f"list_transform(regexp_extract_all(lower({x}), '[{WORD}]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::bigint % 64)"


def embedded(source: str, key: str, text: str, name: str) -> str:
    """CTEs that end in {name} (key, text, e)."""
    return f"""{name}_b as (select {key}, {text}, {buckets(text)} as b from {source}),
    {name}_c as (select {key}, {text}, list_transform(range(64), lambda k: len(list_filter(b, lambda x: x = k))::double) as c from {name}_b),
    {name}_n as (select *, sqrt(list_sum(list_transform(c, lambda x: x * x))) as n from {name}_c),
    {name} as (select {key}, {text}, list_transform(c, lambda x: case when n > 0 then x / n else 0.0 end) as e from {name}_n)"""


FOUND = f"""asked as (select item_id as query_id, text as query from benchmark), library as (select doc_id, text as document from documents),
    {embedded('asked', 'query_id', 'query', 'qe')}, {embedded('library', 'doc_id', 'document', 'de')},
    dist as (select query_id, query, doc_id, document, qe.e as q_e, de.e as d_e,
      list_sum(list_transform(range(1, 65), lambda k: (qe.e[k] - de.e[k]) * (qe.e[k] - de.e[k]))) as distance from qe, de),
    found as (select *, 1 / (1 + distance) as retrieval_score, row_number() over (partition by query_id order by distance, doc_id)::int as retrieval_rank from dist qualify retrieval_rank <= 10),
    cos as (select *, list_sum(list_transform(range(1, 65), lambda k: q_e[k] * d_e[k])) / nullif(sqrt(list_sum(list_transform(q_e, lambda x: x * x))) * sqrt(list_sum(list_transform(d_e, lambda x: x * x))), 0) as raw from found),
    semantic as (select query_id, doc_id, coalesce(raw, 0) as bi from cos),
    pair as (select query_id, doc_id, coalesce({jaccard(content('query', P.GROUPING_STOP_WORDS), content('document', P.GROUPING_STOP_WORDS))}, 0) as cross_score from found),
    tokens as (select query_id, doc_id, unnest(list_filter(regexp_extract_all(lower(document), '[{WORD}]{{2,}}'), lambda w: not list_contains({names(STOP_WORDS)}, w))) as term from found),
    tf as (select query_id, doc_id, term, count(*) as tf from tokens group by all),
    vocabulary as (select query_id, term, count(*) as df, row_number() over (partition by query_id order by sum(tf) desc, term) as place from tf group by query_id, term qualify place <= 10000),
    sizes as (select query_id, count(*) as n from found group by query_id),
    idf as (select query_id, term, df, ln((1 + n) / (1 + df)::double) + 1 as idf from vocabulary join sizes using (query_id)),
    weighed as (select *, tf * idf as w from tf join idf using (query_id, term)),
    terms as (select *, w / sqrt(sum(w * w) over (partition by query_id, doc_id)) as weight from weighed),
    q_tokens as (select query_id, unnest(list_filter(regexp_extract_all(lower(query), '[{WORD}]{{2,}}'), lambda w: not list_contains({names(STOP_WORDS)}, w))) as term from (select distinct query_id, query from found)),
    q_tf as (select query_id, term, count(*) * any_value(idf) as w from q_tokens join idf using (query_id, term) group by query_id, term),
    q_unit as (select query_id, term, w / sqrt(sum(w * w) over (partition by query_id)) as qw from q_tf),
    hits as (select query_id, doc_id, round(sum(weight * qw), 12) as tfidf from terms join q_unit using (query_id, term) group by all),
    tfidf as (select query_id, doc_id, coalesce(tfidf, 0) as tfidf from found left join hits using (query_id, doc_id))"""


def min_max(x: str) -> str:
    own = "over (partition by query_id)"
    return f"(case when count({x}) {own} > 1 then ({x} - min({x}) {own}) / (max({x}) {own} - min({x}) {own} + 1e-8) else {x} end)"


SCORES = f"""{FOUND},
    all_scores as (select query_id, doc_id, retrieval_rank, retrieval_score, query, document, cross_score,
      0.5 * {min_max('bi')} + 0.5 * {min_max('cross_score')} as bi_score, 0.3 * {min_max('tfidf')} + 0.7 * {min_max('bi')} as hybrid_score
      from found join semantic using (query_id, doc_id) join pair using (query_id, doc_id) join tfidf using (query_id, doc_id)),
    scored as (select *, {min_max('cross_score')} as n_cross, {min_max('bi_score')} as n_bi, {min_max('hybrid_score')} as n_hybrid from all_scores)"""


def by(score: str, limit: str = "") -> str:
    return f"""with {SCORES}, final as (select *, {score} as score from scored),
    placed as (select *, row_number() over (partition by query_id order by score desc, retrieval_rank)::int as rank from final)
    select query_id, doc_id, round(score, 6) as score, rank from placed {limit}"""


def knn(metric: str, select: str) -> str:
    dot = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda k: {a}[k] * {b}[k]))"
    expression = "list_sum(list_transform(range(1, len(a) + 1), lambda k: (a[k] - b[k]) * (a[k] - b[k])))" if metric == "l2" else f"greatest(0, 1 - coalesce({dot('a', 'b')} / nullif(sqrt({dot('a', 'a')}) * sqrt({dot('b', 'b')}), 0), 0))"
    return f"""with v as (select vec_id, embedding::double[] as e from embeddings),
    p as (select q.vec_id as query_id, c.vec_id as doc_id, q.e as a, c.e as b from v q, v c where q.vec_id % 100 = 0),
    d as (select query_id, doc_id, {expression} as distance from p),
    r as (select *, row_number() over (partition by query_id order by distance, doc_id)::int as retrieval_rank from d qualify retrieval_rank <= 10)
    select {select} from r"""


STORED = f"{token_chunks(50, 10)}, stored as (select source, unnest(chunks) as document from c)"


AS_FILES = "'/data/' || doc_id || '.txt'"
LIBRARY = "library as (select doc_id, text as document from documents)"
CHUNK_LIBRARY = f"""{token_chunks(50, 10)}, x as ({posexplode('doc_id', 'chunks', 'c', 'chunk_pos', 'chunk')}),
    library as (select sha256({AS_FILES} || ':' || chunk_pos || ':' || chunk) as doc_id, chunk as document from x)"""

#: Window by window: base rows stand before a text's first window. `last` tells that a window reaches the end.
CHARACTER = f"""with recursive d as materialized (select doc_id, text, len(text) as n from documents where len(text) > 0),
    walk(doc_id, k, start, cut, last) as (
      select doc_id, -1, -1, 0, false from d
      union all
      select doc_id, k + 1, start, case when start + 200 >= n then n when mark > 0 and low + mark <> stop then low + mark when blank > 0 and from_blank + blank + 1 <> stop then from_blank + blank + 1
          when ahead > 1 then stop + ahead - 1 when back > 0 then stop - back else stop end, start + 200 >= n
      from (select *, coalesce(len(regexp_extract(substr(text, low + 1, least(stop + 51, n) - low), '^((?s:.*?)[{P.SENTENCE_END}]) ', 1)), 0) as mark,
          strpos(substr(text, from_blank + 1, least(stop + 100, n - 1) + 1 - from_blank), chr(10) || chr(10)) as blank,
          strpos(substr(text, stop + 1, least(stop + 50, n) - stop), ' ') as ahead, strpos(reverse(substr(text, half + 1, stop - half)), ' ') as back
        from (select *, start + 200 as stop, greatest(start + 1, start + 150) as low, greatest(start + 1, start + 100) as from_blank, start + 101 as half
          from (select d.doc_id, text, n, k, case when cut - 30 > start then cut - 30 else cut end as start from walk join d on d.doc_id = walk.doc_id where not last) where start < n))),
    out as (select doc_id, k, {strip("substr(text, start + 1, cut - start)")} as chunk from walk join d using (doc_id) where k >= 0)
    select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as chunk_pos, chunk from out where chunk <> ''"""


def recursive(base: int) -> str:
    """CTEs from n0 (doc_id, path, t), texts of over 200 characters at paths of `base` numbers, to split (doc_id, path, chunk): level by level of separators, then overlaps from the deepest level up."""
    steps = []
    for k, mark in enumerate(P.SEPARATORS):
        s = " || ".join(f"chr({ord(c)})" for c in mark)
        # A long piece is a place holder, chr(2), among the packed ones; its own pieces go below that place.
        steps.append(f"""y{k} as (select doc_id, path, list_transform(range(1, len(string_split(t, {s})) + 1), lambda i: string_split(t, {s})[i] || case when i < len(string_split(t, {s})) then {s} else '' end) as pieces from n{k} where contains(t, {s})),
    z{k} as (select doc_id, path, list_filter(pieces, lambda p: len(p) > 200) as longs, list_reduce(list_transform(pieces, lambda p: [case when len(p) > 200 then chr(2) else p end]),
      lambda acc, x: case when x[1] <> chr(2) and acc[-1] <> chr(2) and len(acc[-1]) + len(x[1]) <= 200 then list_concat(acc[1 : len(acc) - 1], [acc[-1] || x[1]]) else list_concat(acc, x) end) as packed from y{k}),
    c{k} as (select doc_id, list_append(path, g) as path, {strip("packed[g]")} as chunk from (select *, unnest(range(1, len(packed) + 1)) as g from z{k}) where packed[g] <> chr(2)),
    n{k + 1} as (select doc_id, path, t from n{k} where not contains(t, {s})
      union all select doc_id, list_append(path, list_filter(range(1, len(packed) + 1), lambda g: packed[g] = chr(2))[j]), longs[j] from (select *, unnest(range(1, len(longs) + 1)) as j from z{k}))""")
    last = len(P.SEPARATORS)
    all_ = " union all ".join(f"select doc_id, path, chunk, false as fixed from c{k} where chunk <> ''" for k in range(last))
    steps.append(f"""f as (select doc_id, list_append(path, w + 1) as path, {strip("substr(t, w + 1, 200)")} as chunk from (select *, unnest(range(0, len(t), 170)) as w from n{last})),
    o{base + last + 1} as ({all_} union all select doc_id, path, chunk, true from f where chunk <> '')""")
    for level in range(base + last + 1, base, -1):
        lead = overlap_words("before", 30)
        steps.append(f"""v{level} as (select *, case when len(path) >= {level} and not (fixed and len(path) = {level}) then lag(chunk) over (partition by doc_id, path[1 : {level - 1}], len(path) >= {level} order by path) end as before from o{level}),
    u{level} as (select *, case when before is not null then {lead} end as lead_words from v{level}),
    o{level - 1} as (select doc_id, path, fixed, case when lead_words is not null and lead_words <> '' and not starts_with(chunk, {strip('lead_words')}) and len(lead_words || ' ' || chunk) <= 240 then lead_words || ' ' || chunk else chunk end as chunk from u{level})""")
    return ",\n    ".join([*steps, f"split as (select doc_id, path, chunk from o{base})"])


def numbered(source: str) -> str:
    return f"select doc_id, (row_number() over (partition by doc_id order by path) - 1)::int as chunk_pos, chunk from {source}"


#: Neighbouring sentences that go on with each other, joined while they fit; s holds the sentence lists.
GROUPS = f"""s as (select doc_id, {sentence_list('text')} as s from documents), r as ({posexplode('doc_id', 's', 's', 'i', 'now')}),
    p as (select *, lag(now) over (partition by doc_id order by i) as previous, count(*) over (partition by doc_id) as n from r),
    g as materialized (select doc_id, i, now, n, case when i = 0 then false else {goes_on('previous', 'now')} end as goes_on from p),
    walk(doc_id, i, n, chunk_pos, chunk) as (
      select doc_id, i, n, 0, now from g where i = 0
      union all
      select g.doc_id, g.i, g.n, case when joins then chunk_pos else chunk_pos + 1 end, case when joins then chunk || ' ' || now else now end
      from walk join g on g.doc_id = walk.doc_id and g.i = walk.i + 1, lateral (select g.n <= 2 or (g.goes_on and len(chunk) + len(now) + 1 <= 200) as joins)),
    groups as (select doc_id, chunk_pos, arg_max(chunk, i) as chunk from walk group by doc_id, chunk_pos)"""

#: Short texts and those of one sentence stay whole, those of two are split by separators, others by groups, and groups that are too long again.
SEMANTIC = f"""with recursive {GROUPS}, kinds as (select doc_id, text, case when len(text) <= 200 or len(s) <= 1 then 'whole' when len(s) < 3 then 'pair' else 'groups' end as kind from documents join s using (doc_id)),
    parts as (select doc_id, 0 as chunk_pos, text as chunk, kind from kinds where kind <> 'groups' union all select doc_id, chunk_pos, chunk, kind from groups join kinds using (doc_id) where kind = 'groups'),
    n0 as (select doc_id, [chunk_pos::bigint] as path, chunk as t from parts where kind <> 'whole' and len(chunk) > 200), {recursive(1)},
    everything as (select * from split union all select doc_id, [chunk_pos::bigint], {strip('chunk')} from parts where (kind = 'whole' or len(chunk) <= 200) and {strip('chunk')} <> '')
    {numbered('everything')}"""

RECURSIVE = f"""with n0 as (select doc_id, []::bigint[] as path, text as t from documents where len(text) > 200), {recursive(0)},
    everything as (select * from split union all select doc_id, []::bigint[], {strip('text')} from documents where len(text) <= 200 and {strip('text')} <> '')
    {numbered('everything')}"""

ORACLES: dict[str, str] = {
    "clean_nfc": cleaning("nfc"),
    "clean_zero_width": cleaning("zero_width"),
    "clean_quotes_dashes": cleaning("quotes", "low_quote", "dashes", "ellipsis"),
    "clean_spaces_newlines": cleaning("spaces", "newlines"),
    "clean_rtrim_lines": cleaning("rtrim_lines"),
    "clean_single_letters": cleaning("letters"),
    "clean_punct_runs": cleaning("punctuation"),
    "clean_page_lines": cleaning("number_lines", "page_marks"),
    "clean_urls": cleaning("urls"),
    "clean_emails": cleaning("emails"),
    "clean_charset": cleaning("characters"),
    "clean_blank_lines": cleaning("blank_lines", "strip"),
    "clean_full": cleaning("nfc", "zero_width", "quotes", "low_quote", "dashes", "ellipsis", "spaces", "newlines", "rtrim_lines", "letters", "punctuation", "number_lines", "page_marks", "urls", "emails", "characters", "spaces", "blank_lines", "strip"),
    "chunk_token": f"with {token_chunks(50, 10)} {posexplode('doc_id', 'chunks', 'c', 'chunk_pos', 'chunk')}",
    "chunk_token_plain": f"with {token_chunks(50, 0)} {posexplode('doc_id', 'chunks', 'c', 'chunk_pos', 'chunk')}",
    "chunk_fixed_stride": f"""with c as (select doc_id, list_filter(list_transform(range(0, len(text), 170), lambda s: {strip('substr(text, s + 1, 200)')}), lambda x: x <> '') as chunks from documents)
    {posexplode('doc_id', 'chunks', 'c', 'chunk_pos', 'chunk')}""",
    "chunk_small_text": f"select doc_id, 0 as chunk_pos, {strip('text')} as chunk from documents where len(text) <= 1500 and {strip('text')} <> ''",
    "chunk_overlap_prefix": f"""with {token_chunks(50, 0)}, e as ({posexplode('doc_id', 'chunks', 'c', 'chunk_pos', 'chunk')}),
    l as (select *, lag(chunk) over (partition by doc_id order by chunk_pos) as before from e),
    o as (select *, case when before is not null then {overlap_words('before', 10)} end as lead_words from l)
    select doc_id, chunk_pos, case when lead_words is not null and lead_words <> '' and not starts_with(chunk, {strip('lead_words')}) and len(lead_words || ' ' || chunk) <= 480 then lead_words || ' ' || chunk else chunk end as chunk from o""",
    "sentences": f"with s as (select doc_id, {sentence_list('text')} as s from documents) {posexplode('doc_id', 's', 's', 'i', 'sentence')}",
    "sentence_counts": f"""select 'document' as kind, doc_id as id, 0::bigint as turn, len({sentence_list('text')})::int as n_sentences, len({tokens('text')})::int as n_tokens from documents
    union all select 'chat', conv_id, turn, len({sentence_list('text')})::int, len({tokens('text')})::int from conversations""",
    "sentence_should_group": f"""with s as (select doc_id, {sentence_list('text')} as s from documents), r as ({posexplode('doc_id', 's', 's', 'i', 'now')}),
    p as (select *, lag(now) over (partition by doc_id order by i) as previous from r)
    select doc_id, i, {goes_on('previous', 'now')} as goes_on from p where i > 0""",
    "sentence_group_greedy": f"with recursive {GROUPS} select doc_id, chunk_pos, chunk from groups",
    "chunk_recursive": RECURSIVE,
    "chunk_semantic": SEMANTIC,
    "sentence_features": f"with {FEATURED} select doc_id, i, {', '.join(f"array_to_string(list_sort({c}), '|') as {c}" for c in ('words', 'noun_phrases', 'entities'))}, length, word_count from featured",
    "sentence_pair_similarity": f"""with {FEATURED} select a.doc_id, a.i, b.i as j, round(0.5 * coalesce({jaccard('a.words', 'b.words')}, 0) + 0.25 * coalesce({jaccard('a.noun_phrases', 'b.noun_phrases')}, 0)
      + 0.15 * coalesce({jaccard('a.entities', 'b.entities')}, 0) + 0.1 * (1 - abs(a.length - b.length) / greatest(a.length, b.length)::double), 9) as sim
      from featured a join featured b on a.doc_id = b.doc_id and a.i < b.i""",
    "cluster_pair_linkage": """with v as (select label, embedding::double[] as e from embeddings),
    u as (select label, list_transform(e, lambda x: coalesce(x / nullif(sqrt(list_sum(list_transform(e, lambda y: y * y))), 0), 0)) as e from v),
    m as (select label, i, avg(e[i]) as x from u, range(1, 65) t(i) group by all)
    select a.label as a, b.label as b, round(sum(a.x * b.x), 6) as linkage from m a join m b on a.i = b.i and a.label < b.label group by all""",
    "chunk_metadata": f"""with {token_chunks(50, 10)}, e as ({posexplode('doc_id, source', 'chunks', 'c', 'chunk_pos', 'chunk')})
    select sha256(doc_id || ':' || chunk_pos || ':' || chunk) as id, chunk as content, '/data/files/' || source || '.txt' as source_file, source || '.txt' as file_name, len(chunk)::int as length, len({tokens('chunk')})::int as token from e""",
    "chunk_stats_by_source": f"with {STORED} select source, count(*) as n_chunks, sum(len(document))::bigint as n_chars, max(len({tokens('document')}))::int as most_tokens from stored group by source",
    "hash_embed": f"with {embedded('documents', 'doc_id', 'text', 'd')}, x as ({posexplode('doc_id', 'e', 'd', 'i', 'x')}) select doc_id, i, round(x, 6) as x from x",
    "vector_norms": "select vec_id, len(embedding)::int as dim, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as norm from embeddings",
    "knn_l2": knn("l2", "query_id, doc_id, round(distance, 6) as distance, retrieval_rank"),
    "knn_cosine": knn("cosine", "query_id, doc_id, round(distance, 6) as distance, retrieval_rank"),
    "knn_score": knn("l2", "query_id, doc_id::varchar as doc_id, round(1 / (1 + distance), 6) as score"),
    "retrieve_candidates": f"with {FOUND} select query_id, doc_id, round(retrieval_score, 6) as retrieval_score, retrieval_rank from found",
    "bm25_search": bm25(),
    "file_table": """with f as (select '/data/' || source || '/' || doc_id || '.' || ['txt', 'PDF', 'odd'][doc_id % 3 + 1] as file, doc_id % 3 as kind from documents)
        select row_number() over (order by file) as id, string_split(file, '/')[-1] as name, file, ['txt', 'pdf', 'other'][kind + 1] as file_type from f""",
    "tfidf_terms": f"with {FOUND} select query_id, doc_id, term, tf, df, round(idf, 6) as idf, round(weight, 6) as weight from terms",
    "tfidf_scores": f"with {FOUND} select query_id, doc_id, round(tfidf, 6) as tfidf from tfidf",
    "rerank_minmax": f"with {FOUND} select query_id, doc_id, round({min_max('retrieval_score')}, 6) as normalised from found",
    "rerank_cross_stub": by("cross_score"),
    "rerank_bi": by("bi_score"),
    "rerank_hybrid": by("hybrid_score"),
    "rerank_fusion_fixed": by("(n_cross + 2 * n_bi + n_hybrid) / 4"),
    "rerank_fusion_compat": by("(2 * n_bi + n_hybrid) / 3"),
    "best_score": f"with {FOUND} select query_id, doc_id, round(case doc_id % 3 when 0 then 0.25 when 1 then 0.5 else retrieval_score end, 6)::double as score from found",
    "search_two_stage": by("cross_score", "where rank <= 3"),
    "multi_method_search": by("(n_bi + n_hybrid) / 2", "where rank <= 3"),
    "no_rerank_topn": by("retrieval_score", "where rank <= 3"),
    "collection_stats": f"with {STORED} select 'documents' as collection, count(*) as n from stored",
    "system_info": "select 'documents' as collection, count(*) as n, 'cross_encoder,bi-encoder' as rerankers, 'cross_encoder' as default_reranker from documents",
    "vectorized_files": f"""with {STORED}, files as (select distinct source as name, source as url from documents union all select 'file' || doc_id, 'file' || doc_id from labels where toxic = 1),
    have as (select source as url, count(*) as n from stored group by source)
    select name, url, n is not null as vectorized, coalesce(n, 0) as n_chunks from files left join have using (url)""",
    "delete_by_source": f"""with {STORED}, gone as (select distinct source from labels join documents using (doc_id) where toxic = 1)
    select source, count(*) as n from stored where source not in (select source from gone) group by source""",
    "chunk_character": CHARACTER,
    "ingest_upsert": f"""with now as (select doc_id, case when toxic = 1 then substr(text, 1, 200) when quality = 0 then '' else text end as text from documents left join labels using (doc_id)),
    {token_chunks(50, 10, 'now')}, x as ({posexplode('doc_id', 'chunks', 'c', 'chunk_pos', 'chunk')})
    select sha256({AS_FILES} || ':' || chunk_pos || ':' || chunk) as id, {AS_FILES} as source_file, len({tokens('chunk')})::int as token, chunk as document from x""",
    "search_collection": by("cross_score", "where rank <= 3").replace(LIBRARY, CHUNK_LIBRARY),
    "files_extracted": """select source || '.txt' as name, 'txt' as file_type, source || ': ' || count(*) || ' documents' || chr(10) || sum(n_chars)::bigint || ' characters' as text, false as failed from documents group by source
    union all values ('picture.PNG', 'png', null, true), ('empty.txt', 'txt', '', false)""",
    "pdf_pages": "select doc_id, length(coalesce(text, '') || chr(10)) as n_chars, md5(coalesce(text, '') || chr(10)) as text_md5, cast(null as varchar) as error from documents",
    "replies_kept": "select conv_id, turn, split_part(text, chr(10), 1) as reply from conversations where role = 'user'",
    "reply_stub": f"""with {SCORES}, placed as (select *, row_number() over (partition by query_id order by cross_score desc, retrieval_rank)::int as rank from scored),
    l as (select query_id, string_agg(replace(replace({q(LINE)}, '%d', rank::varchar), '%s', document), '' order by rank) as body from placed where rank <= 5 group by query_id),
    p as (select query_id, coalesce(string_split(replace({q(HEAD)}, '%s', query) || coalesce(body, ''), chr(10))[2], '') as line from asked left join l using (query_id))
    select query_id, case when strpos(line, ': ') > 0 then substr(line, strpos(line, ': ') + 2) else '' end as reply, null::varchar as error from p""",
    "prompt_build": f"""with {SCORES}, placed as (select *, row_number() over (partition by query_id order by cross_score desc, retrieval_rank)::int as rank from scored),
    l as (select query_id, string_agg(replace(replace({q(LINE)}, '%d', rank::varchar), '%s', document), '' order by rank) as body from placed where rank <= 5 group by query_id)
    select query_id, replace({q(HEAD)}, '%s', query) || coalesce(body, '') as prompt from asked left join l using (query_id)""",
    "chat_turns_update": """with opened as (select * from conversations union all select max(conv_id) + 1, 0, 'user', 'Hello' from conversations),
    last as (select conv_id, max(turn) as last, arg_max(role, turn) as role from opened group by conv_id),
    sent as (select * from opened union all select conv_id, last + n, r, t from last, (values (1, 'assistant', 'Yes?'), (2, 'user', 'Go on')) m(n, r, t) where role = 'user')
    select conv_id, turn, role, text from sent where conv_id not in (select conv_id from sent group by conv_id having count(*) = 1)""",
    "chat_titles": """with t as (select conv_id, substr(arg_min(text, turn), 1, 40) as title, count(*) as n_turns from conversations group by conv_id)
    select conv_id, case when n_turns > 6 then 'Long: ' || title else title end as title, n_turns from t""",
    "parse_split_points": """with a as (select doc_id, case when doc_id % 2 = 0 then [n_chars, 7, doc_id] else
      list_filter([n_chars, 100, 200, 300, 400, 500, 600, 700, 800, 900, 1000, 1100], lambda x: x >= 10)[1:10] end as p from documents)
    select doc_id, array_to_string(list_sort(p), ',') as points from a""",
}
