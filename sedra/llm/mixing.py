"""Mixing sources to target weights by hierarchical budgeting.

A tree of domain, language and source has a weight at each node. The token budget goes down it: a node's amount is shared
among its children in proportion to their weights, but a child gets no more than its subtree holds in MAX_EPOCHS epochs,
and what it can't take is shared among its siblings in the same way. Only where all of a node's children are full is its
own shortage shared among its siblings, one level up. Sorted by capacity over weight, the full children come first, so
a level is solved by running sums: no iteration, nothing on the driver. Shares are whole tokens: what rounding down
leaves goes to the children with the largest remainders, a token each.

A leaf then takes whole epochs of its documents and, of one more, the shortest prefix that reaches the rest of its
amount, in the order of a hash of seed, epoch and document. The place where a prefix ends is found from token sums of 256
ranges of the hash, then of 256 ranges within one of them, and last within one of these: no leaf is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedra.llm.shared import cut

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
STEPS = 2  # times that a hash range is narrowed to one of its 256 parts
MOST_BROADCAST = 100_000  # leaves that are sent to every executor; more are joined by a shuffle


@dataclass(frozen=True)
class Plan:
    """Weights by level and name (others: 1), the budget as a share of all tokens, the most epochs of a leaf, and the seed of the order."""

    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    budget: float = 1.0
    max_epochs: int = 4
    seed: int = 42


#: Production parameters: the domains of sources by hash, and the target weights.
DOMAINS = ("web", "books", "code", "reference")
PLAN = Plan({"domain": {"web": 4.0, "books": 3.0, "code": 1.0, "reference": 2.0}, "lang": {"en": 3.0, "de": 1.0, "fr": 1.0, "es": 1.0}})


def domain_of(source: Column) -> Column:
    return F.get(F.array(*map(F.lit, DOMAINS)), (F.conv(F.substring(F.md5(source.cast("binary")), 1, 4), 16, 10).cast("int") % len(DOMAINS)).cast("int"))


def _weight(plan: Plan, level: str) -> Column:
    own = plan.weights.get(level, {})
    if not own:
        return F.lit(1.0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in (kv[0], float(kv[1]))]), F.col(level)), F.lit(1.0))


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes (parent columns, amount, weight, capacity, ...) with `got`: the amount's share of each child."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = [F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).asc_nulls_last(), *[F.col(c).asc() for c in LEVELS if c in nodes.columns and c not in parent]]
    before = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("amount") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / (F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    tried = nodes.withColumn("weighs", F.col("weight") > 0).withColumn("level", F.when(F.col("weighs"), level)).withColumn("full", F.col("weighs") & (F.col("capacity") <= F.col("level") * F.col("weight")))
    # Past the first child that isn't full the level only falls, so the greatest is the one at which the rest is shared.
    shared = F.col("weighs") & ~F.col("full")
    exact = F.max(F.when(shared, F.col("level"))).over(by) * F.col("weight")
    got = F.when(~F.col("weighs"), 0).when(F.col("full"), F.col("capacity")).otherwise(F.floor(exact)).cast("long")
    tried = tried.withColumn("shared", shared).withColumn("got", got).withColumn("part", F.when(F.col("shared"), exact - F.floor(exact)))
    # A child that isn't full holds more than its share, so one token more always fits.
    rest = F.col("amount") - F.sum("got").over(by)
    names = [F.col(c).asc() for c in LEVELS if c in nodes.columns and c not in parent]
    place = F.row_number().over(by.orderBy(F.col("part").desc_nulls_last(), *names))
    return tried.withColumn("rest", rest).withColumn("place", place).withColumn("got", F.col("got") + (F.col("shared") & (F.col("place") <= F.col("rest"))).cast("long")).drop("weighs", "level", "full", "shared", "part", "rest", "place")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """(domain, lang, source, tokens, quota) for leaves (domain, lang, source, tokens). The quotas add up to the budget, unless every child of some node with weights is full."""
    amount = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(plan.budget))).cast("long")).first()[0]
    above, keys = None, []
    out = None
    for k, level in enumerate(LEVELS):
        keys = list(LEVELS[: k + 1])
        nodes = leaves.groupBy(*keys).agg((F.sum("tokens") * plan.max_epochs).alias("capacity")).withColumn("weight", _weight(plan, level))
        nodes = nodes.withColumn("amount", F.lit(amount)) if above is None else nodes.join(above, keys[:-1])
        out = _share(nodes, keys[:-1])
        above = out.select(*keys, F.col("got").alias("amount"))
    return leaves.join(out.select(*LEVELS, F.col("got").alias("quota")), list(LEVELS))


def _hash(plan: Plan, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{plan.seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))


def _units(slim: DataFrame, edge: DataFrame, plan: Plan) -> DataFrame:
    """The rows of slim within the hash range that their leaf's prefix ends in."""
    own = with_leaves(slim, edge, "inner").withColumn("hash", _hash(plan, F.col("epochs"), F.col("key")))
    return own.where(F.startswith("hash", "prefix"))


def leaf_plan(slim: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """(domain, lang, source, tokens, quota, epochs, last) for slim (key, domain, lang, source, n_tokens): whole epochs, and the hash of the last document of the prefix of the next one, null for none."""
    leaves = cut(budgets(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), plan).withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0).cast("int")).withColumn("part", F.col("quota") - F.col("epochs") * F.col("tokens")))
    edge = leaves.where("part > 0").select(*LEVELS, "epochs", "part", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for _ in range(STEPS):
        # The sums of the next 256 ranges of each leaf, and the one among them that reaches its part.
        sums = _units(slim, edge, plan).groupBy(*LEVELS, "epochs", "part", "before", F.substring("hash", 1, F.length("prefix") + 2).alias("prefix")).agg(F.sum("n_tokens").alias("n"))
        before = Window.partitionBy(*LEVELS).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        edge = cut(sums.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(before), F.lit(0))).where("before < part and before + n >= part").drop("n"))
    near = _units(slim, edge, plan).groupBy(*LEVELS, "hash", "part", "before").agg(F.sum("n_tokens").alias("n"))
    inner = Window.partitionBy(*LEVELS).orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    last = near.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0))).where("start < part").groupBy(*LEVELS).agg(F.max("hash").alias("last"))
    return cut(leaves.join(last, list(LEVELS), "left").select(*LEVELS, "tokens", "quota", "epochs", "last"))


def with_leaves(docs: DataFrame, leaves: DataFrame, how: str = "left") -> DataFrame:
    """docs and the row of their leaf; leaves must be a table in storage, as it is counted first."""
    small = leaves.count() <= MOST_BROADCAST
    return docs.join(F.broadcast(leaves) if small else leaves, list(LEVELS), how)


def slim_of(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, domain, lang, source, n_tokens): tokens are words between ASCII white space; null counts as an empty text, language or source."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return df.select(F.col(key).alias("key"), domain_of(source).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))


def epochs_of(plan: Plan, key: Column) -> Column:
    """The epochs that a document is taken in, for a row with its leaf's columns."""
    times = F.col("epochs") + F.coalesce((_hash(plan, F.col("epochs"), key) <= F.col("last")).cast("int"), F.lit(0))
    return F.when(times > 0, F.sequence(F.lit(0), times - 1))


def mix(df: DataFrame, plan: Plan = PLAN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, domain, lang, source, n_tokens, epoch): a row for each epoch that a row of df is taken in.

    Rows of one key in a leaf stay together, in the order as in the count. Leaves without tokens take no part. An empty
    table gives none. Other columns are not read. Every row of df counts; none is sampled.
    """
    slim = cut(slim_of(df, text, key))
    leaves = leaf_plan(slim, plan)
    return with_leaves(slim, leaves).withColumn("epoch", F.explode(epochs_of(plan, F.col("key")))).select(F.col("key").alias(key), *LEVELS, "n_tokens", "epoch")


def mix_documents(df: DataFrame, plan: Plan = PLAN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df that mix() takes, as often as it takes them, with df's columns. A column of df may have any name."""
    leaves = leaf_plan(cut(slim_of(df, text, key)), plan)
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("key"), domain_of(F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    taken = with_leaves(own, leaves.select(*LEVELS, "epochs", "last")).withColumn("epoch", F.explode(epochs_of(plan, F.col("key"))))
    return taken.select("row.*")


def mix_sql(plan: Plan = PLAN) -> str:
    """The same for DuckDB, with one ordered sum over each leaf."""
    hashed = lambda epoch: f"md5('{plan.seed}:' || {epoch} || ':' || coalesce(key::varchar, 'null'))"
    weight = lambda level: f"(case {' '.join(f"when {level} = '{k}' then {float(v)}" for k, v in plan.weights.get(level, {}).items())} else 1.0 end)::double" if plan.weights.get(level) else "1.0::double"
    steps, above = [], "top"
    for k, level in enumerate(LEVELS):
        keys = LEVELS[: k + 1]
        part = f"partition by {', '.join(keys[:-1])}" if k else ""
        join = f"join {above} using ({', '.join(keys[:-1])})" if k else "cross join top"
        order = f"({part} order by case when weight > 0 then capacity / weight end nulls last, {level} rows between unbounded preceding and 1 preceding)"
        steps.append(f"""n{k} as (select *, {weight(level)} as weight from (select {', '.join(keys)}, sum(tokens)::bigint * {plan.max_epochs} as capacity from leaves group by all) {join}),
        l{k} as (select *, (amount - coalesce(sum(capacity) over {order}, 0))::double / (sum(weight) over ({part}) - coalesce(sum(weight) over {order}, 0.0)) as level from n{k}),
        f{k} as (select *, weight > 0 and capacity <= level * weight as is_full from l{k}),
        c{k} as (select *, max(level) filter (where weight > 0 and not is_full) over ({part}) as common from f{k}),
        g{k} as (select *, (case when weight <= 0 then 0 when is_full then capacity else floor(common * weight) end)::bigint as got, case when weight > 0 and not is_full then common * weight - floor(common * weight) end as part from c{k}),
        r{k} as (select *, amount - sum(got) over ({part}) as rest, row_number() over ({part} order by part desc nulls last, {level}) as place from g{k}),
        a{k} as (select {', '.join(keys)}, (got + (part is not null and place <= rest)::int)::bigint as amount from r{k})""")
        above = f"a{k}"
    domain = f"([{', '.join(f"'{d}'" for d in DOMAINS)}])[('0x' || substr(md5(coalesce(source, '')), 1, 4))::int % {len(DOMAINS)} + 1]"
    return f"""
    with slim as (select doc_id as key, {domain} as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from documents),
    leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens from slim group by all),
    top as (select floor(sum(tokens) * {float(plan.budget)})::bigint as amount from leaves),
    {','.join(steps)},
    planned as (select *, case when tokens > 0 then amount // tokens else 0 end as epochs from leaves join {above} using (domain, lang, source)),
    units as (select *, {hashed('epochs')} as hash, amount - epochs * tokens as part from slim join planned using (domain, lang, source)),
    summed as (select domain, lang, source, key, hash, sum(n_tokens) as n from units group by all),
    running as (select *, coalesce(sum(n) over (partition by domain, lang, source order by hash rows between unbounded preceding and 1 preceding), 0) as start from summed),
    taken as (select u.*, u.epochs + (r.start < u.part)::int as times from units u join running r on u.hash = r.hash and u.domain = r.domain and u.lang = r.lang and u.source = r.source)
    select key as doc_id, domain, lang, source, n_tokens, unnest(range(times::bigint))::int as epoch from taken where times > 0"""
