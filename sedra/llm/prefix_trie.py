"""The prefix trie of conversations, rolled up by pointer jumping.

A node is a sequence of turns that some conversation begins with; its name is a digest, chained turn by turn, and its
parent's name the digest before. Copies of a prefix so meet under one key, and counts are partially aggregated before
they are shuffled: what conversations share costs a row a task, however many share it.

Sums over subtrees come in doubling rounds. In round k every node that has one points to its ancestor 2^k levels up and
knows the sums over the 2^k topmost levels of its subtree. Adding up what points to a node gives the next 2^k levels of
its own; its pointer's pointer is the next pointer. So a trie of depth d takes log2(d) rounds of joins on slim rows, not d,
and nodes whose pointer has left the trie drop out of the rounds. A node that many point to is joined in salted parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedra.llm.shared import cut_at, cut, drop, in_batches, join_hot

SHARED = 20  # conversations to each one that lends its first turns
LENT = 4  # it lends fewer turns than this
PIECE = 1 << 13  # conversation ids that are written out as one text
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256().hexdigest()


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, turn_key, words) of conversations (conv_id, turn, role, text): turn_key is the digest of role and text.

    Turns go by number, null first, and equal numbers by role and text's digest. Null role or text is empty; rows without
    a conv_id are in no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    own = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), key.alias("turn_key"), F.size(F.regexp_extract_all(text, F.lit(WORD), 0)).cast("long").alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_key")) - 1
    return own.select("conv_id", place.alias("pos"), "turn_key", "words")


def lent(conv: Column) -> Column:
    """How many turns a conversation takes over from the one that lends."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(LENT)).cast("int")


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, words) of conversations that begin with the first turns of the one before them whose id is divisible by SHARED; one without turns is a row of pos -1.

    Of turns(): the lent ones in place of as many of their own, as far as there are any.
    """
    base = F.col("conv_id") - F.col("conv_id") % SHARED
    heads = own.where((F.col("pos") < LENT - 1) & (F.col("conv_id") % SHARED == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn_key", "words"))).alias("head"))  # LENT - 1 rows at most
    convs = own.select("conv_id").distinct().select("conv_id", base.alias("base"), lent(F.col("conv_id")).alias("h")).join(heads, "base", "left")
    convs = convs.select("conv_id", "h", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h")).alias("head"))
    convs = cut(convs)
    taken = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    kept = own.join(convs.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where("pos >= h")
    bare = convs.where(F.size("head") == 0).select("conv_id", F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("words"))
    return taken.unionByName(kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "turn_key", "words")).unionByName(bare)


ROOT = hashlib.sha256(b"root").digest()
PLACES = "conv_id long, node binary, parent binary, depth int, words long, ends boolean"


def places(rows: DataFrame) -> DataFrame:
    """(conv_id, node, parent, depth, words, ends) for each conversation and each node that it is a member of, of rebuilt() rows; `ends` marks its last node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last node of the conversation at hand, which may go on in the next batch
        for b in batches:
            out = []
            for conv, pos, key, words in zip(*(b[c].to_pylist() for c in ("conv_id", "pos", "turn_key", "words")), strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        out.append((*held, True))
                    held = (conv, ROOT, None, 0, 0)
                if pos >= 0:
                    out.append((*held, False))
                    node = hashlib.sha256(held[1] + key).digest()
                    held = (conv, node, held[1], held[3] + 1, words)
            yield _rows(out)
        if held is not None:
            yield _rows([(*held, True)])

    dealt = rows.select("conv_id", "pos", "turn_key", "words").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return in_batches(dealt, run, PLACES)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[f.split()[0] for f in PLACES.split(", ")])


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(node, *values): each value (long) summed over the subtree of each node, for nodes (node, parent: null at a root, *values).

    Takes as many rounds as the depth has binary digits. An empty table gives none.
    """
    spark = nodes.sparkSession
    total = lambda cols: [F.sum(v).alias(v) for v in cols]
    added = [nodes.select("node", *values)]
    live, path = cut_at(nodes.where("parent is not null").select("node", F.col("parent").alias("up"), *values))
    while not live.isEmpty():
        sums = cut(live.groupBy(F.col("up").alias("node")).agg(*total(values), F.count("*").alias("n")))
        added.append(sums.select("node", *values))
        # The pointer's pointer; nodes whose pointer has none are done.
        onward = sums.select("node", "n").join(live.select("node", F.col("up").alias("next")), "node").select(F.col("node").alias("up"), "next", "n")
        jumped = join_hot(live, cut(onward), "up").select("node", F.col("next").alias("up"), *values)
        more = sums.select("node", *[F.col(v).alias(f"more_{v}") for v in values])
        new, new_path = cut_at(jumped.join(more, "node", "left").select("node", "up", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]))
        drop(spark, path)
        live, path = new, new_path
    out = added[0]
    for a in added[1:]:
        out = out.unionByName(a)
    return out.groupBy("node").agg(*total(values))


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) for rows (node, conv_id): the SHA-256 of each node's ids, decimal, ascending, joined by commas.

    Ids are sorted and written out as texts by ranges of (node, id), so a node of many ids is many tasks' work; the
    digest, which is sequential, reads the texts of PIECE ids each, in order.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array(ids[:1], pa.int64()), pa.array([",".join(map(str, ids))])], names=["node", "first", "ids"])

        for b in batches:
            for n, c in zip(b["node"].to_pylist(), b["conv_id"].to_pylist(), strict=True):
                if ids and (n != node or len(ids) == PIECE):
                    yield row()
                    ids = []
                node = n
                ids.append(c)
        if ids:
            yield row()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            out = []
            for n, ids in zip(b["node"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if sha is None or n != node:
                    if sha is not None:
                        out.append((node, sha.hexdigest()))
                    node, sha = n, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.string()))], names=["node", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])

    written = in_batches(ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id"), pieces, "node binary, first long, ids string")
    return in_batches(written.repartition("node").sortWithinPartitions("node", "first").select("node", "ids"), joined, "node binary, ends_sha256 string")


def rollup(at: DataFrame) -> DataFrame:
    """One row for each node of places(): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    at = cut(at)
    nodes = cut(at.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.select("node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = subtree_sums(own, ["n_leaves", "saved_tokens"])
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = join_hot(nodes.where("parent is not null"), parents, "parent").unionByName(nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = below.join(sums, "node").join(digests_of_ends(at.where("ends")), "node", "left")
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def trie(df: DataFrame) -> DataFrame:
    """rollup() of the conversations (conv_id, turn, role, text) after rebuilt(): one row for each node.

    Turns go by number, null first, equal numbers by the digest of role and text; null role or text is empty; repeated
    rows are turns of their own. Rows without a conv_id take no part. No conversation gives no node, not even the root.
    A conversation's turns are chained by one task, in bounded memory. Other columns are not read.
    """
    own = cut(turns(df.select("conv_id", "turn", "role", "text")))
    return rollup(places(rebuilt(own)))


def trie_sql() -> str:
    """DuckDB SQL for the query's rows: subtrees by the pairs of a conversation's nodes, and CRC-32 bit by bit."""
    step = "list_reduce([xor(a, b)] || [0::ubigint for i in range(8)], lambda c, z: xor(c >> 1, 3988292384::ubigint * (c & 1)))"
    crc = f"xor(list_reduce([4294967295::ubigint] || [x::ubigint for x in list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c))], lambda a, b: {step}), 4294967295::ubigint)"
    return f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as k from conversations where conv_id is not null),
    o as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, k) - 1 as pos from t),
    c as materialized (select conv_id, conv_id - conv_id % {SHARED} as base, ({crc} % {LENT})::bigint as h from (select distinct conv_id from o)),
    r as materialized (select c.conv_id, o.pos, o.k, o.text from c join o on o.conv_id = c.base and o.pos < c.h union all
        select c.conv_id, o.pos - c.h + least(c.h, (select count(*) from o as b where b.conv_id = c.base)), o.k, o.text from c join o using (conv_id) where o.pos >= c.h),
    p as materialized (select conv_id, 0 as depth, '' as node, '' as text from c union all select conv_id, pos + 1, string_agg(k, '') over (partition by conv_id order by pos), text from r),
    e as (select conv_id, max_by(node, depth) as node from p group by conv_id),
    s as (select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends from e group by node),
    n as materialized (select node, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) as saved from p group by node),
    k as materialized (select n.*, q.node as parent, q.conv_id as parent_conv_id from n left join n as q on n.depth > 0 and q.node = n.node[:-65]),
    m as (select parent as node, count(*) as n_children from k group by parent),
    u as (select distinct a.node as top, b.node from p as a join p as b on a.conv_id = b.conv_id and a.depth <= b.depth),
    z as (select u.top as node, count(*) filter (m.node is null) as n_leaves, sum(n.saved) as saved_tokens from u join n on n.node = u.node left join m on m.node = u.node group by u.top)
    select k.conv_id, k.depth::bigint as depth, k.parent_conv_id, k.n_convs, coalesce(m.n_children, 0) as n_children, z.n_leaves, z.saved_tokens::bigint as saved_tokens, coalesce(s.ends, sha256('')) as ends_sha256
    from k join z using (node) left join m using (node) left join s using (node)"""
