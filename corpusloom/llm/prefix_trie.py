"""Trie of conversation prefixes: a node for each distinct sequence of first turns, with sums over its subtree.

1. Turns become digests of role and text, and are numbered within their conversations by a range sort on (conv_id,
   turn): a conversation that fills many ranges is numbered by all of them, its rows per range summed up.
2. Prefix digests are chained: the digest of a prefix is SHA-256 of that of the prefix before and of its last turn's.
   Chains run within blocks of BLOCK turns; a longer conversation chains its blocks' ends, a 64th of its rows, and
   mixes them into the blocks' digests. No array is longer than a block.
3. Every prefix is exploded to a row; rows grouped by (depth, digest) are the nodes. Equal prefixes meet in partial
   aggregates before the shuffle, be it the root or a first turn that a third of all conversations have.
4. A node's weights go to all its ancestors. The ancestors of a node are prefixes of its smallest member, so the weights
   of nodes with one smallest member are first summed from the bottom up within blocks, then exploded to their
   ancestors: n rows for a conversation of n turns, not n * n / 2. These are summed by (depth, digest).

Defined results: a null role or text is empty; turns are ordered by turn, null first, ties by their digest, so that equal
rows count each; rows without a conv_id belong to no conversation and are passed over; other columns are ignored; no
conversations: no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, maybe_broadcast

#: Turns of a block, children of a node that one task joins to it, and conversation ids of a text that is hashed at once.
BLOCK, SHARE, IDS = 64, 10_000, 4096
#: Digest of the root.
ROOT = hashlib.sha256(b"").digest()
NODE = ["depth", "digest"]


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, range, pos, n_turns, digest, n_bytes) of every turn; pos counts from 1.

    conversations: conv_id, turn, role, text. A range holds neighbouring rows and is never larger than one task's share.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    plain = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    sorted_ = materialise(plain, "turns").repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The place in the range is in the lower 33 bits, the range above.
    at = F.monotonically_increasing_id()
    placed = materialise(sorted_.select("conv_id", "digest", "n_bytes", at.alias("at")), "placed").withColumn("range", F.shiftright("at", 33))
    firsts = placed.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = firsts.select("conv_id", "range", (before - F.col("first") + 1).alias("shift"), F.sum("n").over(whole).alias("n_turns"))
    return placed.join(known, ["conv_id", "range"]).select("conv_id", "range", (F.col("at") + F.col("shift")).alias("pos"), "n_turns", "digest", "n_bytes")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, length) of what numbered gives."""
    return turns.groupBy("conv_id").agg(F.max("n_turns").alias("length"))


def spliced(turns: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another one does: turns (conv_id, pos, length, digest, n_bytes), and (conv_id, length).

    Conversation c takes the first h turns of c - c % family, h being crc32 of c's decimal modulo most + 1, and then its
    own after its first h. Signs are as in SQL: of a negative c the remainder is negative or zero.
    """
    n = lengths(turns)
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    first = n.select("conv_id", "length", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    have = n.select(F.col("conv_id").alias("base"), F.col("length").alias("have"))
    plan = first.join(have, "base", "left").withColumn("taken", F.least("h", F.coalesce("have", F.lit(0))))
    plan = materialise(plan.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("length") - F.col("h"))).alias("length")), "plan")
    # A row for each range: a long conversation's turns stay spread.
    ranges = turns.select("conv_id", "range").distinct().join(plan.select("conv_id", "h", "taken", "length"), "conv_id")
    own = turns.join(ranges, ["conv_id", "range"]).filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "length", "digest", "n_bytes")
    heads = turns.filter(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", "digest", "n_bytes")
    lent = heads.join(plan.filter("taken > 0"), "base").filter("pos <= taken").select("conv_id", "pos", "length", "digest", "n_bytes")
    return own.unionByName(lent), plan.select("conv_id", "length")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, block, end), sorted, to (conv_id, block, head): the digest of all turns before a block but the first."""
    own, head = None, b""
    for batch in batches:
        rows = []
        for conv, block, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv == own:
                rows.append((conv, block, head))
                head = hashlib.sha256(head + end).digest()
            else:
                own, head = conv, end
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["conv_id", "block", "head"])


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, n_bytes, ends) of every prefix of every conversation, the empty one included."""
    turn = F.struct("pos", "digest", "n_bytes")
    blocks = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max("length").alias("length"))
    chain = F.aggregate("turns", F.array(F.lit(ROOT)), lambda done, x: F.concat(done, F.array(_sha(F.element_at(done, -1), x["digest"]))))
    blocks = materialise(blocks.withColumn("chain", chain), "blocks")
    long = blocks.filter(F.col("length") > BLOCK).select("conv_id", "block", F.element_at("chain", -1).alias("end"))
    heads = materialise(long.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_heads, "conv_id long, block long, head binary"), "heads")
    mixed = F.when(F.col("head").isNull(), F.col("chain")).otherwise(F.concat(F.array("head"), F.transform(F.slice("chain", 2, BLOCK), lambda x: _sha(F.col("head"), x))))
    joined = blocks.join(maybe_broadcast(heads), ["conv_id", "block"], "left").select("conv_id", "length", "turns", mixed.alias("chain"))
    each = F.transform("turns", lambda x, i: F.struct(x["pos"].alias("depth"), F.get("chain", i + 1).alias("digest"), F.get("chain", i).alias("parent"), x["n_bytes"].alias("n_bytes")))
    deep = joined.select("conv_id", "length", F.inline(each)).select("conv_id", *NODE, "parent", "n_bytes", (F.col("depth") == F.col("length")).alias("ends"))
    top = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_bytes"), (F.col("length") == 0).alias("ends"))
    return deep.unionByName(top)


def subtree_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, digest, n_leaves, saved_tokens): each node's weights, summed over it and all nodes below it."""
    weights = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    block = F.floor(F.col("depth") / BLOCK).alias("block")
    path = rows.select("conv_id", *NODE).join(weights.filter("leaf > 0 or saved > 0"), ["conv_id", "depth"], "left").select("conv_id", block, *NODE, zero("leaf").alias("leaf"), zero("saved").alias("saved"))
    totals = path.groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = totals.select("conv_id", "block", F.sum("leaf").over(after).alias("more_leaf"), F.sum("saved").over(after).alias("more_saved")).filter("more_leaf > 0 or more_saved > 0")
    below = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = path.select("conv_id", "block", *NODE, F.sum("leaf").over(below).alias("leaf"), F.sum("saved").over(below).alias("saved"))
    given = summed.join(later, ["conv_id", "block"], "left").select(*NODE, (F.col("leaf") + zero("more_leaf")).alias("leaf"), (F.col("saved") + zero("more_saved")).alias("saved"))
    return given.filter("leaf > 0 or saved > 0").groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, digest, block, ids), sorted, to (depth, digest, ends_sha256); one text is held at a time."""
    own, state = None, None
    schema = pa.schema([("depth", pa.int64()), ("digest", pa.binary()), ("ends_sha256", pa.string())])

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([own[0]]), pa.array([own[1]], pa.binary()), pa.array([state.hexdigest()])], schema=schema)

    for batch in batches:
        done = []
        for depth, digest, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, digest) != own:
                if own:
                    done.append(row())
                own, state = (depth, digest), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if own:
        yield row()


def end_digests(rows: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256): of the ids of the conversations that end at a node, in ascending order.

    Ids are put together by the thousand first, so the task that hashes a node's ids reads few rows and holds one.
    """
    ended = rows.filter("ends").groupBy(*NODE, F.floor(F.col("conv_id") / IDS).alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    texts = ended.select(*NODE, "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(_hashed, "depth long, digest binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes: (conv_id, depth, digest, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    turns: (conv_id, pos, length, digest, n_bytes); convs: (conv_id, length), those without turns too. conv_id is the
    smallest member of the node, and of its parent; n_leaves counts childless nodes in the subtree, its top included;
    saved_tokens sums what members after the first needn't store again, in bytes of the nodes' last texts.
    """
    rows = materialise(prefixes(turns, convs), "prefixes")
    found = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("parent").alias("parent"), F.max("n_bytes").alias("n_bytes"))
    found = materialise(found, "nodes")
    kids = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = found.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = materialise(nodes, "counted")
    # Parents of many children are joined in several places.
    parts = F.floor(F.col("n_children") / SHARE)
    above = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0).cast("long"), parts)).alias("part"), parts.alias("last"))
    hubs = materialise(nodes.filter(F.col("n_children") >= SHARE).select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), parts.alias("last")), "hubs")
    child = nodes.join(maybe_broadcast(hubs), ["depth", "parent"], "left").withColumn("part", F.pmod(F.xxhash64("digest"), F.coalesce("last", F.lit(0).cast("long")) + 1)).drop("last")
    out = child.join(above.drop("last"), ["depth", "parent", "part"], "left")
    out = out.join(subtree_sums(rows, nodes), NODE, "left").join(end_digests(rows), NODE, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *NODE, "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    turns = numbered(conversations)
    return trie(turns.withColumnRenamed("n_turns", "length").drop("range"), lengths(turns))


def digest(nodes: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: Keys of prefixes are the digests of their turns put together here, without a chain.
ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g, strlen(coalesce(text, '')) AS b
    FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT conv_id, g, b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS p FROM t),
steps AS (SELECT conv_id, length, conv_id - conv_id % 5 AS base,
    [4294967295] || flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(conv_id::VARCHAR, '')]) AS s
    FROM (SELECT conv_id, max(p) AS length FROM own GROUP BY conv_id)),
crc AS (SELECT conv_id, length, base, xor(list_reduce(s, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 9 AS h FROM steps),
plan AS MATERIALIZED (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(o.length, 0)) AS taken, c.length FROM crc c LEFT JOIN crc o ON o.conv_id = c.base),
turns AS MATERIALIZED (SELECT conv_id, p - h + taken AS p, g, b FROM own JOIN plan USING (conv_id) WHERE p > h
    UNION ALL SELECT plan.conv_id, o.p, o.g, o.b FROM plan JOIN own o ON o.conv_id = plan.base AND o.p <= taken),
pre AS MATERIALIZED (SELECT conv_id, p AS depth, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY p) AS k, b FROM turns
    UNION ALL SELECT conv_id, 0, '', 0 FROM plan),
ends AS (SELECT depth, k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM pre JOIN (SELECT conv_id, max(depth) AS depth FROM pre GROUP BY conv_id) USING (conv_id, depth) GROUP BY depth, k),
n AS MATERIALIZED (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b FROM pre GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, left(k, (64 * (depth - 1))::BIGINT) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
w AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, k)),
sub AS (SELECT j AS depth, left(k, (64 * j)::BIGINT) AS k, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * b) AS saved
    FROM (SELECT k, n_children, n_convs, b, unnest(range(depth + 1)) AS j FROM w) GROUP BY ALL)
SELECT w.conv_id, w.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
    n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN sub USING (depth, k) LEFT JOIN ends USING (depth, k) LEFT JOIN n up ON up.depth = w.depth - 1 AND up.k = left(w.k, (64 * (w.depth - 1))::BIGINT) AND w.depth > 0
"""
