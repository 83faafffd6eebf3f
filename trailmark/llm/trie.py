"""Prefix tries of conversations by vertical bitmaps.

Conversations, in the order of their ids, are dealt into blocks; a block's index maps (position, turn) to the bitset of the block's
conversations that have that turn there. Going down from the root, a node's bitset is cut with the postings of the next position:
each nonempty cut is a child, its bits are counted, and those whose last turn this is form an end list. A node is known by a
digest of its path, by which the blocks' nodes come together. Long conversations are further cut into slabs of positions, so
that no task holds a whole one; a slab begins at the digest of what lies before it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import WORD, table, written
from trailmark.operators.fusion import ordinal

#: Rows of a block (a conversation belongs to that of its first row), and positions of a slab.
BLOCK, SLAB = 8192, 64
ROOT = b""
NODES = "key binary, parent binary, depth long, conv_id long, n long, words long, before long, members array<long>, ends array<long>"


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, k, pos (from 0), digest, words: the turns of each conversation by turn (null first; ties by a digest of role and
    text), null roles and texts as empty ones; k numbers all rows. Rows without a conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    placed = written(ordinal(rows, F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("digest"), name="k").drop("turn"), "trie-turns")
    first = placed.groupBy("conv_id").agg(F.min("k").alias("k0"))
    return placed.join(first, "conv_id").select("conv_id", "k", (F.col("k") - F.col("k0")).alias("pos"), "digest", "words")


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id, length, block."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("length"), F.floor(F.min("k") / BLOCK).alias("block"))


def with_borrowed_turns(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where each conversation c begins with the first h turns of c - c % every, h = crc32(c) % most, in place
    of its own first h; fewer if that one is shorter, none if it does not exist."""
    convs = conversations_of(turns)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    of = convs.select("conv_id", "length", "block", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h)
    bases = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("length").alias("there"))
    of = of.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    of = written(of.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"), "block"), "trie-conversations")
    own = turns.join(of.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    lent = of.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("pos < taken").select("conv_id", "pos", "digest", "words")
    return own.unionByName(lent), of.select("conv_id", "length", "block")


def slab_heads(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, block, slab, key, before, more: what lies before each slab of each conversation (digest, words), and whether another
    slab follows it. Only conversations of more than one slab are walked, a row per slab."""
    one = convs.where(F.col("length") <= SLAB).select("conv_id", "block", F.lit(0).cast("long").alias("slab"), F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("before"), F.lit(False).alias("more"))
    at = F.floor(F.col("pos") / SLAB).alias("slab")
    each = F.sort_array(F.collect_list(F.struct("pos", F.hex("digest").alias("x"))))
    path = F.unhex(F.array_join(F.transform(each, lambda e: e["x"]), ""))
    slabs = turns.join(convs.where(F.col("length") > SLAB), "conv_id").groupBy("conv_id", at).agg(F.first("block").alias("block"), F.first("length").alias("length"), F.sum("words").alias("words"), path.alias("path"))

    def walk(batches):
        conv, key, words = None, ROOT, 0
        for b in batches:
            keys, before = [], []
            for c, p, w in zip(b.column(0).to_pylist(), b.column(5).to_pylist(), b.column(4).to_pylist(), strict=True):
                if c != conv:
                    conv, key, words = c, ROOT, 0
                keys.append(key)
                before.append(words)
                key, words = hashlib.sha256(key + p).digest(), words + w
            more = [(s + 1) * SLAB < n for s, n in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), pa.array(keys, pa.binary()), pa.array(before, pa.int64()), pa.array(more, pa.bool_())], names=["conv_id", "block", "slab", "key", "before", "more"])

    walked = slabs.repartition("conv_id").sortWithinPartitions("conv_id", "slab").mapInArrow(walk, "conv_id long, block long, slab long, key binary, before long, more boolean")
    return one.unionByName(walked)


def members_of(bits: int) -> list[int]:
    """The numbers of the bits that are set, ascending."""
    if bits.bit_count() > 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), np.uint8), bitorder="little")).tolist()
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def block_trie(heads: list[tuple], turns: list[tuple], first: bool) -> list[tuple]:
    """Rows of NODES of one block and slab, which begins at the root if ``first``. heads: (conv_id, key, words before, whether more
    follows); turns: (conv_id, position in the slab, digest, words)."""
    heads = sorted(heads)
    ids = [h[0] for h in heads]
    index = {c: i for i, c in enumerate(ids)}
    path: list[dict[int, bytes]] = [{} for _ in ids]
    postings: list[dict[bytes, int]] = [{} for _ in range(SLAB)]
    words: dict[bytes, int] = {}
    for c, pos, digest, w in turns:
        i = index[c]
        path[i][pos] = digest
        postings[pos][digest] = postings[pos].get(digest, 0) | 1 << i
        words[digest] = w
    longer, over, roots = [0] * (SLAB + 1), [0] * (SLAB + 1), {}
    for i, (_, key, before, more) in enumerate(heads):
        if not more:
            over[len(path[i])] |= 1 << i
        for d in range(len(path[i])):
            longer[d] |= 1 << i
        bits, _ = roots.get(key, (0, 0))
        roots[key] = bits | 1 << i, before
    out, todo = [], [(hashlib.sha256(key), key, key, bits, 0, before, 0) for key, (bits, before) in roots.items()]
    while todo:
        path_hash, key, parent, bits, d, before, own = todo.pop()
        if d or first:
            ends = bits & over[d]
            inside = members_of(bits)
            out.append((key, parent if d else None, d, ids[inside[0]], len(inside), own, before, [ids[i] for i in inside], [ids[i] for i in members_of(ends)]))
        rest = bits & longer[d]
        while rest:
            turn = path[(rest & -rest).bit_length() - 1][d]
            child = rest & postings[d][turn]
            rest ^= child
            deeper = path_hash.copy()
            deeper.update(turn)
            todo.append((deeper, deeper.digest(), key, child, d + 1, before + own, words[turn]))
    return out


def block_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """NODES of every block: what its own conversations say of each node on their paths."""
    rows = turns.join(convs.select("conv_id", "block"), "conv_id").select("conv_id", "block", F.floor(F.col("pos") / SLAB).alias("slab"), (F.col("pos") % SLAB).alias("pos"), "digest", "words", F.lit(False).alias("more"))
    heads = slab_heads(turns, convs).select("conv_id", "block", "slab", F.lit(-1).cast("long").alias("pos"), F.col("key").alias("digest"), F.col("before").alias("words"), "more")

    def run(group: pa.Table) -> pa.Table:
        each = list(zip(*[group.column(c).to_pylist() for c in ("conv_id", "pos", "digest", "words", "more")], strict=True))
        slab = group.column("slab")[0].as_py()
        got = block_trie([(c, k, w, more) for c, pos, k, w, more in each if pos < 0], [r[:4] for r in each if r[1] >= 0], slab == 0)
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = list(zip(*got, strict=True)) or [()] * len(kinds)
        columns[2] = [d + slab * SLAB for d in columns[2]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in NODES.split(", ")])

    return rows.unionByName(heads).groupBy("block", "slab").applyInArrow(run, NODES)


def end_digests(nodes: DataFrame) -> DataFrame:
    """key, ends_sha256 of nodes where conversations end: their ids, ascending, joined by commas. The blocks' lists of a node are
    already in order among themselves, so they only have to pass by one after the other."""
    lists = nodes.where(F.size("ends") > 0).select("key", F.col("ends")[0].alias("at"), F.array_join("ends", ",").alias("ends"))

    def run(batches):
        key, state = None, None
        for b in (whole.slice(a, 1024) for whole in batches for a in range(0, whole.num_rows, 1024)):
            out = []
            for k, ends in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return lists.repartition("key").sortWithinPartitions("key", "at").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node (a sequence of first turns that conversations begin with; the root is the empty one): key, parent, conv_id (the
    least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, pos (gapless from 0), digest (of role and text), words; convs: conv_id, length, block (ascending with conv_id).
    Conversations without turns are members of the root and end there. Without conversations there is no node.

    A conversation owns the nodes whose least member it is: all of its path from some depth on. So every node is owned once, and
    sums over a node's subtree are sums over its members: what each has in common with others from that node on, and
    whether it ends in a leaf of its own.
    """
    nodes = written(block_nodes(turns, convs), "trie-nodes")
    least = lambda c: F.min(c).alias(c)
    whole = nodes.groupBy("key").agg(least("parent"), least("depth"), least("conv_id"), F.sum("n").alias("n_convs"), F.sum(F.size("ends")).alias("n_ends"), least("before"))
    whole = written(whole, "trie-whole")
    owned = whole.groupBy("conv_id").agg(F.min_by("before", "depth").alias("common"), F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"))
    ended = nodes.where(F.size("ends") > 0).select((F.col("before") + F.col("words")).alias("total"), F.explode("ends").alias("conv_id"))
    shares = ended.join(owned, "conv_id", "left").select("conv_id", F.coalesce("common", "total").alias("common"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    inside = nodes.select("key", "before", F.explode("members").alias("conv_id")).join(shares, "conv_id")
    sums = inside.groupBy("key").agg(F.sum(F.greatest(F.col("common") - F.col("before"), F.lit(0))).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    children = whole.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    above = whole.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    got = whole.join(sums, "key").join(children, "key", "left").join(end_digests(nodes), "key", "left").join(above, "parent", "left")
    none = hashlib.sha256(b"").hexdigest()
    return got.select(
        "key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, every: int | None = None, most: int = 4) -> DataFrame:
    """``prefix_trie`` of conversations (conv_id, turn, role, text), with ``every``: as rebuilt by ``with_borrowed_turns``.

    Null roles and texts count as empty ones, null turns come first, rows without a conv_id belong to none; repeated rows are
    turns of their own. Other columns play no part.
    """
    turns = written(numbered(conversations), "trie-numbered")
    turns, convs = with_borrowed_turns(turns, every, most) if every else (turns, conversations_of(turns))
    return prefix_trie(turns, convs)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun with turns of the one whose id is the last multiple of 20."""
    got = conversation_trie(table(spark, sf_dir, "conversations"), every=20)
    return got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 of a decimal number, by shifts; then prefixes as lists of turns, whose subtrees are found by cutting longer ones.
ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
hashed AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b:
    list_reduce(list_prepend(xor(a, b), range(8)), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END))) % 4 AS h FROM c),
taken AS (SELECT a.conv_id, a.n, a.base, a.h, least(a.h, coalesce(b.n, 0)) AS taken FROM hashed a LEFT JOIN c b ON b.conv_id = a.base),
whole AS (SELECT k.conv_id, t.pos - k.h + k.taken AS pos, role, text FROM taken k JOIN t ON t.conv_id = k.conv_id AND t.pos >= k.h
  UNION ALL SELECT k.conv_id, t.pos, role, text FROM taken k JOIN t ON t.conv_id = k.base AND t.pos < k.taken),
marked AS (SELECT *, sha256(length(role) || ':' || role || text) AS x, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM whole),
paths AS (SELECT k.conv_id, coalesce(p.path, []::VARCHAR[]) AS path FROM taken k LEFT JOIN (SELECT conv_id, list(x ORDER BY pos) AS path FROM marked GROUP BY 1) p USING (conv_id)),
inside AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM paths),
nodes AS (SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth), '')) AS ends_sha256 FROM inside GROUP BY 1, 2),
weights AS (SELECT DISTINCT x, words FROM marked),
kids AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
worth AS (SELECT o.node, o.depth, CASE WHEN o.depth = 0 THEN 0 ELSE (o.n_convs - 1) * w.words END AS saved, k.n_children IS NULL AS leaf FROM nodes o LEFT JOIN weights w ON w.x = o.node[o.depth] LEFT JOIN kids k ON k.node = o.node),
above AS (SELECT node[1:d] AS node, saved, leaf FROM (SELECT *, unnest(range(depth + 1)) AS d FROM worth)),
sums AS (SELECT node, sum(saved) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM above GROUP BY 1)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, o.ends_sha256
FROM nodes o JOIN sums s ON s.node = o.node LEFT JOIN kids k ON k.node = o.node LEFT JOIN nodes p ON o.depth > 0 AND p.node = o.node[1:o.depth - 1]
"""
