"""Conversation tries: nodes against plain prefixes, SQL, blocks and slabs, odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from trailmark.llm import trie as T


def expected(rows, every=20):
    """The contract's rows, by plain dictionaries of prefixes. rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - (c % every if c >= 0 else -(-c % every)), [])[:h] + turns[h:] if every else turns
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out, done = [], {}
    for p in sorted(nodes, key=len, reverse=True):
        below = [done[k] for k in kids.get(p, ())]
        saved = (len(nodes[p]) - 1) * len(re.findall(T.WORD, p[-1][1])) if p else 0
        done[p] = (sum(x[0] for x in below) or 1, saved + sum(x[1] for x in below))
        ends = sorted(c for c in nodes[p] if len(whole[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids.get(p, ())), *done[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


COLUMNS = "conv_id long, turn long, role string, text string"


def some_rows(seed, conversations=90, most=7, texts=3):
    rng = random.Random(seed)
    return [(c * rng.choice([1, 1, 3]), t, rng.choice(["user", "bot"]) if rng.random() < 0.1 else ["user", "bot"][t % 2], f"{'say ' * rng.randint(0, 2)}{rng.randrange(texts)}") for c in range(-5, conversations) for t in range(rng.randint(0, most))]


@pytest.mark.parametrize(("block", "slab"), [(8192, 64), (16, 64), (8192, 2), (8, 3)])
def test_against_plain_prefixes(spark, monkeypatch, block, slab):
    """The same nodes however conversations are dealt into blocks and positions into slabs."""
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "SLAB", slab)
    rows = some_rows(block + slab)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert found(T.conversation_trie(df, every=20)) == expected(rows)


def test_block_by_hand():
    a, b, c = (x * 32 for x in (b"a", b"b", b"c"))
    heads = [(7, T.ROOT, 0, False), (3, T.ROOT, 0, False), (5, T.ROOT, 0, False)]
    turns = [(3, 0, a, 2), (3, 1, b, 1), (7, 0, a, 2), (5, 0, c, 4)]
    got = {(r[2], r[3]): r[4:] for r in T.block_trie(heads, turns, True)}
    assert got == {(0, 3): (3, 0, 0, [3, 5, 7], []), (1, 3): (2, 2, 0, [3, 7], [7]), (2, 3): (1, 1, 2, [3], [3]), (1, 5): (1, 4, 0, [5], [5])}


def test_members_of_bitsets():
    rng = random.Random(1)
    for n in (0, 1, 8, 9, 500):
        at = sorted(rng.sample(range(2000), n))
        assert T.members_of(sum(1 << k for k in at)) == at


def test_sql_agrees(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = [tuple(None if x is None else x for x in r) for r in c.sql(T.ORACLE_SQL).fetchall()]
    assert found(T.op12_conversation_trie(spark, sf)) == sorted(want, key=str)


def test_odd_rows(spark, monkeypatch):
    """Null ids, turns, roles and texts, repeated rows, a long conversation, hot prefixes, turnless ones, clashing names."""
    monkeypatch.setattr(T, "BLOCK", 64)
    rows = [(20, None, None, None), (20, 1, "user", None), (20, 1, "user", None), (None, 1, "user", "lost"), (21, 5, "user", "a b"), (21, 5, "user", "a b"), (23, 0, "", "x" * 100_000), (61, 0, "u", "only one")]
    rows += [(c, t, "user", "hot turn of many words") for c in range(100, 400) for t in range(2)] + [(1000, t, "u", f"{t}") for t in range(300)] + [(1020, t, "u", f"{t}") for t in range(150)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{COLUMNS}, depth int, block int").repartition(6)
    assert found(T.conversation_trie(df, every=20)) == expected(rows)
    assert found(T.conversation_trie(df)) == expected(rows, every=0)
    assert found(T.conversation_trie(df.limit(0), every=20)) == []
