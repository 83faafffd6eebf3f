"""Sharding and packing against plain versions."""

import heapq
import random
import zlib

from trailmark.llm import packing, sharding


def test_best_fit_against_plain_search():
    def plain(items, cap):
        bins, out = [], []
        for n, s, c in items:
            fit = [(r, k) for k, (r, ss, cc) in enumerate(bins) if r >= n and (s is None or s not in ss) and (c is None or c not in cc)]
            if fit:
                k = min(fit)[1]
            else:
                k = len(bins)
                bins.append([cap, set(), set()])
            out.append((k, cap - bins[k][0]))
            bins[k][0] -= n
            bins[k][1] |= set() if s is None else {s}
            bins[k][2] |= set() if c is None else {c}
        return out

    for seed in range(150):
        rng = random.Random(seed)
        cap = rng.choice([5, 16, 100, 2048])
        items = sorted(((rng.randint(1, cap), rng.choice([None, *"abcd"]), rng.choice([None, *range(9)])) for _ in range(rng.randint(0, 120))), key=lambda x: -x[0])
        assert packing.pack_shard(items, cap) == plain(items, cap)


def test_packing_keeps_everything(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), "hot" if i % 3 else f"s{i % 5}") for i in range(400)] + [(1000, None, "x"), (1001, "w " * 450, None), (1001, "w " * 450, None), (None, "a b", "q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, shard int")
    got = packing.best_fit_pack(packing.document_items(df), capacity=100, items_per_shard=150).collect()
    words = {}
    for r in got:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["length"]
    want = {}
    for i, t, _ in rows:
        n = len((t or "").split())
        if n:
            want[i] = want.get(i, 0) + n
    assert words == want
    source = {i: s for i, _, s in rows}
    bins = {}
    for r in got:
        bins.setdefault((r["shard"], r["bin"]), []).append(r)
    for some in bins.values():
        some.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in some] == [sum(x["length"] for x in some[:k]) for k in range(len(some))] and sum(r["length"] for r in some) <= 100
        named = [source[r["doc_id"]] for r in some if source[r["doc_id"]] is not None]
        assert len(named) == len(set(named))
    assert packing.best_fit_pack(packing.document_items(df.limit(0))).count() == 0


def test_packing_spreads_repeated_rows(spark):
    rows = [(1, "a b c", "s")] * 900 + [(k, "a b c", "s") for k in range(2, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.best_fit_pack(packing.document_items(df), items_per_shard=100).collect()
    shards = [r["shard"] for r in got if r["doc_id"] == 1]
    assert len(got) == len(rows) and len(shards) == 900 and max(map(shards.count, set(shards))) < 200


def test_lpt_against_heap():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 99) for _ in range(200)), reverse=True)
    loads = [(0, k) for k in range(7)]
    heapq.heapify(loads)
    want = []
    for s in sizes:
        load, k = heapq.heappop(loads)
        want.append(k)
        heapq.heappush(loads, (load + s, k))
    assert sharding.lpt(sizes, [0.0] * 7) == want


def test_bucketed_schedule_against_brute_force(spark):
    """The query's assignment with several buckets: each bucket is a plain LPT schedule that starts from its fraction of the
    large groups' loads, and together the shards come out even."""
    rng = random.Random(6)
    sizes = {f"{k:05d}".encode(): rng.choice([rng.randint(20, 300), 100]) for k in range(3000)} | {b"big%d" % k: 40_000 + k for k in range(5)}
    df = spark.createDataFrame([(bytearray(k), v) for k, v in sizes.items()], "key binary, total long").repartition(6)
    got = {bytes(r["key"]): r["shard"] for r in sharding.assign_groups(df, 8, 400).collect()}
    buckets = {bytes(r["key"]): r["b"] for r in df.selectExpr("key", "cast(pmod(xxhash64(key), 8) as int) as b").collect()}
    limit = sum(sizes.values()) // (8 * sharding.LARGE_SHARE)
    large = sorted((k for k in sizes if sizes[k] > limit), key=lambda k: (-sizes[k], k))
    assert sum(k.startswith(b"big") for k in large) == 5 and -(-(len(sizes) - len(large)) // 400) == 8
    loads = [0.0] * 8
    for k in large:
        s = loads.index(min(loads))
        assert got[k] == s
        loads[s] += sizes[k]
    for b in range(8):
        order, mine = [(b + k) % 8 for k in range(8)], [x / 8 for x in loads]
        for k in sorted((k for k in sizes if buckets[k] == b and k not in large), key=lambda k: (-sizes[k], k)):
            s = min(order, key=lambda x: (mine[x], order.index(x)))
            assert got[k] == s
            mine[s] += sizes[k]
    total = [sum(v for k, v in sizes.items() if got[k] == s) for s in range(8)]
    assert max(total) - min(total) < 0.02 * max(total)


def test_sharding(spark):
    rng = random.Random(3)
    rows = [(i, "t%d " % rng.randrange(300) * rng.randint(1, 30)) for i in range(2000)] + [(9000 + i, "hot text") for i in range(1000)] + [(1, None), (2, ""), (None, "ü"), (None, "ü"), (7, "big" * 40_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, slot int, key int").repartition(7)
    got = sharding.shard_documents(df, 8).collect()
    assert len(got) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, home, loads = {}, {}, [0] * 8
    text = {}
    for i, t in rows:
        text.setdefault((str(i), len((t or "").encode()) + 16), t or "")
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        home.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in home.values())
    rest = [x for x in sorted(loads)][:-1]  # the big text is a shard's whole load
    assert max(rest) - min(rest) < 0.05 * max(rest)
    assert {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    assert sharding.shard_documents(df.limit(0), 8).count() == 0
