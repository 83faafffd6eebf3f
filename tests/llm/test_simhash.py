"""SimHash: fingerprints, pigeonhole search and groups against brute force."""

import random

import numpy as np
import pytest
import xxhash

from trailmark.llm import neardup
from trailmark.llm import simhash as S
from trailmark.operators.components import connected_components


def plain_fingerprint(text: str, k: int) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", "one", "A b", "The THE the the cat sat on the ÄÖ mat\x0b\tagain", "x y z " * 50])
def test_fingerprint(text):
    assert int(S.fingerprint(S.shingle_hashes(text.encode(), 3))) == plain_fingerprint(text, 3)


def nodes(spark, n=300, seed=0):
    rng = random.Random(seed)
    base, fps = [rng.getrandbits(64) for _ in range(4)], set()
    while len(fps) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    return fps, spark.createDataFrame([(int(x),) * 2 for x in fps.view(np.int64)], "node long, fp long")


@pytest.mark.parametrize("threshold", [0, 1, 2, 3, 6, 8])
def test_all_close_pairs(spark, threshold):
    fps, df = nodes(spark)
    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    signed = fps.view(np.int64)
    want = {(min(a, b), max(a, b)) for i, j in zip(*np.nonzero(d <= threshold), strict=True) if i != j for a, b in [(int(signed[i]), int(signed[j]))]}
    assert {tuple(r) for r in S.close_pairs(df, threshold).collect()} == want


def test_hot_keys_connect_the_same(spark):
    _, df = nodes(spark, 400, 5)
    a, b = ({tuple(r) for r in connected_components(S.close_pairs(df, 2, hot), "a", "b").collect()} for hot in (10**9, 3))
    assert a == b and a


def test_allocation_covers():
    for threshold in range(7):
        total, t = S.allocate([[1.0 + k for k in range(threshold + 1)]] * 3, threshold)
        assert sum(x + 1 for x in t) == threshold + 1 and total > 0


def test_components(spark):
    long = "the quick brown fox jumps over the lazy dog again and again until the night falls on the hills " * 6
    rows = [(5, long), (3, long.upper()), (9, long + "end"), (1, None), (2, ""), (7, " \t"), (11, "something else entirely here"), (11, "something else entirely here"), (None, "alone at last")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = S.simhash_components(df).collect()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(rows)
    assert by[5] == by[3] == 3 and by[1] == by[2] == by[7] == 1 and by[11] == 11 and by[None] is None
    fps = {i: plain_fingerprint(t or "", 3) for i, t in rows}
    assert all(r["fp"] & (1 << 64) - 1 == fps[r["doc_id"]] for r in got)
    assert (by[9] == 3) == ((fps[9] ^ fps[5]).bit_count() <= 2)
    assert S.simhash_components(df.limit(0)).count() == 0


def jaccard(a: str, b: str, k: int = 5) -> float:
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_dedup(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(200)] for _ in range(12)]
    rows, texts = [], {}
    for k, b in enumerate(base):
        for c in range(3):
            w = list(b)
            for _ in range(c):  # one or two words changed: similarity above 0.9
                w[rng.randrange(200)] = word()
            rows.append((100 * c + k, " ".join(w), "en"))
    rows += [(1000, base[0][0] + " and nothing else of it", "en"), (1001, None, "en"), (1002, "", "de"), (None, "no id here but some words to tell", "en")]
    texts = {i: t for i, t, _ in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    kept = {r["doc_id"] for r in neardup.near_dedup(df).collect()}
    assert all(jaccard(texts[k], texts[100 * c + k]) >= 0.8 for k in range(12) for c in (1, 2))
    assert kept == {*range(12), 1000, 1001, None}
    assert neardup.near_dedup(df.limit(0)).count() == 0
    assert neardup.near_dedup(df).columns == df.columns


def test_near_dedup_recall_by_kind_of_edit(spark):
    """Pairs of documents by edit (scattered words, an inserted block, a cut tail) and by brute-force Jaccard similarity of
    their five-word shingles: of those at 0.8 or more, nine in ten or more are found in every cell; below, none."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    common = [word() for _ in range(60)]
    rows, pairs = [], []
    for k in range(900):
        w = [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(rng.randint(80, 400))]
        kind, v = ("scattered", "block", "tail")[k % 3], list(w)
        if kind == "scattered":
            for i in rng.sample(range(len(v)), max(1, int(len(v) * rng.uniform(0.001, 0.024)))):
                v[i] = word()
        elif kind == "block":
            at = rng.randrange(len(v))
            v[at:at] = [word() for _ in range(int(len(v) * rng.uniform(0.02, 0.24)))]
        else:
            v = v[: int(len(v) * rng.uniform(0.79, 0.98))]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (w, v))
        pairs.append((kind, len(x & y) / len(x | y)))
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    kept = {r["doc_id"] for r in neardup.near_dedup(df).select("doc_id").collect()}
    cells = {}
    for k, (kind, j) in enumerate(pairs):
        found = 2 * k + 1 not in kept
        if j < 0.8:
            assert not found
        else:
            cells.setdefault((kind, 0.8 if j < 0.85 else 0.85 if j < 0.9 else 0.9), []).append(found)
    assert len(cells) == 9 and all(len(c) >= 20 and sum(c) >= 0.9 * len(c) for c in cells.values()), {c: (sum(v), len(v)) for c, v in cells.items()}
    assert all(2 * k in kept for k in range(900))


def test_near_dedup_odd_rows(spark):
    """Repeated rows stay together; a null doc_id comes first; columns with the operator's own names stay as they are."""
    long = " ".join(f"word{i}" for i in range(300_000))
    rows = [(5, "same text here"), (5, "same text here"), (7, "same text here"), (8, None), (9, ""), (None, long), (1, long + " more"), (3, "alone")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, row_key int, `_key` int, ROW_KEY_ int")
    got = neardup.near_dedup(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"] is not None) and r["doc_id"], r["row_key"], r["_key"]) for r in got.collect()) == [(False, 1, 2), (3, 1, 2), (5, 1, 2), (5, 1, 2), (8, 1, 2)]
