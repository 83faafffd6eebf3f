"""Substring dedup against brute force."""

import random

import pytest

from trailmark.llm import substrings


def brute(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (-(1 << 70) if r[0] is None else r[0], r[1] or "")):
        w = (t or "").encode().split()
        gone = set()
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if key in seen:
                gone |= set(range(a, a + window))
            seen.add(key)
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("chunk_bytes", [300, 1 << 20])
@pytest.mark.parametrize("window", [3, 20])
def test_against_brute_force(spark, window, chunk_bytes):
    rng = random.Random(window)
    vocab = [f"w{k}" for k in range(40)] + ["é", "日本", "\x1c"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(window, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(50):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(100, None), (101, "  "), (102, "again " * 500), (103, "again " * 500), (-5, " ".join(passages[0])), (1 << 40, " ".join(passages[1])), (None, " ".join(passages[2]))]
    df = spark.createDataFrame([(*r, 7, "k", 1, 2) for r in rows], "doc_id long, text string, part int, kind string, `_chunk` int, chunk int").repartition(5)
    got = substrings.substring_dedup(df, window, chunk_bytes)
    assert got.columns == ["doc_id", "text", "part", "kind", "_chunk", "chunk", "n_words", "n_removed", "kept"]
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()} == brute(rows, window)


def test_none_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e")] * 2, "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substrings.substring_dedup(df, 3).collect()) == [0, 5]
    assert substrings.substring_dedup(df.limit(0)).count() == 0


def test_sketch_codes():
    import numpy as np

    for bits, n in ((24, 10), (33, 70_000), (48, 5000)):
        plan = substrings.Plan(20, 1 << max(0, bits - 7))
        cells = np.sort(np.random.default_rng(bits).integers(0, 1 << plan.bits, n).astype(np.uint64))
        for r, x in plan.by_range(cells, cells):
            assert (plan.decode(plan.encode(x)) == x - (np.uint64(r) << np.uint64(plan.rest))).all()
