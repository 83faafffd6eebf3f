"""Ball-tree search against brute force, with ties, odd vectors and repeated rows."""

import math
import random

import numpy as np
import pytest

from trailmark.llm import topk


def brute(rows, k=5):
    vs = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i: v for i, v in vs if i % 5 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(q[1], v, strict=True)), i) for i, v in vs if i != q[0] and len(v) == len(q[1]))[:k]
        out |= {(q[0], n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(400)] + [(i, [0.5] * 8) for i in range(400, 700)]
    rows += [(1000, None), (1005, []), (1010, [0.1] * 7 + [None]), (1015, [0.1] * 7 + [float("nan")]), (1020, [float("inf")] * 8), (1025, [0.3] * 3), (1026, [0.2] * 3), (None, [0.1] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    v = topk.integer_vectors(df)
    got = topk.top_k(v, v.where("vec_id % 5 = 0"), shard_rows=100, query_block=64)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()} == brute(as_float)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    v = topk.integer_vectors(df)
    assert [tuple(r) for r in topk.top_k(v, v.where("vec_id = 0")).collect()] == [(0, 1, 1, 2 * 512 * 256)]
    none = v.limit(0)
    assert topk.top_k(none, none).count() == 0


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.0])] * 2 + [(3, [0.5, 0.0])] * 3
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(v, v.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 3), (0, 2, 3), (0, 3, 3)]


def test_large_components(spark):
    rng = random.Random(3)
    sizes = [1.0, 2.0**14, 2.0**16, 2.0**21]
    rows = [(i, [float(np.float32(rng.gauss(0, 1) * rng.choice(sizes))) for _ in range(300)]) for i in range(150)]
    rows += [(i, [float(rng.randint(-(1 << 15), 1 << 15)) * 2] * 299 + [i / 256]) for i in range(150, 160)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    got = topk.top_k(v, v.where("vec_id % 5 = 0"), shard_rows=60, query_block=16)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()} == brute(rows)


def test_products_of_any_size():
    rng = random.Random(4)
    for bits in (10, 24, 28, 29, 31, 40):
        q, x = ([[rng.randint(-(1 << bits), 1 << bits) for _ in range(70)] for _ in range(n)] for n in (5, 9))
        q[0] = [1] * 70
        want = [[max(topk.LOW, min(topk.HIGH, sum(a * b for a, b in zip(r, s, strict=True)))) for s in x] for r in q]
        assert topk.products(np.array(q, float), np.array(x, float)).tolist() == want


def test_beyond_a_long(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**30, 0.0]), (2, [-(2.0**100), 0.0])] + [(k, [float(k), 0.0]) for k in range(3, 9)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    few = topk.top_k(v.where("vec_id <> 1"), v.where("vec_id = 0"))
    assert [(r["vec_id"], r["score"]) for r in few.orderBy("rank").collect()] == [(k, k << 46) for k in (8, 7, 6, 5, 4)]
    with pytest.raises(Exception, match="range of a long"):
        topk.top_k(v, v.where("vec_id = 0")).collect()
