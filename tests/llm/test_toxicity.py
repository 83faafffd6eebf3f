"""Toxicity: Kneser-Ney models against plain ones, held-out accuracy, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from trailmark.llm import toxicity as T


def plain(words, order=T.ORDER, shared=T.SHARED):
    """log(toxic / ordinary) of a word, by dictionaries of symbol tuples; words: word -> (toxic uses, ordinary uses)."""
    raw = [Counter(), Counter()]
    for w, both in words.items():
        s = (1, *map(ord, w), 2)
        for k in range(2, order + 1):
            for i in range(k - 1, len(s)):
                for y in (0, 1):
                    raw[y][s[i - k + 1 : i + 1]] += both[y]
    counts = [Counter(), Counter()]
    for g in raw[0]:
        k = len(g)
        n = [raw[0][g], raw[1][g]]
        if k == order or g[0] == 1:
            for y in (0, 1):
                counts[y][g] += sum(n) if k <= shared else n[y]
        for y in (0, 1):
            counts[y][g[1:]] += 1 if k - 1 <= shared else n[y] > 0
    discount, total, kinds = {}, [Counter(), Counter()], [Counter(), Counter()]
    for y in (0, 1):
        for g, n in counts[y].items():
            total[y][g[:-1]] += n
            kinds[y][g[:-1]] += n > 0
        for k in range(1, order + 1):
            ones, twos = (sum(n == x for g, n in counts[y].items() if len(g) == k) for x in (1, 2))
            discount[y, k] = ones / (ones + 2 * twos) if ones else 0.5

    def probability(y, s, i):
        p = T.UNIFORM
        for k in range(1, min(order, i + 1) + 1):
            g = s[i - k + 1 : i + 1]
            if total[y][g[:-1]]:
                p = (max(counts[y][g] - discount[y, k], 0) + min(discount[y, k] * kinds[y][g[:-1]], total[y][g[:-1]]) * p) / total[y][g[:-1]]
        return p

    def ratio(w):
        s = (1, *map(ord, w), 2)
        return sum(math.log(probability(0, s, i)) - math.log(probability(1, s, i)) for i in range(1, len(s)))

    return ratio


def test_ratios_against_plain_models(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))): (rng.choice([0, 0, 1, 5]), rng.choice([0, 1, 2, 9])) for _ in range(150)} | {"idiotic": (8, 0), "idiot": (20, 0)}
    words = {w: c for w, c in words.items() if any(c)}
    df = spark.createDataFrame([(w, *c) for w, c in words.items()], "word string, tox long, ord long").repartition(3)
    model, ratio = T.fit_counts(df), plain(words)
    asked = [*words, "idiots", "ab", "zzz", "é", "abcdabcdabcdabcd", "日本"]
    assert model.ratios(asked) == pytest.approx([ratio(w) for w in asked], abs=1e-4)
    assert ratio("idiot") > 1 > abs(ratio("日本"))  # what neither class knows weighs little


def test_long_runs_are_read_in_parts():
    rng = np.random.default_rng(1)
    n = 1 << 12
    model = T.Model(rng.integers(0, 9, (n, 2)).astype(np.float32), rng.integers(0, 30, (n, 2)).astype(np.float32), rng.integers(1, 5, (n, 2)).astype(np.float32), np.full((T.ORDER + 1, 2), 0.5))
    words = ["abcdefgh" * 40, "x", "hij" * 100]
    whole, parts = model.ratios(words), T.AT_ONCE
    T.AT_ONCE = 37
    try:
        assert model.ratios(words) == pytest.approx(whole)
    finally:
        T.AT_ONCE = parts


def test_query_against_recomputed_scores(spark):
    """The score is the logistic curve of what a plain reading of each document's words gives."""
    rng = random.Random(4)
    common, bad = [f"w{c}{d}" for c in "abcdefg" for d in "hijk"], ["idiot", "moron", "stupid"]
    text = lambda toxic: " ".join(rng.choice(bad) if toxic and rng.random() < 0.1 else rng.choice(common) for _ in range(rng.randint(5, 90)))
    marks = [rng.random() < 0.3 for _ in range(600)]
    docs = spark.createDataFrame([(k, text(x), "s") for k, x in enumerate(marks)], "doc_id long, text string, score string").repartition(5)
    labels = spark.createDataFrame([(k, int(x)) for k, x in enumerate(marks) if k % 7], "doc_id long, toxic int")
    model, weights = fitted = T.fit(docs, labels)
    got = {r["doc_id"]: r for r in T.score(docs, fitted).collect()}
    right = 0
    for d in docs.collect():
        ratios = [float(model.ratios([w])[0]) for w in "".join(c if c.isalpha() else " " for c in d["text"].lower()).split()]
        n, top = len(ratios), sorted(ratios)[-2:]
        worst = max(sum(ratios[a : a + T.PASSAGE]) / min(n, T.PASSAGE) for a in range(max(1, n - T.PASSAGE + 1)))
        above = sum(min(max(x - T.SURE, 0), T.MOST) for x in ratios)
        z = np.dot(weights, [sum(ratios) / n, worst, math.log(n), above / n, math.log1p(above), sum(top) / len(top), top[0], 1])
        r = got[d["doc_id"]]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and r["predicted"] == (r["score"] >= 0.3)
        right += zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2 and (r["predicted"] == 1) == marks[d["doc_id"]]
    held = sum(zlib.crc32(str(k).encode()) % 4 == 2 for k in range(600))
    assert right >= 0.85 * held


def test_held_out_accuracy_and_training_rows(spark, sf):
    """Labels of held-out documents are not read; the query's columns are as the contract says."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(T.training(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = T.fit(docs, labels), T.fit(docs, other)
    assert (a[0].seen == b[0].seen).all() and a[1] == b[1]
    got = T.op11_toxicity(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got.collect())


def test_odd_rows(spark):
    rows = [(k, "you stupid idiot go" if k % 3 == 0 else "a good day to you", 7, 0.5, "m") for k in range(90)]
    rows += [(100, None, 7, 0.5, "m"), (101, "", 7, 0.5, "m"), (102, "12 !! ½", 7, 0.5, "m"), (103, "x" * 300_000, 7, 0.5, "m"), (104, "a good day to you " * 20_000 + "stupid idiot", 7, 0.5, "m"), (None, "stupid idiot", 7, 0.5, "m"), (0, "you stupid idiot go", 7, 0.5, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mean int, score double, measures string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)] + [(0, 0), (None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    got = T.score(docs, T.fit(docs, labels)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "mean", "measures", "score", "predicted"}
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["score"] for k in (100, 101, 102)] == [0.0] * 3 and by[None]["predicted"] == 1 and by[1]["predicted"] == 0 and (by[1]["mean"], by[1]["measures"]) == (7, "m")
    assert T.fit(docs.limit(0), labels) is None and T.fit(docs, labels.limit(0)) is None
    assert T.score(docs.limit(0), None).count() == 0 and {(r["score"], r["predicted"]) for r in T.score(docs, None).collect()} == {(0.0, 0)}
    assert T.fit(docs, labels.where("toxic = 1")) is None  # one label alone tells nothing
