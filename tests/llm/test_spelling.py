"""Spelling variants: searches against brute force, the query against plain recomputation, odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmark.llm import spelling as S


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) - len(u) == 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["ab", "abc", "abcdefghéÿ÷"]).flatmap(lambda a: st.sets(st.text(a, min_size=3, max_size=9), min_size=1, max_size=80)))
def test_searches_against_brute_force(words):
    """Each pair is found once, by one of the two searches: that of the left half if that is the same in both."""
    words = sorted(words)
    left, right = (list(zip(*[x.tolist() for x in S.near_in(words, words, m)], strict=True)) for m in (False, True))
    want = {(i, j) for i, u in enumerate(words) for j, v in enumerate(words) if near(u, v)}
    assert sorted(left + right) == sorted(want)
    assert set(left) == {(i, j) for i, j in want if words[j].startswith(words[i][: len(words[i]) // 2])}


def test_strange_letters_of_queries():
    q, w = S.near_in(["abcde", "abxde"], ["abçde", "zzzzz", "abcd"], False)
    assert list(zip(q.tolist(), w.tolist(), strict=True)) == [(0, 0), (0, 1), (2, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=300))
def test_suffix_ranks(text):
    text = np.array(text)
    assert S.suffix_ranks(text).tolist() == sorted(range(len(text)), key=lambda k: text[k:].tolist())


def expected(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 5
    n = {w: k for w, k in n.items() if k >= 3}
    beside = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in beside.items() if vs}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), k, len(beside[w]), n.get(form.get(w))) for w, k in n.items()}


def result(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_against_plain_recomputation(spark):
    """Chains of forms, ties, and words of all lengths; with indexes so small that keys are split into grids."""
    rng = random.Random(6)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(40)] + ["prefix" + "".join(rng.choice("ab") for _ in range(4)) for _ in range(30)]
    rows = [(i if i % 9 else None, " ".join(rng.choice(base[: rng.randint(1, 70)]).title() for _ in range(60))) for i in range(80)]
    rows += [(500, "chain1 chains chainss " * 3 + "chains " * 5 + "chainss " * 20), (501, None), (502, ""), (503, "12 !!"), (504, "ÀÉÿ×÷ÿ " * 4 + "ẞß straße straßen " * 3), (505, "longword" * 3000 + " " + ("longword" * 3000 + " ") * 3)]
    rows += [rows[3]] * 3
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(5)
    want = expected(rows)
    words = S.words_used(df)
    assert result(S.variants(words)) == want == result(S.variants(words, index_words=7))
    assert any(r[1] and r[2] != r[1] for r in want) and S.variants(S.words_used(df.limit(0))).count() == 0


def test_query_of_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(S.op13_spelling_variants(spark, sf)) == expected(rows)
