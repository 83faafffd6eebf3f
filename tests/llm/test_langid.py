"""Language identification: sums over segmentations, held-out accuracy, odd rows."""

import math
import zlib

import numpy as np
import pytest

from trailmark.llm import langid

pytest.importorskip("public_tokenizers")


def test_forward_sums_all_segmentations():
    match = {"▁": 0, "▁a": 1, "a": 2, "b": 3, "ab": 4, "▁ab": 5}
    prob = np.vstack([np.array([[0.1], [0.2], [0.15], [0.25], [0.05], [0.25]]), [[1e-9]]])
    p = lambda *k: math.prod(prob[i, 0] for i in k)
    got = langid.Lattice(["ab", "a", "z"], match, 6).scores(prob)
    assert got[:, 0].tolist() == pytest.approx([math.log(p(5) + p(1, 3) + p(0, 4) + p(0, 2, 3)), math.log(p(1) + p(0, 2)), math.log(p(0, 6))])
    counts = langid.Lattice(["ab"], match, 6).counts(prob, np.array([[2.0]]))
    total = p(5) + p(1, 3) + p(0, 4) + p(0, 2, 3)
    assert counts[5, 0] == pytest.approx(2 * p(5) / total) and counts[3, 0] == pytest.approx(2 * (p(1, 3) + p(0, 2, 3)) / total)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.predict(docs.withColumn("held_out", langid.held_out()), langid.fit(docs, langid.default_vocabulary())).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r["held_out"]]
    assert len(out) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in out]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(k, "der hund und die katze " * 3, "de") for k in range(20)] + [(k, "the dog and the cat ", "en") for k in range(20, 40)]
    rows += [(50, None, "en"), (51, "12 34 !!", "en"), (52, "x" * 5000, None), (53, "the dog " * 20_000, None), (None, "die katze", None), (54, "", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.fit(df, langid.default_vocabulary())
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, model).collect()}
    assert (got[50], got[51], got[54], got[53], got[None]) == ("und", "und", "und", "en", "de") and got[52] in ("de", "en")
    none = df.limit(0)
    assert langid.fit(none, langid.default_vocabulary()) is None
    assert langid.predict(none, None).count() == 0 and {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}


def test_predictions_against_brute_force(spark):
    """The query's language and score: every word's probability summed over its segmentations one by one, in plain Python."""
    rows = [(k, "der hund und die katze essen brot", "de") for k in range(10)] + [(k, "the dog and the cat eat bread", "en") for k in range(10, 20)] + [(k, "el perro y el gato comen pan", "es") for k in range(20, 30)]
    texts = ["the katze", "und y and", "Brot, bread & pan!", "qqq zzz", "x²y ½", "日本 hund", "a" * 70]
    df = spark.createDataFrame(rows + [(100 + k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(df, langid.default_vocabulary())

    def word(w, k):
        w, floor = langid.START + w, len(model.prob) - 1

        def rest(i):
            if i == len(w):
                return 1.0
            total, single = 0.0, False
            for j in range(i + 1, len(w) + 1):
                p = model.match.get(w[i:j])
                if p is not None and p >= 0:
                    single |= j == i + 1
                    total += model.prob[p, k] * tails[j]
            return total + (0 if single else model.prob[floor, k] * tails[i + 1])

        tails = {}
        for i in range(len(w), -1, -1):
            tails[i] = rest(i)
        return math.log(max(tails[0], 1e-300))

    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    for k, t in enumerate(texts):
        runs = ["x", "y"] if t == "x²y ½" else [w for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
        parts = [w[a : a + langid.LONGEST] for w in runs for a in range(0, len(w), langid.LONGEST)]
        sums = [sum(word(w, j) for w in parts) for j in range(len(model.langs))]
        best = max(range(len(sums)), key=lambda j: (sums[j], -j))
        assert got[100 + k]["lang_pred"] == model.langs[best]
        assert got[100 + k]["score"] == pytest.approx(1 / sum(math.exp(s - sums[best]) for s in sums))


def test_letters_and_labels(spark):
    """Numerals are no letters, so such a text has no language; labels beyond the bound are not learned."""
    rows = [(k, f"word{chr(97 + k % 3)} text", f"l{k % 3}") for k in range(30)] + [(40, "½ ² ① Ⅷ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, langid.default_vocabulary())
    assert model.langs == ["l0", "l1", "l2"] and {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, model).collect()}[40] == "und"
    most = langid.MOST_LABELS
    langid.MOST_LABELS = 2
    try:
        assert len(langid.fit(df, langid.default_vocabulary()).langs) == 2
    finally:
        langid.MOST_LABELS = most
