"""Re-Pair grammars: exact round trips, random access, and ids equal to the library's."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmark.llm import repair

P = pytest.importorskip("public_tokenizers")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=800))
def test_grammar(ids):
    ids = np.array(ids, np.int64)
    seq, rules, base = repair.compress(ids)
    assert (repair.expand(seq, rules, base) == ids).all()
    spans = repair.lengths_of(rules, base)
    for k in range(len(rules)):
        whole = repair.expand(np.array([base + k]), rules, base)
        assert len(whole) == spans[k] and repair.END_ID not in whole[:-1].tolist()


def test_repetition_is_compressed():
    ids = np.array([5, 6, 7, 8] * 5000 + [2])
    seq, rules, base = repair.compress(ids)
    assert len(seq) < 5100 and len(rules) >= 2 and (repair.expand(seq, rules, base) == ids).all()


def test_ratio_on_documents(both, sf):
    """Stored integers an id on real ids: the early stop costs next to nothing against going on to the last pair."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()]
    ids = np.concatenate([np.append(x, 2) for x in both[0](texts)])
    stored = [(len(s) + 2 * len(r)) / len(ids) for s, r, _ in (repair.compress(ids), repair.compress(ids, least_gain=0.0))]
    assert stored[0] < 0.75 and stored[0] < stored[1] + 0.02, stored


def test_special_tokens_and_other_files(both):
    """Special tokens are those of the file, whatever they look like; a file of other rules goes through the library whole."""
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(P.path("byte_bpe_50k.json")).read())
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": len(spec["model"]["vocab"]), "content": "[x y]"})
    texts = ["a [x y] b", "[x y][x y]", "plain words here", ""]
    for change in ({}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}):
        text = json.dumps(spec | change)
        library = Tokenizer.from_str(text)
        assert [x.tolist() for x in repair.Encoder(text)(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    spec = open(P.path("byte_bpe_50k.json")).read()
    return repair.Encoder(spec), Tokenizer.from_str(spec)


piece = st.sampled_from(["a", "B ", "  ", "\n", " \n", "\t", "'s", " 're", "é", "日本", "12", "!!", " ", "x", "\x85", "\x1c", "<|endoftext|>", "\0", "word,", " Other.", "ǰ"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(piece, max_size=14).map("".join), max_size=4))
def test_encoder(both, texts):
    encode, library = both
    assert [x.tolist() for x in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("batches", [[["Hello, world . ok."]], [["hi!!", "x !! y"]], [["x !! y", "hi!!"]], [["hi!!"], ["x !! y"]], [["x !! y"], ["hi!!", ". . a.", "?! b?!"]]])
def test_points_alone_and_behind_words(both, batches):
    """Points behind a word and the same points between spaces have different ids, whichever comes first."""
    encode = repair.Encoder(open(P.path("byte_bpe_50k.json")).read())
    for texts in batches:
        assert [x.tolist() for x in encode(texts)] == [both[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_letters_need_no_pattern(both):
    """Words of Latin letters are encoded as byte-level symbols, apart from the library's pattern; all other parts go through it."""
    encode, seen = repair.Encoder(open(P.path("byte_bpe_50k.json")).read()), []

    class Library:
        def encode_batch_fast(self, texts, **k):
            seen.extend(texts)
            return both[1].encode_batch_fast(texts, **k)

    encode.library = Library()
    text = "first naïve words, ǰ ÿ µ Łódź ªº x1 re-pair plain"
    assert encode([text])[0].tolist() == both[1].encode(text, add_special_tokens=False).ids
    assert not any(w in " ".join(seen) for w in ("naïve", "words", "ÿ", "Łódź", "plain")) and "x1" in " ".join(seen)


def test_files(spark, both, sf):
    rows = [(7, "some words, and some words again"), (8, "Hello, world . ok. !! x!!"), (7, "some words, and some words again"), (3, None), (5, ""), (9, "x " * 30_000), (3, "again"), (None, "no id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(3)
    files = repair.token_files(df, P.path("byte_bpe_50k.json"), shard_ids=50).cache()
    got = {(r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in repair.document_ids(files).collect()}
    at, want = 0, set()  # the repeated row is two documents, each with its own start
    for i, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = np.array(both[1].encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.add((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    for row in files.collect():
        for k, doc in enumerate(row["doc_ids"]):
            ids = repair.read_document(row.asDict(), k).astype("<u4")
            assert any(doc == d and zlib.crc32(ids.tobytes()) == c for _, d, _, c in want)
    assert repair.document_ids(repair.token_files(df.limit(0), P.path("byte_bpe_50k.json"))).count() == 0
