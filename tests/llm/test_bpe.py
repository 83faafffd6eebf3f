"""The automaton against step-by-step merging and against the tokenizers library."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmark.llm import bpe

P = pytest.importorskip("public_tokenizers")


def merge_all(word, merges):
    w = list(word)
    for u, v in merges:
        i, out = 0, []
        while i < len(w):
            if w[i : i + 2] == [u, v]:
                out.append(u + v)
                i += 2
            else:
                out.append(w[i])
                i += 1
        w = out
    return w


def written_out(alphabet, merges):
    """The whole automaton as the gadget construction makes it, state by state: token -> tokens that may follow."""
    arcs = {a: set(alphabet) for a in alphabet}
    for u, v in merges:
        if v not in arcs.get(u, ()):
            continue
        w = u + v
        state = set(arcs[v])
        arcs[u].discard(v)
        for s in [*arcs.values(), state]:
            if u in s:
                s.add(w)
        arcs[w] = state
    return arcs


@pytest.mark.parametrize("seed", range(40))
def test_gadgets_and_arcs(seed):
    """The table that the query uses, compiled merge by merge, has the arcs of the automaton written out, after every gadget."""
    rng = random.Random(seed)
    tokens, merges = list("abc"), []
    for _ in range(12):
        u, v = rng.choice(tokens), rng.choice(tokens)
        if u + v not in tokens:
            tokens.append(u + v)
            merges.append((u, v))
    at = {t: i for i, t in enumerate(tokens)}
    step = bpe.Table(len(tokens))
    for k, (u, v) in enumerate(merges):
        before = written_out(list("abc"), merges[:k])
        assert (u in before and v in before and step.gadget(at[u], at[v], at[u + v])) == (v in before.get(u, ()))
        now = written_out(list("abc"), merges[: k + 1])
        assert all(step.arc(at[s], at[t]) == (t in now[s]) for s in now for t in now)
    a = bpe.Automaton(json.dumps({"added_tokens": [], "model": {"vocab": at, "merges": merges}}))
    assert (a.table.made, a.table.default, a.table.beside, a.table.taken) == (step.made, step.default, step.beside, step.taken)
    for _ in range(50):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        assert [tokens[i] for i in a.encode(word)] == merge_all(word, merges)


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    spec = open(P.path("word_bpe_49k.json")).read()
    return bpe.WordTokenizer(spec), Tokenizer.from_str(spec)


def check(both, text):
    mine, library = both
    got = list(mine.pieces(text))
    ids = b"".join(x for x, _ in got)
    want = library.encode(text, add_special_tokens=False).ids
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want
    assert " ".join(x for _, x in got) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(both, text):
    check(both, text)


@pytest.mark.parametrize("text", ["Hello  World's ΣΑΣ İstanbul", "<|startoftext|>Hi <|endoftext|>there<|x|>", "\x1c\x85 a\xa0b", "don't WE'LL 12½ ﬁ 日本語 😀", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 50])
def test_odd_text(both, text):
    check(both, text)


def test_rows(spark, both):
    rows = [(1, "Some text, twice."), (2, None), (3, ""), (4, "Some text, twice."), (None, "x")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r for r in bpe.bpe_round_trip(df, P.path("word_bpe_49k.json")).collect()}
    assert got[2]["n_tokens"] == got[3]["n_tokens"] == 0 and got[2]["decoded"] == ""
    assert got[1]["ids"] == got[4]["ids"] and got[1]["decoded"] == both[1].decode(both[1].encode("Some text, twice.", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.bpe_round_trip(df.limit(0), P.path("word_bpe_49k.json")).count() == 0
