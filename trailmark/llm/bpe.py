"""BPE encoding and decoding by a tokenization automaton.

Compiling merges one by one (the merge-gadget construction) turns the one-state automaton over base symbols into a
deterministic one with a state per token, whose arcs say which token may follow which in a proper tokenization. For a
merge (u, v) -> w, the gadget takes the arc v out of state u, adds an arc w beside every arc u that is left, and gives
the new state w the arcs that state v has then. Written out, the arcs of some 50,000 tokens would be billions, so ``Table``
stores a state by what tells it from another one: each gadget adds one row (the state whose arcs the new state copies by
default, the arc that the new arc stands beside) and one exception (the arc taken out). ``Table.arc`` follows the defaults
of a state until an exception or the base symbols decide; words' scans keep what they looked up.

A word's tokenization is then the only path through the automaton that spells the word: one left-to-right scan with a
lookup in the table of symbols (``Table.step``) for each character and one in the table of arcs for each token that matches.
Decoding emits the labels of the arcs on the path.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import table

#: Distinct words whose encoding a Python worker holds, and arcs looked up; beyond it, the store starts anew.
HELD_WORDS, HELD_ARCS = 400_000, 2_000_000
END = "\ue000"  # stands for the end-of-word mark, behind the last symbol


class Table:
    """The compiled automaton over ``size`` tokens. All are base symbols with arcs to each other until a gadget makes them."""

    def __init__(self, size: int):
        self.made = [-1] * size  # the gadget that made the state, or -1
        self.default = [-1] * size  # the state whose arcs it copied then
        self.beside = [-1] * size  # the arc that its arc was added beside
        self.taken: dict[tuple[int, int], int] = {}  # (state, arc) -> the gadget that took the arc out
        self.gadgets = 0
        self.trie: dict[int, int] = {}  # (node, character) -> node
        self.token = [-1]  # the token that a node spells, or -1

    def gadget(self, u: int, v: int, w: int) -> bool:
        """Compile the merge (u, v) -> w in; False if v never follows u, so that the merge has nothing to act on."""
        if not self.arc(u, v):
            return False
        self.made[w], self.default[w], self.beside[w] = self.gadgets, v, u
        self.taken[u, v] = self.gadgets
        self.gadgets += 1
        return True

    def arc(self, state: int, arc: int) -> bool:
        """Whether the state has the arc. Of the two, the one made later says where the arc came from: the state copied it from its
        default state, or it was put beside another arc of the state; so the question goes back to an earlier automaton."""
        made, default, beside, taken, limit = self.made, self.default, self.beside, self.taken, self.gadgets
        while True:
            if taken.get((state, arc), limit) < limit:
                return False
            a, b = made[state], made[arc]
            if a > b:
                state, limit = default[state], a
            elif b > a:
                u = beside[arc]
                if state == u == default[arc]:
                    return False  # u u -> w: once u has no arc u, w is not beside it
                arc, limit = u, b
            elif a < 0:
                return True
            else:  # the gadget's own state and arc
                state, arc, limit = default[state], beside[arc], a

    def label(self, text: str, token: int) -> None:
        """Let the scan know what a token spells."""
        node = 0
        for c in text:
            key = node << 21 | ord(c)
            if key not in self.trie:
                self.trie[key] = len(self.token)
                self.token.append(-1)
            node = self.trie[key]
        self.token[node] = token


class Automaton:
    """The compiled merges of a tokenizer file (BPE model with merges in order of rank)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.suffixed = bool(suffix)
        name = (lambda s: s[: -len(suffix)] + END if s.endswith(suffix) else s) if suffix else (lambda s: s)
        vocab = model["vocab"]
        self.label = {i: s for s, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.table = Table(max(self.label, default=-1) + 1)
        base, dead = set(vocab.values()), set()
        for pair in model["merges"]:
            u, v = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            w = vocab[self.label[u] + self.label[v]]
            if w not in base or w == u or w == v:
                raise ValueError("merges must make each token once, from tokens made before")
            base.discard(w)
            if u in dead or v in dead or not self.table.gadget(u, v, w):
                dead.add(w)
        for s, i in vocab.items():
            if i not in dead:
                self.table.label(name(s), i)
        self.arcs: dict[int, bool] = {}  # arcs looked up by scans

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word, given in the tokenizer's symbols."""
        if self.suffixed:
            word += END
        n, codes = len(word), list(map(ord, word))
        token, back = [-1] * (n + 1), [0] * (n + 1)
        go, spelled, arcs = self.table.trie.get, self.table.token, self.arcs
        for i in range(n):
            s = token[i]
            if s < 0 and i:
                continue
            node = 0
            for j in range(i, n):
                node = go(node << 21 | codes[j])
                if node is None:
                    break
                t = spelled[node]
                if t >= 0 and token[j + 1] < 0:
                    if i:
                        key = s << 20 | t
                        ok = arcs.get(key)
                        if ok is None:
                            if len(arcs) > HELD_ARCS:
                                arcs.clear()
                            ok = arcs[key] = self.table.arc(s, t)
                        if not ok:
                            continue
                    token[j + 1], back[j + 1] = t, i
        out = []
        while n > 0:
            if token[n] < 0:
                raise ValueError("the word has symbols outside the vocabulary")
            out.append(token[n])
            n = back[n]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The arc labels on the path (this kind of tokenizer has no decoder: labels are joined by spaces)."""
        return " ".join(self.label[i] for i in ids)


def _byte_symbols() -> dict[int, str]:
    """Byte-level symbols: printable bytes stand for themselves, the others for 256, 257, ... in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class _Words(dict):
    """word -> (ids as little-endian 32-bit, labels joined by spaces)."""

    def __init__(self, automaton: Automaton, mapped: bool):
        self.automaton, self.mapped = automaton, mapped

    def __missing__(self, word: str) -> tuple[bytes, str]:
        ids = self.automaton.encode(word if self.mapped or word.isascii() and word.isalnum() else "".join(map(_SYMBOL.__getitem__, word.encode())))
        if len(self) > HELD_WORDS:
            self.clear()
        got = self[word] = (b"".join([i.to_bytes(4, "little") for i in ids]), self.automaton.decode(ids))
        return got


_SYMBOL = _byte_symbols()


class WordTokenizer:
    """Splits texts as the tokenizer file says (NFC, lower case, word pattern, special tokens) and encodes the words."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.automaton = Automaton(spec)
        self.library = Tokenizer.from_str(spec)
        said = json.loads(spec)
        pattern = said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find, self.find_ascii = regex.compile(pattern).findall, re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r ")).findall
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        either = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.split, self.marked = either.split, either.search
        starts = {x[:2] for x in self.special}
        if len(starts) == 1:  # a plain search for what they all begin with is faster than the pattern
            begin = starts.pop()
            self.marked = lambda text: begin in text
        self.words, self.mapped = _Words(self.automaton, False), _Words(self.automaton, True)

    def pieces(self, text: str) -> Iterator[tuple[bytes, str]]:
        for part in self.split(text) if self.special and self.marked(text) else (text,):
            if part in self.special:
                yield self.special[part].to_bytes(4, "little"), part
            elif part.isascii():
                yield from map(self.words.__getitem__, self.find_ascii(part.lower()))
            elif max(part) < "ɐ":
                part = unicodedata.normalize("NFC", part).lower()
                yield from map(self.words.__getitem__, self.find(part))
            else:  # scripts where Unicode versions may differ: split by the library's own rules
                normal = self.library.normalizer.normalize_str(part)
                yield from (self.mapped[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal))


_HELD: dict[int, WordTokenizer] = {}


def _tokenizer(spec: str) -> WordTokenizer:
    """One compiled tokenizer per Python worker, kept for its next tasks."""
    key = hash(spec)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = WordTokenizer(spec)
    return _HELD[key]


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text", keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit), decoded; or with ``keep=False`` digests of the latter two.

    Whole texts are encoded as the tokenizers library does with the file at ``path`` (add_special_tokens=False) and
    decoded as its decode(ids, skip_special_tokens=False). Null texts count as empty: no tokens, empty decoded text. Rows are
    independent; equal texts get equal values; extra columns are ignored. The file is read on the driver and broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(path).read_text())
    schema = "doc_id long, n_tokens long, " + ("ids binary, decoded string" if keep else "ids_sha256 string, decoded_sha256 string")

    def run(batches):
        tok = _tokenizer(spec.value)
        for b in batches:
            n, ids, decoded = [], [], []
            for x in b.column(1).to_pylist():
                got = list(tok.pieces(x)) if x else []
                raw, out = b"".join([p[0] for p in got]), " ".join([p[1] for p in got])
                n.append(len(raw) // 4)
                ids.append(raw if keep else hashlib.sha256(raw).hexdigest())
                decoded.append(out if keep else hashlib.sha256(out.encode()).hexdigest())
            kinds = (pa.binary(), pa.string()) if keep else (pa.string(), pa.string())
            names = [f.split(" ")[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, kinds[0]), pa.array(decoded, kinds[1])], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text through the 49k word-level BPE vocabulary and back."""
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=False)
