"""Spelling variants: words at one edit from each other, by search schemes over bidirectional FM-indexes of the vocabulary.

Two words at one edit share the whole of one half: the left one, if they differ behind it, else the right one. So one search
matches the left half and its delimiter exactly and then goes right with one error allowed, another does the same from the right.
An index holds intervals of suffix ranks of a delimited text and of its reverse, and extends a match on either side.
Words are dealt to indexes by length and the letters that any near word must share, so each search meets few of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import byte_column, spread, table, written

RUN = re.compile("[a-zÀ-ÿ]+")
#: Lower-cases A-Z in UTF-8.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: One occurrence in so many loses a letter before it is counted.
TYPO_EVERY = 97
LEAST_LENGTH, LEAST_USES = 5, 3
#: Words of an index; a form is at least so many times as frequent.
INDEX_WORDS, FORM_TIMES = 30_000, 2
#: Queries that are searched at a time.
AT_ONCE = 8192


def words_used(docs: DataFrame, typo_every: int = TYPO_EVERY, least_length: int = LEAST_LENGTH, least_uses: int = LEAST_USES) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, as counted over all documents. Where crc32 of "doc_id:run" is divisible by
    ``typo_every`` (0: nowhere), the run loses a letter first. Null texts have none; a null doc_id counts as an empty one."""

    def run(batches):
        for b in (whole.slice(a, 512) for whole in batches for a in range(0, whole.num_rows, 512)):
            total: dict[str, int] = {}
            for i, t in zip(b.column(0).to_pylist(), byte_column(b, "text"), strict=True):
                if not t:
                    continue
                mark = zlib.crc32(b"%s:" % (i or "").encode())
                for w, n in Counter(RUN.findall(t.translate(LOWER).decode())).items():
                    if typo_every:
                        h = zlib.crc32(w.encode(), mark)
                        if h % typo_every == 0:
                            h %= len(w)
                            w = w[:h] + w[h + 1 :]
                    if len(w) >= least_length:
                        total[w] = total.get(w, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    got = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return got.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_uses)


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """The starts of a text's suffixes in their order, by doubling; the first round compares as many symbols as fit a number."""
    n, bits = len(text), max(1, int(text.max(initial=0) + 1).bit_length())
    step = 62 // bits
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = key << bits | padded[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        if n < 2 or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key, step = rank * (n + 1) + after, 2 * step


class Ranks:
    """One direction of an index: how often each symbol stands before the first i suffixes, in blocks of 64 with a bitmap each."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.starts = suffix_ranks(text)
        self.last = last = text[self.starts - 1]  # the symbol before each suffix; the text is taken as a ring
        n, blocks = len(text), len(text) // 64 + 1
        at = np.arange(n)
        self.map = np.zeros((blocks, sigma), np.uint64)
        np.bitwise_or.at(self.map, (at >> 6, last), np.uint64(1) << (at & 63).astype(np.uint64))
        each = np.bitwise_count(self.map).astype(np.int32)
        self.count = np.cumsum(each, axis=0, dtype=np.int32) - each
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=sigma))[:-1]])
        self.map_less = np.bitwise_or.accumulate(self.map, axis=1)
        self.count_less = np.cumsum(self.count, axis=1, dtype=np.int32)

    @staticmethod
    def _part(i: np.ndarray) -> np.ndarray:
        return (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)

    def one(self, i: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the symbols before the first i suffixes: how many are c, and how many are c or less."""
        b, part = i >> 6, self._part(i)
        return self.count[b, c] + np.bitwise_count(self.map[b, c] & part), self.count_less[b, c] + np.bitwise_count(self.map_less[b, c] & part)

    def each(self, i: np.ndarray) -> np.ndarray:
        b = i >> 6
        return self.count[b] + np.bitwise_count(self.map[b] & self._part(i)[:, None])


class Index:
    """Both directions over the text of some words with delimiters (symbol 0) around them. A match is an interval in either
    direction, of one size: its first rank in ``back`` (extended to the left) and in ``ahead`` (extended to the right)."""

    def __init__(self, words: list[str]):
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        flat = np.frombuffer(("\0" + "".join(w + "\0" for w in words)).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(flat)  # the delimiter is the least
        text = np.searchsorted(self.alphabet, flat)
        self.of = np.concatenate([[0], np.repeat(np.arange(len(words)), size)])  # the word that each place belongs to or ends
        self.sides = Ranks(text, len(self.alphabet)), Ranks(text[::-1], len(self.alphabet))
        self.length = len(text)

    def symbols(self, words: list[str]) -> np.ndarray:
        """A row per word (of equal lengths); letters that no word of the index has are -1."""
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, flat), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == flat, at, -1)

    def search(self, rows: np.ndarray, half: int, mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all words that start with a query's first ``half`` symbols and differ by exactly one edit behind them.
        Mirrored: queries and words are read from their ends."""
        back, ahead = self.sides[::-1] if mirrored else self.sides
        ids, first, other = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        size = np.full(len(rows), self.length)

        def grow(side, q, lo, far, size, c):
            """The matches extended by a symbol each, in the direction of ``side``; ``far`` are the first ranks on the other one."""
            ok = c >= 0
            q, lo, far, size, c = q[ok], lo[ok], far[ok], size[ok], c[ok]
            a, below = side.one(lo, c)
            b, upto = side.one(lo + size, c)
            less = (upto - b) - (below - a)
            ok = b > a
            return q[ok], (side.begin[c] + a)[ok], (far + less)[ok], (b - a)[ok]

        for k in range(half - 1, -1, -1):  # the half, from its inner end to the delimiter
            ids, first, other, size = grow(back, ids, first, other, size, rows[ids, k])
        ids, first, other, size = grow(back, ids, first, other, size, np.zeros(len(ids), np.int64))
        exact = ids, other, size
        none = np.zeros(0, np.int64)
        wrong = none, none, none  # matches with the error behind them

        def on(state, c):
            q, lo, _, size = grow(ahead, state[0], state[1], np.zeros_like(state[1]), state[2], c)
            return q, lo, size

        n = rows.shape[1]
        for k in range(half, n + 1):
            q, lo, size = exact
            many, single = np.flatnonzero(size > 1), np.flatnonzero(size == 1)  # one suffix goes on with one symbol
            before = ahead.each(lo[many])
            there = ahead.each((lo + size)[many]) - before
            at, c = np.nonzero(there)
            one = ahead.last[lo[single]]
            s, first, sizes = np.concatenate([many[at], single]), np.concatenate([before[at, c], ahead.one(lo[single], one)[0]]), np.concatenate([there[at, c], np.ones(len(single), np.int64)])
            c = np.concatenate([c, one])
            letter = c > 0
            s, c = s[letter], c[letter]
            branch = q[s], ahead.begin[c] + first[letter], sizes[letter]
            own = rows[q[s], k] if k < n else np.full(len(s), -1)
            differs = c != own
            added = tuple(x[differs] for x in branch)  # an inserted letter that equals the next one is found behind that
            joined = tuple(np.concatenate(x) for x in zip(wrong, added, strict=True))
            if k == n:
                break
            lost = rows[q, k] != rows[q, k + 1] if k + 1 < n else np.ones(len(q), bool)  # of equal letters the last one is deleted
            wrong = tuple(np.concatenate(x) for x in zip(on(joined, rows[joined[0], k]), added, tuple(x[lost] for x in exact), strict=True))
            exact = on(exact, rows[q, k])
        q, lo, _ = on(joined, np.zeros(len(joined[0]), np.int64))
        place = ahead.starts[lo]  # of the delimiter that a match ends at, in the text of its direction
        return q, self.of[place + 1] if mirrored else self.of[self.length - 1 - place]


def near_in(index: list[str], queries: list[str], mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) at one edit whose left half (mirrored: only the right half) is the same; halves are those of the query."""
    found, by = [], {}
    for k, w in enumerate(queries):
        by.setdefault(len(w), []).append(k)
    fm = Index(index)
    for n, ks in by.items():
        left = n // 2
        per = max(1, AT_ONCE * 16 // n)
        for a in range(0, len(ks), per):
            at = np.array(ks[a : a + per])
            rows = fm.symbols([queries[k] for k in at])
            q, w = fm.search(rows[:, ::-1] if mirrored else rows, n - left if mirrored else left, mirrored)
            found.append((at[q], w))
    q, w = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    if mirrored and len(q):
        new = np.fromiter((not index[j].startswith(queries[i][: len(queries[i]) // 2]) for i, j in zip(q.tolist(), w.tolist(), strict=True)), bool, len(q))
        q, w = q[new], w[new]
    return q, w


def near_words(words: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """word, n_near, near, near_n: of each word (word, n) that has near ones, their number and the most frequent of them (ties: the
    least in code-point order).

    A near word of length m shares its first or its last (m - 1) // 2 letters: a key, by which it has one index on each side and a
    word looks into two. Keys of more words than an index takes have a grid of indexes and parts of queries.
    """
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    key = F.when(F.col("side") == 0, F.substring("word", F.lit(1), F.col("m"))).otherwise(F.expr("right(word, m)"))
    half = lambda n: F.floor((n - 1) / 2).cast("int")
    length = F.length("word")
    held = words.select("word", "n", side, half(length).alias("m")).withColumn("key", key)
    asked = words.select("word", "n", side, F.explode(F.array_distinct(F.array(half(length - 1), half(length + 1)))).alias("m")).withColumn("key", key)
    hot = held.groupBy("side", "key").agg(F.ceil(F.count("*") / index_words).cast("int").alias("times")).where("times > 1")
    parts = spread(words.count(), index_words)

    def dealt(rows: DataFrame, kind: int) -> DataFrame:
        got = rows.join(hot, ["side", "key"], "left").withColumn("times", F.coalesce("times", F.lit(1)))
        mine, every = F.pmod(F.xxhash64("word"), F.col("times")), F.explode(F.sequence(F.lit(0), F.col("times") - 1))
        got = got.withColumn("i", every if kind else mine.cast("int")).withColumn("j", mine.cast("int") if kind else every)
        cell = F.when(F.col("times") > 1, F.struct("key", "i", "j"))
        return got.select("side", F.when(F.col("times") > 1, -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(parts))).alias("at"), cell.alias("cell"), "word", "n", F.lit(kind).alias("kind"))

    def run(group: pa.Table) -> pa.Table:
        mirrored = group.column("side")[0].as_py() == 1
        rows = list(zip(*[group.column(c).to_pylist() for c in ("kind", "word", "n")], strict=True))
        counts = {w: n for kind, w, n in rows if kind == 0}
        index, queries = sorted(counts), list(dict.fromkeys(w for kind, w, _ in rows if kind == 1))
        q, w = near_in(index, queries, mirrored) if index else (np.zeros(0, np.int64),) * 2
        n = np.fromiter((counts[x] for x in index), np.int64, len(index))
        order = np.lexsort((w, -n[w], q))
        q, w = q[order], w[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        return pa.table([pa.array([queries[k] for k in q[first]], pa.string()), pa.array(np.diff(np.append(first, len(q)))), pa.array([index[k] for k in w[first]], pa.string()), pa.array(n[w[first]])], names=["word", "n_near", "near", "near_n"])

    found = dealt(held, 0).unionAll(dealt(asked, 1)).groupBy("side", "at", "cell").applyInArrow(run, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms from each word that has one, by doubling; counts at least double along it."""
    at = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.select("word", "root").join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "forms")
        if at.where("went").isEmpty():
            return at.select("word", "root")


def variants(words: DataFrame, times: float = FORM_TIMES, index_words: int = INDEX_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of a vocabulary (word, n; each word once): the most frequent near word is a word's form if
    it is ``times`` as frequent; root follows forms to the last one. An empty vocabulary gives no rows."""
    near = written(near_words(words, index_words), "near-words")
    is_form = F.col("near_n") >= times * F.col("n")
    got = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    return got.join(roots(got.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants of all words of whole documents."""
    words = written(words_used(table(spark, sf_dir, "documents")), "vocabulary")
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")
