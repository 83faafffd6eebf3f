"""Toxicity: class-conditional Kneser-Ney models of how toxic and ordinary documents spell their words.

An expression is a run of letters, lower-cased. Each class has an interpolated Kneser-Ney model of its symbols (a start mark, the
letters, an end mark) given up to ORDER - 1 symbols before them. Orders above SHARED are counted by class; below, both classes
share their counts, so an expression that neither class knows weighs nothing, and an unseen form of a known stem weighs as
that stem does. A document is scored by log-likelihood ratios per word: over all of it, over its worst passage, and of its most telling words.
Counts come from all labelled documents of the training part. The model is a table of a fixed number of hashed cells.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import cut, free_name, letter_runs, table, written

ORDER, SHARED = 6, 3
#: Cells of the model as a power of two: three tables of two 4-byte numbers a cell, 48 MB whatever the corpus.
CELL_BITS = 21
#: Labelled documents that the logistic curve from ratios to probabilities is fitted on (expected number, drawn by a hash of doc_id).
FIT_DOCS = 20_000
#: Words of a passage.
PASSAGE = 32
#: A word counts as telling from this ratio on, and for this much at most.
SURE, MOST = 2.0, 8.0
#: The curve where no sample holds both labels: the worst passage's ratio, with even odds at a half.
FEW = [0.0, 8.0, 0.0, 0.0, 0.0, 0.0, 0.0, -4.0]
THRESHOLD = 0.3
HELD_WORDS = 300_000
#: Symbols that are scored at a time.
AT_ONCE = 1 << 18
FIRST, LAST = 1, 2  # the marks; no letter has these code points
UNIFORM = 1e-3
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' marks and letters in one row, and the place of each symbol in its word (0 for the start mark)."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(begin, size)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.empty(size.sum(), np.uint64)
    code[begin], code[begin + size - 1] = FIRST, LAST
    inner = np.ones(len(code), bool)
    inner[begin] = inner[begin + size - 1] = False
    code[inner] = flat
    return code, place


def hashes(code: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """By order k (0 to ORDER): a hash of the k symbols up to each place; only good where place >= k - 1."""
    out = [np.full(len(code), B)]
    for k in range(1, ORDER + 1):
        h = np.zeros_like(code)
        h[k - 1 :] = (out[-1][k - 1 :] ^ (code[: len(code) - k + 1] + np.uint64(k << 32)) * B) * A
        out.append(h ^ (h >> np.uint64(29)))
    return out


def before(h: np.ndarray) -> np.ndarray:
    """The value one place to the left."""
    return np.concatenate([h[:1], h[:-1]])


def cells(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * A) >> np.uint64(64 - bits)).astype(np.int64)


class Model:
    """Counts of sequences, sums and kinds of what follows a context (a cell by hash, a column for toxic and for ordinary), and the
    discount of each order and class."""

    def __init__(self, seen: np.ndarray, total: np.ndarray, kinds: np.ndarray, discount: np.ndarray):
        self.seen, self.total, self.kinds, self.discount, self.key = seen, total, kinds, discount, uuid.uuid4().hex
        self.bits = len(seen).bit_length() - 1

    def probabilities(self, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each symbol (start marks: 1) in both classes."""
        by, p = hashes(code, place), np.full((len(code), 2), UNIFORM)
        for k in range(1, ORDER + 1):
            at = np.flatnonzero(place >= max(1, k - 1))
            total = self.total[c := cells(before(by[k - 1])[at], self.bits)].astype(float)
            d = self.discount[k]
            new = (np.maximum(self.seen[cells(by[k][at], self.bits)] - d, 0) + np.minimum(d * self.kinds[c], total) * p[at]) / np.maximum(total, 1e-9)
            p[at] = np.where(total > 0, new, p[at])
        p[place == 0] = 1
        return p

    def ratios(self, words: list[str]) -> np.ndarray:
        """log(toxic / ordinary) of each word. Symbols are taken in parts, each with what its first ones look back on."""
        if not words:
            return np.zeros(0)
        code, place = symbols(words)
        out = np.zeros(len(code))
        for a in range(0, len(code), AT_ONCE):
            back = min(a, ORDER)
            p = self.probabilities(code[a - back : a + AT_ONCE], place[a - back : a + AT_ONCE])[back:]
            out[a : a + AT_ONCE] = np.log(p[:, 0]) - np.log(p[:, 1])
        return np.add.reduceat(out, np.flatnonzero(place == 0))


def training():
    """Whether crc32 of the doc_id as text leaves no 2 when divided by 4 (null ids: as an empty text)."""
    return F.crc32(_id()) % 4 != 2


def _id():
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")


def _fold():
    """Every fifth training document fits the curve and not the counts."""
    return F.pmod(F.xxhash64(_id()), F.lit(5)) == 0


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, y of documents with a label; of several labels the higher holds. Only the ids' join moves texts, once."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").join(y.hint("shuffle_hash"), "doc_id")


def count_words(docs: DataFrame) -> DataFrame:
    """word, tox, ord: uses in toxic and in ordinary documents (text, y)."""

    def run(batches):
        for b in batches:
            texts, ys = b.column(0).to_pylist(), b.column(1).to_pylist()
            seen: tuple[dict[str, int], dict[str, int]] = ({}, {})
            for t, y in zip(texts, ys, strict=True):
                d = seen[0 if y == 1 else 1]
                for w in letter_runs(t.lower()):
                    d[w] = d.get(w, 0) + 1
            words = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([d.get(w, 0) for w in words], pa.int64()) for d in seen]], names=["word", "tox", "ord"])

    return docs.select("text", "y").mapInArrow(run, "word string, tox long, ord long").groupBy("word").agg(F.sum("tox").alias("tox"), F.sum("ord").alias("ord"))


def sequences(words: DataFrame) -> DataFrame:
    """k, g, c, sub, subc, head, tox, ord: the words' sequences of 2 to ORDER symbols as hashes, with those of the context, of the
    sequence less its first symbol and of that one's context; head: whether it begins with the start mark."""

    def run(batches):
        for b in (whole.slice(a, 50_000) for whole in batches for a in range(0, whole.num_rows, 50_000)):
            code, place = symbols(b.column(0).to_pylist())
            word = np.cumsum(place == 0) - 1
            by = hashes(code, place)
            counts = [b.column(k).to_numpy() for k in (1, 2)]
            for k in range(2, ORDER + 1):
                at = np.flatnonzero(place >= k - 1)
                g, first, where = np.unique(by[k][at], return_index=True, return_inverse=True)
                here = at[first]
                sums = [np.bincount(where, c[word[at]], len(g)).astype(np.int64) for c in counts]
                hashed = [x.view(np.int64) for x in (g, by[k - 1][here - 1], by[k - 1][here], by[k - 2][here - 1])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), *map(pa.array, hashed), pa.array(place[here] == k - 1), *map(pa.array, sums)], names=["k", "g", "c", "sub", "subc", "head", "tox", "ord"])

    got = words.mapInArrow(run, "k int, g long, c long, sub long, subc long, head boolean, tox long, ord long")
    return got.groupBy("k", "g").agg(*[F.first(x).alias(x) for x in ("c", "sub", "subc", "head")], F.sum("tox").alias("tox"), F.sum("ord").alias("ord"))


def kneser_ney(grams: DataFrame) -> DataFrame:
    """k, g, c, tox, ord: uses of the longest sequences (and of those with a start mark before them), else how many different
    symbols come before; of both classes together in the shared orders."""
    pooled = lambda one, both: F.when(F.col("k") <= SHARED, both).otherwise(one)
    top = grams.where((F.col("k") == ORDER) | F.col("head")).select("k", "g", "c", pooled(F.col("tox"), F.col("tox") + F.col("ord")).alias("tox"), pooled(F.col("ord"), F.col("tox") + F.col("ord")).alias("ord"))
    less = grams.select((F.col("k") - 1).alias("k"), F.col("sub").alias("g"), F.col("subc").alias("c"), (F.col("tox") > 0).cast("long").alias("tox"), (F.col("ord") > 0).cast("long").alias("ord"))
    less = less.select("k", "g", "c", pooled(F.col("tox"), F.lit(1)).alias("tox"), pooled(F.col("ord"), F.lit(1)).alias("ord"))
    return top.unionAll(less).groupBy("k", "g").agg(F.first("c").alias("c"), F.sum("tox").alias("tox"), F.sum("ord").alias("ord"))


def fit_counts(words: DataFrame, bits: int = CELL_BITS) -> Model:
    """The model of a table of words (word, tox, ord). What reaches the driver has a row per cell at most."""
    counts = written(kneser_ney(sequences(words)), "toxic-counts")
    size = 1 << bits
    ones = lambda c: (F.sum((F.col(c) == 1).cast("long")).alias(f"{c}1"), F.sum((F.col(c) == 2).cast("long")).alias(f"{c}2"))
    discount = np.full((ORDER + 1, 2), 0.5)
    for r in counts.groupBy("k").agg(*ones("tox"), *ones("ord")).collect():
        for j, c in enumerate(("tox", "ord")):
            if r[f"{c}1"]:
                discount[r["k"], j] = r[f"{c}1"] / (r[f"{c}1"] + 2 * r[f"{c}2"])

    def place(column):
        def run(batches):
            for b in batches:
                at = cells(b.column(0).to_numpy().view(np.uint64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *b.columns[1:]], names=["cell", "tox", "ord"])

        return counts.select(column, "tox", "ord").mapInArrow(run, "cell int, tox long, ord long").groupBy("cell")

    def dense(rows: DataFrame, a: str, b: str) -> np.ndarray:
        got, out = rows.select("cell", a, b).toArrow(), np.zeros((size, 2), np.float32)
        at = got.column(0).to_numpy()
        out[at, 0], out[at, 1] = got.column(1).to_numpy(), got.column(2).to_numpy()
        return out

    seen = place("g").agg(F.sum("tox").alias("tox"), F.sum("ord").alias("ord"))
    some = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(f"k_{c}")
    after = cut(place("c").agg(F.sum("tox").alias("tox"), F.sum("ord").alias("ord"), some("tox"), some("ord")))
    return Model(dense(seen, "tox", "ord"), dense(after, "tox", "ord"), dense(after, "k_tox", "k_ord"), discount)


def measures(ratios: np.ndarray) -> list[float]:
    """Of a document's words: the mean ratio; that of the worst PASSAGE words in a row (of all, if fewer); the log of their number;
    what is above SURE (up to MOST a word), per word and as the log of the sum; the two highest ratios' mean, and the second."""
    n = len(ratios)
    mean, worst = float(ratios.mean()), float(ratios.mean())
    if n > PASSAGE:
        run = np.cumsum(np.concatenate([[0.0], ratios]))
        worst = float((run[PASSAGE:] - run[:-PASSAGE]).max()) / PASSAGE
    above = float(np.clip(ratios - SURE, 0, MOST).sum())
    two = np.partition(ratios, n - 2)[-2:] if n > 1 else ratios
    return [mean, worst, float(np.log(n)), above / n, float(np.log1p(above)), float(two.mean()), float(two.min())]


_HELD: dict = {}


def measured(docs: DataFrame, model: Model, name: str = "measures") -> DataFrame:
    """All rows and columns of docs with ``measures`` (an array; null for texts without a letter). Ratios of words are kept per
    Python worker, up to a bound."""
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        model = shared.value
        for b in (whole.slice(a, 256) for whole in batches for a in range(0, whole.num_rows, 256)):
            texts = [letter_runs(t.lower()) if t else [] for t in b.column(column).to_pylist()]
            if _HELD.get("key") != model.key or len(_HELD["index"]) > HELD_WORDS:
                _HELD.update(key=model.key, index={}, ratios=np.zeros(0))
            index = _HELD["index"]
            known = len(index)
            for ws in texts:
                for w in ws:
                    if w not in index:
                        index[w] = len(index)
            if len(index) > known:
                _HELD["ratios"] = np.concatenate([_HELD["ratios"], model.ratios(list(islice(index, known, None)))])
            ratios, get = _HELD["ratios"], index.__getitem__
            got = [measures(ratios[np.fromiter(map(get, ws), np.int64, len(ws))]) if ws else None for ws in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.float64()))], names=[*b.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{name}` array<double>")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the constant last) of a logistic curve, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, bits: int = CELL_BITS) -> tuple[Model, list[float]] | None:
    """Counts over all training documents with a label but every fifth, and the curve's weights on ``fit_docs`` of those. None if
    not both labels occur."""
    rows = _labelled(docs.where(training()), labels.where(training()))
    words = written(count_words(rows.where(~_fold())), "toxic-words")
    if not all(words.agg(F.sum("tox"), F.sum("ord")).first()):
        return None
    model = fit_counts(words, bits)
    n = labels.where(training() & _fold()).count()
    drawn = training() & _fold() & (F.xxhash64(_id(), F.lit(11)).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53)) < min(1.0, fit_docs / max(n, 1)))
    got = measured(_labelled(docs.where(drawn), labels.where(drawn)), model).where("measures is not null").select("measures", "y").toArrow()
    x, y = np.array(got.column(0).to_pylist()), (got.column(1).to_numpy() == 1).astype(float)
    if not 0 < y.sum() < len(y):
        return model, FEW
    return model, logistic(x, y).tolist()


def score(docs: DataFrame, fitted: tuple[Model, list[float]] | None, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on).

    Only the text counts; it is read whole, at any length. Texts that are null, empty or without a letter score 0.0, and so does
    all if there was nothing to learn from. Columns named score and predicted are replaced, others stay. Repeated rows get equal
    values; an empty table gives an empty one.
    """
    docs = docs.drop("score", "predicted")
    if fitted is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    name = free_name(docs, "measures")
    *weights, constant = fitted[1]
    z = reduce(lambda a, k: a + F.lit(weights[k]) * F.col(name)[k], range(len(weights)), F.lit(constant))
    got = measured(docs, fitted[0], name).withColumn("score", F.coalesce(1 / (1 + F.exp(-z)), F.lit(0.0)))
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(name)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, by labels of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    fitted = fit(docs, table(spark, sf_dir, "labels"))
    got = score(docs.select("doc_id", (~training()).alias("held_out"), "text"), fitted)
    return got.select("doc_id", "held_out", "score", "predicted")
