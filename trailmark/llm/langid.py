"""Language identification: segmentation-marginalised unigram models over a fixed public vocabulary.

A language's model gives each piece a probability. A word's probability is the sum over all its segmentations into
pieces, by the forward algorithm; a text's is the product over its words. Models are fitted by expectation-maximisation
(forward-backward counts) on a bounded sample of labelled documents.
"""

from __future__ import annotations

import uuid
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import cut, letter_runs, table

UNKNOWN = "und"
#: Labelled documents per language that models are fitted on (expected number, drawn by a hash of doc_id).
TRAIN_DOCS = 1500
ROUNDS = 2
#: Letter runs beyond this length are read in parts of it.
LONGEST = 32
#: Scores that a Python worker keeps at most between batches (8 bytes each): 300,000 words of eight languages, fewer of more.
HELD_SCORES = 2_400_000
#: Labels that are learned: those with the most documents (ties: in alphabetical order). It bounds the model's size.
MOST_LABELS = 200
SMOOTH, FLOOR = 0.1, 1e-9
START = "▁"


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters (Unicode category L), those beyond LONGEST in parts of it."""
    words = letter_runs(text.lower()) if text else []
    if words and max(map(len, words)) > LONGEST:
        return [w[a : a + LONGEST] for w in words for a in range(0, len(w), LONGEST)]
    return words


def vocabulary(path: str) -> dict[str, int]:
    """Prefixes of the pieces that can occur in a word -> index of the piece, or -1. Single characters missing from
    the vocabulary have no entry; they are read at a floor probability."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = sorted({p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if (b := p.removeprefix(START)) == b.lower() and (not b or b.isalpha())})
    out: dict[str, int] = {}
    for p in pieces:
        for j in range(1, len(p)):
            out.setdefault(p[:j], -1)
    return out | {p: i for i, p in enumerate(pieces)}


class Lattice:
    """All segmentations of a batch of words: edges (word, from, to, piece), grouped by their start."""

    def __init__(self, words: list[str], match: dict[str, int], pieces: int):
        self.n, self.length = len(words), np.array([len(w) + 1 for w in words], np.int64)
        steps: list[list[list[int]]] = [[[], [], []] for _ in range(int(self.length.max(initial=0)))]
        get = match.get
        for k, w in enumerate(words):
            w = START + w
            for i in range(len(w)):
                ks, js, ps = steps[i]
                single = False
                for j in range(i + 1, len(w) + 1):
                    p = get(w[i:j])
                    if p is None:
                        break
                    if p >= 0:
                        single |= j == i + 1
                        ks.append(k)
                        js.append(j)
                        ps.append(p)
                if not single:
                    ks.append(k)
                    js.append(i + 1)
                    ps.append(pieces)
        self.steps = [tuple(np.array(x, np.int64) for x in s) for s in steps]

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha[word, position, language]; prob has a row per piece and the floor last."""
        alpha = np.zeros((self.n, len(self.steps) + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for i, (k, j, p) in enumerate(self.steps):
            alpha[k, j] += alpha[k, i] * prob[p]
        return alpha

    def scores(self, prob: np.ndarray) -> np.ndarray:
        """log probability of each word in each language."""
        return np.log(np.maximum(self.forward(prob)[np.arange(self.n), self.length], 1e-300))

    def counts(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece per language, the words weighted by ``weight`` (word x language)."""
        alpha = self.forward(prob)
        beta = np.zeros_like(alpha)
        rows = np.arange(self.n)
        beta[rows, self.length] = 1
        for i in range(len(self.steps) - 1, -1, -1):
            k, j, p = self.steps[i]
            np.add.at(beta, (k, np.full_like(k, i)), beta[k, j] * prob[p])
        scale = weight / np.maximum(alpha[rows, self.length], 1e-300)
        out = np.zeros_like(prob)
        for i, (k, j, p) in enumerate(self.steps):
            np.add.at(out, p, alpha[k, i] * prob[p] * beta[k, j] * scale[k])
        return out


class Model:
    """langs, the vocabulary's prefixes, and a probability per piece and language (bounded by vocabulary and labels)."""

    def __init__(self, langs: list[str], match: dict[str, int], prob: np.ndarray):
        self.langs, self.match, self.prob, self.key = langs, match, prob, uuid.uuid4().hex
        self.block = max(64, 16384 // len(langs))  # words of a lattice
        self.held = max(4096, HELD_SCORES // len(langs))  # words whose scores are kept


def with_floor(counts: np.ndarray) -> np.ndarray:
    p = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=0)
    return np.vstack([p, np.full((1, counts.shape[1]), FLOOR)])


def held_out():
    """Whether crc32 of the doc_id as text is divisible by 5 (null ids: as an empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, path: str, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model | None:
    """Models of the labels (MOST_LABELS at most) that occur in documents which are not held out; None if there are none. A label
    is learned from about ``train_docs`` of its documents, drawn by a hash of doc_id; a null text or label does not count."""
    spark = docs.sparkSession
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LABELS).collect()}
    if not sizes:
        return None
    langs, match = sorted(sizes), vocabulary(path)
    pieces, at = 1 + max(match.values()), {lang: k for k, lang in enumerate(langs)}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, train_docs / n))])
    draw = (F.xxhash64("doc_id", F.lit(9)).bitwiseAND((1 << 53) - 1)) / F.lit(float(1 << 53))
    sample = labelled.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count_words(batches):
        for b in batches:
            seen: dict[tuple[int, str], int] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = at[lang]
                for w in letter_words(text):
                    seen[k, w] = seen.get((k, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int32()), pa.array([w for _, w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["k", "word", "n"])

    words = cut(sample.mapInArrow(count_words, "k int, word string, n long").groupBy("k", "word").agg(F.sum("n").alias("n")))
    prob = np.full((pieces, len(langs)), 1 / pieces)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((match, np.vstack([prob, np.full((1, len(langs)), FLOOR)])))

        def expect(batches):
            match, prob = shared.value
            total = np.zeros_like(prob)
            for b in batches:
                k, n = b.column(0).to_numpy(), b.column(2).to_numpy()
                weight = np.zeros((len(k), len(langs)))
                weight[np.arange(len(k)), k] = n
                for a in range(0, len(k), 4096):
                    total += Lattice(b.column(1).slice(a, 4096).to_pylist(), match, len(prob) - 1).counts(prob, weight[a : a + 4096])
            p, k = np.nonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(k), pa.array(total[p, k])], names=["piece", "k", "n"])

        got = words.mapInArrow(expect, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((pieces, len(langs)))
        counts[got.column("piece").to_numpy(), got.column("k").to_numpy()] = got.column("n").to_numpy()
        prob = with_floor(counts)[:-1]
    return Model(langs, match, np.vstack([prob, np.full((1, len(langs)), FLOOR)]))


_HELD: dict = {}


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score (the posterior of that language, uniform prior).

    Only the text counts. ``und`` and 0.0 for null texts and texts without a letter (or if no language was learned);
    ties go to the first language in alphabetical order. Letters are those of Unicode's category L; runs of more than LONGEST
    letters are read in parts of it. Columns named lang_pred and score are replaced, others stay as they are. Repeated rows
    get equal values; an empty table gives an empty one. Whole texts of any length are read; scores of words are kept per
    Python worker, up to a bound.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for b in (whole.slice(a, 256) for whole in batches for a in range(0, whole.num_rows, 256)):
            texts = [letter_words(t) for t in b.column(column).to_pylist()]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if model is not None:
                if _HELD.get("key") != model.key or len(_HELD["index"]) > model.held:
                    _HELD.update(key=model.key, index={}, rows=np.zeros((0, len(model.langs)), np.float64))
                index = _HELD["index"]
                known = len(index)
                for ws in texts:
                    for w in ws:
                        if w not in index:
                            index[w] = len(index)
                if len(index) > len(_HELD["rows"]):  # room for twice as many, so that each score is copied a few times at most
                    _HELD["rows"] = np.concatenate([_HELD["rows"][:known], np.empty((max(len(index), min(2 * known, model.held)) - known, len(model.langs)))])
                rows, fresh = _HELD["rows"], islice(index, known, None)
                for a in range(known, len(index), model.block):
                    some = list(islice(fresh, model.block))
                    rows[a : a + len(some)] = Lattice(some, model.match, len(model.prob) - 1).scores(model.prob)
                get = index.__getitem__
                for k, ws in enumerate(texts):
                    if ws:
                        total = rows[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0)
                        best = int(total.argmax())
                        lang[k], score[k] = model.langs[best], float(1 / np.exp(total - total[best]).sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, by models learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, default_vocabulary())
    got = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return got.select("doc_id", "held_out", "lang_pred", "score")
