"""Token-id files under Re-Pair grammar compression, with random access by expansion lengths.

A shard's ids are rewritten in rounds: each counts all pairs, gives the most frequent ones (of three uses or more, which pays
for a rule) a nonterminal each and replaces them from left to right, until a round shortens the sequence by less than 4 %.
On the check documents that leaves 0.521 stored integers an id; going on to the last pair would leave 0.513, in twice the time. No rule crosses the end of a document, so
each document is a slice of its shard's sequence and is decoded from that slice alone.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from itertools import count, islice, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.llm.common import spread, table, written

SHARD_IDS = 1 << 20
PARTITION_BYTES = 16 << 20
#: Pairs that a round replaces at most, uses that make a pair worth a rule, and the share of the sequence a round must save.
PAIRS_PER_ROUND, LEAST_COUNT, LEAST_GAIN = 12_000, 3, 0.04
#: Cells of a round's table of pairs (64 MB); a round of too many different symbols takes fewer pairs, and the next one more.
GRID_CELLS = 1 << 25
END_ID = 2
HELD_PARTS = 900_000
#: The byte-level symbol of a space.
SPACE = "Ġ"
#: A word of Latin letters (all below U+0250) and the points behind it.
WORD = r"^(?P<head>[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)(?P<tail>[.,;:!?]*)$"
LATIN = WORD.partition("(?P<tail>")[0] + "$"
#: The byte-level symbol of each byte but a line feed, which parts words.
SYMBOLS = {b: chr(b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else 256 + (b if b < 33 else b - 94 if b < 161 else 323 - 256)) for b in range(256) if b != 10}
#: Bytes of text that are encoded at a time.
AT_ONCE = 4 << 20


def compress(ids: np.ndarray, end_id: int = END_ID, least_gain: float = LEAST_GAIN) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, rules, base): symbol base + k stands for the pair rules[k]; symbols below base are ids."""
    seq = ids.astype(np.int32)
    base = int(ids.max(initial=0)) + 1
    rules: list[np.ndarray] = []
    closes = np.zeros(base, bool)  # symbols whose expansion ends a document: never the left of a pair
    if end_id < base:
        closes[end_id] = True
    while len(seq) > 1:
        used = np.bincount(seq, minlength=len(closes)) > 0
        rank = (np.cumsum(used) - 1).astype(np.uint32 if used.sum() < 65536 else np.uint64)
        d = rank.dtype.type(used.sum())
        codes = rank[seq[:-1]] * d + rank[seq[1:]]
        ok = ~closes[seq[:-1]]
        order = np.sort(codes[ok])
        cut = np.flatnonzero(np.append(True, order[1:] != order[:-1])) if len(order) else np.zeros(0, np.int64)
        counts = np.diff(np.append(cut, len(order)))
        often = np.flatnonzero(counts >= LEAST_COUNT)
        if not len(often):
            break
        often = often[np.argsort(-counts[often], kind="stable")][:PAIRS_PER_ROUND]
        while True:
            pairs = order[cut[np.sort(often)]]
            left, right = (pairs // d).astype(np.int64), (pairs % d).astype(np.int64)
            if len(often) == 1 or len(np.unique(left)) * len(np.unique(right)) <= GRID_CELLS:
                break
            often = often[: len(often) // 2]
        row, col = np.zeros(int(d), np.int32), np.zeros(int(d), np.int32)
        row[left] = 1
        col[right] = 1
        row, col = np.cumsum(row, dtype=np.int32) * row, np.cumsum(col, dtype=np.int32) * col  # 0: on no such side
        grid = np.zeros((row.max() + 1, col.max() + 1), np.int16)
        grid[row[left], col[right]] = np.arange(1, len(pairs) + 1)
        ranks = rank[seq].astype(np.int64)
        where = grid[row[ranks[:-1]], col[ranks[1:]]]
        hit = np.flatnonzero((where > 0) & ok)
        run = np.append(True, np.diff(hit) > 1)  # overlapping hits: every other one, from the left
        first = hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
        hit = hit[(hit - first) % 2 == 0]
        if len(hit) < least_gain * len(seq):
            break
        symbols = np.flatnonzero(used)
        left, right = symbols[left], symbols[right]
        first_symbol = base + sum(map(len, rules))
        rules.append(np.stack([left, right], axis=1).astype(np.int32))
        closes = np.append(closes, closes[right])
        seq = seq.copy()
        seq[hit] = first_symbol + where[hit].astype(np.int32) - 1
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int32), base


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each nonterminal expands to."""
    out = np.ones(len(rules), np.int64)
    at = 0
    while at < len(rules):  # a round's rules refer to earlier rounds only
        end = at + int(np.argmax(np.append(rules[at:].max(axis=1) >= base + at, True)))
        part = rules[at:end].astype(np.int64)
        out[at:end] = sum(np.where(part[:, s] < base, 1, out[np.maximum(part[:, s] - base, 0)]) for s in (0, 1))
        at = end
    return out


def _unfold(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    seq = seq.astype(np.int64)
    while len(rules) and (seq >= base).any():
        deep = seq >= base
        size = 1 + deep
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        out[at] = np.where(deep, rules[np.maximum(seq - base, 0), 0], seq)
        out[at[deep] + 1] = rules[seq[deep] - base, 1]
        seq = out
    return seq


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that a (slice of a) sequence stands for. A long sequence has each rule unfolded once and then copied."""
    if len(seq) < 4 * len(rules):
        return _unfold(seq, rules, base)
    spans = lengths_of(rules, base)
    ids = np.concatenate([np.arange(base), _unfold(base + np.arange(len(rules)), rules, base)]).astype(np.int32)
    size = np.concatenate([np.ones(base, np.int64), spans])
    return _gather(ids, np.cumsum(size) - size, size, seq).astype(np.int64)


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size] of the given slots, one after another."""
    n = size[slots]
    end = np.cumsum(n, dtype=np.int64)
    return flat[np.repeat(start[slots] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]


def _strings(column: pa.Array) -> list[str]:
    """to_pylist() for strings without nulls, some five times faster."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """ids of whole texts by the tokenizers library; parts between single spaces are encoded once and kept.

    Byte-level pre-tokenization never joins what stands on both sides of a space, unless white space surrounds that
    space; texts with such a place, or with a special token of the file, go through the library whole, and so do all texts
    if the file's rules are not those. A part's ids are those of at most two slots: its letters, and the points behind them.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(spec)
        # the same model for words in byte-level symbols, which need no pattern to part them
        self.by_words = Tokenizer(self.library.model)
        self.by_words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        said = json.loads(spec)
        rules, vocab = said.get("pre_tokenizer") or {}, said["model"].get("vocab", {})
        self.by_parts = rules.get("type") == "ByteLevel" and rules.get("use_regex", True) and not rules.get("add_prefix_space") and said.get("normalizer") is None and not said["model"].get("dropout")
        self.special = [x["content"] for x in said.get("added_tokens", ())]
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that begin with a space
        self.begins[[i for s, i in vocab.items() if s.startswith(SPACE)]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.head, self.tail = np.zeros(0, np.int32), np.zeros(0, np.int32)  # slots of each part
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(1, np.int32)  # slot 0 has no ids
        self.slots: dict[str, int] = {"": 0}  # of words with the space before them
        self.points: dict[str, int] = {"": 0}  # of the points behind words, which may look like a word that stands alone
        self.opens, self.closes = np.zeros(0, bool), np.zeros(0, bool)  # parts that begin or end with white space

    def learn(self, parts: list[str]) -> None:
        """Encode new parts. Those without white space at their ends are encoded many at a time, in texts where each begins with
        a space: the only ids that begin with one are then their first."""
        slots, points, each = self.slots, self.points, pa.array(parts, pa.string())
        cut = pc.extract_regex(each, WORD)  # null for a part that is no word of Latin letters with points behind
        plain = pc.is_null(cut).to_numpy(zero_copy_only=False)
        heads, tails = (pc.if_else(pc.is_valid(cut), pc.struct_field(cut, k), x) for k, x in ((0, each), (1, "")))
        begins = lambda column, x: pc.starts_with(column, x).to_numpy(zero_copy_only=False)
        first = begins(each, " ")  # a text's first part, marked by a space
        opens, closes = np.zeros(len(parts), bool), np.zeros(len(parts), bool)
        for k in np.flatnonzero(plain | first).tolist():
            p = parts[k]
            if first[k]:
                closes[k] = p[-1:].isspace() and len(p) > 1
            else:
                opens[k], closes[k] = p == "" or p[0].isspace(), p == "" or p[-1].isspace()
        alone = opens | closes | first | begins(each, "\0")
        kept = pc.if_else(pa.array(alone), pc.binary_join_element_wise("\0", each, ""), heads)  # the mark tells them from words
        parted = [c.dictionary_encode() for c in (kept, pc.if_else(pa.array(alone), "", tails))]
        names = parted[0].dictionary
        strings = _strings(names)
        slot = np.fromiter(map(slots.get, strings, repeat(-1)), np.int32, len(strings))
        new = np.flatnonzero(slot < 0)
        some = names.take(pa.array(new))
        # words of Latin letters are each one match of the library's pattern, with the space before them
        letters, ascii_ = (f.to_numpy(zero_copy_only=False) for f in (pc.match_substring_regex(some, LATIN), pc.string_is_ascii(some)))
        kind = np.where(begins(some, "\0"), 0, np.where(letters, np.where(ascii_, 1, 2), 3))
        new = new[np.argsort(kind, kind="stable")]
        rest, *kinds = ([strings[k] for k in part.tolist()] for part in np.split(new, np.cumsum(np.bincount(kind, minlength=4))[:3]))
        tails = [t for t in _strings(parted[1].dictionary) if t not in points]
        # points are encoded as they stand, a first part without its mark, another part with the space before it
        plain_texts = tails + [w[2:] if w[:2] == "\0 " else " " + w[1:] for w in rest]
        got = [e.ids for e in self.library.encode_batch_fast(plain_texts, add_special_tokens=False)]
        flat, size = [np.fromiter((i for x in got for i in x), np.int32)], [np.fromiter(map(len, got), np.int32, len(got))]
        groups = [[k[a : a + 256] for a in range(0, len(k), 256)] for k in kinds]
        symbols = [SPACE + ("\n" + SPACE).join(g) for g in groups[0]] + [(" " + "\n ".join(g)).encode().decode("latin-1").translate(SYMBOLS) for g in groups[1]]
        got_groups = self.by_words.encode_batch_fast(symbols, add_special_tokens=False) + self.library.encode_batch_fast([" " + " ".join(g) for g in groups[2]], add_special_tokens=False)
        for g, e in zip(groups[0] + groups[1] + groups[2], got_groups, strict=True):
            ids = np.array(e.ids, np.int32)
            begin = np.flatnonzero(self.begins[ids])
            if len(begin) != len(g):  # this vocabulary joins what a space parts: one by one
                each_ids = [x.ids for x in self.library.encode_batch_fast([" " + w for w in g], add_special_tokens=False)]
                flat.append(np.fromiter((i for x in each_ids for i in x), np.int32))
                size.append(np.fromiter(map(len, each_ids), np.int32, len(each_ids)))
                continue
            flat.append(ids)
            size.append(np.diff(np.append(begin, len(ids))).astype(np.int32))
        n = len(self.size)
        points.update(zip(tails, range(n, n + len(tails)), strict=True))
        slots.update(zip(sum(kinds, rest), range(n + len(tails), n + len(tails) + len(new)), strict=True))
        slot[new] = np.arange(n + len(tails), n + len(tails) + len(new))
        self.flat, self.size = np.concatenate([self.flat, *flat]), np.concatenate([self.size, *size])
        point = np.fromiter(map(points.__getitem__, _strings(parted[1].dictionary)), np.int32, len(parted[1].dictionary))
        head, tail = slot[parted[0].indices.to_numpy()], point[parted[1].indices.to_numpy()]
        self.head, self.tail = np.concatenate([self.head, head]), np.concatenate([self.tail, tail])
        self.opens, self.closes = np.concatenate([self.opens, opens]), np.concatenate([self.closes, closes])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (no nulls)."""
        texts = texts.cast(pa.string())
        if not len(texts):
            return []
        whole = np.full(len(texts), not self.by_parts)
        for x in self.special:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if len(self.index) > HELD_PARTS:
            self.clear()
        known, number = len(self.index), self.index.__getitem__
        lists = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        start, values = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), lists.flatten()
        coded = values.dictionary_encode()
        part = np.fromiter(map(number, _strings(coded.dictionary)), np.int64, len(coded.dictionary))[coded.indices.to_numpy()]
        # the space marks each first part, which has none before it
        part[start] = np.fromiter((number(" " + p) for p in _strings(values.take(pa.array(start)))), np.int64, len(start))
        if len(self.index) > known:
            self.learn(list(islice(self.index, known, None)))
        odd = np.zeros(len(part), bool)
        odd[:-1] = self.closes[part[:-1]] & self.opens[part[1:]]
        odd[np.append(start[1:], len(part)) - 1] = False  # a text's last part meets no other
        whole |= np.logical_or.reduceat(odd, start)
        slots = np.stack([self.head[part], self.tail[part]], axis=1).ravel()
        sizes = np.add.reduceat(self.size[slots].astype(np.int64), 2 * start)
        ids = _gather(self.flat, np.cumsum(self.size, dtype=np.int64) - self.size, self.size, slots)
        ends = np.cumsum(sizes)
        out = [ids[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.array(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids, np.int32)
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode(pa.array(texts, pa.string()))


_HELD: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(spec)
    return _HELD[key]


def by_bytes(batch: pa.RecordBatch, most: int):
    """Slices of a batch (doc_id, text) of about ``most`` bytes of text each, one row at least."""
    ends, a = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


FILE = "part int, seq int, doc_ids array<bigint>, doc_starts binary, n_ids long, base int, rules binary, lengths binary, sequence binary"


def token_files(docs: DataFrame, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, text: str = "text") -> DataFrame:
    """Shards of the corpus' token ids in ascending order of doc_id (nulls first; ties by text): rows that make up the
    files. A shard is cut at a document once it has ``shard_ids`` ids: part and seq give its place, doc_starts the first
    symbol of each document in its sequence (32-bit), rules and lengths the grammar. Null texts count as empty; each
    document ends with ``end_id``. Repeated rows are documents of their own, one after the other; other columns play no part."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(path).read_text())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    placed = docs.repartitionByRange(spread(total, PARTITION_BYTES), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.binary()), ("n_ids", pa.int64()), ("base", pa.int32()), ("rules", pa.binary()), ("lengths", pa.binary()), ("sequence", pa.binary())])

    def shard(part: int, seq: int, doc_ids: list, sizes: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array(sizes, np.int64)
        sequence, rules, base = compress(np.concatenate(ids), end_id)
        lengths = lengths_of(rules, base)
        spans = np.where(sequence < base, 1, np.append(lengths, 0)[np.maximum(sequence - base, 0)])
        starts = np.searchsorted(np.cumsum(spans) - spans, np.cumsum(sizes) - sizes)
        cols = [part, seq, doc_ids, starts.astype(np.uint32).tobytes(), int(sizes.sum()), base, rules.tobytes(), lengths.astype(np.uint32).tobytes(), sequence.astype(np.uint16 if base + len(rules) < 65536 else np.int32).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches):
        encode, part = _encoder(spec.value), TaskContext.get().partitionId()
        seq, doc_ids, sizes, ids, n, end = 0, [], [], [], 0, np.array([end_id], np.int32)
        for b in batches:
            for some in by_bytes(b, AT_ONCE):
                for doc, got in zip(some.column(0).to_pylist(), encode.encode(some.column(1)), strict=True):
                    doc_ids.append(doc)
                    sizes.append(len(got) + 1)
                    ids += [got, end]
                    n += len(got) + 1
                    if n >= shard_ids:
                        yield shard(part, seq, doc_ids, sizes, ids)
                        seq, doc_ids, sizes, ids, n = seq + 1, [], [], [], 0
        if doc_ids:
            yield shard(part, seq, doc_ids, sizes, ids)

    return placed.mapInArrow(run, FILE)


def _sequence(row: dict) -> tuple[np.ndarray, np.ndarray]:
    rules = np.frombuffer(row["rules"], np.int32).reshape(-1, 2)
    return np.frombuffer(row["sequence"], np.uint16 if row["base"] + len(rules) < 65536 else np.int32), rules


def read_document(row: dict, k: int) -> np.ndarray:
    """The ids of the k-th document of a shard, decoded from its slice of the sequence alone."""
    seq, rules = _sequence(row)
    starts = np.append(np.frombuffer(row["doc_starts"], np.uint32), len(seq)).astype(np.int64)
    return expand(seq[starts[k] : starts[k + 1]], rules, row["base"])


def document_ids(files: DataFrame, end_id: int = END_ID) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the files."""
    before = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("of_parts", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    offsets = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("of_shards")).join(before.select("part", "of_parts"), "part")

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                seq, rules = _sequence(row)
                ids = expand(seq, rules, row["base"]).astype("<u4")
                starts = np.frombuffer(row["doc_starts"], np.uint32).astype(np.int64)
                spans = np.where(seq < row["base"], 1, np.append(np.frombuffer(row["lengths"], np.uint32), 0)[np.maximum(seq.astype(np.int64) - row["base"], 0)])
                first = np.append((np.cumsum(spans) - spans)[starts], len(ids))
                n, raw = len(starts), memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(first[:-1]), pa.array(np.diff(first)), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    got = files.mapInArrow(run, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return got.join(offsets, ["part", "seq"]).select("doc_id", (F.col("of_parts") + F.col("of_shards") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op6_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text by the 50k byte-level vocabulary, written as grammar files and read back."""
    import public_tokenizers

    files = token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return document_ids(written(files, "token-files"))
