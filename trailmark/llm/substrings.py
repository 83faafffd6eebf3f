"""Exact substring dedup over word windows, behind a count-min prefilter.

Three passes over chunks of documents, which one shuffle deals out:

1. Each chunk sketches its windows: one row of a count-min sketch with some 64 cells per window of the corpus, which is
   therefore nearly empty and kept as the sorted list of the cells in use (a cell in use twice or more is listed twice).
   The sketches are merged by range of cells, and each chunk gets back a bit per listed cell: whether the merged count,
   which can only overestimate, is 2 or more.
2. Each chunk sends, for each window estimated repeated, a digest (96 bits) and its earliest place. These are grouped
   exactly; each chunk gets back a bit per digest: whether its place is the earliest of all.
3. Each chunk removes the words covered by windows that are estimated repeated and not the earliest.

What travels is about 2 bytes per window, and about 18 per window estimated repeated and chunk; nothing is broadcast or
collected. A window that a third of all documents share is one entry per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import free_name, spread, table

WINDOW = 20
CHUNK_BYTES = 6 << 20
RANGE_WINDOWS = 4 << 20
CELLS_PER_WINDOW = 64
LOW, B1, B2 = np.uint64(0xFFFF), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """word -> its 64-bit hash, computed once per chunk."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Chunk:
    """The documents of a chunk in order of (doc_id, text) with the windows of their words, in that order too."""

    def __init__(self, docs: pa.Table, plan: Plan):
        self.plan = plan
        ids, text = docs.column("doc_id"), docs.column("text")
        self.order = pa.compute.sort_indices(pa.table({"i": ids, "t": text}), sort_keys=[("i", "ascending"), ("t", "ascending")], null_placement="at_start")
        ids, text = ids.take(self.order), text.take(self.order).cast(pa.large_binary())
        self.ids = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
        hashes, parts, self.words, counts = _Hashes(), [], [], []
        for t in text.to_pylist():
            w = t.split() if t else []
            self.words.append(w)
            counts.append(len(w))
        self.counts = np.array(counts, np.int64)
        parts = np.fromiter((hashes[w] for ws in self.words for w in ws), np.uint64, int(self.counts.sum()))
        self.first = np.cumsum(self.counts) - self.counts
        k, n = plan.window, len(parts)
        per = np.maximum(self.counts - k + 1, 0)
        self.doc = np.repeat(np.arange(len(per)), per)
        self.start = np.arange(len(self.doc)) - np.repeat(np.cumsum(per) - per, per)
        at = self.first[self.doc] + self.start
        m = max(n - k + 1, 0)
        h1, h2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        for j in range(k):
            part = parts[j : j + m]
            h1 *= B1
            h1 += part
            h2 *= B2
            h2 += part
        self.h1, self.h2 = _mix(h1[at]), (_mix(h2[at]) >> np.uint64(32)).astype(np.uint32)
        self.cells, self.cell_of, copies = np.unique(self.h1 >> np.uint64(64 - plan.bits), return_inverse=True, return_counts=True)
        self.copies = np.minimum(copies, 2)

    def sketch(self) -> list[tuple[int, bytes]]:
        listed = np.repeat(self.cells, self.copies)
        return [(r, self.plan.encode(x)) for r, x in self.plan.by_range(listed, listed)]

    def estimated(self, bits: dict[int, bytes]) -> np.ndarray:
        """Indexes of the windows whose cell has a merged count of 2 or more."""
        flags = [np.unpackbits(np.frombuffer(bits[r], np.uint8), count=len(x)) for r, x in self.plan.by_range(np.repeat(self.cells, self.copies), self.cells.repeat(self.copies))]
        flags = np.concatenate(flags) if flags else np.zeros(0, np.uint8)
        return np.flatnonzero(flags[np.cumsum(self.copies) - 1][self.cell_of]) if len(flags) else np.zeros(0, np.int64)

    def earliest(self, windows: np.ndarray) -> np.ndarray:
        """Of these windows, the first of each digest, in order of digest."""
        by = windows[np.lexsort((windows, self.h2[windows], self.h1[windows]))]
        new = np.ones(len(by), bool)
        new[1:] = (self.h1[by[1:]] != self.h1[by[:-1]]) | (self.h2[by[1:]] != self.h2[by[:-1]])
        return by[new]

    def places(self, windows: np.ndarray) -> list[tuple[int, bytes]]:
        out = []
        for r, x in self.plan.by_range(self.h1[windows] >> np.uint64(64 - self.plan.bits), windows):
            ids, start = self.ids[self.doc[x]], self.start[x]
            kinds = (b"I" if len(ids) and 0 <= ids.min() and ids.max() < 1 << 32 else b"l") + (b"H" if start.max(initial=0) < 1 << 16 else b"I")
            out.append((r, kinds + np.uint32(len(x)).tobytes() + self.h1[x].tobytes() + self.h2[x].tobytes() + ids.astype(kinds[:1].decode()).tobytes() + start.astype(kinds[1:].decode()).tobytes()))
        return out

    def covered(self, removed: np.ndarray) -> np.ndarray:
        """For each word of the chunk: whether a removed window covers it."""
        edge = np.zeros(int(self.counts.sum()) + 1, np.int64)
        at = self.first[self.doc[removed]] + self.start[removed]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.plan.window, -1)
        return np.cumsum(edge)[:-1] > 0


class Plan:
    """Sizes that follow from the corpus: window length, bits of a cell, bits of a range of cells."""

    def __init__(self, window: int, windows: int):
        self.window = window
        self.bits = min(48, max(24, (windows * CELLS_PER_WINDOW).bit_length()))
        self.range_bits = min(self.bits - 16, spread(windows, RANGE_WINDOWS).bit_length())
        self.rest = self.bits - self.range_bits

    def by_range(self, cells: np.ndarray, values: np.ndarray):
        """(range, its values) for cells in ascending order; ranges without any are left out."""
        r = (cells >> np.uint64(self.rest)).astype(np.int64)
        cut = np.flatnonzero(np.diff(r)) + 1
        return [(int(r[a]), values[a:b]) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(r)], strict=True)] if len(r) else []

    def encode(self, cells: np.ndarray) -> bytes:
        """Sorted cells of one range: 16 bits each behind a count per page of 65,536 cells, or whole where those are few."""
        inside = cells & np.uint64((1 << self.rest) - 1)
        pages = 1 << (self.rest - 16)
        if len(cells) < 2 * pages:
            return b"W" + inside.astype(np.uint64 if self.rest > 32 else np.uint32).tobytes()
        per = np.bincount((inside >> np.uint64(16)).astype(np.int64), minlength=pages)
        return b"P" + per.astype(np.uint32).tobytes() + (inside & LOW).astype(np.uint16).tobytes()

    def decode(self, data: bytes) -> np.ndarray:
        if data[:1] == b"W":
            return np.frombuffer(data, np.uint64 if self.rest > 32 else np.uint32, offset=1).astype(np.uint64)
        pages = 1 << (self.rest - 16)
        per = np.frombuffer(data, np.uint32, pages, 1)
        return (np.repeat(np.arange(pages, dtype=np.uint64), per) << np.uint64(16)) | np.frombuffer(data, np.uint16, offset=1 + 4 * pages).astype(np.uint64)


NOTE = "chunk int, kind int, part int, data binary"


def _notes(chunk, kind: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    n = len(rows)
    return pa.table({"chunk": pa.array(chunk if isinstance(chunk, list) else [chunk] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "part": pa.array([r for r, _ in rows], pa.int32()), "data": pa.array([x for _, x in rows], pa.binary())})


def _merge_sketches(plan: Plan):
    def run(rows: pa.Table) -> pa.Table:
        lists = [plan.decode(x) for x in rows.column("data").to_pylist()]
        _, which, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        flags = np.split(counts[which] >= 2, np.cumsum([len(x) for x in lists])[:-1])
        part = rows.column("part")[0].as_py()
        return _notes(rows.column("chunk").to_pylist(), 1, [(part, np.packbits(f).tobytes()) for f in flags])

    return run


def _group_places(rows: pa.Table) -> pa.Table:
    cols, sizes = ([], [], [], []), []
    for data in rows.column("data").to_pylist():
        n, at = int(np.frombuffer(data, np.uint32, 1, 2)[0]), 6
        for col, kind in zip(cols, (np.uint64, np.uint32, np.dtype(chr(data[0])), np.dtype(chr(data[1]))), strict=True):
            col.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        sizes.append(n)
    chunks = np.repeat(rows.column("chunk").to_numpy(), sizes)
    h1, h2, ids, start = (np.concatenate(c) for c in cols)
    by = np.lexsort((chunks, start, ids.astype(np.int64), h2, h1))
    first = np.ones(len(by), bool)
    first[1:] = (h1[by[1:]] != h1[by[:-1]]) | (h2[by[1:]] != h2[by[:-1]])
    won = np.zeros(len(by), bool)
    won[by] = first
    part = rows.column("part")[0].as_py()
    return _notes(rows.column("chunk").to_pylist(), 2, [(part, np.packbits(f).tobytes()) for f in np.split(won, np.cumsum(sizes)[:-1])])


def _bits(notes: pa.Table, kind: int) -> dict[int, bytes]:
    return {r["part"]: r["data"] for r in notes.to_pylist() if r["kind"] == kind}


def substring_dedup(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_removed and kept (the words left, joined by one space).

    Words are runs of characters other than space and the controls 9 to 13, unchanged. A word goes if a window of
    ``window`` words that covers it starts earlier elsewhere: in a document of smaller doc_id, or earlier in the same
    one; all windows are judged on the input. Null texts have no words (kept: empty). Null doc_ids come first. Rows that
    repeat a doc_id count in the order of start, then of chunk; rows equal in doc_id and text share a chunk and count in
    the order read. Extra columns are kept as they are, whatever their names (but n_words, n_removed, kept, which are replaced).
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan(window, max(1, total // 6))
    chunks = spread(total, chunk_bytes)
    chunk = free_name(docs, "chunk")
    dealt = docs.withColumn(chunk, F.expr(f"cast(pmod(xxhash64(doc_id, text), {chunks}) as int)"))
    key = dealt.groupBy(chunk)

    def sketch(rows: pa.Table) -> pa.Table:
        return _notes(rows.column(chunk)[0].as_py(), 0, Chunk(rows, plan).sketch())

    def places(rows: pa.Table, notes: pa.Table) -> pa.Table:
        c = Chunk(rows, plan)
        return _notes(rows.column(chunk)[0].as_py(), 0, c.places(c.earliest(c.estimated(_bits(notes, 1)))))

    def remove(rows: pa.Table, notes: pa.Table) -> pa.Table:
        c = Chunk(rows, plan)
        out = c.estimated(_bits(notes, 1))
        first, won = c.earliest(out), _bits(notes, 2)
        flags = [np.unpackbits(np.frombuffer(won[r], np.uint8), count=len(x)).astype(bool) for r, x in plan.by_range(c.h1[first] >> np.uint64(64 - plan.bits), first)]
        keep = np.zeros(len(c.h1), bool)
        if flags:
            keep[first[np.concatenate(flags)]] = True
        gone = c.covered(out[~keep[out]])
        n_removed = np.add.reduceat(np.append(gone, False), c.first, dtype=np.int64) if len(c.first) else np.zeros(0, np.int64)
        n_removed[c.counts == 0] = 0
        kept = []
        for words, a, n, r in zip(c.words, c.first.tolist(), c.counts.tolist(), n_removed.tolist(), strict=True):
            kept.append(b" ".join(words if not r else [w for w, g in zip(words, gone[a : a + n].tolist(), strict=True) if not g]))
        table_ = rows.take(c.order).drop_columns([chunk])
        return table_.append_column("n_words", pa.array(c.counts)).append_column("n_removed", pa.array(n_removed)).append_column("kept", pa.array(kept, pa.binary()).cast(pa.string()))

    np.seterr(over="ignore")
    sketched = key.applyInArrow(sketch, NOTE)
    repeated = sketched.groupBy("part").applyInArrow(_merge_sketches(plan), NOTE)
    sent = key.cogroup(repeated.groupBy("chunk")).applyInArrow(places, NOTE)
    earliest = sent.groupBy("part").applyInArrow(_group_places, NOTE)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return key.cogroup(repeated.unionAll(earliest).groupBy("chunk")).applyInArrow(remove, f"{fields}, n_words long, n_removed long, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words over every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM s),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1)),
q AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
m AS (SELECT d.doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN q USING (doc_id)),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM u ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT m.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM m LEFT JOIN k USING (doc_id)
"""
