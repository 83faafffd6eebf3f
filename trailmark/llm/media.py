"""Media columns: ISO base media containers in a binary column, probed by their boxes and sample tables alone."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import byte_column, table

FRAME = 64  # bytes of a frame: 8 x 8 samples of 8 bits
PER_CHUNK, GOP, TIMESCALE, DELTA = 16, 12, 25, 1
#: Boxes whose payload is more boxes.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"})


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


def mux(payload: bytes) -> bytes:
    """A movie of one uncompressed video track: 8 x 8 frames of 8-bit samples, one frame per 64 bytes of payload."""
    n = len(payload) // FRAME
    if n < 1 or n * FRAME != len(payload):
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    chunks = -(-n // PER_CHUNK)
    keys = np.arange(1, n + 1, GOP, dtype=">u4")
    rest = n - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] * (chunks > 1 or rest == PER_CHUNK) + [(chunks, rest, 1)] * (rest != PER_CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 8, 8), struct.pack(">III", 0x480000, 0x480000, 0), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 8, -1))

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * FRAME)
        wide = bool(offsets[-1] >= 1 << 32)
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, DELTA)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8)), box(b"dinf", full(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1"))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n * DELTA, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(13)), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * DELTA), bytes(16), matrix, struct.pack(">II", 8 << 16, 8 << 16))
        mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, n * DELTA), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    wide = len(payload) + 8 >= 1 << 32
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    first = len(head) + len(moov(0)) + len(mdat)
    again = moov(first)
    if len(head) + len(again) + len(mdat) != first:  # wide offsets made the index longer
        again = moov(len(head) + len(again) + len(mdat))
    return head + again + mdat + payload


def walk(data: memoryview):
    """(kind, whether inside a track, payload start, payload end) of every box, nested ones after their container, however
    deep they are nested."""
    at, ends, tracks = 0, [(len(data), False)], 0
    while ends:
        end, track = ends[-1]
        if at >= end:
            ends.pop()
            tracks -= track
            continue
        if end - at < 8:
            raise ValueError("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise ValueError("truncated box header")
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} runs beyond its container")
        yield kind, tracks > 0, at + head, at + size
        if kind in CONTAINERS:
            ends.append((at + size, kind == b"trak"))
            tracks += kind == b"trak"
            at += head
        else:
            at += size


def probe(data: bytes) -> list[dict]:
    """Per track: handler, codec, timescale, duration, and arrays of sample offsets, sizes and sync flags.

    Only boxes are read: media payloads are never decoded. Tables that contradict each other or the file's length raise
    ValueError before anything of a size that they claim is made; samples may not take more bytes than the file has.
    """
    view, tracks = memoryview(data), []
    ints = lambda at, count, kind=">u4": np.frombuffer(view, kind, count, at).astype(np.int64)
    for kind, inside, at, end in walk(view):
        if kind == b"trak":
            tracks.append({"handler": "", "codec": "", "timescale": 0, "duration": 0})
        if not inside:
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", view, at + 20) if view[at] == 1 else struct.unpack_from(">II", view, at + 12)
        elif kind == b"hdlr":
            t["handler"] = bytes(view[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = bytes(view[at + 12 : min(at + 16, end)]).decode("latin-1")
        elif kind in (b"stts", b"stsc", b"stss", b"stco", b"co64"):
            (n,) = struct.unpack_from(">I", view, at + 4)
            wide = {b"stts": 2, b"stsc": 3}.get(kind, 1)
            if at + 8 + n * wide * (8 if kind == b"co64" else 4) > end:
                raise ValueError(f"the table {kind!r} runs beyond its box")
            got = ints(at + 8, n * wide, ">u8" if kind == b"co64" else ">u4")
            t["stco" if kind == b"co64" else kind.decode()] = got.reshape(-1, wide) if wide > 1 else got
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", view, at + 4)
            if size * n > len(view) or (not size and at + 12 + 4 * n > end):
                raise ValueError("the samples have more bytes than the file")
            t["sizes"] = np.full(n, size, np.int64) if size else ints(at + 12, n)
    for t in tracks:
        sizes, chunks, runs = t.get("sizes", np.zeros(0, np.int64)), t.pop("stco", np.zeros(0, np.int64)), t.pop("stsc", np.zeros((0, 3), np.int64))
        length = np.diff(np.append(runs[:, 0], len(chunks) + 1)) if len(runs) else np.zeros(0, np.int64)
        if (length < 0).any() or length.sum() != len(chunks) or (len(runs) and runs[0, 0] != 1) or int((runs[:, 1] * length).sum()) != len(sizes):
            raise ValueError("the sample tables disagree")
        per = np.repeat(runs[:, 1], length)
        ends = np.cumsum(sizes)
        first = np.minimum(np.cumsum(per) - per, max(len(sizes) - 1, 0))  # an empty chunk has no first sample
        base = np.repeat((ends - sizes)[first] if len(sizes) else first, per)
        t["sizes"], t["offsets"] = sizes, np.repeat(chunks, per) + (ends - sizes) - base
        if len(sizes) and (chunks.min() < 0 or chunks.max() > len(view) or (t["offsets"] + sizes).max() > len(view)):
            raise ValueError("a sample lies beyond the file")
        stts = t.pop("stts", np.zeros((0, 2), np.int64))
        t["duration"] = t["duration"] or sum(a * b for a, b in stts.tolist())
        if t["duration"] >= 1 << 63:
            raise ValueError("the duration is out of range")
        sync = t.pop("stss", None)
        t["keys"] = np.arange(len(sizes)) if sync is None else sync - 1
        if len(t["keys"]) and (t["keys"].min() < 0 or t["keys"].max() >= len(sizes)):
            raise ValueError("a sync sample is no sample")
    return tracks


def read_samples(data: bytes, track: dict) -> bytes:
    """The track's samples in order, from the byte ranges of its tables (adjacent ranges are read at once)."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(sizes):
        return b""
    cut = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    starts, ends = offsets[np.append(0, cut)], (offsets + sizes)[np.append(cut - 1, len(sizes) - 1)]
    return b"".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def store_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every whole text (null: empty) as UTF-8, padded with zeros and stored in a container."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for b in batches:
            raw = [x or b"" for x in byte_column(b, "text")]
            media = [mux(x + bytes(max(FRAME, -(-len(x) // FRAME) * FRAME) - len(x))) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


RANGE = "array<struct<offset: long, size: long>>"
PROBED = f"codec string, timescale long, duration long, n_samples long, keyframes {RANGE}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"


def probe_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) with the first track's codec, duration and keyframe byte ranges, and digests of the
    stored form and of the payload read back. Null media give nulls; media that break the format give nulls and an
    ``error``, and no other row suffers. Rows are independent: equal media, equal values."""

    def run(batches):
        kinds = None
        for b in batches:
            rows = []
            for data in byte_column(b, "media"):
                row = dict.fromkeys(("codec", "timescale", "duration", "n_samples", "keyframes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "error"))
                rows.append(row)
                if data is None:
                    continue
                row |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
                try:
                    tracks = probe(data)
                    if not tracks:
                        raise ValueError("no track")
                    t = tracks[0]
                    payload = read_samples(data, t)
                    keys = [{"offset": int(o), "size": int(s)} for o, s in zip(t["offsets"][t["keys"]], t["sizes"][t["keys"]], strict=True)]
                    row |= {"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "n_samples": len(t["sizes"]), "keyframes": keys, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:])}
                except (ValueError, struct.error, IndexError) as e:
                    row["error"] = str(e) or "broken"
            keyframe = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
            kinds = kinds or {"codec": pa.string(), "keyframes": keyframe, "payload_sha256": pa.string(), "media_sha256": pa.string(), "error": pa.string()}
            cols = {k: pa.array([r[k] for r in rows], kinds.get(k, pa.int64())) for k in rows[0]} if rows else {}
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols.values()], names=["doc_id", "n_bytes", *cols])

    return media.mapInArrow(run, f"doc_id long, n_bytes long, {PROBED}")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a media column and probed; ``feature`` sums up what the boxes say."""
    got = probe_media(store_media(table(spark, sf_dir, "documents")))
    first, last = F.element_at("keyframes", 1), F.element_at("keyframes", -1)
    feature = F.format_string(
        "codec=%s;timescale=%d;duration=%d;samples=%d;keyframes=%d;first=%d+%d;last=%d+%d",
        F.trim("codec"), "timescale", "duration", "n_samples", F.size("keyframes"), first["offset"], first["size"], last["offset"], last["size"],
    )
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "codec", "duration", "keyframes")
