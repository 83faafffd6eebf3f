"""Media columns: exact round trips, box parsing, broken input."""

import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmark.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(data):
    payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    (t,) = media.probe(media.mux(payload))
    assert media.read_samples(media.mux(payload), t) == payload
    assert (t["codec"], t["duration"], len(t["sizes"])) == ("raw ", len(payload) // 64, len(payload) // 64)
    assert t["keys"].tolist() == list(range(0, len(payload) // 64, media.GOP))


def test_layouts_and_versions():
    """Scattered chunks, sizes per sample, 64-bit offsets and durations, no sync table."""
    full, box = media.full, media.box
    sizes = [3, 2, 1, 4, 2]
    stbl = box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(8))), full(b"stts", struct.pack(">IIIII", 2, 3, 10, 2, 5)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 3, 1, 2, 2, 1)),
        full(b"stsz", struct.pack(">II", 0, 5), struct.pack(">5I", *sizes)), full(b"co64", struct.pack(">I", 2), struct.pack(">QQ", 15, 8)),
    )
    mdhd = box(b"mdhd", b"\1\0\0\0" + bytes(16) + struct.pack(">IQ", 1000, 0) + bytes(4))
    data = box(b"mdat", b"ddddee!aaabbc") + box(b"moov", box(b"trak", box(b"mdia", mdhd, box(b"minf", stbl))))
    (t,) = media.probe(data)
    assert (t["codec"], t["timescale"], t["duration"], t["keys"].tolist()) == ("avc1", 1000, 40, [0, 1, 2, 3, 4])
    assert t["offsets"].tolist() == [15, 18, 20, 8, 12] and media.read_samples(data, t) == b"aaabbcddddee"


@pytest.mark.parametrize("data", [b"", b"1234567", b"\0\0\0\7free", media.mux(bytes(64))[:-10], media.mux(bytes(640))[:60]])
def test_broken(data):
    try:
        assert media.probe(data) == []
    except (ValueError, struct.error):
        pass


def test_columns(spark):
    rows = [(1, "héllo", "x"), (2, None, "x"), (3, "", "y"), (3, "", "y"), (4, "z" * 100_000, None), (None, "n", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    stored = media.store_media(df)
    got = media.probe_media(stored.unionByName(spark.createDataFrame([(9, 1, None), (10, 1, bytearray(b"junkjunkjunk"))], "doc_id long, n_bytes long, media binary"))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 8 and by[9]["payload_sha256"] is None and by[10]["error"]
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.mux(payload)).hexdigest()
    assert media.probe_media(media.store_media(df.limit(0))).count() == 0


def movie(stsc=(1, 1, 1, 1), stsz=(64, 1), offsets=(0,), kind=b"co64", stss=(1,), duration=5):
    """A file of 64 bytes of media and one track with the given tables."""
    full, box, u4 = media.full, media.box, lambda *x: struct.pack(f">{len(x)}I", *x)
    stbl = box(b"stbl", full(b"stsc", u4(*stsc)), full(b"stsz", u4(*stsz)), full(kind, struct.pack(">I", len(offsets)), *(struct.pack(">Q" if kind == b"co64" else ">I", o) for o in offsets)), full(b"stss", u4(len(stss), *stss)))
    mdhd = box(b"mdhd", b"\1\0\0\0" + bytes(16) + struct.pack(">IQ", 1000, duration) + bytes(4))
    return bytes(64) + box(b"moov", box(b"trak", box(b"mdia", mdhd, box(b"minf", stbl))))


def test_hostile_files_are_errors_of_their_row(spark):
    """Deep nesting, tables that claim billions of entries, offsets, sizes, durations and sync samples out of range."""
    nested = b""
    for _ in range(1500):
        nested = media.box(b"moov", nested)
    body = movie()[64:]
    head = media.box(b"free", bytes(56))
    hostile = [
        nested, head + movie(stsz=(1, (1 << 32) - 1))[64:], head + movie(stsz=(0, (1 << 32) - 1))[64:], head + movie(stsc=(1, 1, (1 << 32) - 1, 1))[64:], head + movie(stsc=(2, 1, 1, 1, (1 << 32) - 1, 1, 1))[64:],
        head + movie(offsets=((1 << 64) - 100,))[64:], head + movie(offsets=(1 << 62,))[64:], head + movie(stss=(0,))[64:], head + movie(stss=(9,))[64:], head + movie(duration=1 << 63)[64:], head + movie(stsc=(1 << 31,))[64:],
    ]
    rows = [(k, 1, bytearray(x)) for k, x in enumerate([*hostile, head + body])]
    got = sorted(media.probe_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect(), key=lambda r: r["doc_id"])
    assert all(r["error"] and r["payload_sha256"] is None for r in got[:-1]), [r["doc_id"] for r in got[:-1] if not r["error"]]
    assert got[-1]["error"] is None and got[-1]["payload_bytes"] == 64 and got[-1]["keyframes"][0]["size"] == 64
