"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.plans.shared import cut, shared_dir, written

__all__ = ["cut", "shared_dir", "written", "table", "byte_column", "spread", "free_name", "Wanted", "LETTERS", "letter_runs", "SPACES", "WORD"]

#: Word separators of all word-based operators here: space and the controls 9 to 13 (what bytes.split() takes).
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Letters are Unicode's category L. What re's \w takes besides decimal digits and "_" includes numerals such as \u00b2 or \u2167.
WIDE = re.compile(r"[^\W\d_]+")
NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
LETTERS = re.compile(rf"[^\W\d_{NUMERALS}]+")
#: A bitmap of wanted keys has eight bits a key within these bounds of its size, as powers of two (32 KB to 16 MB).
LEAST_BITS, MOST_BITS = 18, 27
BITMAP = 4096 * 8  # bits of one value of bitmap_construct_agg


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_column(batch: pa.RecordBatch, name: str) -> list:
    """A string column as UTF-8 bytes (None for null), without decoding."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def letter_runs(text: str) -> list[str]:
    """The runs of letters in a text. The wide class is some twenty times faster, and seldom finds anything else."""
    found = WIDE.findall(text)
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [run for w in found for run in LETTERS.findall(w)]


def spread(n: int, per: int) -> int:
    """How many groups of about ``per`` hold ``n`` things."""
    return max(1, -(-n // per))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores behind it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Wanted:
    """Tells in tasks which binary keys (of 8 bytes or more, evenly spread) are surely not in ``wanted``, one column of such keys.

    A bitmap of at most 16 MB, built in Spark and broadcast. With more than some 100 million keys it lets ever more through,
    which only costs a wider join behind it."""

    def __init__(self, wanted: DataFrame):
        key = F.col(wanted.columns[0])
        self.bits = min(MOST_BITS, max(LEAST_BITS, (8 * wanted.count()).bit_length()))
        at = F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long").bitwiseAND((1 << self.bits) - 1)
        maps = wanted.select((at + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
        seen = np.zeros((1 << self.bits) // 8, np.uint8)
        for bucket, data in maps.toLocalIterator():  # 4 KB each; Spark's buckets and positions count from 1
            a = (bucket - 1) * (BITMAP // 8)
            seen[a : a + BITMAP // 8] = np.frombuffer(bytes(data), np.uint8)[: len(seen) - a]
        self.shared = wanted.sparkSession.sparkContext.broadcast(seen.tobytes())

    def holds(self, keys: list[bytes]) -> np.ndarray:
        k = np.frombuffer(b"".join([x[:4] for x in keys]), ">u4").astype(np.int64) & ((1 << self.bits) - 1)
        return (np.frombuffer(self.shared.value, np.uint8)[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
