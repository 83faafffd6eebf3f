"""Best-fit packing of documents into fixed-capacity sequences under conflict constraints."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import WORD, spread, table, written

CAPACITY = 2048
ITEMS_PER_SHARD = 4096
SCHEMA = "doc_id long, piece int, start long, length long, shard int, bin int, offset long"


class Bins:
    """Open bins ordered by residual. A bin's state is its residual and two bitmaps: the sources and the duplicate
    clusters it holds. A tree over residuals keeps, per node, the sources that *every* bin below it holds, so the
    successor search steps over whole ranges of bins that conflict with an item's source."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.common = [-1] * (2 * self.size)  # all ones: no bin below
        self.at: dict[int, dict[int, list[int]]] = {}  # residual -> source bitmap -> bins in order of number
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.residual: list[int] = []

    def _settle(self, residual: int) -> None:
        common = -1
        for mask in self.at.get(residual, ()):
            common &= mask
        node = residual + self.size
        while node and self.common[node] != common:
            self.common[node] = common
            node //= 2
            common = self.common[2 * node] & self.common[2 * node + 1] if node else 0

    def _next(self, least: int, bit: int) -> int:
        """The smallest residual >= least with a bin that lacks the source bit; -1 if none."""
        node = least + self.size
        while True:
            if not self.common[node] & bit:
                while node < self.size:
                    node = 2 * node if not self.common[2 * node] & bit else 2 * node + 1
                return node - self.size
            while node & 1:  # a right child: go up
                node //= 2
                if node <= 1:
                    return -1
            node += 1

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put an item into the tightest compatible bin (ties: the lowest number), or a new one: (bin, offset).

        Bit 0 of the source bitmaps is never set in a bin, so an item without a source searches with it.
        """
        residual, found = size - 1, -1
        while residual < self.capacity and found < 0:
            residual = self._next(residual + 1, source or 1)
            if residual < 0:
                break
            for mask, bins in self.at[residual].items():
                if not mask & source:
                    first = next((b for b in bins if not self.clusters[b] & cluster), -1)
                    if first >= 0 and (found < 0 or first < found):
                        found = first
        if found < 0:
            found = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        else:
            old = self.at[residual]
            bins = old[self.sources[found]]
            bins.pop(bisect_left(bins, found))
            if not bins:
                del old[self.sources[found]]
                if not old:
                    del self.at[residual]
            self._settle(residual)
        offset = self.capacity - self.residual[found]
        self.residual[found] -= size
        self.sources[found] |= source
        self.clusters[found] |= cluster
        if self.residual[found] > 0:
            insort(self.at.setdefault(self.residual[found], {}).setdefault(self.sources[found], []), found)
            self._settle(self.residual[found])
        return found, offset


def pack_shard(items: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each (length, source, cluster), which come in the order of placing (longest first)."""
    bins, source_bit, cluster_bit, out = Bins(capacity), {}, {}, []
    for length, source, cluster in items:
        s = 0 if source is None else 2 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        out.append(bins.place(length, s, c))
    return out


def best_fit_pack(
    items: DataFrame,
    capacity: int = CAPACITY,
    items_per_shard: int = ITEMS_PER_SHARD,
    doc_id: str = "doc_id",
    length: str = "length",
    source: str = "source",
    cluster: str = "cluster",
) -> DataFrame:
    """Pack items into bins of ``capacity``; one row per piece: doc_id, piece, start, length, shard, bin, offset.

    No bin holds two items of one source or of one duplicate cluster (pieces of one document count as such). Items
    longer than the capacity are cut into full pieces, each a bin of its own, and a rest; items of null or no length
    take no part. Null sources and null clusters conflict with nothing. Items are dealt by a hash of all their values
    into shards of about ``items_per_shard``, packed apart; within a shard longest first, ties by cluster, document
    and start; a bin's number counts within its shard. Items equal in all values are one row with a count until they are
    dealt, each copy by its number, so that no shard gets them all. Other columns of ``items`` are ignored; no items give
    no rows.
    """
    it = items.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(length).cast("long").alias("total"),
        F.col(source).cast("string").alias("source"),
        F.xxhash64(F.col(cluster).cast("string")).alias("cluster")
        if cluster
        else F.lit(None).cast("long").alias("cluster"),
        (F.col(cluster).isNull() if cluster else F.lit(True)).alias("free"),
    ).where("total > 0")
    it = written(it.groupBy("doc_id", "total", "source", "cluster", "free").agg(F.count("*").alias("n")), "packing-items")
    n = it.agg(F.sum("n")).first()[0] or 0
    shards = spread(n, items_per_shard)
    it = it.withColumn("copy", F.explode(F.expr("sequence(1L, n)")))
    pieces = it.withColumn("piece", F.explode(F.expr(f"sequence(0, cast((total - 1) div {capacity} as int))"))).select(
        "doc_id",
        "piece",
        (F.col("piece") * F.lit(capacity).cast("long")).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * F.lit(capacity).cast("long")).alias("length"),
        "source",
        F.when(~F.col("free"), F.col("cluster")).alias("cluster"),
        F.expr(f"cast(pmod(xxhash64(doc_id, total, cluster, piece, copy), {shards}) as int)").alias("shard"),
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "cluster", "doc_id", "start"], ascending=[False, True, True, True], kind="stable")
        some = lambda x: None if pd.isna(x) else x
        todo = [(int(a), some(b), some(c)) for a, b, c in zip(pdf["length"], pdf["source"], pdf["cluster"], strict=True)]
        placed = pack_shard(todo, capacity)
        pdf["bin"], pdf["offset"] = [b for b, _ in placed], [o for _, o in placed]
        return pdf[["doc_id", "piece", "start", "length", "shard", "bin", "offset"]]

    return pieces.groupBy("shard").applyInPandas(pack, SCHEMA)


def document_items(docs: DataFrame) -> DataFrame:
    """doc_id, length (words), source, cluster (hash of the whole text: equal texts are one cluster)."""
    return docs.select(
        "doc_id",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("length"),
        "source",
        F.sha2("text", 256).alias("cluster"),
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a word, packed by word count into sequences of 2,048 words."""
    return best_fit_pack(document_items(table(spark, sf_dir, "documents")))
