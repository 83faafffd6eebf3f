"""Sharding by longest-processing-time scheduling: groups stay together, shards come out near equal in bytes."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailmark.llm.common import spread, table, written

SHARDS = 40
#: A group counts as large from this share of a shard's fair load; so at most shards x this many groups are large.
LARGE_SHARE = 250
GROUPS_PER_BUCKET = 20_000


def lpt(sizes: list[int], loads: list[float]) -> list[int]:
    """Shard of each size (given in descending order): always the least loaded one, found through a heap."""
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for size in sizes:
        load, k = heap[0]
        out.append(k)
        heapq.heapreplace(heap, (load + size, k))
    return out


def assign_groups(groups: DataFrame, shards: int = SHARDS, per_bucket: int = GROUPS_PER_BUCKET) -> DataFrame:
    """key, shard for groups given as (key, total).

    The few large groups (a provably bounded number: those above 1/250 of a shard's fair load) go first, through one
    heap. The rest is dealt into hash buckets of about ``per_bucket`` groups; each bucket is scheduled by its own heap,
    which starts from its fraction of the large groups' loads and from a shard order turned by the bucket's number, so
    that the buckets' small remainders do not add up on the same shards.
    """
    spark = groups.sparkSession
    n, total = groups.agg(F.count("*"), F.sum("total")).first()
    limit = max(1, (total or 0) // (shards * LARGE_SHARE))
    large = groups.where(F.col("total") > limit).orderBy(F.desc("total"), "key").collect()
    placed = lpt([r["total"] for r in large], [0.0] * shards)
    loads = [0] * shards
    for r, k in zip(large, placed, strict=True):
        loads[k] += r["total"]
    buckets = spread(n - len(large), per_bucket)

    def schedule(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["total", "key"], ascending=[False, True])
        turn = int(pdf["bucket"].iloc[0]) * shards // buckets
        order = [(turn + k) % shards for k in range(shards)]
        got = lpt(pdf["total"].tolist(), [loads[k] / buckets for k in order])
        return pd.DataFrame({"key": pdf["key"], "shard": [order[k] for k in got]})

    rest = groups.where(F.col("total") <= limit).withColumn("bucket", F.expr(f"cast(pmod(xxhash64(key), {buckets}) as int)"))
    out = rest.groupBy("bucket").applyInPandas(schedule, "key binary, shard int")
    if large:
        rows = [(r["key"], k) for r, k in zip(large, placed, strict=True)]
        out = out.unionByName(spark.createDataFrame(rows, "key binary, shard int"))
    return out


def gapless(rows: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps and without bringing a shard into one task.

    Each task counts on from 0 per shard; the counts of the tasks before it are then added. ``rows`` must be a scan
    of a written table, so that tasks see the same rows each time.
    """
    at = rows.withColumn("_task", F.spark_partition_id())
    before = W.partitionBy(shard).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    counts = at.groupBy("_task", shard).agg(F.count("*").alias("_n"))
    offsets = counts.select("_task", shard, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))

    def local(batches):
        seen: dict[int, int] = {}
        for pdf in batches:
            k = pdf.groupby(shard).cumcount() + pdf[shard].map(lambda s: seen.get(s, 0))
            for s, c in pdf[shard].value_counts().items():
                seen[s] = seen.get(s, 0) + int(c)
            yield pdf.assign(_local=k)

    numbered = at.mapInPandas(local, at.schema.simpleString()[7:-1].replace(":", " ") + ", _local long")
    return numbered.join(offsets, ["_task", shard]).withColumn(slot, F.col("_local") + F.col("_before")).drop("_task", "_local", "_before")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard under the law of near equal bytes.

    Size is the UTF-8 length of the text (null: none) plus 16. Documents of equal text form a group, which goes to one
    shard whole; null texts form one group with empty ones. Repeated rows are rows of one group. Extra columns are
    ignored; no documents give no rows. ``slot`` is gapless from 0 in each shard; its order carries no meaning.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"),
    )
    groups = base.groupBy("key").agg(F.sum("size").alias("total"))
    plan = assign_groups(written(groups, "shard-groups"), shards)
    dealt = written(base.join(plan, "key").drop("key"), "shard-rows")
    return gapless(dealt).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, law ``bytes``."""
    return shard_documents(table(spark, sf_dir, "documents"))
