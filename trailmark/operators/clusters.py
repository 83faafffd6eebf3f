"""Counts, priorities and upserts of clusters (cluster_id, wallet), whatever made them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_counts(clusters: DataFrame, transfers: DataFrame, observations: DataFrame) -> DataFrame:
    """cluster_id, wallets, transactions (with a member as a party, once per cluster), observations (of members)."""
    party = transfers.select("transaction_id", F.explode(F.array("sender", "receiver")).alias("wallet"))
    tx = party.join(clusters, "wallet").groupBy("cluster_id").agg(F.count_distinct("transaction_id").alias("transactions"))
    seen = observations.join(clusters, "wallet").groupBy("cluster_id").agg(F.count("*").alias("observations"))
    size = clusters.groupBy("cluster_id").agg(F.count("*").alias("wallets"))
    return size.join(tx, "cluster_id", "left").join(seen, "cluster_id", "left").fillna(0)


def cluster_priority(clusters: DataFrame, ranked: DataFrame) -> DataFrame:
    """cluster_id, scored, anomalous, high, max_score, mean_score, top_wallet (of the best rank)."""
    j = clusters.join(ranked, "wallet")
    return j.groupBy("cluster_id").agg(
        F.count("*").alias("scored"), F.count_if(F.col("anomaly_prediction") == "Anomalous").alias("anomalous"), F.count_if(F.col("priority_level") == "High").alias("high"),
        F.max("combined_score").alias("max_score"), F.round(F.avg("combined_score"), 6).alias("mean_score"), F.min_by("wallet", "priority_rank").alias("top_wallet"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str, now) -> DataFrame:
    """The new state of a table (key, content, created_at, updated_at): created_at is kept, updated_at moves only where the
    content changed, keys that vanished go. ``change`` says created, updated or unchanged."""
    o = old.select(key, F.col("content").alias("_content"), F.col("created_at").alias("_created"), F.col("updated_at").alias("_updated"))
    j = new.select(key, "content").join(o, key, "left")
    same = F.col("content").eqNullSafe(F.col("_content"))
    fresh, now = F.col("_created").isNull(), F.lit(now).cast("timestamp_ntz")
    return j.select(
        key, "content", F.coalesce("_created", now).alias("created_at"), F.when(same & ~fresh, F.col("_updated")).otherwise(now).alias("updated_at"),
        F.when(fresh, "created").when(same, "unchanged").otherwise("updated").alias("change"),
    )


def internal_pairs(clusters: DataFrame, transfers: DataFrame, limit: int = 100) -> DataFrame:
    """cluster_id, sender, receiver, transfers, amount: the busiest flows inside each cluster."""
    from pyspark.sql import Window as W

    s, r = clusters.select("cluster_id", F.col("wallet").alias("sender")), clusters.select("cluster_id", F.col("wallet").alias("receiver"))
    flows = transfers.groupBy("sender", "receiver").agg(F.count("*").alias("transfers"), F.sum("amount").alias("amount"))
    got = flows.join(s, "sender").join(r, ["cluster_id", "receiver"])
    k = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("transfers"), F.desc("amount"), "sender", "receiver"))
    return got.withColumn("k", k).where(F.col("k") <= limit).drop("k")
