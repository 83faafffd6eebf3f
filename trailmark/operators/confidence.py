"""Confidence of a flagged wallet from its combined score and what the address level adds; typology tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.config import CONFIDENCE_COMBINED, CONFIDENCE_ENTITY, CONFIDENCE_FINDING, CONFIDENCE_PATTERN


def confidence(scores: DataFrame, flagged: DataFrame, wallet_entities: DataFrame, findings: DataFrame, pattern_wallets: DataFrame) -> DataFrame:
    """Per wallet of ``scores`` (wallet, combined_score): confidence (6 places, at most 1) and an array of signals.

    co_flagged: other wallets of ``flagged`` that share an entity; findings: findings of its entities; in_pattern: end
    or party of a chain or CoinJoin-like transaction."""
    we = wallet_entities.select("wallet", "entity_id").distinct()
    lead = flagged.select("wallet").distinct().withColumn("lead", F.lit(1))
    # Wallets with the same set of entities form a class, so that a large entity costs pairs of classes and not of wallets.
    word = F.xxhash64("entity_id")
    of = we.groupBy("wallet").agg(F.struct(F.count("*").alias("n"), F.bit_xor(word).alias("x"), F.sum(word.cast("decimal(20,0)")).alias("s")).alias("kind"))
    classes = we.join(of, "wallet").select("kind", "entity_id").distinct()
    sizes = of.join(lead, "wallet").groupBy("kind").agg(F.count("*").alias("leads"))
    meet = classes.join(classes.join(sizes, "kind").select(F.col("kind").alias("other"), "entity_id", "leads"), "entity_id").select("kind", "other", "leads").distinct()
    near = meet.groupBy("kind").agg(F.sum("leads").alias("leads"))
    found = findings.groupBy("entity_id").agg(F.count("*").alias("found"))
    hits = classes.join(found, "entity_id").groupBy("kind").agg(F.sum("found").alias("findings"))
    # a wallet's own flag counts in its class, so it is taken off
    sums = of.join(lead, "wallet", "left").join(near, "kind", "left").join(hits, "kind", "left")
    sums = sums.select("wallet", (F.coalesce("leads", F.lit(0)) - F.coalesce("lead", F.lit(0))).alias("co_flagged"), F.coalesce("findings", F.lit(0)).alias("findings"))
    out = scores.select("wallet", "combined_score").join(sums, "wallet", "left").join(pattern_wallets.select("wallet").distinct().withColumn("in_pattern", F.lit(True)), "wallet", "left")
    out = out.fillna(0, ["co_flagged", "findings"]).fillna(False, ["in_pattern"])
    terms = {
        "combined_score": (F.lit(True), F.lit(CONFIDENCE_COMBINED) * F.col("combined_score"), F.format_string("combined score %.6f", "combined_score")),
        "entity_co_flagged": (F.col("co_flagged") > 0, F.lit(CONFIDENCE_ENTITY), F.format_string("%d other flagged wallets share an entity", "co_flagged")),
        "correlation_finding": (F.col("findings") > 0, F.lit(CONFIDENCE_FINDING), F.format_string("%d findings of its entities", "findings")),
        "pattern_membership": ("in_pattern", F.lit(CONFIDENCE_PATTERN), F.lit("part of a peeling chain or CoinJoin-like transaction")),
    }
    test = lambda c: F.col(c) if isinstance(c, str) else c
    total = sum((F.when(test(c), v).otherwise(0.0) for c, v, _ in terms.values()), F.lit(0.0))
    signals = F.array_compact(F.array(*[F.when(test(c), F.struct(F.lit(n).alias("name"), v.alias("contribution"), d.alias("detail"))) for n, (c, v, d) in terms.items()]))
    return out.withColumn("confidence", F.round(F.least(F.lit(1.0), total), 6)).withColumn("signals", signals)


def pattern_wallets(hops: DataFrame, coinjoins: DataFrame, transfers: DataFrame) -> DataFrame:
    """Wallets at either end of a hop, or party to a CoinJoin-like transaction."""
    ends = hops.select(F.explode(F.array("from_wallet", "to_wallet")).alias("wallet"))
    party = transfers.join(coinjoins.select("transaction_id").distinct(), "transaction_id", "left_semi").select(F.explode(F.array("sender", "receiver")).alias("wallet"))
    return ends.unionAll(party).distinct()


def typology(hops: DataFrame, coinjoins: DataFrame, transfers: DataFrame, wallet_entities: DataFrame, findings: DataFrame) -> DataFrame:
    """wallet, tag, reference: peeling (the least chain), coinjoin (the least transaction), correlated_entity (the least
    entity with a finding)."""
    peel = hops.select(F.explode(F.array("from_wallet", "to_wallet")).alias("wallet"), "chain_id").groupBy("wallet").agg(F.min("chain_id").alias("reference"))
    party = transfers.join(coinjoins.select("transaction_id").distinct(), "transaction_id", "left_semi").select(F.explode(F.array("sender", "receiver")).alias("wallet"), "transaction_id")
    mixed = party.groupBy("wallet").agg(F.min("transaction_id").alias("reference"))
    linked = wallet_entities.join(findings.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("wallet").agg(F.min("entity_id").alias("reference"))
    tag = lambda df, name: df.select("wallet", F.lit(name).alias("tag"), "reference")
    return tag(peel, "peeling").unionAll(tag(mixed, "coinjoin")).unionAll(tag(linked, "correlated_entity"))
