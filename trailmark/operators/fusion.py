"""Fusion of rule evidence and model scores into ranked leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.config import FORENSIC_WEIGHT, HIGH_SHARE, MEDIUM_SHARE, ML_WEIGHT, RULES, SIGNAL_NOTE
from trailmark.plans.shared import cut


def unique_by_wallet(source: DataFrame) -> DataFrame:
    """Rows of usable wallets, with ``ambiguous`` for wallets that occur more than once (one row each, chosen as the
    least: its evidence is not used)."""
    usable = source.where(F.col("wallet").isNotNull() & (F.trim("wallet") != ""))
    rest = [c for c in source.columns if c != "wallet"]
    got = usable.groupBy("wallet").agg(F.min(F.struct(*rest)).alias("r"), (F.count("*") > 1).alias("ambiguous"))
    return got.select("wallet", "r.*", "ambiguous")


def fuse(forensic: DataFrame, model: DataFrame) -> DataFrame:
    """Full outer fusion of (wallet, rule_count, evidence_level, triggered_rules, explanation) and (wallet, anomaly_score,
    anomaly_prediction). A score is null unless its source has exactly one valid row; nothing is clipped or invented; the
    combined score needs both. Every problem is named in ``errors`` or ``warnings``."""
    f = unique_by_wallet(forensic.withColumn("rule_count", F.col("rule_count").cast("string"))).withColumnRenamed("ambiguous", "f_ambiguous").withColumn("f_there", F.lit(True))
    m = unique_by_wallet(model.withColumn("anomaly_score", F.col("anomaly_score").cast("string"))).withColumnRenamed("ambiguous", "m_ambiguous").withColumn("m_there", F.lit(True))
    j = f.join(m, "wallet", "full_outer")
    no = lambda c: F.coalesce(c, F.lit(False))
    f_ok, m_ok = no(F.col("f_there")) & ~no(F.col("f_ambiguous")), no(F.col("m_there")) & ~no(F.col("m_ambiguous"))
    count, score = F.col("rule_count").try_cast("double"), F.col("anomaly_score").try_cast("double")
    top = len(RULES)
    f_error = (
        F.when(no(F.col("f_ambiguous")), "rules: several rows of this wallet, none is used")
        .when(F.col("f_there").isNull(), "rules: no row of this wallet")
        .when(F.col("rule_count").isNull(), "rules: no count")
        .when(count.isNull() | F.isnan(count), "rules: the count is no number")
        .when((count < 0) | (count > top), f"rules: the count lies outside 0 to {top}")
    )
    m_error = (
        F.when(no(F.col("m_ambiguous")), "model: several rows of this wallet, none is used")
        .when(F.col("m_there").isNull(), "model: no row of this wallet")
        .when(F.col("anomaly_score").isNull(), "model: no score")
        .when(score.isNull() | F.isnan(score), "model: the score is no number")
        .when((score < 0) | (score > 1), "model: the score lies outside 0 to 1")
    )
    rules_missing = F.col("triggered_rules").isNull() | (F.trim("triggered_rules") == "")
    out = j.select(
        "wallet",
        F.when(f_error.isNull(), F.round(count / top, 6)).alias("forensic_score"),
        F.when(f_ok, count.cast("int")).alias("rule_count"),
        *[F.when(f_ok, F.col(c)).alias(c) for c in ("evidence_level", "triggered_rules", "explanation")],
        F.when(m_error.isNull(), F.round(score, 6)).alias("ml_score"),
        F.when(m_ok, F.col("anomaly_prediction")).alias("anomaly_prediction"),
        F.when(f_error.isNull() & (count > 0) & rules_missing, "rules: a count without the rules behind it").otherwise("").alias("warnings"),
        F.array_join(F.array_compact(F.array(f_error, m_error)), ";").alias("errors"),
    )
    combined = F.round(FORENSIC_WEIGHT * F.col("forensic_score") + ML_WEIGHT * F.col("ml_score"), 6)
    return out.withColumn("combined_score", combined).withColumn("valid", combined.isNotNull())


def nested(fusion: DataFrame) -> DataFrame:
    """The investigator's view of a fusion row: wallet, forensic{}, ml{}, fusion{}, validation{}."""
    return fusion.select(
        "wallet",
        F.struct("forensic_score", "rule_count", "evidence_level", F.split("triggered_rules", ";").alias("rules"), "explanation").alias("forensic"),
        F.struct("ml_score", "anomaly_prediction").alias("ml"),
        F.struct("combined_score", F.lit(FORENSIC_WEIGHT).alias("forensic_weight"), F.lit(ML_WEIGHT).alias("ml_weight")).alias("fusion"),
        F.struct("valid", "warnings", "errors").alias("validation"),
    )


def ordinal(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Adds a gapless 1-based rank under a total order, without bringing all rows into one task: rows are range-partitioned, sorted
    and written down with their places, and each partition goes on from the counts before it (a row per partition)."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1  # of a row in its partition, by Spark's definition
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), place.alias("_place")))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_part", "_place", "_before")


def priority(fusion: DataFrame) -> DataFrame:
    """Valid fusion rows with priority_rank (combined score descending, wallet ascending), n and priority_level."""
    valid = fusion.where("valid")
    n = valid.agg(F.count("*").alias("n"))
    ranked = ordinal(valid, F.desc("combined_score"), F.asc("wallet"), name="priority_rank").crossJoin(F.broadcast(n))
    share = lambda s: F.ceil(F.lit(s).cast("double") * F.col("n"))
    level = F.when(F.col("priority_rank") <= share(HIGH_SHARE), "High").when(F.col("priority_rank") <= share(MEDIUM_SHARE), "Medium").otherwise("Low")
    return ranked.withColumn("priority_level", level)


def leads(ranked: DataFrame) -> DataFrame:
    """Ranked wallets that are anomalous or of high priority, with the reasons and the evidence as JSON."""
    top = len(RULES)
    rules = F.when(F.col("triggered_rules") == "none", F.lit("No forensic rule was triggered.")).otherwise(
        F.concat(F.col("rule_count").cast("string"), F.lit(f" of {top} forensic rules triggered: "), F.replace("triggered_rules", F.lit(";"), F.lit(", ")), F.lit("."))
    )
    model = F.when(F.col("anomaly_prediction") == "Anomalous", "Anomalous behaviour: the isolation forest flags this wallet").otherwise("Not flagged by the isolation forest; surfaced by its combined result")
    rank = F.format_string("Ranked #%d of %d (%s priority band).", "priority_rank", "n", "priority_level")
    out = ranked.where((F.col("anomaly_prediction") == "Anomalous") | (F.col("priority_level") == "High"))
    out = out.withColumn("reasons", F.array(F.format_string("%s (score %.3f).", model, "ml_score"), rules, rank, F.lit(SIGNAL_NOTE)))
    evidence = F.struct(
        F.struct("ml_score", "anomaly_prediction").alias("ml"),
        F.struct("forensic_score", "rule_count", "evidence_level", F.split("triggered_rules", ";").alias("rules")).alias("forensic"),
        F.struct("combined_score", F.lit(FORENSIC_WEIGHT).alias("forensic_weight"), F.lit(ML_WEIGHT).alias("ml_weight")).alias("fusion"),
        F.struct(F.col("priority_rank").alias("rank"), F.col("n").alias("of"), F.col("priority_level").alias("level")).alias("priority"),
    )
    return out.withColumn("evidence", F.to_json(evidence))
