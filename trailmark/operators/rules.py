"""Percentile rules over wallet features, their findings, and counts of what fired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.config import EVIDENCE_LEVELS, HIGH_PERCENTILE, HIGH_RULES, IMBALANCE_HIGH, IMBALANCE_LOW, IMBALANCE_RULE, LOW_PERCENTILE
from trailmark.functions.scalars import compact_number
from trailmark.operators.ranks import percentiles

RATIO = "incoming_outgoing_ratio"


def thresholds(features: DataFrame) -> DataFrame:
    """One row: the exact (linearly interpolated) 90th percentile per rule's feature, and both ends of the ratio."""
    high = {f: (f, HIGH_PERCENTILE) for _, f, _ in HIGH_RULES}
    return percentiles(features, high | {"ratio_high": (RATIO, HIGH_PERCENTILE), "ratio_low": (RATIO, LOW_PERCENTILE)})


def _finding(rule: str, feature: str, value, limit, text) -> F.Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(feature).alias("feature"), value.cast("double").alias("value"), limit.cast("double").alias("threshold"), text.alias("text"))


def _filled(text: str, *values) -> F.Column:
    """A text whose {} are columns."""
    parts = text.split("{}")
    return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (v, F.lit(p))])


def with_findings(features: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """The features with an array of findings (rule, feature, value, threshold, text) in the order of the rules. A value must
    lie strictly beyond its threshold. The thresholds are one row."""
    limits = limits if limits is not None else thresholds(features)
    lim = limits.select(*[F.col(c).alias(f"limit_{c}") for c in limits.columns])
    joined = features.crossJoin(F.broadcast(lim))
    found = []
    for rule, feature, text in HIGH_RULES:
        v, t = F.col(feature), F.col(f"limit_{feature}")
        said = F.concat(F.lit(f"{text} ({feature}="), compact_number(v), F.lit("; above the population 90th percentile of "), compact_number(t), F.lit(")."))
        found.append(F.when(v > t, _finding(rule, feature, v, t, said)))
    v, hi, lo = F.col(RATIO), F.col("limit_ratio_high"), F.col("limit_ratio_low")
    more, less = (_filled(text, compact_number(v), compact_number(limit)) for text, limit in ((IMBALANCE_HIGH, hi), (IMBALANCE_LOW, lo)))
    found.append(F.when(v > hi, _finding(IMBALANCE_RULE, RATIO, v, hi, more)).when(v < lo, _finding(IMBALANCE_RULE, RATIO, v, lo, less)))
    return joined.withColumn("findings", F.array_compact(F.array(*found))).drop(*lim.columns)


def evidence_level(count: str = "rule_count") -> F.Column:
    c = F.col(count)
    return F.when(c == 0, EVIDENCE_LEVELS[0]).when(c == 1, EVIDENCE_LEVELS[1]).when(c <= 3, EVIDENCE_LEVELS[2]).otherwise(EVIDENCE_LEVELS[3])


def rule_results(with_findings_: DataFrame) -> DataFrame:
    """wallet, rule_count, evidence_level, triggered_rules, explanation."""
    names, texts = F.transform("findings", lambda f: f["rule"]), F.transform("findings", lambda f: f["text"])
    none = F.size("findings") == 0
    return with_findings_.withColumn("rule_count", F.size("findings")).select(
        "wallet", "rule_count", evidence_level().alias("evidence_level"),
        F.when(none, "none").otherwise(F.array_join(names, ";")).alias("triggered_rules"),
        F.when(none, "No behavioural rule was triggered for this wallet.").otherwise(F.array_join(texts, " ")).alias("explanation"),
    )


def findings(with_findings_: DataFrame) -> DataFrame:
    """One row per finding: wallet, position, rule, feature, value, threshold, text."""
    return with_findings_.select("wallet", F.posexplode("findings").alias("position", "f")).select("wallet", "position", "f.*")


def rule_counts(with_findings_: DataFrame, anomalous: DataFrame | None = None) -> DataFrame:
    """rule, wallets, anomalous_wallets: how often each rule fired, among all and among flagged wallets."""
    rows = with_findings_.select("wallet", F.explode("findings.rule").alias("rule"))
    rows = rows.join(anomalous.select("wallet").distinct().withColumn("flag", F.lit(True)), "wallet", "left") if anomalous is not None else rows.withColumn("flag", F.lit(False))
    return rows.groupBy("rule").agg(F.count("*").alias("wallets"), F.count_if(F.coalesce("flag", F.lit(False))).alias("anomalous_wallets"))
