"""Behavioural features per wallet from a ledger of transfers (transaction_id, ts, sender, receiver, amount)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.config import BURST_SECONDS, FEATURES, MIN_PERIOD_HOURS, RATIO_CAP
from trailmark.functions.scalars import micros

HOUR = 3_600_000_000.0
#: Span of a partial result of the time features, so that one busy wallet is many window groups, not one.
DAY = 86_400_000_000


def legs(transfers: DataFrame) -> DataFrame:
    """Each transfer as seen from both ends, in one pass: wallet, counterparty, direction, amount."""
    side = lambda wallet, other, name: F.struct(F.col(wallet).alias("wallet"), F.col(other).alias("counterparty"), F.lit(name).alias("direction"))
    both = F.explode(F.array(side("sender", "receiver", "Outgoing"), side("receiver", "sender", "Incoming")))
    return transfers.select("transaction_id", "ts", both.alias("leg"), "amount").select("transaction_id", "ts", "leg.*", "amount")


def mirror_breaks(legs_: DataFrame) -> DataFrame:
    """Legs whose mirror is missing, with multiplicity: side tells which. Empty for a sound mirrored ledger."""
    cols = ["transaction_id", "ts", "amount"]
    out = legs_.where("direction = 'Outgoing'").select(*cols, F.col("wallet").alias("sender"), F.col("counterparty").alias("receiver"))
    inc = legs_.where("direction = 'Incoming'").select(*cols, F.col("counterparty").alias("sender"), F.col("wallet").alias("receiver"))
    return out.exceptAll(inc).withColumn("side", F.lit("no incoming")).unionAll(inc.exceptAll(out).withColumn("side", F.lit("no outgoing")))


def pair_totals(legs_: DataFrame) -> DataFrame:
    """Per wallet and counterparty: n_in, n_out, received, sent. Feeds all counting features."""
    inc = F.col("direction") == "Incoming"
    return legs_.groupBy("wallet", "counterparty").agg(
        F.count_if(inc).alias("n_in"),
        F.count_if(~inc).alias("n_out"),
        F.sum(F.when(inc, F.col("amount")).otherwise(0.0)).alias("received"),
        F.sum(F.when(~inc, F.col("amount")).otherwise(0.0)).alias("sent"),
    )


def core_features(legs_: DataFrame) -> DataFrame:
    """Counts, volumes, ratio, fan-in and fan-out, counterparties. The pairs are pre-aggregated, so a hub costs one row per
    counterparty, and the second grouping combines those before its shuffle."""
    n = F.col("n_in") + F.col("n_out")
    agg = pair_totals(legs_).groupBy("wallet").agg(
        F.sum(n).alias("transaction_count"),
        F.sum("n_in").alias("incoming_count"),
        F.sum("n_out").alias("outgoing_count"),
        F.sum("received").alias("total_received_btc"),
        F.sum("sent").alias("total_sent_btc"),
        F.count_if(F.col("n_in") > 0).alias("fan_in"),
        F.count_if(F.col("n_out") > 0).alias("fan_out"),
        F.count("*").alias("unique_counterparties"),
        F.count_if(n > 1).alias("repeated_connections"),
    )
    recv, sent = F.col("total_received_btc"), F.col("total_sent_btc")
    ratio = F.when(sent > 0, F.least(recv / sent, F.lit(RATIO_CAP))).when(recv > 0, F.lit(RATIO_CAP))
    return agg.withColumns(
        {
            "avg_transaction_amount": (recv + sent) / F.col("transaction_count"),
            "incoming_outgoing_ratio": ratio,
            "wallet_degree": F.col("fan_in") + F.col("fan_out"),
        }
    )


def time_features(legs_: DataFrame) -> DataFrame:
    """Hours: last gap, mean gap, longest gap; and transfers per day. All null for a single transfer.

    Gaps are found per wallet and day, then between the days of a wallet, so no window group holds all of a busy wallet. Times
    alone decide: of legs of one time, in whatever order, all but the first have a gap of 0.
    """
    t = legs_.select("wallet", micros("ts").alias("us")).withColumn("day", F.floor(F.col("us") / DAY))
    inside = W.partitionBy("wallet", "day").orderBy("us")
    gaps = t.withColumn("gap", F.col("us") - F.lag("us").over(inside)).withColumn("final", F.lead("us").over(inside).isNull())
    days = gaps.groupBy("wallet", "day").agg(
        F.count("*").alias("n"), F.min("us").alias("first"), F.max("us").alias("last"), F.max("gap").alias("longest"), F.max(F.when(F.col("final"), F.col("gap"))).alias("final")
    )
    between = F.col("first") - F.lag("last").over(W.partitionBy("wallet").orderBy("day"))
    days = days.withColumn("between", between)
    agg = days.groupBy("wallet").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max(F.greatest("longest", "between")).alias("longest"),
        F.max_by(F.coalesce("final", "between"), "day").alias("final"),
    )
    span = (F.col("last") - F.col("first")) / HOUR
    return agg.select(
        "wallet",
        (F.col("final") / HOUR).alias("time_since_previous_tx"),
        F.when(F.col("n") > 1, span / (F.col("n") - 1)).alias("avg_transaction_interval"),
        (F.col("longest") / HOUR).alias("dormancy_duration"),
        F.when(F.col("n") > 1, F.col("n") / (F.greatest(span, F.lit(MIN_PERIOD_HOURS)) / 24)).alias("transaction_frequency"),
    )


def activity_burst(legs_: DataFrame, seconds: int = BURST_SECONDS) -> DataFrame:
    """Most transfers in [t, t + seconds) over all t of a wallet's transfers.

    Windows are evaluated per wallet and span of a day (from noon on, since times without an hour are midnights), so a busy wallet
    is spread over its spans. A leg within ``seconds`` of its span's start is also shown to the span before.
    """
    size, half = seconds * 1_000_000, DAY // 2
    width = max(DAY, size)
    t = legs_.select("wallet", (micros("ts") + half).alias("us")).withColumn("span", F.floor(F.col("us") / width))
    near = F.col("us") - F.col("span") * width < size - 1
    spans = F.when(near, F.array("span", F.col("span") - 1)).otherwise(F.array("span"))
    t = t.select("wallet", "us", F.floor(F.col("us") / width).alias("home"), F.explode(spans).alias("span"))
    ahead = W.partitionBy("wallet", "span").orderBy("us").rangeBetween(0, size - 1)
    return t.withColumn("n", F.count("*").over(ahead)).where("span = home").groupBy("wallet").agg(F.max("n").alias("activity_burst"))


def wallet_features(transfers: DataFrame, hops: DataFrame | None = None) -> DataFrame:
    """One row per wallet on either side: wallet and the 18 features, rounded to 6 places; hop_distance comes from
    ``hops`` (wallet, hop_distance) and is null without it."""
    both = legs(transfers)
    got = core_features(both).join(time_features(both), "wallet").join(activity_burst(both), "wallet")
    got = got.join(hops, "wallet", "left") if hops is not None else got.withColumn("hop_distance", F.lit(None).cast("double"))
    return got.select("wallet", *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in ((f, dict(got.dtypes)[f]) for f in FEATURES)])


def feature_breaks(features: DataFrame) -> DataFrame:
    """Wallets whose features contradict each other, with the reason."""
    checks = {
        "in and out do not add up": F.col("incoming_count") + F.col("outgoing_count") != F.col("transaction_count"),
        "degree below counterparties": F.col("wallet_degree") < F.col("unique_counterparties"),
        "repeated above counterparties": F.col("repeated_connections") > F.col("unique_counterparties"),
        "time features of a single transfer": (F.col("transaction_count") < 2) & F.col("dormancy_duration").isNotNull(),
        "burst out of range": (F.col("activity_burst") < 1) | (F.col("activity_burst") > F.col("transaction_count")),
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in checks.items()]))
    return features.select("wallet", F.array_join(reasons, "; ").alias("reasons")).where("reasons <> ''")


def complete(features: DataFrame, columns=FEATURES) -> DataFrame:
    """Adds scored (all features finite) and the reason why not."""
    missing = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), F.lit(c)) for c in columns]
    gaps = F.array_compact(F.array(*missing))
    reason = F.when(F.size(gaps) > 0, F.concat(F.lit("undefined features: "), F.array_join(gaps, ", ")))
    return features.withColumn("unscored_reason", reason).withColumn("scored", reason.isNull())


def finite(columns) -> F.Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns])
