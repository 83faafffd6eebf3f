"""Validation with a reason per record, idempotent ingestion, and rich imports. Nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.config import BALANCE_TOLERANCE_SATS, ID_PATTERN, MAX_BTC, SCRIPT_TYPES
from trailmark.functions.scalars import canonical_ip, sats


def _reasons(checks: dict[str, Column]) -> Column:
    """The reasons whose condition is true, joined by '; ' (empty: the record is fine). A null condition counts as true."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in checks.items()])), "; ")


def check_transfers(rows: DataFrame) -> DataFrame:
    """Adds ``reasons`` to (transaction_id, ts, sender, receiver, amount, input_count, output_count)."""
    bad_id = lambda c, n: F.col(c).isNull() | ~F.col(c).rlike(ID_PATTERN) | (F.length(c) > n)
    amount = F.round("amount", 8)
    return rows.withColumn(
        "reasons",
        _reasons(
            {
                "transaction_id": F.when(F.col("transaction_id").isNull(), False).otherwise(bad_id("transaction_id", 80)),
                "timestamp": F.col("ts").isNull(),
                "sender": bad_id("sender", 128),
                "receiver": bad_id("receiver", 128),
                "amount must be positive, at least 1 satoshi and at most 21,000,000": F.isnan(amount) | (amount < 1e-8) | (amount > MAX_BTC),
                "input_count": ~F.coalesce("input_count", F.lit(1)).between(1, 10_000),
                "output_count": ~F.coalesce("output_count", F.lit(1)).between(1, 10_000),
                "sender and receiver must differ": F.col("sender") == F.col("receiver"),
            }
        ),
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where("reasons = ''").drop("reasons"), checked.where("reasons <> ''")


def ingest(batch: DataFrame, stored: DataFrame, source: str = "synthetic", replace: bool = False) -> DataFrame:
    """Adds ``outcome`` to a batch (transaction_id, source_ref, ts, sender, receiver, amount): accepted, duplicate, or conflict; with
    ``replace`` a conflict with a stored row is to replace it.

    An id or reference that is stored (or came earlier in the batch, in the order of ``position``) with equal content is a
    duplicate, with other content a conflict; so is a wallet that another source owns."""
    same = lambda a, b: F.col(f"{a}.ts").eqNullSafe(F.col(f"{b}.ts")) & (F.col(f"{a}.sender") == F.col(f"{b}.sender")) & (F.col(f"{a}.receiver") == F.col(f"{b}.receiver")) & (sats(F.col(f"{a}.amount")) == sats(F.col(f"{b}.amount")))
    content = F.struct("ts", "sender", "receiver", sats("amount").alias("amount"))
    first = F.first(content).over(W.partitionBy("transaction_id").orderBy("position"))
    nth = F.row_number().over(W.partitionBy("transaction_id").orderBy("position"))
    b = batch.withColumn("_first", first).withColumn("_nth", nth).withColumn("_own", content).alias("b")
    s = stored.select("transaction_id", "ts", "sender", "receiver", "amount").alias("s")
    j = b.join(s, "transaction_id", "left")
    others = stored.where(F.col("source") != source).select(F.explode(F.array("sender", "receiver")).alias("w")).distinct()
    j = j.select("b.*", F.col("s.sender").isNotNull().alias("_there"), same("b", "s").alias("_same"))
    for side in ("sender", "receiver"):
        j = j.join(others.select(F.col("w").alias(side), F.lit(True).alias(f"_{side}")), side, "left")
    outcome = (
        F.when(F.col("_there") & F.col("_same"), "duplicate").when(F.col("_there"), "replaced" if replace else "conflict")
        .when((F.col("_nth") > 1) & (F.col("_own") == F.col("_first")), "duplicate").when(F.col("_nth") > 1, "conflict")
        .when(F.col("_sender") | F.col("_receiver"), "wallet of another source").otherwise("accepted")
    )
    return j.select(*batch.columns, outcome.alias("outcome"))


def next_number(stored: DataFrame, prefix: str = "syn-") -> DataFrame:
    """One row: the next free number of ids like syn-000123."""
    digits = F.substring("transaction_id", len(prefix) + 1, 20).try_cast("long")
    return stored.where(F.col("transaction_id").startswith(prefix)).agg((F.coalesce(F.max(digits), F.lit(0)) + 1).alias("next_number"))


def normalise_rich(rows: DataFrame) -> DataFrame:
    """Trims, blanks to null, lower-case txid and script, upper-case country, canonical addresses, UTC timestamp."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    out = rows
    for c in ("legacy_transaction_id", "sender_wallet", "receiver_wallet", "geo_country", "asn_org"):
        out = out.withColumn(c, blank(c))
    return out.withColumns(
        {
            "txid": F.lower("txid"), "script_type": F.lower("script_type"), "geo_country": F.upper("geo_country"),
            "input_addresses": F.transform("input_addresses", lambda a: F.trim(a)), "output_addresses": F.transform("output_addresses", lambda a: F.trim(a)),
            "src_ip_ok": canonical_ip(blank("src_ip")), "dst_ip_ok": canonical_ip(blank("dst_ip")), "src_ip": blank("src_ip"), "dst_ip": blank("dst_ip"),
            "ts": F.coalesce(F.to_utc_timestamp(F.to_timestamp("timestamp"), F.current_timezone()).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")),
        }
    )


def check_rich(rows: DataFrame) -> DataFrame:
    """Adds ``reasons`` to normalised rich records: formats, ranges, equal lengths, the balance of value within a satoshi."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.rint(x * 1e8).cast("long"))
    fine = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (x <= MAX_BTC) & (F.rint(x * 1e8) >= 1))
    named = lambda c: F.forall(c, lambda a: a.rlike(ID_PATTERN) & (F.length(a) <= 128))
    opt = lambda c, cond: F.col(c).isNotNull() & cond
    gap = F.abs(total("input_amounts") - total("output_amounts") - sats("fee_btc"))
    pay = F.exists("output_amounts", lambda x: F.rint(x * 1e8) == F.rint(F.col("amount_btc") * 1e8))
    return rows.withColumn(
        "reasons",
        _reasons(
            {
                "timestamp": F.col("ts").isNull(),
                "txid must be 64 hexadecimal characters": ~F.col("txid").rlike("^[0-9a-f]{64}$"),
                "legacy_transaction_id": opt("legacy_transaction_id", ~F.col("legacy_transaction_id").rlike(ID_PATTERN) | (F.length("legacy_transaction_id") > 80)),
                "sender_wallet": opt("sender_wallet", ~F.col("sender_wallet").rlike(ID_PATTERN)), "receiver_wallet": opt("receiver_wallet", ~F.col("receiver_wallet").rlike(ID_PATTERN)),
                "fee_btc": F.isnan("fee_btc") | (F.col("fee_btc") < 0) | (F.col("fee_btc") > MAX_BTC),
                "script_type": ~F.col("script_type").isin(*SCRIPT_TYPES),
                "no inputs": F.size("input_addresses") < 1, "no outputs": F.size("output_addresses") < 1,
                "input_addresses and input_amounts differ in length": F.size("input_addresses") != F.size("input_amounts"),
                "output_addresses and output_amounts differ in length": F.size("output_addresses") != F.size("output_amounts"),
                "addresses": ~named("input_addresses") | ~named("output_addresses"),
                "every amount must be finite and at least 1 satoshi": ~fine("input_amounts") | ~fine("output_amounts"),
                "value does not balance": fine("input_amounts") & fine("output_amounts") & (gap > BALANCE_TOLERANCE_SATS),
                "not a valid IP address": opt("src_ip", F.col("src_ip_ok").isNull()) | opt("dst_ip", F.col("dst_ip_ok").isNull()),
                "port": opt("src_port", ~F.col("src_port").between(0, 65535)) | opt("dst_port", ~F.col("dst_port").between(0, 65535)),
                "geo_country must be a 2-letter ISO code": opt("geo_country", ~F.col("geo_country").rlike("^[A-Z]{2}$")),
                "asn": opt("asn", F.col("asn") < 0),
                "sender_wallet and receiver_wallet must differ": opt("sender_wallet", F.coalesce(F.col("sender_wallet") == F.col("receiver_wallet"), F.lit(False))),
                "amount_btc must equal one of the output amounts": opt("amount_btc", ~pay),
            }
        ),
    )


def rich_signature() -> Column:
    """Digest of what makes a rich record's content: fee, script and both sides in satoshis."""
    side = lambda a, b: F.array_join(F.transform(F.arrays_zip(a, b), lambda z: F.concat_ws("@", z[a], F.rint(z[b] * 1e8).cast("long").cast("string"))), ",")
    return F.sha2(F.concat_ws("|", F.round("fee_btc", 8).cast("string"), "script_type", side("input_addresses", "input_amounts"), side("output_addresses", "output_amounts")), 256)


def import_rich(records: DataFrame, transfers: DataFrame, details: DataFrame, source: str | None = None) -> DataFrame:
    """Adds ``outcome`` and ``problem`` to valid records (in the order of ``position``): attached to a stored transfer, created,
    duplicate or rejected. ``details``: (txid, transaction_id, signature) that are stored already. With ``source``, a stored transfer
    (which then has a source column) must be of that source."""
    r = records.withColumn("signature", rich_signature())
    w = W.partitionBy("txid").orderBy("position")
    r = r.withColumn("_nth", F.row_number().over(w)).withColumn("_first", F.first("signature").over(w))
    d = details.select("txid", F.col("signature").alias("_stored"))
    t = transfers.select(F.col("transaction_id").alias("legacy_transaction_id"), F.col("ts").alias("_ts"), F.col("sender").alias("_s"), F.col("receiver").alias("_r"), F.col("amount").alias("_a"), (F.col("source") if source else F.lit(None).cast("string")).alias("_source"))
    taken = details.select(F.col("transaction_id").alias("legacy_transaction_id"), F.lit(True).alias("_taken")).distinct()
    j = r.join(d, "txid", "left").join(t, "legacy_transaction_id", "left").join(taken, "legacy_transaction_id", "left")
    there = F.col("_s").isNotNull()
    mismatch = (
        F.when(F.col("sender_wallet") != F.col("_s"), "the stored transfer has another sender").when(F.col("receiver_wallet") != F.col("_r"), "the stored transfer has another receiver")
        .when(sats("amount_btc") != sats("_a"), "the stored transfer has another amount").when(F.col("ts") != F.col("_ts"), "the stored transfer has another timestamp")
        .when(F.col("_source") != F.lit(source), "the stored transfer is of another source")
    )
    problem = (
        F.when((F.col("_nth") > 1) & (F.col("signature") != F.col("_first")), "txid appears twice with different content")
        .when(F.col("_stored").isNotNull() & (F.col("_stored") != F.col("signature")), "txid was already imported with different content")
        .when(F.col("_stored").isNull() & (F.col("_nth") == 1) & there, F.coalesce(mismatch, F.when(F.col("_taken"), "the transfer already has details")))
        .when(F.col("_stored").isNull() & (F.col("_nth") == 1) & (F.col("sender_wallet").isNull() | F.col("receiver_wallet").isNull() | F.col("amount_btc").isNull()), "sender, receiver and amount are required to create the transfer")
    )
    j = j.withColumn("problem", problem)
    outcome = F.when(F.col("problem").isNotNull(), "rejected").when(F.col("_stored").isNotNull() | (F.col("_nth") > 1), "duplicate").when(there, "attached").otherwise("created")
    return j.withColumn("outcome", outcome).drop("_nth", "_first", "_stored", "_ts", "_s", "_r", "_a", "_taken", "_source")


def explode_sides(records: DataFrame, key: str = "txid") -> tuple[DataFrame, DataFrame]:
    """(inputs, outputs): key, position, address, amount."""
    one = lambda a, b: records.select(key, F.posexplode(F.arrays_zip(F.col(a).alias("address"), F.col(b).alias("amount"))).alias("position", "z")).select(key, "position", "z.address", F.round("z.amount", 8).alias("amount"))
    return one("input_addresses", "input_amounts"), one("output_addresses", "output_amounts")


def check_observations(rows: DataFrame, transfers: DataFrame) -> DataFrame:
    """Adds ``reasons``: the transaction must exist, the wallet be its sender (suffix -S) or receiver (-R), the device, the
    address and the time be given, and the time not lie before the transaction."""
    t = transfers.select("transaction_id", F.col("ts").alias("_ts"), "sender", "receiver")
    j = rows.join(t, "transaction_id", "left")
    party = F.when(F.col("observation_id").endswith("-S"), F.col("sender")).when(F.col("observation_id").endswith("-R"), F.col("receiver"))
    there = F.col("_ts").isNotNull()
    reason = F.when(~there, "unknown transaction").when(~party.eqNullSafe(F.col("wallet")), "wallet is not that party of the transaction").when(F.col("ip_address").isNull(), "no address").when(F.col("device_id").isNull(), "no device").when(F.col("observed_at").isNull() | (F.col("observed_at") < F.col("_ts")), "observed before the transaction")
    return j.withColumn("reasons", F.coalesce(reason, F.lit(""))).drop("_ts", "sender", "receiver")
