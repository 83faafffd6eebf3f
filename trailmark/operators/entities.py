"""Address-level analysis: common-input entities, their network correlation, CoinJoin-like transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.config import COINJOIN_INPUTS, COINJOIN_OUTPUTS, COINJOIN_TOLERANCE, MANY_ASNS, MANY_COUNTRIES, USUAL_PORT
from trailmark.operators.components import connected_components
from trailmark.plans.shared import likely_among, remove_since, tables_written, written


def coinjoin_metrics(inputs: DataFrame, outputs: DataFrame, tolerance: float = COINJOIN_TOLERANCE) -> DataFrame:
    """transaction_id, input_count (distinct addresses), output_count, group_size, group_value, score (4 places).

    The largest group of near-equal outputs: amounts ascending, a group runs while they stay within the tolerance of its
    lowest member, and the next begins behind it; the first of the largest wins. A fold over the sorted array."""
    ins = inputs.groupBy("transaction_id").agg(F.count_distinct("address").alias("input_count"))
    outs = outputs.groupBy("transaction_id").agg(F.array_sort(F.collect_list("amount")).alias("amounts"))
    j = ins.join(outs, "transaction_id", "full_outer").withColumn("amounts", F.coalesce("amounts", F.array().cast("array<double>")))
    return _coinjoin_scores(j.withColumn("g", _largest_group(tolerance)))


def _largest_group(tolerance: float) -> F.Column:
    """low, n, best, value: the fold over the sorted ``amounts``."""
    zero = F.struct(F.lit(None).cast("double").alias("low"), F.lit(0).alias("n"), F.lit(0).alias("best"), F.lit(0.0).alias("value"))

    def step(acc, x):
        same = acc["low"].isNotNull() & (x <= acc["low"] * (1 + tolerance))
        low, n = F.when(same, acc["low"]).otherwise(x), F.when(same, acc["n"] + 1).otherwise(F.lit(1))
        better = n > acc["best"]
        return F.struct(low.alias("low"), n.alias("n"), F.when(better, n).otherwise(acc["best"]).alias("best"), F.when(better, low).otherwise(acc["value"]).alias("value"))

    return F.aggregate("amounts", zero, step)


def _coinjoin_scores(j: DataFrame) -> DataFrame:
    j = j.withColumn("output_count", F.size("amounts")).withColumn("input_count", F.coalesce("input_count", F.lit(0)))
    balance = F.least(F.lit(1.0), F.col("input_count") / F.greatest("input_count", "output_count", F.lit(1)))
    score = F.when(F.col("output_count") == 0, 0.0).otherwise(F.round(F.col("g.best") / F.col("output_count") * balance, 4))
    return j.select("transaction_id", F.col("input_count").cast("long").alias("input_count"), F.col("output_count").cast("long").alias("output_count"), F.col("g.best").cast("long").alias("group_size"), F.round("g.value", 8).alias("group_value"), score.alias("score"))


def coinjoin_candidates(metrics: DataFrame, min_inputs: int = COINJOIN_INPUTS, min_outputs: int = COINJOIN_OUTPUTS) -> DataFrame:
    return metrics.where((F.col("input_count") >= min_inputs) & (F.col("group_size") >= min_outputs))


def coinjoin_transactions(inputs: DataFrame, outputs: DataFrame, min_inputs: int = COINJOIN_INPUTS, min_outputs: int = COINJOIN_OUTPUTS, tolerance: float = COINJOIN_TOLERANCE) -> DataFrame:
    """The candidates among all transactions' metrics (both minima are 1 or more). Outputs tell most of the others apart, so inputs
    are counted for those alone whose outputs have a group of the size; these are a table."""
    outs = outputs.groupBy("transaction_id").agg(F.array_sort(F.collect_list("amount")).alias("amounts"))
    outs = written(outs.withColumn("g", _largest_group(tolerance)).where(F.col("g.best") >= min_outputs), "coinjoin-outputs")
    ins = inputs.join(outs.select("transaction_id"), "transaction_id", "left_semi").groupBy("transaction_id").agg(F.count_distinct("address").alias("input_count"))
    return coinjoin_candidates(_coinjoin_scores(outs.join(ins, "transaction_id")), min_inputs, min_outputs)


def common_input_groups(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id, address) and (entity_id, transaction_id): addresses spent together, transitively, and the transactions that an
    entity spends in. Singletons stay. Ids are CIO- and the least address. Both are read from three tables, the only ones that stay."""
    spark, mark, used = inputs.sparkSession, tables_written(), inputs.select("transaction_id", "address")
    # Groups are sought among transactions: only an address of two or more links any, and those are few. All of an address's
    # transactions are of one group, so its least one (null, if it has none) stands for it.
    per = used.groupBy("address").agg(F.min("transaction_id").alias("least"), F.max("transaction_id").alias("most"), F.bool_or(F.col("transaction_id").isNull()).alias("idle"))
    per = written(per.select("address", "least", (F.col("least") < F.col("most")).alias("again"), "idle"), "entity-addresses")
    again = per.where("again").select("address", "least")
    links = likely_among(used, again, "address").join(again, "address").where("transaction_id <> least").select("least", "transaction_id")
    groups = written(connected_components(links, "least", "transaction_id"), "entity-groups")
    # Each address meets its least transaction's group and first address in one shuffle; those without a transaction need neither.
    named = per.where("least is not null").withColumn("first", F.min("address").over(W.partitionBy("least")))
    named = named.join(groups.withColumnRenamed("node", "least"), "least", "left").select("address", "least", "first", "component", "idle")
    named = named.unionAll(per.where("least is null").select("address", "least", F.col("address").alias("first"), F.lit(None).cast(groups.schema["component"].dataType), "idle"))
    named = written(named, "entities")
    linked = written(named.where("component is not null").groupBy("component").agg(F.min("address").alias("entity")), "entity-names")
    remove_since(spark, mark, keep=3)
    name = lambda c: F.concat(F.lit("CIO-"), c).alias("entity_id")
    single, several = named.where("component is null"), named.where("component is not null").join(linked, "component")
    found = single.select(F.when(F.col("address").isNotNull(), name("first")).alias("entity_id"), "address", "idle").unionAll(several.select(F.when(F.col("address").isNotNull(), name("entity")).alias("entity_id"), "address", "idle"))
    # A transaction is linked to others, or the least one of all its addresses. (Rows without a transaction count as one.)
    alone = single.where("address = first and least is not null").select(name("first"), F.col("least").alias("transaction_id"))
    spends = groups.join(linked, "component").select(name("entity"), F.col("node").alias("transaction_id")).unionAll(alone)
    none = found.where("idle and entity_id is not null").select("entity_id", F.lit(None).cast("string").alias("transaction_id")).distinct()
    return found.select("entity_id", "address"), spends.unionAll(none)


def common_input_entities(inputs: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """entity_id, address: addresses spent together, transitively; singletons stay. Transactions in ``excluded``
    (CoinJoin-like ones, by transaction_id) do not count. Ids are CIO- and the least address."""
    if excluded is not None:
        # inputs are read more than once, what is left out is found only once
        inputs = inputs.join(written(excluded.select("transaction_id").distinct(), "entity-excluded"), "transaction_id", "left_anti")
    return common_input_groups(inputs)[0]


def entity_transactions(entities: DataFrame, inputs: DataFrame, spends: DataFrame | None = None) -> DataFrame:
    """entity_id, transaction_id: transactions that an entity spends in; ``spends``, where they are known already."""
    if spends is not None:
        return spends
    return inputs.select("transaction_id", "address").join(entities, "address").select("entity_id", "transaction_id").distinct()


def entity_uses(spends: DataFrame, flows: DataFrame) -> DataFrame:
    """entity_id, sender, src_ip, country, asn, ports (distinct): what is seen of each transaction that an entity spends in. A table, so
    that all that asks for senders and findings reads flows and joins them once."""
    seen = flows.groupBy("transaction_id", "sender", "src_ip", "country", "asn").agg(F.collect_set("dst_port").alias("ports"))
    return written(spends.join(seen, "transaction_id").drop("transaction_id"), "entity-uses")


def entity_stats(entities: DataFrame, inputs: DataFrame, outputs: DataFrame, flows: DataFrame, excluded: DataFrame | None = None, spends: DataFrame | None = None) -> DataFrame:
    """Per entity: addresses, sent, received, transactions touched, first and last seen, sorted lists of countries and
    ASNs, distinct addresses of flows. Only transactions that some entity spends in count. ``spends``, of common_input_groups, has
    one entity per transaction."""
    one_each = spends is not None and excluded is None
    if excluded is not None:
        gone = excluded.select("transaction_id").distinct()
        inputs, outputs, flows = (d.join(gone, "transaction_id", "left_anti") for d in (inputs, outputs, flows))
    spends = entity_transactions(entities, inputs, spends if excluded is None else None)
    if one_each:  # so that what was sent needs no join by address
        paid = inputs.where("address is not null").groupBy("transaction_id").agg(F.sum("amount").alias("amount")).join(spends, "transaction_id").select("entity_id", "amount")
        paid = paid.unionAll(inputs.where("transaction_id is null").join(entities, "address").select("entity_id", "amount"))
    else:
        paid = inputs.join(entities, "address")
    sent = paid.groupBy("entity_id").agg(F.sum("amount").alias("total_sent"))
    # Of the transactions received in, those that the entity does not spend in too are counted beside the ones spent in.
    mine = outputs.join(entities, "address").select("entity_id", "transaction_id", "amount").repartition("transaction_id")
    mine = mine.groupBy("transaction_id", "entity_id").agg(F.sum("amount").alias("amount")).join(spends.select("transaction_id", F.col("entity_id").alias("spender")), "transaction_id")
    mine = mine.groupBy("transaction_id", "entity_id").agg(F.first("amount").alias("amount"), F.bool_or(F.col("spender") == F.col("entity_id")).alias("own"))
    received = mine.groupBy("entity_id").agg(F.sum("amount").alias("total_received"), F.count_if(~F.col("own")).alias("others"))
    spent_in = spends.groupBy("entity_id").agg(F.count("*").alias("transactions"))
    seen = flows.select("transaction_id", "ts", "src_ip", "country", "asn").distinct()
    net = spends.join(seen, "transaction_id").groupBy("entity_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_distinct("src_ip").alias("ips"),
        F.array_sort(F.collect_set("country")).alias("countries"), F.array_sort(F.collect_set("asn")).alias("asns"),
    )
    base = entities.groupBy("entity_id").agg(F.count("*").alias("addresses"))
    for part in (sent, received, spent_in, net):
        base = base.join(part, "entity_id", "left")
    base = base.fillna(0.0, ["total_sent", "total_received"]).fillna(0, ["transactions", "others", "ips"])
    return base.withColumn("transactions", F.col("transactions") + F.col("others")).drop("others")


def entity_ip_links(entities: DataFrame, inputs: DataFrame, flows: DataFrame, spends: DataFrame | None = None) -> DataFrame:
    """entity_id, src_ip, transactions, first_seen, last_seen, asn and country (of the first use)."""
    uses = flows.where("src_ip is not null").groupBy("transaction_id", "src_ip").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.min_by("asn", "ts").alias("asn"), F.min_by("country", "ts").alias("country"))
    j = entity_transactions(entities, inputs, spends).join(uses, "transaction_id")
    at = F.struct("first", "transaction_id")
    return j.groupBy("entity_id", "src_ip").agg(F.count("*").alias("transactions"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), F.min_by("asn", at).alias("asn"), F.min_by("country", at).alias("country"))


def entity_links(ip_links: DataFrame) -> DataFrame:
    """a, b (a < b), shared_ips: entities that use the same address. Output grows with the square of an address's users by
    definition; the join is one that adaptive execution can split."""
    a = ip_links.select("src_ip", F.col("entity_id").alias("a"))
    b = ip_links.select("src_ip", F.col("entity_id").alias("b"))
    return a.join(b, "src_ip").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared_ips"))


def correlation_findings(entities: DataFrame, inputs: DataFrame, flows: DataFrame, many_countries: int = MANY_COUNTRIES, many_asns: int = MANY_ASNS, port: int = USUAL_PORT, spends: DataFrame | None = None, uses: DataFrame | None = None) -> DataFrame:
    """finding, entity_id, subject, n: addresses of several entities (at the least of them), entities with many
    countries or ASNs, entities with unusual ports (subject: the sorted ports; 0 and null do not count).
    All count distinct values, so each joins a transaction's distinct values alone; with ``uses`` (of entity_uses) nothing is joined."""
    unusual = (F.col("dst_port") != 0) & (F.col("dst_port") != port)
    if uses is None:
        spends = entity_transactions(entities, inputs, spends)
        seen = lambda c, some=F.lit(True): spends.join(flows.where(some).select("transaction_id", c).distinct(), "transaction_id").select("entity_id", c).distinct()
    else:
        seen = lambda c, some=F.lit(True): uses.where(some).select("entity_id", c).distinct()
    row = lambda name, subject: [F.lit(name).alias("finding"), "entity_id", subject.alias("subject"), "n"]
    ip = seen("src_ip", F.col("src_ip").isNotNull()).groupBy("src_ip").agg(F.count("entity_id").alias("n"), F.min("entity_id").alias("entity_id")).where("n >= 2")
    none = F.lit(None).cast("string")
    if uses is None:
        countries = seen("country").groupBy("entity_id").agg(F.count("country").alias("n"))
        asns = seen("asn").groupBy("entity_id").agg(F.count("asn").alias("n"))
        ports = seen("dst_port", unusual).groupBy("entity_id").agg(F.array_sort(F.collect_set("dst_port")).alias("ports"))
    else:  # few distinct values each, which are put together where the rows are
        odd = uses.select("entity_id", "country", "asn", F.explode_outer("ports").alias("dst_port")).withColumn("dst_port", F.when(unusual, F.col("dst_port")))
        sets = odd.groupBy("entity_id").agg(*[F.collect_set(c).alias(c) for c in ("country", "asn", "dst_port")])
        sets = sets.where((F.size("country") >= many_countries) | (F.size("asn") >= many_asns) | (F.size("dst_port") > 0))
        sets = written(sets, "entity-sets")
        countries, asns = (sets.select("entity_id", F.size(c).cast("long").alias("n")) for c in ("country", "asn"))
        ports = sets.where(F.size("dst_port") > 0).select("entity_id", F.array_sort("dst_port").alias("ports"))
    countries, asns = countries.where(F.col("n") >= many_countries), asns.where(F.col("n") >= many_asns)
    ports = ports.withColumn("n", F.size("ports").cast("long"))
    return (
        ip.select(*row("ip_used_by_several_entities", F.col("src_ip")))
        .unionAll(countries.select(*row("entity_many_countries", none)))
        .unionAll(asns.select(*row("entity_many_asns", none)))
        .unionAll(ports.select(*row("entity_unusual_port", F.array_join(F.transform("ports", lambda p: p.cast("string")), ","))))
    )


def wallet_entities(entities: DataFrame, inputs: DataFrame, flows: DataFrame, spends: DataFrame | None = None, uses: DataFrame | None = None) -> DataFrame:
    """wallet, entity_id: entities whose addresses a wallet's sent transactions spend; ``uses`` as in correlation_findings."""
    if uses is not None:
        return uses.select(F.col("sender").alias("wallet"), "entity_id").distinct()
    senders = flows.select("transaction_id", F.col("sender").alias("wallet")).distinct()
    return entity_transactions(entities, inputs, spends).join(senders, "transaction_id").select("wallet", "entity_id").distinct()


def entity_truth(entities: DataFrame, owners: DataFrame) -> DataFrame:
    """One row: mean share of an entity's main owner (purity) and of an owner's main entity (completeness), for
    owners (address, owner)."""
    return owned_truth(entities.join(owners, "address"))


def owned_truth(owned: DataFrame) -> DataFrame:
    """The same of addresses (entity_id, owner) that come with their owner."""
    j = owned.groupBy("entity_id", "owner").agg(F.count("*").alias("n"))
    share = lambda k: j.groupBy(k).agg((F.max("n") / F.sum("n")).alias("s")).agg(F.avg("s"))
    return share("entity_id").toDF("purity").crossJoin(share("owner").toDF("completeness"))


def utxo_transfers(transactions: DataFrame) -> DataFrame:
    """transaction_id, ts, sender, receiver, amount, input_count, output_count, or a skip_reason, from explorer
    transactions (txid, status, vin, vout with values in satoshis).

    The sender is the address of the largest input total (ties: the smaller address). Change and outputs without
    an address are dropped, outputs to one receiver are summed; the id ends with its first output index."""
    coinbase = F.exists("vin", lambda v: F.coalesce(v["is_coinbase"], F.lit(False)))
    paid = F.filter(F.transform("vin", lambda v: v["prevout"]), lambda p: p["scriptpubkey_address"].isNotNull())
    t = transactions.withColumn("paid", paid).withColumn(
        "skip", F.when(~F.coalesce(F.col("status.confirmed"), F.lit(False)), "unconfirmed").when(coinbase, "coinbase").when(F.size("paid") == 0, "no input address")
    )
    # Both sides' sums come from one pass over a transaction's rows; all that follows stays where its transaction is.
    ins = F.transform("paid", lambda p: F.struct(p["scriptpubkey_address"].alias("address"), F.lit(True).alias("pays"), p["value"].alias("paid"), F.lit(None).cast("long").alias("got"), F.lit(None).cast("int").alias("pos")))
    outs = F.transform("vout", lambda o, i: F.struct(o["scriptpubkey_address"].alias("address"), F.lit(False).alias("pays"), F.lit(None).cast("long").alias("paid"), o["value"].alias("got"), i.alias("pos")))
    outs = F.filter(outs, lambda o: o["address"].isNotNull() & (o["got"] > 0))
    when = F.from_unixtime("status.block_time").cast("timestamp_ntz").alias("ts")
    some = t.where("skip is null").select("txid", when, F.size("vin").alias("input_count"), F.size("vout").alias("output_count"), F.inline(F.concat(ins, F.coalesce(outs, F.array()))))
    some = some.groupBy("txid", "ts", "input_count", "output_count", "address").agg(F.bool_or("pays").alias("pays"), F.sum("paid").alias("paid"), F.sum("got").alias("v"), F.min("pos").alias("pos"))
    whole, each = W.partitionBy("txid"), W.partitionBy("txid", "address")
    some = some.withColumn("paid", F.sum("paid").over(each)).withColumn("pays", F.max("pays").over(each))
    some = some.withColumn("sender", F.min_by("address", F.when(F.col("pays"), F.struct((-F.col("paid")).alias("v"), "address"))).over(whole))
    outs = some.where("pos is not null and not pays").withColumnRenamed("address", "receiver")
    made = outs.where("txid is not null").select(
        F.concat_ws(":", F.lit("btc"), "txid", F.col("pos").cast("string")).alias("transaction_id"), "ts", "sender", "receiver", (F.col("v") / 1e8).alias("amount"), "input_count", "output_count", F.lit(None).cast("string").alias("skip_reason"), "txid",
    )
    empty = t.where("skip is null").join(outs.select("txid").distinct(), "txid", "left_anti").select("txid", F.lit("no external output").alias("skip_reason"))
    # never null, which lets this side go where only what was made is asked for
    skipped = t.where("skip is not null").select("txid", F.coalesce("skip", F.lit("")).alias("skip_reason")).unionAll(empty)
    return made.unionByName(skipped, allowMissingColumns=True)
