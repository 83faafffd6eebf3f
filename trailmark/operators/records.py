"""Listings and details of what the analysis left behind: leads, wallets, clusters, entities, patterns, observations, cases.

Listings filter, sort in a total order and cut a page (a top-k, no full sort). Details are joins that one id narrows down;
nested lists are sorted and whole; ``key_profile`` alone lists a stated number of the first values, beside how many there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions.scalars import contains_text
from trailmark.operators.entities import entity_transactions, wallet_entities
from trailmark.operators.fusion import ordinal
from trailmark.operators.listing import list_transfers, related_wallets

UNSCORED = "Not scored: fewer than two transfers, or an undefined feature."


def _where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    return reduce(lambda d, c: d if c is None else d.where(c), conditions, df)


def _page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def _equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == value


def total(df: DataFrame) -> DataFrame:
    """One row: how many rows a listing has over all its pages."""
    return df.agg(F.count("*").alias("total"))


# ---- leads and wallets ----------------------------------------------------------------------------------------------------
def find_leads(leads: DataFrame, q: str | None = None, level: str | None = None, prediction: str | None = None, least: float | None = None, source: str | None = None) -> DataFrame:
    return _where(leads, contains_text("wallet", q) if q else None, _equals("priority_level", level), _equals("anomaly_prediction", prediction), None if least is None else F.col("combined_score") >= least, _equals("source", source))


def list_leads(leads: DataFrame, sort: str = "priority_rank", descending: bool = False, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """A page of leads by priority_rank, combined_score, ml_score, first_flagged_at or wallet; ties go by wallet upwards."""
    if sort not in ("priority_rank", "combined_score", "ml_score", "first_flagged_at", "wallet"):
        raise ValueError(f"leads are not sorted by {sort}")
    return _page(find_leads(leads, **filters), [F.desc(sort) if descending else F.asc(sort), F.asc("wallet")], limit, offset)


def wallet_analysis(wallets: DataFrame, ranked: DataFrame, leads: DataFrame) -> DataFrame:
    """Every wallet with its scores and rank, whether it was scored, why not, and whether it is a lead."""
    scores = ranked.select("wallet", "ml_score", "anomaly_prediction", "forensic_score", "rule_count", "evidence_level", "combined_score", "priority_rank", "priority_level", F.lit(True).alias("_scored"))
    j = wallets.select("wallet").join(scores, "wallet", "left").join(leads.select("wallet", F.lit(True).alias("_lead")).distinct(), "wallet", "left")
    scored = F.coalesce("_scored", F.lit(False))
    return j.select("wallet", scored.alias("scored"), F.when(~scored, UNSCORED).alias("unscored_reason"), *scores.columns[1:-1], F.coalesce("_lead", F.lit(False)).alias("is_lead"))


def bulk_analysis(ranked: DataFrame, features: DataFrame, findings: DataFrame, leads: DataFrame, status: DataFrame) -> DataFrame:
    """Every scored wallet: scores, rules and sentences in the order of the rules, lead state and reasons, review status, cases
    and features (a struct). Findings are at most one per rule, so their lists are bounded."""
    rows = F.array_sort(F.collect_list(F.struct("position", "rule", "text")))
    found = findings.groupBy("wallet").agg(rows.alias("f")).select("wallet", F.col("f.rule").alias("rules"), F.col("f.text").alias("findings"))
    feats = features.select("wallet", F.struct(*[c for c in features.columns if c != "wallet"]).alias("features"))
    j = ranked.select("wallet", "ml_score", "anomaly_prediction", "forensic_score", "rule_count", "evidence_level", "combined_score", "priority_rank", "priority_level").join(feats, "wallet").join(found, "wallet", "left")
    j = j.join(leads.select("wallet", "reasons"), "wallet", "left").join(status, "wallet", "left")
    none = F.array().cast("array<string>")
    return j.withColumns({"is_lead": F.col("reasons").isNotNull(), "rules": F.coalesce("rules", none), "findings": F.coalesce("findings", none), "reasons": F.coalesce("reasons", none), "status": F.coalesce("status", F.lit("Unreviewed"))})


def lead_detail(wallet: str, leads: DataFrame, findings: DataFrame, features: DataFrame, transfers: DataFrame, limit: int = 10) -> DataFrame:
    """One row for a lead: its lead row, its findings, its features, its latest transfers and its closest partners."""
    mine = lambda df: df.where(F.col("wallet") == wallet)
    rows = lambda df, *order: df.agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order]))).alias("x"))
    found = rows(mine(findings).drop("wallet"), "position").select(F.col("x").alias("findings"))
    last = list_transfers(transfers, "ts", True, limit, wallet=wallet)
    last = last.agg(F.sort_array(F.collect_list(F.struct("ts", "transaction_id", "sender", "receiver", "amount")), False).alias("transfers"))
    near = related_wallets(transfers, wallet, limit).agg(F.array_sort(F.collect_list(F.struct((-F.col("transfers")).alias("_n"), (-F.col("amount")).alias("_a"), "partner", "transfers", "sent_count", "received_count", "amount"))).alias("partners"))
    near = near.select(F.transform("partners", lambda p: p.dropFields("_n", "_a")).alias("partners"))
    feats = mine(features).select(F.struct(*[c for c in features.columns if c != "wallet"]).alias("features"))
    out = mine(leads)
    for part in (feats, found, last, near):  # one row each
        out = out.join(F.broadcast(part), F.lit(True), "left")
    return out


def wallet_info(wallets: DataFrame, ranked: DataFrame, leads: DataFrame, transfers: DataFrame) -> DataFrame:
    """What graph nodes and member lists say of wallets: transfers, scores and lead state."""
    sides = transfers.select(F.explode(F.array("sender", "receiver")).alias("wallet")).join(wallets.select("wallet").distinct(), "wallet", "left_semi").groupBy("wallet").agg(F.count("*").alias("transaction_count"))
    analysis = wallet_analysis(wallets.select("wallet").distinct(), ranked, leads)
    return analysis.join(sides, "wallet", "left").select("wallet", F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"), "anomaly_prediction", "combined_score", "priority_rank", "priority_level", "is_lead")


def anomaly_table(ranked: DataFrame, leads: DataFrame, status: DataFrame, chain_wallets: DataFrame, scope: str = "flagged", review: str | None = None, evidence: str | None = None, level: str | None = None, q: str | None = None, peeling_only: bool = False, sort: str = "priority_rank", descending: bool = False) -> DataFrame:
    """The scored wallets of a scope (leads, flagged, normal, all) under the filters, in order; ties go by priority."""
    j = ranked.join(leads.select("wallet", F.lit(True).alias("is_lead")), "wallet", "left").join(status.select("wallet", "status"), "wallet", "left")
    j = j.withColumns({"is_lead": F.coalesce("is_lead", F.lit(False)), "status": F.coalesce("status", F.lit("Unreviewed"))})
    flagged = F.col("anomaly_prediction") == "Anomalous"
    inside = {"leads": F.col("is_lead"), "flagged": flagged, "normal": ~flagged, "all": None}[scope]
    j = _where(j, inside, _equals("status", review), _equals("evidence_level", evidence), F.col("is_lead") & (F.col("priority_level") == level) if level else None, contains_text("wallet", q) if q else None)
    if peeling_only:
        j = j.join(chain_wallets.select("wallet").distinct(), "wallet", "left_semi")
    key = F.expr("CASE status WHEN 'Unreviewed' THEN 0 WHEN 'Under Review' THEN 1 ELSE 2 END") if sort == "status" else F.col(sort)
    return j.orderBy(key.desc() if descending else key.asc(), "priority_rank")


def key_figures(features: DataFrame, ranked: DataFrame, leads: DataFrame) -> DataFrame:
    """One row: flagged wallets, those of them with two rules or more, transfers, ledger rows, leads."""
    sums = features.agg(F.sum("outgoing_count").alias("transfers"), F.sum("transaction_count").alias("ledger_rows"))
    flagged = ranked.where("anomaly_prediction = 'Anomalous'").agg(F.count("*").alias("flagged"), F.count_if(F.col("rule_count") >= 2).alias("flagged_with_rules"))
    return sums.crossJoin(F.broadcast(flagged)).crossJoin(F.broadcast(leads.agg(F.count("*").alias("leads"))))


# ---- clusters, entities, patterns -------------------------------------------------------------------------------------------
def list_clusters(summary: DataFrame, members: DataFrame, least_wallets: int | None = None, has_leads: bool | None = None, q: str | None = None, sort: str = "priority", limit: int = 50, offset: int = 0, **equal) -> DataFrame:
    """A page of clusters (cluster_id, wallets, transactions, lead_count, max_score, ...) whose id or a member holds the text, by
    priority (leads, best score, size), size or id. Other keyword arguments are columns that must be equal (method, source)."""
    s = _where(summary, *[_equals(c, v) for c, v in equal.items()], None if least_wallets is None else F.col("wallets") >= least_wallets)
    if has_leads is not None:
        s = s.where((F.coalesce("lead_count", F.lit(0)) > 0) == F.lit(has_leads))
    if q:
        hit = members.where(contains_text("wallet", q)).select("cluster_id").distinct().withColumn("_hit", F.lit(True))
        s = s.join(hit, "cluster_id", "left").where(contains_text("cluster_id", q) | F.col("_hit").isNotNull()).drop("_hit")
    orders = {"priority": [F.desc(F.coalesce("lead_count", F.lit(0))), F.desc(F.coalesce("max_score", F.lit(0.0))), F.desc("wallets"), F.asc("cluster_id")], "size": [F.desc("wallets"), F.desc("transactions"), F.asc("cluster_id")], "id": [F.asc("cluster_id")]}
    return _page(s, orders[sort], limit, offset)


def cluster_members(clusters: DataFrame, info: DataFrame, cluster_id: str | None = None) -> DataFrame:
    """The wallets of one cluster (or all) with what is known of them, and their place by priority (unscored ones last). Places are
    ranks over range partitions less those of the clusters before, so a giant cluster is in no one task."""
    j = _where(clusters, _equals("cluster_id", cluster_id)).join(info, "wallet")
    ranked = ordinal(j, F.asc("cluster_id"), F.asc_nulls_last("priority_rank"), F.asc("wallet"), name="place")
    before = ranked.groupBy("cluster_id").agg((F.min("place") - 1).alias("_before"))
    return ranked.join(before, "cluster_id").withColumn("place", (F.col("place") - F.col("_before")).cast("int")).drop("_before")


def list_entities(stats: DataFrame, entities: DataFrame, ip_links: DataFrame, linked: DataFrame, least_addresses: int | None = None, country: str | None = None, asn: int | None = None, ip: str | None = None, wallet: str | None = None, q: str | None = None, sort: str = "size", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of entities by size, activity or id; ``linked`` (wallet, entity_id) narrows down to a sender's entities."""
    s = _where(stats, None if least_addresses is None else F.col("addresses") >= least_addresses, F.array_contains("countries", country.upper()) if country else None, None if asn is None else F.array_contains("asns", asn))
    if ip:
        s = s.join(ip_links.where(F.col("src_ip") == ip).select("entity_id").distinct(), "entity_id", "left_semi")
    if wallet:
        s = s.join(linked.where(F.col("wallet") == wallet).select("entity_id").distinct(), "entity_id", "left_semi")
    if q:
        hit = entities.where(contains_text("address", q)).select("entity_id").distinct().withColumn("_hit", F.lit(True))
        s = s.join(hit, "entity_id", "left").where(contains_text("entity_id", q.strip()) | F.col("_hit").isNotNull()).drop("_hit")
    orders = {"size": [F.desc("addresses"), F.desc("transactions"), F.asc("entity_id")], "activity": [F.desc(F.col("total_sent") + F.col("total_received")), F.asc("entity_id")], "id": [F.asc("entity_id")]}
    return _page(s, orders[sort], limit, offset)


def first_items(rows: DataFrame, group: str, item: str, name: str, most: int | None = None) -> DataFrame:
    """group, name (all distinct items, sorted, or the first ``most``), n (how many there are). Items are told apart in parts before
    they meet, and those beyond ``most`` go before that too."""
    each = rows.select(group, item).distinct()
    if most is None:
        return each.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias(name), F.count("*").alias("n"))
    top = each.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(item))).where(F.col("_k") <= most)
    return top.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias(name)).join(each.groupBy(group).agg(F.count("*").alias("n")), group)


def linked_wallets(entities: DataFrame, inputs: DataFrame, flows: DataFrame, spends: DataFrame | None = None) -> DataFrame:
    """entity_id, wallets (sorted), n: all who sent the transactions that an entity spends in."""
    return first_items(wallet_entities(entities, inputs, flows, spends), "entity_id", "wallet", "wallets")


def entity_detail(entity_id: str, stats: DataFrame, entities: DataFrame, inputs: DataFrame, flows: DataFrame, ip_links: DataFrame, links: DataFrame, findings: DataFrame, spends: DataFrame | None = None) -> DataFrame:
    """One row for an entity: its statistics, addresses, transactions spent in, wallets, addresses of flows, related entities and
    findings; each list is whole and sorted, and <name>_count says how many there are. ``spends`` as in entity_stats."""
    mine = lambda df: df.where(F.col("entity_id") == entity_id)

    def whole(df: DataFrame, item, name: str) -> DataFrame:
        each = df.select("entity_id", F.col(item).alias("x") if isinstance(item, str) else item.alias("x")).distinct()
        return each.groupBy("entity_id").agg(F.array_sort(F.collect_list("x")).alias(name), F.count("*").alias(f"{name}_count"))

    one = F.col("a") == entity_id
    near = links.where(one | (F.col("b") == entity_id)).select(F.when(one, F.col("a")).otherwise(F.col("b")).alias("entity_id"), F.when(one, F.col("b")).otherwise(F.col("a")).alias("other"))
    spent = mine(entity_transactions(mine(entities), inputs, spends))
    parts = {
        "members": whole(mine(entities), "address", "members"), "spending_transactions": whole(spent, "transaction_id", "spending_transactions"),
        "linked_wallets": whole(wallet_entities(mine(entities), inputs, flows, spent), "wallet", "linked_wallets"),
        "ip_links": whole(mine(ip_links), F.struct("src_ip", "transactions", "first_seen", "last_seen", "asn", "country"), "ip_links"),
        "related_entities": whole(near, "other", "related_entities"), "findings": whole(mine(findings), F.struct("finding", "subject", "n"), "findings"),
    }
    out = mine(stats)
    for name, part in parts.items():  # a row each, joined by the entity: a long list is not sent to all tasks
        out = out.join(part, "entity_id", "left").withColumns({name: F.coalesce(name, F.array().cast(part.schema[name].dataType)), f"{name}_count": F.coalesce(f"{name}_count", F.lit(0))})
    return out


def list_chains(chains: DataFrame, hops: DataFrame, wallet: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of peeling chains, longest first, with all wallets of their hops; of one wallet, if given."""
    ends = hops.select("chain_id", F.explode(F.array("from_wallet", "to_wallet")).alias("wallet"))
    some = chains if wallet is None else chains.join(ends.where(F.col("wallet") == wallet).select("chain_id").distinct(), "chain_id", "left_semi")
    page = _page(some, [F.desc("hop_count"), F.asc("chain_id")], limit, offset)
    names = first_items(ends.join(F.broadcast(page.select("chain_id")), "chain_id", "left_semi"), "chain_id", "wallet", "wallets")
    return page.join(names.drop("n"), "chain_id")


def list_coinjoins(candidates: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return _page(candidates, [F.desc("score"), F.asc("transaction_id")], limit, offset)


def list_confidence(scores: DataFrame, least: float | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    return _page(_where(scores, None if least is None else F.col("confidence") >= least), [F.desc("confidence"), F.asc("wallet")], limit, offset)


# ---- observations, transactions, cases ---------------------------------------------------------------------------------------
def observed_party() -> Column:
    """Which party of the transfer an observation saw, from the end of its id."""
    end = F.substring("observation_id", -2, 2)
    return F.when(end == "-S", "sender").when(end == "-R", "receiver")


def list_observations(observations: DataFrame, limit: int = 50, offset: int = 0, **equal) -> DataFrame:
    """A page of observations, latest first; keyword arguments are columns that must be equal."""
    page = _page(_where(observations, *[_equals(c, v) for c, v in equal.items()]), [F.desc("observed_at"), F.asc("observation_id")], limit, offset)
    return page.withColumn("observed_party", observed_party())


def key_profile(observations: DataFrame, key: str, related: tuple[str, ...], most: int = 50) -> DataFrame:
    """Per value of a key column (address, device, session): observations, wallets, transactions, first and last time, how many
    values of the related columns go with it, and the least ``most`` of them."""
    o = observations.where(F.col(key).isNotNull())
    base = o.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("wallet").alias("wallets"), F.count_distinct("transaction_id").alias("transactions"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))
    for column in related:
        pairs = o.where(F.col(column).isNotNull()).select(key, column).distinct()
        count = pairs.groupBy(key).agg(F.count("*").alias(f"{column}_count"))
        least = pairs.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(column))).where(F.col("k") <= most).groupBy(key).agg(F.array_sort(F.collect_list(column)).alias(f"{column}_list"))
        base = base.join(count, key, "left").join(least, key, "left")
    return base


def device_state(observations: DataFrame) -> DataFrame:
    """What live observation goes on from: per wallet its latest device, and that device's commonest address and latest time."""
    at = F.struct("observed_at", "observation_id")
    latest = observations.where("device_id is not null").groupBy("wallet").agg(F.max_by("device_id", at).alias("device_id"))
    uses = observations.where("device_id is not null").groupBy("device_id", "ip_address").agg(F.count("*").alias("n"), F.max("observed_at").alias("last_at"))
    best = uses.groupBy("device_id").agg(F.min_by("ip_address", F.struct((-F.col("n")).alias("n"), "ip_address")).alias("ip_address"), F.max("last_at").alias("last_at"))
    return latest.join(best, "device_id").select("wallet", "device_id", "ip_address", "last_at")


def transaction_details(inputs: DataFrame, outputs: DataFrame, flows: DataFrame) -> DataFrame:
    """transaction_id, inputs and outputs (address and amount in the order of position; a transaction's own, so bounded by it) and the
    flow of the least port, if there is one."""
    side = lambda df, name: df.groupBy("transaction_id").agg(F.array_sort(F.collect_list(F.struct("position", "address", "amount"))).alias(name))
    flow = flows.groupBy("transaction_id").agg(F.min(F.struct("dst_port", "src_ip", "country", "asn")).alias("flow"))
    return side(inputs, "inputs").join(side(outputs, "outputs"), "transaction_id", "full_outer").join(flow, "transaction_id", "left")


def source_counts(**tables: DataFrame) -> DataFrame:
    """name, source, n: rows per source of each table that has one."""
    rows = [df.groupBy("source").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "source", "n") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, rows)


def list_cases(cases: DataFrame, items: DataFrame, status: str | None = None, priority: str | None = None, q: str | None = None, item_id: str | None = None, item_type: str | None = None, sort: str = "updated_at", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of cases (case_id, title, description, status, priority, created_at, updated_at); the text may be part of the id, title,
    description or an item (case_id, item_type, item_id)."""
    c = _where(cases, _equals("status", status), _equals("priority", priority))
    if q:
        hit = items.where(contains_text("item_id", q)).select("case_id").distinct().withColumn("_hit", F.lit(True))
        here = reduce(lambda a, b: a | b, [F.coalesce(contains_text(x, q), F.lit(False)) for x in ("case_id", "title", "description")])
        c = c.join(hit, "case_id", "left").where(here | F.col("_hit").isNotNull()).drop("_hit")
    if item_id:
        own = _where(items.where(F.col("item_id") == item_id), _equals("item_type", item_type))
        c = c.join(own.select("case_id").distinct(), "case_id", "left_semi")
    return _page(c, [F.desc(sort) if descending else F.asc(sort), F.asc("case_id")], limit, offset)


def case_transfers(items: DataFrame, transfers: DataFrame) -> DataFrame:
    """case_id, transaction_id, ts, amount: the transfers of a case's wallets and those added to it themselves, once each."""
    wallets = items.where("item_type in ('wallet', 'lead')").select("case_id", F.col("item_id").alias("wallet"))
    sides = transfers.select("transaction_id", "ts", "amount", F.explode(F.array("sender", "receiver")).alias("wallet")).join(wallets, "wallet")
    own = items.where("item_type = 'transaction'").select("case_id", F.col("item_id").alias("transaction_id")).join(transfers, "transaction_id")
    columns = ["case_id", "transaction_id", "ts", "amount"]
    return sides.select(*columns).unionAll(own.select(*columns)).distinct()


def case_summary(items: DataFrame, transfers: DataFrame) -> DataFrame:
    """case_id, total, moved, first_at, last_at of a case's transfers."""
    return case_transfers(items, transfers).groupBy("case_id").agg(F.count("*").alias("total"), F.sum("amount").alias("moved"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def case_seeds(items: DataFrame, clusters: DataFrame, transfers: DataFrame, linked: DataFrame) -> DataFrame:
    """case_id, wallet: the wallets to draw for a case: its own, its clusters' members, its transactions' parties, and the senders
    linked (wallet, entity_id) to its entities."""
    of = lambda *kinds: items.where(F.col("item_type").isin(*kinds)).select("case_id", "item_id")
    parts = [
        of("wallet", "lead").select("case_id", F.col("item_id").alias("wallet")), of("cluster").join(clusters.withColumnRenamed("cluster_id", "item_id"), "item_id").select("case_id", "wallet"),
        of("transaction").join(transfers.withColumnRenamed("transaction_id", "item_id"), "item_id").select("case_id", F.explode(F.array("sender", "receiver")).alias("wallet")),
        of("entity").join(linked.withColumnRenamed("entity_id", "item_id"), "item_id").select("case_id", "wallet"),
    ]
    return reduce(DataFrame.unionAll, parts).distinct()


def purge_source(spark, folder: str, tables: tuple[str, ...], source: str) -> list[str]:
    """Delete the ``source=`` partitions of the given tables (in the given order, dependants first); other tables, such as cases, stay.
    Returns the tables that had any."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf, gone = spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in tables:
        at = path(f"{folder}/{name}/source={source}")
        if at.getFileSystem(conf).delete(at, True):
            gone.append(name)
    return gone
