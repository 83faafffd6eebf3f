"""Listing, search, geographic and chart queries. Filters are plain predicates, so that scans can push them down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions.scalars import contains_text, micros
from trailmark.operators.features import legs
from trailmark.operators.ranks import cumulative


def transfer_filter(q: str | None = None, sender=None, receiver=None, wallet=None, least=None, most=None, after=None, before=None, source=None) -> Column:
    """All given conditions; text is a literal part of the id or of either wallet, ranges are inclusive."""
    conds = [F.lit(True)]
    if q:
        conds.append(contains_text("transaction_id", q) | contains_text("sender", q) | contains_text("receiver", q))
    if wallet:
        conds.append((F.col("sender") == wallet) | (F.col("receiver") == wallet))
    pairs = ((sender, "sender", "__eq__"), (receiver, "receiver", "__eq__"), (least, "amount", "__ge__"), (most, "amount", "__le__"), (source, "source", "__eq__"))
    conds += [getattr(F.col(c), op)(v) for v, c, op in pairs if v is not None]
    if after is not None:
        conds.append(F.col("ts") >= F.lit(after).cast("timestamp_ntz"))
    if before is not None:
        conds.append(F.col("ts") <= F.lit(before).cast("timestamp_ntz"))
    return reduce(lambda a, b: a & b, conds)


def page(df: DataFrame, by: str, key: str, descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in a total order: ties go by key in the same direction (a top-k, no full sort)."""
    d = F.desc if descending else F.asc
    return df.orderBy(d(by), d(key)).offset(offset).limit(limit)


def list_transfers(transfers: DataFrame, sort: str = "ts", descending: bool = True, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    return page(transfers.where(transfer_filter(**filters)), sort, "transaction_id", descending, limit, offset)


def wallet_stats(transfers: DataFrame) -> DataFrame:
    """wallet, sent_count, sent, received_count, received, first_seen, last_seen, in one conditional aggregation."""
    out = F.col("direction") == "Outgoing"
    return legs(transfers).groupBy("wallet").agg(
        F.count_if(out).alias("sent_count"), F.sum(F.when(out, F.col("amount")).otherwise(0.0)).alias("sent"),
        F.count_if(~out).alias("received_count"), F.sum(F.when(~out, F.col("amount")).otherwise(0.0)).alias("received"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )


def wallet_partners(transfers: DataFrame) -> DataFrame:
    return legs(transfers).groupBy("wallet").agg(F.count_distinct("counterparty").alias("partners"))


def related_wallets(transfers: DataFrame, wallet: str, limit: int = 10) -> DataFrame:
    """The partners of a wallet by transfers, amount, id."""
    mine = transfers.where((F.col("sender") == wallet) | (F.col("receiver") == wallet))
    other = F.when(F.col("sender") == wallet, F.col("receiver")).otherwise(F.col("sender"))
    got = mine.groupBy(other.alias("partner")).agg(F.count("*").alias("transfers"), F.count_if(F.col("sender") == wallet).alias("sent_count"), F.count_if(F.col("receiver") == wallet).alias("received_count"), F.sum("amount").alias("amount"))
    return got.orderBy(F.desc("transfers"), F.desc("amount"), "partner").limit(limit)


def pair_flows(transfers: DataFrame) -> DataFrame:
    """a, b (a < b), forward and backward counts and amounts per unordered pair."""
    fwd = F.col("sender") < F.col("receiver")
    return transfers.groupBy(F.least("sender", "receiver").alias("a"), F.greatest("sender", "receiver").alias("b")).agg(
        F.count_if(fwd).alias("forward"), F.count_if(~fwd).alias("backward"), F.sum(F.when(fwd, F.col("amount")).otherwise(0.0)).alias("forward_amount"), F.sum(F.when(~fwd, F.col("amount")).otherwise(0.0)).alias("backward_amount")
    )


def busy_wallets(transfers: DataFrame, least: int = 2) -> DataFrame:
    got = legs(transfers).groupBy("wallet").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    return got.where(F.col("n") >= least)


def overview(transfers: DataFrame) -> DataFrame:
    return transfers.agg(F.count("*").alias("transfers"), F.count_distinct("sender").alias("senders"), F.count_distinct("receiver").alias("receivers"), F.sum("amount").alias("amount"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def wallet_geo(flows: DataFrame) -> DataFrame:
    """wallet, kind (country, asn), value, transactions."""
    pairs = F.explode(F.array(F.struct(F.lit("country").alias("kind"), F.col("country").alias("value")), F.struct(F.lit("asn").alias("kind"), F.col("asn").cast("string").alias("value"))))
    rows = flows.select(F.col("sender").alias("wallet"), "transaction_id", pairs.alias("p")).select("wallet", "transaction_id", "p.*").where("value is not null")
    return rows.groupBy("wallet", "kind", "value").agg(F.count_distinct("transaction_id").alias("transactions"))


def geo_summary(flows: DataFrame, wallets: DataFrame, limit: int = 10) -> DataFrame:
    """The countries of the given wallets' transactions by number of transactions, then name."""
    mine = flows.join(wallets.select(F.col("wallet").alias("sender")).distinct(), "sender", "left_semi").where("country is not null")
    return mine.groupBy("country").agg(F.count_distinct("transaction_id").alias("transactions")).orderBy(F.desc("transactions"), "country").limit(limit)


def geoip(rows: DataFrame, ranges: DataFrame, ip: str = "src_ip", bits: int = 16) -> DataFrame:
    """Joins IPv4 addresses to the longest of the ranges (start, end: 32-bit numbers, and attributes) that hold them.

    Ranges are cut at /16 borders, so the join is an equality on the upper half with a range test: no nested loop, and no
    assumption about the size of the range table."""
    from trailmark.functions.scalars import ipv4_number

    upper = 32 - bits
    cut = ranges.withColumn("_net", F.explode(F.sequence(F.shiftright("start", upper), F.shiftright("end", upper))))
    attrs = [c for c in ranges.columns if c not in ("start", "end")]
    # each distinct address is looked up once and joined back by itself
    seen = rows.select(F.col(ip).alias("_ip")).where("_ip is not null").distinct().withColumn("_n", ipv4_number("_ip"))
    hit = seen.withColumn("_net", F.shiftright("_n", upper)).join(cut, "_net").where("_n between start and end")
    best = hit.groupBy("_ip").agg(F.min_by(F.struct(*attrs), F.struct((F.col("end") - F.col("start")).alias("w"), "start")).alias("_g"))
    return rows.join(best, rows[ip] == best["_ip"], "left").select(*[rows[c] for c in rows.columns], *[F.col(f"_g.{a}").alias(a) for a in attrs])


def longest_prefix(rows: DataFrame, prefixes: DataFrame, ip: str = "src_ip", public_only: bool = True) -> DataFrame:
    """Joins IPv4 and IPv6 addresses to the longest of the prefixes (network such as 10.0.0.0/8 or 2001:db8::/32, and attributes) that
    holds each. Addresses that are none, or (``public_only``) not public, get nulls; of equal prefixes the least attributes hold.

    An address has one key for each length that occurs among the prefixes of its version (162 at most), so the join is one hash join
    on a prefix's bits. Each distinct address is looked up once."""
    from trailmark.functions.scalars import address_bits

    attrs = [c for c in prefixes.columns if c != "network"]
    parts = F.split("network", "/")
    nets = prefixes.withColumn("_b", address_bits(parts[0])).withColumn("_n", F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.length("_b.bits") - 1))
    nets = nets.where(F.col("_n").between(0, F.length("_b.bits") - 1)).select(F.substring("_b.bits", F.lit(1), F.col("_n") + 1).alias("_key"), F.struct(*attrs).alias("_g"))
    nets = nets.groupBy("_key").agg(F.min("_g").alias("_g"))
    lengths = nets.groupBy(F.substring("_key", 1, 1).alias("_version")).agg(F.collect_set(F.length("_key")).alias("_lengths"))
    seen = rows.select(F.col(ip).alias("_ip")).where("_ip is not null").distinct().withColumn("_b", address_bits("_ip")).where("_b.bits is not null")
    if public_only:
        seen = seen.where("_b.is_global")
    seen = seen.withColumn("_version", F.substring("_b.bits", 1, 1)).join(F.broadcast(lengths), "_version")
    keys = seen.select("_ip", F.explode(F.transform("_lengths", lambda n: F.substring(F.col("_b.bits"), F.lit(1), n))).alias("_key"))
    best = keys.join(nets, "_key").groupBy("_ip").agg(F.max_by("_g", F.length("_key")).alias("_g"))
    return rows.join(best, rows[ip] == best["_ip"], "left").select(*[rows[c] for c in rows.columns], *[F.col(f"_g.{a}").alias(a) for a in attrs])


def search(transfers: DataFrame, observations: DataFrame, q: str, limit: int = 10, clusters: DataFrame | None = None, cases: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """category, value, n (how many rows hold it), total (matches in the category): exact matches first, then by value.

    Transactions, wallets, addresses, devices and (if there are any) sessions match by their ids; clusters (cluster_id, wallet) by
    id or member, with n members; cases (case_id, title) by id, title or item, with n items."""

    def hits(df: DataFrame, category: str, column: str, count) -> DataFrame:
        return df.where(contains_text(column, q)).groupBy(F.col(column).alias("value")).agg(count.alias("n")).select(F.lit(category).alias("category"), "value", "n")

    def named(df: DataFrame, category: str, key: str, match: DataFrame, rows: DataFrame) -> DataFrame:
        ids = df.select(key).join(match.select(key).distinct(), key, "left_semi").distinct()
        return ids.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(F.lit(category).alias("category"), F.col(key).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))

    one = F.count("*")
    sides = transfers.select(F.explode(F.array("sender", "receiver")).alias("wallet"))
    rows = [hits(transfers, "transaction", "transaction_id", one), hits(sides, "wallet", "wallet", one)]
    kinds = [("ip", "ip_address"), ("device", "device_id"), ("session", "session_id")]
    rows += [hits(observations, kind, column, F.count_distinct("wallet")) for kind, column in kinds if column in observations.columns]
    if clusters is not None:
        rows.append(named(clusters, "cluster", "cluster_id", clusters.where(contains_text("cluster_id", q) | contains_text("wallet", q)), clusters))
    if cases is not None and items is not None:
        match = cases.where(contains_text("case_id", q) | contains_text("title", q)).select("case_id").unionAll(items.where(contains_text("item_id", q)).select("case_id"))
        rows.append(named(cases, "case", "case_id", match, items))
    every = reduce(DataFrame.unionAll, rows)
    totals = every.groupBy("category").agg(F.count("*").alias("total"))
    order = F.struct(F.when(F.lower("value") == q.lower(), 0).otherwise(1).alias("o"), F.col("value"))
    top = every.withColumn("k", F.row_number().over(W.partitionBy("category").orderBy(order))).where(F.col("k") <= limit).drop("k")
    return top.join(totals, "category")


def device_profile(observations: DataFrame) -> DataFrame:
    """Per device: observations, wallets, addresses."""
    return observations.groupBy("device_id").agg(F.count("*").alias("n"), F.count_distinct("wallet").alias("wallets"), F.count_distinct("ip_address").alias("ips"))


def score_histogram(scores: DataFrame, column: str, width: float = 0.025, start: float = 0.0) -> DataFrame:
    return scores.groupBy(F.floor((F.col(column) - F.lit(start)) / F.lit(width)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def weekly_activity(transfers: DataFrame, flagged: DataFrame) -> DataFrame:
    """week (from the first day's midnight, 0-based), flagged, other; a trailing part of a week is left out."""
    mark = flagged.select("wallet").distinct()
    t = transfers.select("transaction_id", "sender", "receiver", micros("ts").alias("us"))
    span = t.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).select((F.floor(F.col("lo") / 86_400_000_000) * 86_400_000_000).alias("zero"), "hi")
    for side in ("sender", "receiver"):
        t = t.join(mark.select(F.col("wallet").alias(side), F.lit(True).alias(f"{side}_flag")), side, "left")
    week = 7 * 86_400_000_000
    t = t.crossJoin(F.broadcast(span)).withColumn("week", F.floor((F.col("us") - F.col("zero")) / week))
    t = t.where((F.col("week") + 1) * week + F.col("zero") <= F.col("hi") + 1)
    hit = F.coalesce("sender_flag", F.lit(False)) | F.coalesce("receiver_flag", F.lit(False))
    return t.groupBy("week").agg(F.count_if(hit).alias("flagged"), F.count_if(~hit).alias("other"))


def percentile_rank(values: DataFrame, column: str) -> DataFrame:
    """wallet, value, percent of wallets with a value at most as high."""
    ranks = cumulative(values, [column]).select("value", (100.0 * F.col("upto") / F.col("total")).alias("percent"))
    return values.select("wallet", F.col(column).cast("double").alias("value")).join(ranks, "value").select("wallet", "value", "percent")


def descending_rank(values: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """wallet, value, n (of all), and the value's rank from the highest down (ties share the least rank)."""
    ranks = cumulative(values, [column]).select("value", F.col("total").alias("n"), (F.col("total") - F.col("upto") + 1).alias(name))
    return values.select("wallet", F.col(column).cast("double").alias("value")).join(ranks, "value").select("wallet", "value", "n", name)


def standout_features(features: DataFrame, columns: list[str], share: float = 0.9) -> DataFrame:
    """wallet, feature, value, percent: the features of a wallet whose value lies in the population's top tenth (at or above
    ``share`` of all values), in rows."""
    ranks = cumulative(features, columns).where(F.col("upto") >= F.lit(share) * F.col("total")).select(F.col("name").alias("feature"), "value", (100.0 * F.col("upto") / F.col("total")).alias("percent"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    return features.select("wallet", pairs.alias("p")).select("wallet", "p.*").join(ranks, ["feature", "value"])


def evidence_matrix(fusion: DataFrame) -> DataFrame:
    """evidence_level by prediction counts."""
    return fusion.groupBy("evidence_level").pivot("anomaly_prediction", ["Anomalous", "Normal"]).count().fillna(0).withColumnsRenamed({"Anomalous": "anomalous", "Normal": "normal"})


def ego_graph(transfers: DataFrame, wallet: str, limit: int = 10) -> DataFrame:
    """Edges between a wallet, its top partners, and among them, oriented by the larger flow: source, target, transfers, amount."""
    top = related_wallets(transfers, wallet, limit).select(F.col("partner").alias("w"))
    nodes = F.broadcast(top.unionAll(transfers.sparkSession.createDataFrame([(wallet,)], "w string")))
    inside = transfers.join(nodes.withColumnRenamed("w", "sender"), "sender", "left_semi").join(nodes.withColumnRenamed("w", "receiver"), "receiver", "left_semi")
    p = pair_flows(inside)
    forward = F.col("forward_amount") >= F.col("backward_amount")
    return p.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("target"), (F.col("forward") + F.col("backward")).alias("transfers"), (F.col("forward_amount") + F.col("backward_amount")).alias("amount"))


def same_key_pairs(observations: DataFrame, key: str = "device_id") -> DataFrame:
    """a, b (a < b), shared: wallets seen under the same key."""
    m = observations.where(F.col(key).isNotNull()).select(key, "wallet").distinct()
    return m.select(key, F.col("wallet").alias("a")).join(m.select(key, F.col("wallet").alias("b")), key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
