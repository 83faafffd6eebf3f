"""Graph views: typed nodes and edges around a focus, as two DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.graphs import expand
from trailmark.operators.hops import undirected_edges
from trailmark.operators.listing import same_key_pairs
from trailmark.plans.shared import cut

NODE_CAP, DEPTH_CAP = 500, 3


def _node(df: DataFrame, id_: str, kind: str, *data: str) -> DataFrame:
    pairs = [x for d in data for x in (F.lit(d), F.col(d).cast("string"))]
    return df.select(F.concat(F.lit(f"{kind}:"), F.col(id_)).alias("id"), F.lit(kind).alias("type"), F.col(id_).alias("label"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("data"))


def _edge(df: DataFrame, kind: str, source, target, *data: str) -> DataFrame:
    pairs = [x for d in data for x in (F.lit(d), F.col(d).cast("string"))]
    s = F.concat(F.lit(f"{source[0]}:"), F.col(source[1]))
    t = F.concat(F.lit(f"{target[0]}:"), F.col(target[1]))
    return df.select(F.concat_ws("", F.lit(f"{kind}:"), s, F.lit("->"), t).alias("id"), s.alias("source"), t.alias("target"), F.lit(kind).alias("type"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("data"))


def focus_wallets(kind: str, value: str, transfers: DataFrame, observations: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """The seed wallets of a focus: a wallet itself, a transaction's parties, whoever an address, device or session was seen with, or a
    cluster's members. (Cases have seeds of their own, see case_seeds.)"""
    if kind == "wallet":
        return transfers.sparkSession.createDataFrame([(value,)], "wallet string")
    if kind == "transaction":
        return transfers.where(F.col("transaction_id") == value).select(F.explode(F.array("sender", "receiver")).alias("wallet")).distinct()
    if kind == "cluster" and clusters is not None:
        return clusters.where(F.col("cluster_id") == value).select("wallet").distinct()
    column = {"ip": "ip_address", "device": "device_id", "session": "session_id"}[kind]
    return observations.where(F.col(column) == value).select("wallet").distinct()


def wallet_graph(transfers: DataFrame, observations: DataFrame, seeds: DataFrame, depth: int = 1, max_nodes: int = 150, single: bool = False, types: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around seed wallets: wallets up to ``depth`` steps off (strongest links first, capped), aggregated
    ``sent_to`` edges (or, with ``single``, a node per transfer with ``sent`` and ``received_by`` edges), the addresses, devices and
    sessions seen with them, and ``same_device`` and ``same_session`` pairs; edges of the given types only. Edge ids are unique."""
    if not (0 <= depth <= DEPTH_CAP and 1 <= max_nodes <= NODE_CAP):
        raise ValueError(f"depth is at most {DEPTH_CAP}, nodes at most {NODE_CAP}")
    inside = cut(expand(cut(undirected_edges(transfers)), seeds, depth, max_nodes).select("wallet", "hop"))
    members = F.broadcast(inside.select("wallet"))
    t = transfers.join(members.withColumnRenamed("wallet", "sender"), "sender", "left_semi").join(members.withColumnRenamed("wallet", "receiver"), "receiver", "left_semi")
    o = observations.join(members, "wallet", "left_semi")
    ip, dev = (o.where(f"{c} is not null").groupBy("wallet", c).agg(F.count("*").alias("n")) for c in ("ip_address", "device_id"))
    link = o.where("ip_address is not null and device_id is not null").select("ip_address", "device_id").distinct()
    nodes = [_node(inside, "wallet", "wallet", "hop"), _node(ip.select("ip_address").distinct(), "ip_address", "ip"), _node(dev.select("device_id").distinct(), "device_id", "device")]
    if single:
        nodes.append(_node(t, "transaction_id", "tx", "amount", "ts"))
        edges = [_edge(t, "sent", ("wallet", "sender"), ("tx", "transaction_id"), "amount", "ts"), _edge(t, "received_by", ("tx", "transaction_id"), ("wallet", "receiver"), "amount", "ts")]
    else:
        sent = t.groupBy("sender", "receiver").agg(F.count("*").alias("transfers"), F.sum("amount").alias("amount"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        edges = [_edge(sent, "sent_to", ("wallet", "sender"), ("wallet", "receiver"), "transfers", "amount", "first_seen", "last_seen")]
    edges += [
        _edge(ip, "observed_from", ("wallet", "wallet"), ("ip", "ip_address"), "n"),
        _edge(link, "associated_with", ("ip", "ip_address"), ("device", "device_id")),
        _edge(same_key_pairs(o), "same_device", ("wallet", "a"), ("wallet", "b"), "shared"),
    ]
    if "session_id" in observations.columns:
        seen = o.where("session_id is not null").groupBy("wallet", "session_id").agg(F.count("*").alias("n"))
        nodes.append(_node(seen.select("session_id").distinct(), "session_id", "session"))
        edges += [_edge(seen, "in_session", ("wallet", "wallet"), ("session", "session_id"), "n"), _edge(same_key_pairs(o, "session_id"), "same_session", ("wallet", "a"), ("wallet", "b"), "shared")]
    every = reduce(DataFrame.unionAll, edges)
    return reduce(DataFrame.unionAll, nodes), every if types is None else every.where(F.col("type").isin(*types))


def omitted_wallets(transfers: DataFrame, seeds: DataFrame, depth: int = 1, max_nodes: int = 150) -> DataFrame:
    """One row: how many wallets lie within ``depth`` steps, and how many of them the cap leaves out of the graph."""
    near = seeds.select("wallet").distinct()
    sym = undirected_edges(transfers)
    sym = cut(sym.select(F.col("a").alias("wallet"), F.col("b").alias("other")).unionAll(sym.select("b", "a")))
    for _ in range(depth):
        near = cut(near.unionAll(sym.join(near, "wallet").select(F.col("other").alias("wallet"))).distinct())
    return near.agg(F.count("*").alias("within"), F.greatest(F.count("*") - max_nodes, F.lit(0)).alias("omitted"))


def focus_entities(kind: str, value: str, entities: DataFrame, inputs: DataFrame, ip_links: DataFrame) -> DataFrame:
    """The focus entities (entity_id) of an entity itself, an address, a transaction's inputs, or an address of flows."""
    if kind == "entity":
        return entities.where(F.col("entity_id") == value).select("entity_id").distinct()
    if kind == "address":
        return entities.where(F.col("address") == value).select("entity_id").distinct()
    if kind == "transaction":
        return inputs.where(F.col("transaction_id") == value).join(entities, "address").select("entity_id").distinct()
    if kind == "ip":
        return ip_links.where(F.col("src_ip") == value).select("entity_id").distinct()
    raise ValueError(f"no focus on {kind}")


def entity_graph(entities: DataFrame, inputs: DataFrame, outputs: DataFrame, ip_links: DataFrame, links: DataFrame, focus: DataFrame, depth: int = 1, max_nodes: int = 150) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around focus entities (entity_id): entities that share addresses of flows, step by step, their member
    addresses, transactions, network addresses, ASNs and countries."""
    weighted = cut(links.select("a", "b", F.col("shared_ips").alias("transfers")))
    inside = cut(expand(weighted, focus.select(F.col("entity_id").alias("wallet")), depth, max_nodes).select(F.col("wallet").alias("entity_id"), "hop"))
    mine = F.broadcast(inside.select("entity_id"))
    member = entities.join(mine, "entity_id", "left_semi")
    spend = inputs.join(member, "address").select("address", "transaction_id").distinct()
    get = outputs.join(member.select("address"), "address", "left_semi").select("address", "transaction_id").distinct()
    net = ip_links.join(mine, "entity_id", "left_semi")
    shared = links.join(mine.withColumnRenamed("entity_id", "a"), "a", "left_semi").join(mine.withColumnRenamed("entity_id", "b"), "b", "left_semi")
    nets = net.select("src_ip", F.col("asn").cast("string").alias("asn"), "country").distinct()
    nodes = [
        _node(inside, "entity_id", "entity", "hop"), _node(member, "address", "address"), _node(spend.select("transaction_id").unionAll(get.select("transaction_id")).distinct(), "transaction_id", "tx"),
        _node(net.select("src_ip").distinct(), "src_ip", "ip"), _node(nets.where("asn is not null").select("asn").distinct(), "asn", "asn"), _node(nets.where("country is not null").select("country").distinct(), "country", "country"),
    ]
    edges = [
        _edge(member, "in_entity", ("address", "address"), ("entity", "entity_id")), _edge(spend, "input_of", ("address", "address"), ("tx", "transaction_id")), _edge(get, "output_to", ("tx", "transaction_id"), ("address", "address")),
        _edge(net, "sent_from_ip", ("entity", "entity_id"), ("ip", "src_ip"), "transactions"), _edge(nets.select("src_ip", "asn").where("asn is not null").distinct(), "in_asn", ("ip", "src_ip"), ("asn", "asn")),
        _edge(nets.select("src_ip", "country").where("country is not null").distinct(), "in_country", ("ip", "src_ip"), ("country", "country")), _edge(shared, "shared_ip", ("entity", "a"), ("entity", "b"), "shared_ips"),
    ]
    return reduce(DataFrame.unionAll, nodes), reduce(DataFrame.unionAll, edges)
