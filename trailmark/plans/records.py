"""Registered queries of the record listings and details, in addition to those of the ledger engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import clusters, confidence, entities, features, fusion, graphs, graphview, listing, records, rules
from trailmark.plans.analysis import review_status
from trailmark.plans.registry import CHAINS, CIO, COIN, CONF, CORE, FIND, FOCUS, NET, ORACLE_SQL, QUERIES, SCORED, _entities, _features, _model, _ranked, register
from trailmark.plans.shared import cut, written
from trailmark.sources import views
from trailmark.sources.views import sql

__all__ = ["ORACLE_SQL", "QUERIES"]

LD = "ld AS (SELECT * FROM pr WHERE anomaly_prediction = 'Anomalous' OR priority_level = 'High')"
REVIEW = "rev AS (SELECT wallet, CASE WHEN wallet LIKE '%5' THEN 'Case Created' WHEN wallet LIKE '%3' THEN 'Under Review' ELSE 'Unreviewed' END AS status FROM (SELECT DISTINCT wallet FROM legs))"
CASES = """cas AS (SELECT 'case-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS case_id, n_name AS title, 'file of ' || lower(n_name) AS description, CASE n_regionkey % 3 WHEN 0 THEN 'Open' WHEN 1 THEN 'In progress' ELSE 'Closed' END AS status,
  CASE n_nationkey % 2 WHEN 0 THEN 'High' ELSE 'Low' END AS priority, DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS created_at, DATE '2024-03-01' + CAST(n_nationkey * 7 % 11 AS INTEGER) AS updated_at FROM nation),
itm AS (SELECT 'case-' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS case_id, 'wallet' AS item_type, 'w' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS item_id FROM supplier
  UNION ALL SELECT 'case-' || lpad(CAST(p_partkey % 25 AS VARCHAR), 2, '0'), 'transaction', 'tx-' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') FROM part
  UNION ALL SELECT 'case-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0'), 'cluster', 'NET-w' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer)"""


def _cases(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(cases, items) read from nation, supplier, part and customer."""
    case, n = lambda c: F.concat(F.lit("case-"), F.lpad(c.cast("string"), 2, "0")).alias("case_id"), views.table(s, d, "nation")
    status = F.expr("CASE n_regionkey % 3 WHEN 0 THEN 'Open' WHEN 1 THEN 'In progress' ELSE 'Closed' END")
    cases = n.select(
        case(F.col("n_nationkey")), F.col("n_name").alias("title"), F.concat(F.lit("file of "), F.lower("n_name")).alias("description"), status.alias("status"), F.when(F.col("n_nationkey") % 2 == 0, "High").otherwise("Low").alias("priority"),
        F.expr("date_add(date'2024-01-01', cast(n_nationkey as int))").alias("created_at"), F.expr("date_add(date'2024-03-01', cast(n_nationkey * 7 % 11 as int))").alias("updated_at"),
    )
    item = lambda t, key, kind, prefix, width, number: views.table(s, d, t).select(case(key), F.lit(kind).alias("item_type"), views._code(prefix, width, number).alias("item_id"))
    items = item("supplier", F.col("s_nationkey"), "wallet", "w", 6, "s_suppkey").unionAll(item("part", F.col("p_partkey") % 25, "transaction", "tx-", 10, "p_partkey")).unionAll(item("customer", F.col("c_nationkey"), "cluster", "NET-w", 6, "c_custkey"))
    return cases, items


def _leads(s, d) -> tuple[DataFrame, DataFrame]:
    ranked = cut(_ranked(s, d))
    return ranked, fusion.leads(ranked)


def _status(s, d) -> DataFrame:
    w = features.legs(views.transfers(s, d)).select("wallet").distinct()
    items = w.where("wallet like '%5'").select(F.lit("wallet").alias("item_type"), F.col("wallet").alias("item_id"), F.lit("case-1").alias("case_id"))
    return review_status(w, w.where("wallet like '%3' or wallet like '%5'"), items)


def _net(s, d) -> DataFrame:
    return cut(graphs.network_clusters(views.observations(s, d), ("device_id",)))


# ---- leads and wallets ----------------------------------------------------------------------------------------------------
LEAD_FILTER = "contains(lower(wallet), '1') AND combined_score >= 0.2"
register("lead_list", sql(f"WITH {SCORED}, {LD} SELECT wallet, combined_score, priority_rank, priority_level FROM ld WHERE {LEAD_FILTER} ORDER BY combined_score DESC, wallet LIMIT 20 OFFSET 2", "t", "legs"))(
    lambda s, d: records.list_leads(_leads(s, d)[1], "combined_score", True, 20, 2, q="1", least=0.2).select("wallet", "combined_score", "priority_rank", "priority_level")
)
register("lead_total", sql(f"WITH {SCORED}, {LD} SELECT count(*) AS total FROM ld WHERE {LEAD_FILTER}", "t", "legs"))(lambda s, d: records.total(records.find_leads(_leads(s, d)[1], q="1", least=0.2)))


@register("wallet_analysis", sql(f"WITH {SCORED}, {LD}, sc AS (SELECT pr.* FROM pr JOIN f USING (wallet) WHERE dormancy_duration IS NOT NULL AND transaction_count >= 40) SELECT w.wallet, sc.wallet IS NOT NULL AS scored, CASE WHEN sc.wallet IS NULL THEN 'Not scored: fewer than two transfers, or an undefined feature.' END AS unscored_reason, ml_score, combined_score, priority_rank, w.wallet IN (SELECT wallet FROM ld) AS is_lead FROM (SELECT DISTINCT wallet FROM legs) w LEFT JOIN sc USING (wallet)", "t", "legs"))
def wallet_analysis(s, d):
    ranked, leads = _leads(s, d)
    some = _features(s, d).where("dormancy_duration is not null and transaction_count >= 40").select("wallet")
    got = records.wallet_analysis(features.legs(views.transfers(s, d)).select("wallet").distinct(), ranked.join(some, "wallet", "left_semi"), leads)
    return got.select("wallet", "scored", "unscored_reason", "ml_score", "combined_score", "priority_rank", "is_lead")


@register("bulk_analysis", sql(f"WITH {SCORED}, {LD}, {REVIEW} SELECT wallet, ml_score, combined_score, priority_rank, CASE WHEN triggered_rules = 'none' THEN '' ELSE triggered_rules END AS rules, CAST(rule_count AS INTEGER) AS sentences, fan_in, wallet IN (SELECT wallet FROM ld) AS is_lead, CASE WHEN wallet IN (SELECT wallet FROM ld) THEN 4 ELSE 0 END AS reasons, status FROM pr JOIN f USING (wallet) JOIN rev USING (wallet)", "t", "legs"))
def bulk_analysis(s, d):
    f = cut(_features(s, d))
    found = cut(rules.with_findings(f))
    ranked = cut(fusion.priority(cut(fusion.fuse(rules.rule_results(found), _model(f)))))
    got = records.bulk_analysis(ranked, f, rules.findings(found), fusion.leads(ranked), _status(s, d).select("wallet", "status", "case_ids"))
    return got.select("wallet", "ml_score", "combined_score", "priority_rank", F.array_join("rules", ";").alias("rules"), F.size("findings").alias("sentences"), F.col("features.fan_in").alias("fan_in"), "is_lead", F.size("reasons").alias("reasons"), "status")


@register("lead_detail", sql(f"WITH {SCORED}, w AS (SELECT wallet FROM pr WHERE priority_rank = 1), x AS (SELECT transaction_id, ts FROM t WHERE sender = (SELECT wallet FROM w) OR receiver = (SELECT wallet FROM w) ORDER BY ts DESC, transaction_id DESC LIMIT 10), p AS (SELECT counterparty, count(*) AS k, sum(amount) AS a FROM legs WHERE wallet = (SELECT wallet FROM w) GROUP BY 1 ORDER BY k DESC, a DESC, 1 LIMIT 10) SELECT pr.wallet, CAST(pr.rule_count AS INTEGER) AS findings, fan_in, (SELECT string_agg(transaction_id, ',' ORDER BY ts DESC, transaction_id DESC) FROM x) AS transfers, (SELECT string_agg(counterparty, ',' ORDER BY k DESC, a DESC, counterparty) FROM p) AS partners FROM pr JOIN f USING (wallet) WHERE priority_rank = 1", "t", "legs"))
def lead_detail(s, d):
    f = cut(_features(s, d))
    found = cut(rules.with_findings(f))
    ranked = cut(fusion.priority(cut(fusion.fuse(rules.rule_results(found), _model(f)))))
    wallet = ranked.where("priority_rank = 1").first()["wallet"]
    got = records.lead_detail(wallet, fusion.leads(ranked), rules.findings(found), f, views.transfers(s, d))
    return got.select("wallet", F.size("findings").alias("findings"), F.col("features.fan_in").alias("fan_in"), F.array_join("transfers.transaction_id", ",").alias("transfers"), F.array_join("partners.partner", ",").alias("partners"))


register("wallet_info", sql(f"WITH {SCORED}, {LD} SELECT wallet, transaction_count, anomaly_prediction, combined_score, priority_rank, priority_level, wallet IN (SELECT wallet FROM ld) AS is_lead FROM pr JOIN core USING (wallet) WHERE wallet IN (SELECT wallet FROM obs)", "t", "legs", "obs"))(
    lambda s, d: (lambda r: records.wallet_info(views.observations(s, d).select("wallet"), r[0], r[1], views.transfers(s, d)).where("transaction_count > 0"))(_leads(s, d))
)
register("anomaly_table", sql(f"WITH {SCORED}, {LD}, {CHAINS}, {REVIEW} SELECT wallet, priority_rank, status, wallet IN (SELECT wallet FROM ld) AS is_lead FROM pr JOIN rev USING (wallet) WHERE status = 'Unreviewed' AND wallet IN (SELECT from_wallet FROM hop UNION SELECT to_wallet FROM hop)", "t", "legs", recursive=True))(
    lambda s, d: (lambda r: records.anomaly_table(r[0], r[1], _status(s, d), graphs.peeling_hops(views.transfers(s, d)).select(F.explode(F.array("from_wallet", "to_wallet")).alias("wallet")), "all", "Unreviewed", peeling_only=True, sort="ml_score", descending=True).select("wallet", "priority_rank", "status", "is_lead"))(_leads(s, d))
)
register("key_figures", sql(f"WITH {SCORED}, {LD} SELECT CAST((SELECT sum(outgoing_count) FROM f) AS BIGINT) AS transfers, CAST((SELECT sum(transaction_count) FROM f) AS BIGINT) AS ledger_rows, count(*) FILTER (anomaly_prediction = 'Anomalous') AS flagged, count(*) FILTER (anomaly_prediction = 'Anomalous' AND rule_count >= 2) AS flagged_with_rules, (SELECT count(*) FROM ld) AS leads FROM pr", "t", "legs"))(
    lambda s, d: (lambda r: records.key_figures(_features(s, d), *r))(_leads(s, d))
)
register("top_priority", sql(f"WITH {SCORED} SELECT wallet, priority_rank, combined_score FROM pr WHERE priority_rank <= 10", "t", "legs"))(lambda s, d: _ranked(s, d).orderBy("priority_rank").limit(10).select("wallet", "priority_rank", "combined_score"))
STANDOUT = ("fan_in", "transaction_count", "dormancy_duration")
register("standout_features", sql(f"WITH {CORE}, u AS (" + " UNION ALL ".join(f"SELECT wallet, '{c}' AS feature, CAST({c} AS DOUBLE) AS value, cume_dist() OVER (ORDER BY {c}) AS share FROM f WHERE {c} IS NOT NULL" for c in STANDOUT) + ") SELECT wallet, feature, value, round(100 * share, 6) AS percent FROM u WHERE share >= 0.9", "t", "legs"))(
    lambda s, d: listing.standout_features(cut(_features(s, d)), list(STANDOUT)).withColumn("percent", F.round("percent", 6))
)

# ---- clusters, entities, patterns -------------------------------------------------------------------------------------------
CLUSTER_SUM = "cs AS (SELECT cluster_id, count(*) AS wallets, count(ld.wallet) AS lead_count, max(pr.combined_score) AS max_score FROM net LEFT JOIN ld USING (wallet) LEFT JOIN pr USING (wallet) GROUP BY 1), ct AS (SELECT cluster_id, count(DISTINCT transaction_id) AS transactions FROM (SELECT transaction_id, sender AS wallet FROM t UNION SELECT transaction_id, receiver FROM t) JOIN net USING (wallet) GROUP BY 1)"


@register("cluster_list", sql(f"WITH {SCORED}, {LD}, {NET}, {CLUSTER_SUM} SELECT cluster_id, wallets, coalesce(transactions, 0) AS transactions, lead_count, max_score FROM cs LEFT JOIN ct USING (cluster_id) WHERE lead_count > 0 AND wallets >= 2 AND (contains(lower(cluster_id), '7') OR cluster_id IN (SELECT cluster_id FROM net WHERE contains(wallet, '7'))) ORDER BY lead_count DESC, max_score DESC, wallets DESC, cluster_id LIMIT 30", "t", "legs", "obs", recursive=True))
def cluster_list(s, d):
    net, (ranked, leads) = _net(s, d), _leads(s, d)
    scores = net.join(ranked.select("wallet", "combined_score"), "wallet", "left").join(leads.select("wallet", F.lit(1).alias("lead")), "wallet", "left").groupBy("cluster_id").agg(F.count("lead").alias("lead_count"), F.max("combined_score").alias("max_score"))
    summary = clusters.cluster_counts(net, views.transfers(s, d), views.observations(s, d)).drop("observations").join(scores, "cluster_id")
    return records.list_clusters(summary, net, 2, True, "7", limit=30)


register("cluster_members", sql(f"WITH {SCORED}, {LD}, {NET} SELECT cluster_id, wallet, priority_rank, wallet IN (SELECT wallet FROM ld) AS is_lead, row_number() OVER (PARTITION BY cluster_id ORDER BY priority_rank NULLS LAST, wallet) AS place FROM net LEFT JOIN pr USING (wallet)", "t", "legs", "obs", recursive=True))(
    lambda s, d: (lambda n, r: records.cluster_members(n, records.wallet_info(n, *r, views.transfers(s, d))).select("cluster_id", "wallet", "priority_rank", "is_lead", "place"))(_net(s, d), _leads(s, d))
)
STATS = "st AS (SELECT entity_id, count(*) AS addresses FROM ent GROUP BY 1), sk AS (SELECT entity_id, count(*) AS transactions FROM (SELECT entity_id, transaction_id FROM et UNION SELECT entity_id, transaction_id FROM outp JOIN ent USING (address)) GROUP BY 1)"


@register("entity_list", sql(f"WITH {CIO}, {STATS}, en AS (SELECT DISTINCT entity_id FROM et JOIN flows USING (transaction_id) WHERE country = 'NATION_7') SELECT entity_id, addresses, transactions FROM st JOIN sk USING (entity_id) WHERE addresses >= 3 AND entity_id IN (SELECT entity_id FROM en) AND (contains(lower(entity_id), '9-4') OR entity_id IN (SELECT entity_id FROM ent WHERE contains(address, '9-4'))) ORDER BY addresses DESC, transactions DESC, entity_id LIMIT 40", "inp", "flows", recursive=True))
def entity_list(s, d):
    e, ins, outs, flows, spends = _entities(s, d)
    got = records.list_entities(entities.entity_stats(e, ins, outs, flows, spends=spends), e, entities.entity_ip_links(e, ins, flows, spends), entities.wallet_entities(e, ins, flows, spends), 3, "nation_7", q="9-4", limit=40)
    return got.select("entity_id", "addresses", "transactions")


@register("entity_detail", sql(f"WITH {CIO}, {FIND}, {STATS}, big AS (SELECT entity_id FROM st ORDER BY addresses DESC, entity_id LIMIT 1), my AS (SELECT address FROM ent WHERE entity_id = (SELECT entity_id FROM big)), tx AS (SELECT DISTINCT transaction_id FROM inp WHERE address IN (SELECT address FROM my)), lk AS (SELECT x.entity_id AS a, y.entity_id AS b FROM ipl x JOIN ipl y ON x.src_ip = y.src_ip AND x.entity_id <> y.entity_id WHERE x.entity_id = (SELECT entity_id FROM big)) SELECT (SELECT entity_id FROM big) AS entity_id, (SELECT count(*) FROM my) AS addresses, (SELECT string_agg(transaction_id, ',' ORDER BY transaction_id) FROM tx) AS spent, (SELECT string_agg(w, ',' ORDER BY w) FROM (SELECT DISTINCT sender AS w FROM flows WHERE transaction_id IN (SELECT transaction_id FROM tx))) AS wallets, (SELECT count(DISTINCT b) FROM lk) AS related, (SELECT count(*) FROM fin WHERE entity_id = (SELECT entity_id FROM big)) AS findings", "inp", "flows", recursive=True))
def entity_detail(s, d):
    e, ins, outs, flows, spends = _entities(s, d)
    big = e.groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").first()["entity_id"]
    links = written(entities.entity_ip_links(e, ins, flows, spends), "entity-ips")
    got = records.entity_detail(big, entities.entity_stats(e, ins, outs, flows, spends=spends), e, ins, flows, links, entities.entity_links(links), entities.correlation_findings(e, ins, flows, spends=spends), spends)
    joined = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))  # noqa: E731  (null for no items, as in SQL)
    return got.select("entity_id", "addresses", joined("spending_transactions").alias("spent"), joined("linked_wallets").alias("wallets"), F.size("related_entities").cast("long").alias("related"), F.size("findings").cast("long").alias("findings"))


register("entity_linked_wallets", sql(f"WITH {CIO} SELECT entity_id, string_agg(DISTINCT sender, ',' ORDER BY sender) AS wallets FROM et JOIN flows USING (transaction_id) GROUP BY 1", "inp", "flows", recursive=True))(
    lambda s, d: (lambda e, i, o, f, t: records.linked_wallets(e, i, f, spends=t).select("entity_id", F.array_join("wallets", ",").alias("wallets")))(*_entities(s, d))
)
register("chain_list", sql(f"WITH {CHAINS}, c AS (SELECT chain_id, count(*) AS hop_count, string_agg(DISTINCT wallet, ',' ORDER BY wallet) AS wallets FROM (SELECT chain_id, from_wallet AS wallet FROM hop UNION ALL SELECT chain_id, to_wallet FROM hop) JOIN (SELECT chain_id, count(*) AS hops FROM hop GROUP BY 1) USING (chain_id) GROUP BY 1) SELECT chain_id, hop_count // 2 AS hop_count, wallets FROM c ORDER BY hop_count DESC, chain_id LIMIT 50", "t", recursive=True))(
    lambda s, d: (lambda h: records.list_chains(graphs.peeling_chains(h), h).select("chain_id", "hop_count", F.array_join("wallets", ",").alias("wallets")))(cut(graphs.peeling_hops(views.transfers(s, d))))
)
register("coinjoin_list", sql(f"WITH {COIN} SELECT transaction_id, score FROM cj WHERE input_count >= 3 AND group_size >= 3 ORDER BY score DESC, transaction_id LIMIT 50", "inp"))(
    lambda s, d: records.list_coinjoins(entities.coinjoin_candidates(entities.coinjoin_metrics(*views.rich_sides(s, d)))).select("transaction_id", "score")
)


@register("confidence_list", sql(f"WITH {SCORED}, {CHAINS}, {CIO}, {FIND}, {COIN}, {CONF}, cf AS (SELECT wallet, round(least(1.0::DOUBLE, 0.55::DOUBLE * combined_score + CASE WHEN co.k > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN fc.k > 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN pw.wallet IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END), 6) AS confidence, 1 + CASE WHEN co.k > 0 THEN 1 ELSE 0 END + CASE WHEN fc.k > 0 THEN 1 ELSE 0 END + CASE WHEN pw.wallet IS NOT NULL THEN 1 ELSE 0 END AS signals FROM pr LEFT JOIN co USING (wallet) LEFT JOIN fc USING (wallet) LEFT JOIN pw USING (wallet)) SELECT * FROM cf WHERE confidence >= 0.3 ORDER BY confidence DESC, wallet LIMIT 50", "t", "legs", "inp", "flows", "ot", recursive=True))
def confidence_list(s, d):
    e, ins, outs, flows, spends = _entities(s, d)
    uses = entities.entity_uses(spends, flows)
    ranked, t = cut(_ranked(s, d)), views.transfers(s, d)
    mixed = entities.coinjoin_transactions(ins, outs)
    got = confidence.confidence(ranked, fusion.leads(ranked), entities.wallet_entities(e, ins, flows, uses=uses), entities.correlation_findings(e, ins, flows, uses=uses), confidence.pattern_wallets(graphs.peeling_hops(t), mixed, views.order_transfers(s, d)))
    return records.list_confidence(got, 0.3).select("wallet", "confidence", F.size("signals").alias("signals"))


# ---- observations, transactions, cases ---------------------------------------------------------------------------------------
register("observation_list", sql("SELECT observation_id, wallet, ip_address, device_id, observed_at, CAST(NULL AS VARCHAR) AS observed_party FROM obs WHERE wallet = 'w000007' ORDER BY observed_at DESC, observation_id LIMIT 20 OFFSET 3", "obs"))(
    lambda s, d: records.list_observations(views.observations(s, d), 20, 3, wallet="w000007").drop("transaction_id")
)
register("ip_profile", sql("WITH g AS (SELECT ip_address, count(*) AS n, count(DISTINCT wallet) AS wallets, count(DISTINCT transaction_id) AS transactions, min(observed_at) AS first_at, max(observed_at) AS last_at, count(DISTINCT device_id) AS device_id_count FROM obs GROUP BY 1), p AS (SELECT ip_address, device_id, row_number() OVER (PARTITION BY ip_address ORDER BY device_id) AS k FROM (SELECT DISTINCT ip_address, device_id FROM obs)), l AS (SELECT ip_address, string_agg(device_id, ',' ORDER BY device_id) AS devices FROM p WHERE k <= 50 GROUP BY 1) SELECT * FROM g JOIN l USING (ip_address)", "obs"))(
    lambda s, d: records.key_profile(views.observations(s, d), "ip_address", ("device_id",)).withColumn("devices", F.array_join("device_id_list", ",")).drop("device_id_list")
)
register("device_state", sql("WITH l AS (SELECT wallet, arg_max(device_id, observation_id) AS device_id FROM (SELECT *, max(observed_at) OVER (PARTITION BY wallet) AS m FROM obs) WHERE observed_at = m GROUP BY 1), u AS (SELECT device_id, ip_address, count(*) AS n, max(observed_at) AS last_at FROM obs GROUP BY 1, 2), b AS (SELECT device_id, ip_address, max(last_at) OVER (PARTITION BY device_id) AS last_at, row_number() OVER (PARTITION BY device_id ORDER BY n DESC, ip_address) AS k FROM u) SELECT wallet, device_id, ip_address, last_at FROM l JOIN b USING (device_id) WHERE k = 1", "obs"))(
    lambda s, d: records.device_state(views.observations(s, d))
)
register("tx_details", sql("WITH a AS (SELECT transaction_id, string_agg(address, ',' ORDER BY position, address, amount) AS inputs FROM inp GROUP BY 1), b AS (SELECT transaction_id, string_agg(address, ',' ORDER BY position, address, amount) AS outputs FROM outp GROUP BY 1), c AS (SELECT transaction_id, min(dst_port) AS dst_port, min(src_ip) AS src_ip FROM flows GROUP BY 1) SELECT transaction_id, inputs, outputs, dst_port, src_ip FROM a JOIN b USING (transaction_id) LEFT JOIN c USING (transaction_id)", "inp", "flows"))(
    lambda s, d: records.transaction_details(*views.rich_sides(s, d), views.flows(s, d)).select("transaction_id", F.array_join("inputs.address", ",").alias("inputs"), F.array_join("outputs.address", ",").alias("outputs"), "flow.dst_port", "flow.src_ip")
)
register("source_counts", "SELECT 'events' AS name, event_type AS source, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'documents', source, count(*) FROM documents GROUP BY 2")(
    lambda s, d: records.source_counts(events=views.table(s, d, "events").withColumnRenamed("event_type", "source"), documents=views.table(s, d, "documents"))
)
register("case_list", f"WITH {CASES} SELECT case_id, title, status, priority, updated_at FROM cas WHERE priority = 'High' AND (contains(lower(title), 'on_1') OR contains(lower(description), 'on_1') OR case_id IN (SELECT case_id FROM itm WHERE contains(lower(item_id), 'on_1'))) ORDER BY updated_at DESC, case_id LIMIT 8")(
    lambda s, d: records.list_cases(*_cases(s, d), priority="High", q="ON_1", limit=8).select("case_id", "title", "status", "priority", "updated_at")
)
register("case_summary", sql(f"WITH {CASES}, x AS (SELECT case_id, transaction_id, ts, amount FROM t JOIN itm ON item_type = 'wallet' AND item_id = sender UNION SELECT case_id, transaction_id, ts, amount FROM t JOIN itm ON item_type = 'wallet' AND item_id = receiver UNION SELECT case_id, transaction_id, ts, amount FROM t JOIN itm ON item_type = 'transaction' AND item_id = transaction_id) SELECT case_id, count(*) AS total, round(sum(amount), 4) AS moved, min(ts) AS first_at, max(ts) AS last_at FROM x GROUP BY 1", "t"))(
    lambda s, d: records.case_summary(_cases(s, d)[1], views.transfers(s, d)).withColumn("moved", F.round("moved", 4))
)
register("case_seeds", sql(f"WITH {CASES}, {NET} SELECT case_id, item_id AS wallet FROM itm WHERE item_type = 'wallet' UNION SELECT case_id, wallet FROM itm JOIN net ON item_type = 'cluster' AND item_id = cluster_id UNION SELECT case_id, sender FROM itm JOIN t ON item_type = 'transaction' AND item_id = transaction_id UNION SELECT case_id, receiver FROM itm JOIN t ON item_type = 'transaction' AND item_id = transaction_id", "t", "obs", recursive=True))(
    lambda s, d: records.case_seeds(_cases(s, d)[1], _net(s, d), views.transfers(s, d), s.createDataFrame([], "wallet string, entity_id string"))
)
SEARCH_ALL = """h AS (SELECT * FROM (SELECT 'transaction' AS category, transaction_id AS value, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'wallet', wallet, count(*) FROM legs GROUP BY ALL
  UNION ALL SELECT 'ip', ip_address, count(DISTINCT wallet) FROM obs GROUP BY ALL UNION ALL SELECT 'device', device_id, count(DISTINCT wallet) FROM obs GROUP BY ALL) WHERE contains(lower(value), '{q}')
  UNION ALL SELECT 'cluster', cluster_id, count(*) FROM net WHERE cluster_id IN (SELECT cluster_id FROM net WHERE contains(lower(cluster_id), '{q}') OR contains(lower(wallet), '{q}')) GROUP BY 2
  UNION ALL SELECT 'case', cas.case_id, count(item_id) FROM cas LEFT JOIN itm USING (case_id) WHERE contains(lower(cas.case_id), '{q}') OR contains(lower(title), '{q}') OR cas.case_id IN (SELECT case_id FROM itm WHERE contains(lower(item_id), '{q}')) GROUP BY 2),
m AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN lower(value) = '{q}' THEN 0 ELSE 1 END, value) AS k, count(*) OVER (PARTITION BY category) AS total FROM h) SELECT category, value, n, total FROM m WHERE k <= 10"""
register("search_all", sql(f"WITH {NET}, {CASES}, " + SEARCH_ALL.replace("{q}", "w00001"), "t", "legs", "obs", recursive=True))(
    lambda s, d: (lambda c: listing.search(views.transfers(s, d), views.observations(s, d), "W00001", 10, _net(s, d), *c))(_cases(s, d))
)
TX_FOCUS = "fx AS (SELECT min(transaction_id) AS id FROM t), sd AS (SELECT sender AS w FROM t WHERE transaction_id = (SELECT id FROM fx) UNION SELECT receiver FROM t WHERE transaction_id = (SELECT id FROM fx)), tt AS (SELECT * FROM t WHERE sender IN (SELECT w FROM sd) AND receiver IN (SELECT w FROM sd))"


@register("graph_transaction_edges", sql(f"WITH {TX_FOCUS} SELECT 'sent:wallet:' || sender || '->tx:' || transaction_id AS id, 'wallet:' || sender AS source, 'tx:' || transaction_id AS target, 'sent' AS type FROM tt UNION ALL SELECT 'received_by:tx:' || transaction_id || '->wallet:' || receiver, 'tx:' || transaction_id, 'wallet:' || receiver, 'received_by' FROM tt", "t"))
def graph_transaction_edges(s, d):
    t, o = views.transfers(s, d), views.observations(s, d)
    seeds = graphview.focus_wallets("transaction", t.agg(F.min("transaction_id")).first()[0], t, o)
    return graphview.wallet_graph(t, o, seeds, 0, 10, single=True, types={"sent", "received_by"})[1].select("id", "source", "target", "type")


register("graph_omitted", sql(f"WITH e AS (SELECT DISTINCT sender AS a, receiver AS b FROM t UNION SELECT DISTINCT receiver, sender FROM t), n AS (SELECT '{FOCUS}' AS w UNION SELECT b FROM e WHERE a = '{FOCUS}') SELECT count(*) AS within, greatest(count(*) - 20, 0) AS omitted FROM n", "t"))(
    lambda s, d: (lambda t: graphview.omitted_wallets(t, graphview.focus_wallets("wallet", FOCUS, t, views.observations(s, d)), 1, 20))(views.transfers(s, d))
)
