"""Every registered query of the ledger engine against its SQL, or against what its rows must satisfy."""

from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from trailmark.operators import features
from trailmark.plans.analysis import analyse
from trailmark.plans.records import LD, ORACLE_SQL, QUERIES
from trailmark.plans.registry import FOCUS, MODEL, SCORED
from trailmark.sources import views

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    def text(x):
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return ""
        return str(int(x)) if isinstance(x, float) and x == int(x) else repr(round(x, 6)) if isinstance(x, float) else str(x)  # a nullable column of integers may come as floats

    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if out[c].dtype.kind == "M":
            out[c] = out[c].astype("datetime64[us]")
    return sorted(tuple(text(x) for x in r) for r in out.itertuples(index=False))


def database(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    want = database(sf).sql(ORACLE_SQL[name]).df()
    if name == "case_list":
        want["updated_at"] = want["updated_at"].dt.date
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(want)


def test_leads_on_the_forest_s_scores(spark, sf):
    """The stages behind the forest by SQL, with the forest's own table of scores as their input."""
    got = analyse(views.transfers(spark, sf), hops=False)
    c = database(sf)
    c.register("forest", got.anomaly.toPandas())
    scored = ", ".join(x for x in features.FEATURES if x != "hop_distance")
    sql = SCORED.replace("\nf AS (SELECT", "\nf0 AS (SELECT").replace(MODEL, MODEL[MODEL.index("fu AS") :])
    finite = " AND ".join(f"{x} IS NOT NULL" for x in scored.split(", "))
    sql = sql.replace("lim AS (", f"f AS (SELECT * FROM f0 WHERE {finite}), mp AS (SELECT wallet, anomaly_score AS ml_score, anomaly_prediction FROM forest), lim AS (", 1)
    want = c.sql(views.sql(f"WITH {sql}, {LD} SELECT wallet, combined_score, anomaly_prediction, priority_rank, priority_level, triggered_rules FROM ld", "t", "legs")).df()
    assert len(want) > 1 and rows(got.leads.select(*want.columns).toPandas()) == rows(want)


def test_forest(spark, sf):
    """Scores in range, about a tenth flagged, those the highest; the same under another partitioning."""
    from trailmark.operators.forest import isolation_forest

    got = QUERIES["isolation_forest"](spark, sf).toPandas()
    flagged = got[got.anomaly_prediction == "Anomalous"]
    assert got.anomaly_score.between(0, 1).all() and 0 < len(flagged) <= 0.1 * len(got) + 1
    assert flagged.anomaly_score.min() >= got[got.anomaly_prediction == "Normal"].anomaly_score.max()
    columns = [c for c in features.FEATURES if c != "hop_distance"]
    again = isolation_forest(features.wallet_features(views.transfers(spark, sf)).repartition(7, "fan_in"), columns)
    assert rows(again.toPandas()) == rows(got)


def test_explanations(spark, sf):
    got = QUERIES["rule_explanations"](spark, sf).collect()
    assert got and all(r["explanation"].count(").") >= r["rule_count"] == len([x for x in r["triggered_rules"].split(";") if x != "none"]) for r in got)


def test_nested_fusion(spark, sf):
    flat = {r["wallet"]: r for r in QUERIES["fusion"](spark, sf).collect()}
    got = QUERIES["nested_fusion"](spark, sf).collect()
    assert len(got) == len(flat) and all((r["ml"]["ml_score"], r["fusion"]["combined_score"], r["forensic"]["rule_count"]) == (flat[r["wallet"]]["ml_score"], flat[r["wallet"]]["combined_score"], flat[r["wallet"]]["rule_count"]) for r in got)


def neighbours(spark, sf):
    out = {}
    for r in views.transfers(spark, sf).select("sender", "receiver").distinct().collect():
        out.setdefault(r["sender"], set()).add(r["receiver"])
    return out


def test_shortest_path(spark, sf):
    near, reached, edge, hops = neighbours(spark, sf), {FOCUS}, {FOCUS}, 0
    while edge and "w000042" not in reached:
        edge = {y for x in edge for y in near.get(x, ())} - reached
        reached, hops = reached | edge, hops + 1
    got = [r["wallet"] for r in sorted(QUERIES["shortest_path"](spark, sf).collect(), key=lambda r: r["position"])]
    if "w000042" in reached:
        assert len(got) == hops + 1 and (got[0], got[-1]) == (FOCUS, "w000042") and all(b in near[a] for a, b in zip(got, got[1:], strict=False))


def test_partitions_of_wallets(spark, sf):
    """Communities and stable ids give each wallet one group; stable ids keep an old id at most once."""
    for name in ("communities", "stable_ids"):
        got = QUERIES[name](spark, sf).toPandas()
        wallet = next(c for c in got.columns if c == "wallet")
        assert len(got) and got[wallet].is_unique, name
    old = QUERIES["net_clusters"](spark, sf).toPandas()
    joined = old.merge(got, on="wallet", suffixes=("", "_new"))
    assert (joined.groupby("cluster_id")["cluster_id_new"].nunique() == 1).all()


def test_graph_views(spark, sf):
    nodes = {r["id"] for r in QUERIES["graph_wallet_nodes"](spark, sf).collect()}
    edges = QUERIES["graph_wallet_edges"](spark, sf).collect()
    assert f"wallet:{FOCUS}" in nodes and edges and all(e["source"] in nodes and e["target"] in nodes for e in edges)
    got = QUERIES["graph_entity_edges"](spark, sf).toPandas()
    assert len(got) and got["id"].is_unique and {"in_entity", "input_of", "sent_from_ip"} <= set(got["type"])


def test_every_query_has_a_check():
    assert set(QUERIES) - set(ORACLE_SQL) == {"analysis_run", "communities", "graph_entity_edges", "graph_wallet_nodes", "isolation_forest", "nested_fusion", "rule_explanations", "shortest_path", "stable_ids"}


def test_risk_reaches_every_wallet_within_its_hops(spark, tmp_path):
    """More wallets than an analyst's view shows: the query has all of them, as its SQL."""
    rows_ = [(k, datetime(2026, 1, 1) + timedelta(minutes=k), 7, 1.0, f'{{"k": {1000 + k}}}') for k in range(300)]
    spark.createDataFrame(rows_, "event_id long, ts timestamp_ntz, user_id long, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = c.sql(ORACLE_SQL["risk_propagation"]).df()
    assert len(want) == 301 and rows(QUERIES["risk_propagation"](spark, str(tmp_path)).toPandas()) == rows(want)


def giant_entity(spark, folder):
    """A ledger whose entity CIO-a-1-1-1 spends in 1,100 orders of as many customers, each of whom has an order of another entity."""
    orders = [(2 * c + k, c, datetime(2026, 1, 1)) for c in range(1, 1101) for k in range(2)]
    lines = [(o, 1, 1 if o % 2 == 0 else 1000 + c, 1, 1.0, 5.0) for o, c, _ in orders]
    tables = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"), "customer": ([(c, 1) for c in range(1, 1101)], "c_custkey long, c_nationkey int"), "nation": ([(1, "N")], "n_nationkey int, n_name string"),
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"),
    }
    c = duckdb.connect()
    for name, (some, schema) in tables.items():
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        c.sql(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return c


def test_details_of_a_giant_entity_are_whole(spark, tmp_path):
    want = giant_entity(spark, tmp_path).sql(ORACLE_SQL["entity_detail"]).df()
    assert want["related"][0] == 1100 and want["findings"][0] == 1100 and want["wallets"][0].count(",") == 1099
    assert rows(QUERIES["entity_detail"](spark, str(tmp_path)).toPandas()) == rows(want)


def test_wallets_of_a_giant_entity_are_whole(spark, tmp_path):
    want = giant_entity(spark, tmp_path).sql(ORACLE_SQL["entity_linked_wallets"]).df()
    assert len(want) == 1101 and want["wallets"].str.count(",").max() == 1099
    assert rows(QUERIES["entity_linked_wallets"](spark, str(tmp_path)).toPandas()) == rows(want)
