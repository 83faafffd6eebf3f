"""Runs, exports, cases, upserts and purges on literal cases."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from trailmark.functions.scalars import documentation_ip
from trailmark.operators import clusters, graphview, records
from trailmark.plans import analysis
from trailmark.sources import files

LEADS = "wallet string, priority_rank long, priority_level string, anomaly_prediction string, combined_score double, ml_score double, source string"


def leads(spark):
    rows = [("wB", 1, "High", "Anomalous", 0.9, 0.8, "x"), ("wA", 2, "High", "Normal", 0.9, 0.1, "x"), ("wC", 3, "Low", "Anomalous", 0.2, 0.7, "y")]
    return spark.createDataFrame(rows, LEADS)


def names(df, column="wallet"):
    return [r[column] for r in df.collect()]


def test_lead_pages(spark):
    df = leads(spark)
    assert names(records.list_leads(df, "combined_score", True)) == ["wA", "wB", "wC"] and names(records.list_leads(df, "wallet", True, 1, 1)) == ["wB"]
    assert names(records.list_leads(df, q="WA")) == ["wA"] and names(records.list_leads(df, level="High", prediction="Anomalous")) == ["wB"] and names(records.list_leads(df, source="y", least=0.3)) == []


def test_cluster_entity_and_case_pages(spark):
    summary = spark.createDataFrame([("c1", 3, 9, 0, 0.5, "m"), ("c2", 2, 9, 1, 0.1, "m"), ("c3", 3, 10, None, None, "n")], "cluster_id string, wallets long, transactions long, lead_count long, max_score double, method string")
    members = spark.createDataFrame([("c1", "w1"), ("c2", "w2"), ("c3", "w3")], "cluster_id string, wallet string")
    ids = lambda **k: names(records.list_clusters(summary, members, **k), "cluster_id")
    assert ids() == ["c2", "c1", "c3"] and ids(sort="size") == ["c3", "c1", "c2"] and ids(has_leads=False) == ["c1", "c3"] and ids(q="W3") == ["c3"] and ids(method="m", least_wallets=3) == ["c1"]
    cases = spark.createDataFrame([("k1", "Alpha", None, "Open", "High", date(2025, 1, 1), date(2025, 1, 2)), ("k2", "Beta", "x", "Closed", "Low", date(2025, 1, 2), date(2025, 1, 2))], "case_id string, title string, description string, status string, priority string, created_at date, updated_at date")
    items = spark.createDataFrame([("k1", "wallet", "w1"), ("k2", "cluster", "c2"), ("k2", "transaction", "t9"), ("k2", "entity", "E1")], "case_id string, item_type string, item_id string")
    assert names(records.list_cases(cases, items), "case_id") == ["k1", "k2"] and names(records.list_cases(cases, items, q="T9"), "case_id") == ["k2"] and names(records.list_cases(cases, items, item_id="w1", item_type="wallet"), "case_id") == ["k1"]
    t = spark.createDataFrame([("t9", datetime(2025, 1, 1), "p", "q", 2.0), ("t8", datetime(2025, 1, 2), "w1", "q", 3.0)], "transaction_id string, ts timestamp_ntz, sender string, receiver string, amount double")
    linked = spark.createDataFrame([("v", "E1")], "wallet string, entity_id string")
    assert {tuple(r) for r in records.case_seeds(items, members, t, linked).collect()} == {("k1", "w1"), ("k2", "w2"), ("k2", "p"), ("k2", "q"), ("k2", "v")}
    assert {(r["case_id"], r["total"], r["moved"]) for r in records.case_summary(items, t).collect()} == {("k1", 1, 3.0), ("k2", 1, 2.0)}


def test_graph_focus_kinds(spark):
    t = spark.createDataFrame([("t1", datetime(2025, 1, 1), "a", "b", 2.0), ("t2", datetime(2025, 1, 2), "b", "c", 3.0)], "transaction_id string, ts timestamp_ntz, sender string, receiver string, amount double")
    o = spark.createDataFrame([("a", "1.1.1.1", "d1", "s1"), ("b", "1.1.1.1", "d2", "s1"), ("c", None, None, None)], "wallet string, ip_address string, device_id string, session_id string")
    c = spark.createDataFrame([("c1", "c")], "cluster_id string, wallet string")
    seeds = lambda kind, value: set(names(graphview.focus_wallets(kind, value, t, o, c)))
    assert [seeds(*x) for x in (("wallet", "a"), ("transaction", "t2"), ("ip", "1.1.1.1"), ("device", "d2"), ("session", "s1"), ("cluster", "c1"))] == [{"a"}, {"b", "c"}, {"a", "b"}, {"b"}, {"a", "b"}, {"c"}]
    nodes, edges = graphview.wallet_graph(t, o, graphview.focus_wallets("wallet", "a", t, o), 1, 10)
    assert {r["id"] for r in nodes.collect()} == {"wallet:a", "wallet:b", "ip:1.1.1.1", "device:d1", "device:d2", "session:s1"}
    assert {(r["type"], r["source"], r["target"]) for r in edges.where("type in ('same_session', 'sent_to')").collect()} == {("same_session", "wallet:a", "wallet:b"), ("sent_to", "wallet:a", "wallet:b")}
    assert tuple(graphview.omitted_wallets(t, graphview.focus_wallets("wallet", "a", t, o), 2, 2).first()) == (3, 1)
    e = spark.createDataFrame([("E1", "x"), ("E2", "y")], "entity_id string, address string")
    i, links = spark.createDataFrame([("t1", "y")], "transaction_id string, address string"), spark.createDataFrame([("E1", "9.9.9.9")], "entity_id string, src_ip string")
    assert [names(graphview.focus_entities(*x, e, i, links), "entity_id") for x in (("entity", "E1"), ("address", "y"), ("transaction", "t1"), ("ip", "9.9.9.9"))] == [["E1"], ["E2"], ["E2"], ["E1"]]


def test_runs_purge_and_staleness(spark, tmp_path):
    one = spark.createDataFrame([("w", 1.0)], "wallet string, x double")
    result, folder = analysis.Analysis(one, one, one, one, one, one), str(tmp_path / "runs")
    for source, run in (("a", 1), ("a", 2), ("b", 1)):
        analysis.save_run(result, folder, source, run)
    table = spark.read.parquet(f"{folder}/leads")
    assert {(r["source"], r["run_id"]) for r in table.collect()} == {("a", 2), ("b", 1)} and [r["run_id"] for r in analysis.current(spark, folder, "leads", "a").collect()] == [2]
    assert records.purge_source(spark, folder, ("leads", "cases"), "a") == ["leads"] and [r["source"] for r in spark.read.parquet(f"{folder}/leads").collect()] == ["b"]
    runs = spark.createDataFrame([("a", k, "completed" if k < 60 else "failed", k) for k in range(1, 61)] + [("b", 2, "completed", 5)], "source string, run_id long, status string, transfer_count long")
    assert analysis.run_history(runs).count() == 51 and analysis.latest_run(runs, "a").first()["run_id"] == 59
    stale = lambda n, source: analysis.stale(runs, spark.range(n), source)
    assert (stale(59, "a"), stale(60, "a"), stale(5, "b"), stale(6, "b"), stale(0, "c"), stale(1, "c")) == (False, True, False, True, False, True)


def test_run_state_survives_a_crash(spark, tmp_path, monkeypatch):
    """A run that stops between two writes leaves the state as it was; leads keep their first time; records are kept to a number."""
    from datetime import timedelta

    t0, folder = datetime(2025, 1, 1), str(tmp_path / "state")
    leads_of = lambda *ws: (lambda df: analysis.Analysis(df, df, df, df, df, df))(spark.createDataFrame([(w, 1.0) for w in ws], "wallet string, x double"))
    state = lambda: {r["wallet"]: r["first_flagged_at"] for r in analysis.current(spark, folder, "leads", "a").collect()}
    assert analysis.current(spark, folder, "leads", "a") is None
    analysis.save_run(leads_of("u", "v"), folder, "a", 1, t0)
    assert state() == {"u": t0, "v": t0}
    make = analysis.Folder.create
    monkeypatch.setattr(analysis.Folder, "create", lambda self, name: (_ for _ in ()).throw(OSError("lost")) if "_manifests" in name else make(self, name))
    with pytest.raises(OSError, match="lost"):
        analysis.save_run(leads_of("v", "w"), folder, "a", 2, t0 + timedelta(days=1))
    monkeypatch.setattr(analysis.Folder, "create", make)
    assert analysis.current_run(spark, folder, "a") == 1 and state() == {"u": t0, "v": t0}
    analysis.save_run(leads_of("v", "w"), folder, "a", 2, t0 + timedelta(days=2))
    assert state() == {"v": t0, "w": t0 + timedelta(days=2)} and spark.read.parquet(f"{folder}/features").select("run_id").distinct().count() == 1
    changes = analysis.lead_changes(leads_of("u", "v").leads, leads_of("v", "w").leads)
    assert {tuple(r) for r in changes.collect()} == {("u", "gone"), ("v", "kept"), ("w", "new")}
    for k in range(1, 6):
        analysis.note_run(spark, folder, ("a", k, "running", k, t0, None, None), keep=3)
        analysis.note_run(spark, folder, ("a", k, "completed", k, t0, t0, None), keep=3)
    assert sorted((r["run_id"], r["status"]) for r in analysis.run_records(spark, folder).collect()) == [(k, "completed") for k in (3, 4, 5)]


def test_failed_and_concurrent_runs(spark, tmp_path):
    t = spark.createDataFrame([("t1", datetime(2025, 1, 1), "a", "b", 2.0)], "transaction_id string, ts timestamp_ntz, sender string, receiver string, amount double")
    folder = str(tmp_path / "runs")
    for _ in range(2):
        with pytest.raises(ValueError, match="fewer than 20"):
            analysis.run_analysis(t, folder, "a")
    runs = analysis.run_records(spark, folder).orderBy("run_id").collect()
    assert [(r["run_id"], r["status"], r["transfer_count"], r["error"][:10]) for r in runs] == [(1, "failed", 1, "ValueError"), (2, "failed", 1, "ValueError")]
    (tmp_path / "runs" / "_running-a").touch()
    with pytest.raises(RuntimeError, match="running"):
        analysis.run_analysis(t, folder, "a")
    with pytest.raises(ValueError, match="fewer than 20"):  # the lock of a driver that is lost
        analysis.run_analysis(t, folder, "a", lock_seconds=-1)
    analysis.replace_source(spark.createDataFrame([("x",)], "c string"), f"{folder}/chains", "a")
    analysis.replace_source(spark.createDataFrame([("y",)], "c string"), f"{folder}/chains", "b")
    analysis.replace_source(spark.createDataFrame([("z",)], "c string"), f"{folder}/chains", "a")
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/chains").collect()} == {("z", "a"), ("y", "b")}


def test_case_states_upsert_and_exports(spark, tmp_path):
    log = spark.createDataFrame([("k", datetime(2025, 1, 1), "status", "Open"), ("k", datetime(2025, 1, 2), "status", "Closed"), ("k", datetime(2025, 1, 1), "title", "T")], "case_id string, at timestamp_ntz, field string, value string")
    assert tuple(analysis.case_states(log).first()) == ("k", "T", "Closed", None)
    t0 = datetime(2025, 1, 1)
    old = spark.createDataFrame([("a", "same", t0, t0), ("b", "was", t0, t0), ("gone", "x", t0, t0)], "id string, content string, created_at timestamp_ntz, updated_at timestamp_ntz")
    got = {r["id"]: (r["change"], r["created_at"] == t0, r["updated_at"] == t0) for r in clusters.upsert(old, spark.createDataFrame([("a", "same"), ("b", "is"), ("c", "new")], "id string, content string"), "id", "2025-02-01 00:00:00").collect()}
    assert got == {"a": ("unchanged", True, True), "b": ("updated", True, False), "c": ("created", False, False)}
    df = spark.createDataFrame([(1, 'say "hi", all', None)], "n int, text string, z string")
    files.export_csv(df, str(tmp_path / "csv"))
    files.export_json(df, str(tmp_path / "json"))
    assert tuple(spark.read.schema(df.schema).options(header=True, escape='"').csv(str(tmp_path / "csv")).first()) == (1, 'say "hi", all', None)
    assert spark.read.schema(df.schema).json(str(tmp_path / "json")).first()["text"] == 'say "hi", all'
    ips = spark.createDataFrame([("192.0.2.7",), ("8.8.8.8",), (None,)], "ip string")
    assert [r[0] for r in ips.select(documentation_ip("ip")).collect()] == [True, False, None]


def test_observations(spark):
    o = spark.createDataFrame([("obs-1-S", "w", "i", "d", datetime(2025, 1, 1)), ("obs-2-R", "w", "i", "d", datetime(2025, 1, 2)), ("obs-3", "w", "j", None, datetime(2025, 1, 2))], "observation_id string, wallet string, ip_address string, device_id string, observed_at timestamp_ntz")
    got = records.list_observations(o, wallet="w").select("observation_id", "observed_party").collect()
    assert [tuple(r) for r in got] == [("obs-2-R", "receiver"), ("obs-3", None), ("obs-1-S", "sender")]
    r = records.key_profile(o.withColumn("transaction_id", F.lit("t")), "ip_address", ("device_id",)).where("ip_address = 'i'").first()
    assert (r["n"], r["wallets"], r["transactions"], r["device_id_count"], r["device_id_list"]) == (2, 1, 1, 1, ["d"])


def test_ingest_state_under_late_rows_and_replays(spark, tmp_path):
    """Spans and numbers kept batch by batch equal those of the whole, whatever comes late, runs twice or stops halfway."""
    import random
    from datetime import timedelta

    from trailmark.streaming import wallets

    rng, folder, t0 = random.Random(3), str(tmp_path / "state"), datetime(2025, 1, 1)
    columns = "transaction_id string, position long, ts timestamp_ntz, sender string, receiver string"
    rows = [(None if rng.random() < 0.5 else f"x{k}", k, t0 + timedelta(minutes=rng.randrange(10_000)), f"w{rng.randrange(12)}", f"w{rng.randrange(12)}") for k in range(120)]
    rows[70] = ("syn-000500", *rows[70][1:])  # a number that came with its row
    batches, stored, want, last = [rows[a : a + 30] for a in range(0, 120, 30)], {}, [], 0
    for b, some in enumerate(batches):
        for again in range(2 if b in (1, 3) else 1):  # run again, as after a failure: the same numbers
            before = wallets.last_number(spark, folder, b)
            got = wallets.number(spark.createDataFrame(some, columns).repartition(3), before)
            stored[b] = {r["position"]: r["transaction_id"] for r in got.collect()}
            wallets.keep_spans(got, folder, b)
            wallets.keep_number(got, folder, b, before)
        for i, k, *_ in some:
            last += i is None
            want.append((k, i or f"syn-{last:06d}"))
        last = max([last, *(int(i[4:]) for i, *_ in some if i and i.startswith("syn-"))])
        if b == 2:
            assert wallets.compact(spark, folder) == 1
    assert [x for s in stored.values() for x in sorted(s.items())] == want and wallets.last_number(spark, folder) == last > 500
    ends = [(w, ts) for _, _, ts, a, b in rows for w in {a, b}]
    whole = {w: (min(t for x, t in ends if x == w), max(t for x, t in ends if x == w), sum(x == w for x, _ in ends)) for w, _ in ends}
    spans = lambda: {r["wallet"]: tuple(r)[1:] for r in wallets.wallet_spans(spark, folder).collect()}
    assert spans() == whole
    (tmp_path / "state" / "base" / "upto=3").mkdir()  # a base that was not finished does not count
    assert spans() == whole and wallets.compact(spark, folder, leave=0) == 3 and spans() == whole
    assert wallets.wallet_spans(spark, str(tmp_path / "none")).count() == 0


def test_longest_prefix_against_search(spark):
    """Nested and equal prefixes, both versions, bad and non-public addresses."""
    import ipaddress
    import random

    from trailmark.operators.listing import longest_prefix

    rng = random.Random(12)
    nets = [f"{rng.choice([8, 9, 31])}.{rng.randrange(3)}.{rng.randrange(3)}.0/{n}" for n in (8, 15, 16, 22, 24) for _ in range(6)] + ["0.0.0.0/0", "2a00::/12", "2a00:1::/32", "2a00:1:2::/48", "8.8.8.8/32", "8.8.8.8/32", "9.9.9.9", "10.0.0.0/8", "nonsense/8", "1.2.3.4/33"]
    rows = [(n, f"{k:02}") for k, n in enumerate(nets)]
    ips = [f"{rng.choice([8, 9, 31, 44])}.{rng.randrange(4)}.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(80)] + ["8.8.8.8", "9.9.9.9", "2a00:1:2::7", "2A00:1::9", "2a00:5::1", "2607::1", "999.1.1.1", "01.2.3.4", "10.1.1.1", "2001:db8::1", " 8.8.8.8", "", None]

    def best(ip, public):
        try:
            a = ipaddress.ip_address(ip.strip())
        except (ValueError, AttributeError):
            return None
        if public and not a.is_global:
            return None
        hits = []
        for n, g in rows:
            try:
                net = ipaddress.ip_network(n, strict=False)
            except ValueError:
                continue
            if net.version == a.version and a in net:
                hits.append((-net.prefixlen, g))
        return min(hits)[1] if hits else None

    df, prefixes = spark.createDataFrame([(k, ip) for k, ip in enumerate(ips)], "k int, src_ip string"), spark.createDataFrame(rows, "network string, g string")
    for public in (True, False):
        got = {r["k"]: r["g"] for r in longest_prefix(df, prefixes, public_only=public).collect()}
        assert got == {k: best(ip, public) for k, ip in enumerate(ips)}


def test_details_of_a_giant_group_are_cut(spark):
    """Lists hold the first items and the count of all; places of members come without a task that holds the cluster."""
    many = spark.range(500).selectExpr("concat('w', lpad(cast(id as string), 4, '0')) as wallet", "'big' as cluster_id", "cast(if(id % 5 = 0, null, 500 - id) as long) as priority_rank")
    got = records.cluster_members(many.select("cluster_id", "wallet").unionAll(spark.createDataFrame([("a", "w0003")], "cluster_id string, wallet string")), many.select("wallet", "priority_rank")).collect()
    want = sorted((r for r in got if r["cluster_id"] == "big"), key=lambda r: (r["priority_rank"] is None, r["priority_rank"] or 0, r["wallet"]))
    assert [r["place"] for r in want] == list(range(1, 501)) and [r["place"] for r in got if r["cluster_id"] == "a"] == [1]
    top = records.first_items(many, "cluster_id", "wallet", "wallets", 3).first()
    assert (top["wallets"], top["n"]) == (["w0000", "w0001", "w0002"], 500)


def test_wallets_of_a_long_chain_are_whole(spark):
    hops = spark.range(1200).selectExpr("'c' as chain_id", "concat('w', lpad(cast(id as string), 4, '0')) as from_wallet", "concat('w', lpad(cast(id + 1 as string), 4, '0')) as to_wallet")
    got = records.list_chains(spark.createDataFrame([("c", 1200)], "chain_id string, hop_count int"), hops).collect()
    assert [r["wallets"] for r in got] == [[f"w{k:04}" for k in range(1201)]]
