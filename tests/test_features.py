"""Features, rules and fusion on a ledger small enough to work out by hand."""

import random
from datetime import datetime, timedelta

import pytest

from trailmark.operators import features, hops, fusion, rules
from trailmark.operators.hops import hop_distance
from trailmark.plans.analysis import analyse

ROWS = [
    ("t1", "2025-10-01 08:00:00", "wallet_A", "wallet_B", 0.5), ("t2", "2025-10-02 09:30:00", "wallet_B", "wallet_C", 0.25), ("t3", "2025-10-02 09:30:00", "wallet_A", "wallet_C", 1.0),
    ("t4", "2025-11-15 12:00:00", "wallet_C", "wallet_D", 0.1), ("t5", "2026-03-03 18:45:10", "wallet_D", "wallet_A", 2.0), ("t6", "2026-09-24 21:00:00", "wallet_E", "wallet_A", 0.05),
]
EXPECTED = {
    "wallet_A": (4, 2, 2, 2.05, 1.5, 0.8875, 4922.247222, 2868.333333, 0.011156, 4922.247222, 1, 1.366667, 2, 2, 4, 4, 0, 1.0),
    "wallet_B": (2, 1, 1, 0.5, 0.25, 0.375, 25.5, 25.5, 1.882353, 25.5, 1, 2.0, 1, 1, 2, 2, 0, 1.5),
    "wallet_C": (3, 2, 1, 1.25, 0.1, 0.45, 1058.5, 529.25, 0.068021, 1058.5, 2, 12.5, 2, 1, 3, 3, 0, 1.25),
    "wallet_D": (2, 1, 1, 0.1, 2.0, 1.05, 2598.752778, 2598.752778, 0.01847, 2598.752778, 1, 0.05, 1, 1, 2, 2, 0, 1.5),
    "wallet_E": (1, 0, 1, 0.0, 0.05, 0.05, None, None, None, None, 1, 0.0, 0, 1, 1, 1, 0, 1.75),
}


def ledger(spark, rows=ROWS):
    return spark.createDataFrame([(i, datetime.fromisoformat(t), s, r, a) for i, t, s, r, a in rows], "transaction_id string, ts timestamp_ntz, sender string, receiver string, amount double")


def test_small_ledger(spark):
    t = ledger(spark).repartition(3)
    got = {r["wallet"]: tuple(r)[1:] for r in features.wallet_features(t, hop_distance(t)).collect()}
    for wallet, want in EXPECTED.items():
        for k, (g, w) in enumerate(zip(got[wallet], want, strict=True)):
            assert g == (pytest.approx(w, abs=1e-6) if w is not None else None), (wallet, features.FEATURES[k])


def test_hops_against_plain_search(spark):
    """Several blocks of sources, parts that are not linked, and a long path."""
    rng = random.Random(5)
    links = [(f"a{rng.randrange(90):02}", f"a{rng.randrange(90):02}") for _ in range(150)] + [(f"p{k:02}", f"p{k + 1:02}") for k in range(9)] + [("x", "x")]
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for s in near:
        at, edge = {s: 0}, [s]
        while edge:
            edge = [y for x in edge for y in near[x] if y not in at and at.update({y: at[x] + 1}) is None]
        want[s] = sum(at.values()) / (len(at) - 1)
    t = spark.createDataFrame(links, "sender string, receiver string").repartition(3)
    for masks in (1, 8):
        assert {r[0]: r[1] for r in hop_distance(t, masks).collect()} == pytest.approx(want)
    assert hop_distance(t.where("sender = 'x'")).count() == 0


def test_hops_of_many_wallets_and_few_hubs(spark, monkeypatch):
    """The busier ends of all links carry the search, over several blocks, with twins, unlinked parts and tiles of few classes; one
    wallet more than may carry it, and it goes from all."""
    rng = random.Random(6)
    links = [(f"h{rng.randrange(70):02}", f"u{k % 150:03}") for k in range(400)] + [("h00", f"t{k}") for k in range(9)] + [("far", "h00"), ("far", "farther")] + [(f"o{k}", "other") for k in range(5)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for s in near:
        at, edge = {s: 0}, [s]
        while edge:
            edge = [y for x in edge for y in near[x] if y not in at and at.update({y: at[x] + 1}) is None]
        want[s] = sum(at.values()) / (len(at) - 1)
    heads = {max(e, key=lambda x: (len(near[x]), x)) for e in links}
    starts, whole = [], hops._search
    monkeypatch.setattr(hops, "_search", lambda sym, sources, *rest: (starts.append(sources.count()), whole(sym, sources, *rest))[1])
    monkeypatch.setattr(hops, "TILE", 2000)
    monkeypatch.setattr(hops, "PART", 600)
    t = spark.createDataFrame(links, "sender string, receiver string")
    for cover in (len(heads), len(heads) - 1):
        assert {r[0]: r[1] for r in hop_distance(t, 1, cover).collect()} == pytest.approx(want)
    assert starts == [len(heads), len(near)]


def test_mirror(spark):
    legs = features.legs(ledger(spark))
    assert legs.count() == 12 and features.mirror_breaks(legs).isEmpty()
    assert features.mirror_breaks(legs.where("not (wallet = 'wallet_B' and direction = 'Incoming')")).count() == 1


def test_rules_and_text(spark):
    f = features.wallet_features(ledger(spark))
    got = {r["wallet"]: r for r in rules.rule_results(rules.with_findings(f)).collect()}
    assert "high_transaction_count" in got["wallet_A"]["triggered_rules"]
    assert "(transaction_count=4; above the population 90th percentile of 3.6)." in got["wallet_A"]["explanation"]
    assert got["wallet_B"]["triggered_rules"] == "high_transaction_frequency"
    assert got["wallet_B"]["evidence_level"] == "Single behavioural indicator"


def test_compact_numbers(spark):
    from pyspark.sql import functions as F

    from trailmark.functions.scalars import compact_number

    values = [0.5, 3.0, 12.345, 123456.7, 0.00001234, 0.05, -2.5, 1200.0, 999.6]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(compact_number(F.col("v"))).collect()]
    assert got == [f"{v:.0f}" if v == int(v) else f"{v:.3g}" for v in values]


def test_fusion(spark):
    forensic = spark.createDataFrame([("a", 6, "x", "r1;r2", "t"), ("b", 0, "x", "none", "t"), ("d", 1, "x", "r", "t"), ("d", 2, "x", "r", "t"), ("e", 1, "x", "", "t"), (" ", 1, "x", "r", "t")], "wallet string, rule_count int, evidence_level string, triggered_rules string, explanation string")
    model = spark.createDataFrame([("a", 0.75, "Anomalous"), ("c", 0.5, "Normal"), ("d", 0.5, "Normal"), ("e", 1.7, "Normal")], "wallet string, anomaly_score double, anomaly_prediction string")
    got = {r["wallet"]: r for r in fusion.fuse(forensic, model).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    assert got["a"]["combined_score"] == pytest.approx(0.4 * 6 / 11 + 0.6 * 0.75, abs=1e-6) and got["a"]["valid"]
    assert got["b"]["combined_score"] is None and got["b"]["errors"] == "model: no row of this wallet"
    assert got["c"]["errors"] == "rules: no row of this wallet"
    assert "several rows of this wallet" in got["d"]["errors"] and got["d"]["rule_count"] is None
    assert "outside 0 to 1" in got["e"]["errors"] and got["e"]["ml_score"] is None and got["e"]["warnings"]


def test_priority_bands(spark):
    rows = [(f"w{k:02d}", 1 - k / 100, True) for k in range(20)]
    got = {r["wallet"]: (r["priority_rank"], r["priority_level"]) for r in fusion.priority(spark.createDataFrame(rows, "wallet string, combined_score double, valid boolean")).collect()}
    assert [got[f"w{k:02d}"] for k in (0, 1, 3, 4)] == [(1, "High"), (2, "Medium"), (4, "Medium"), (5, "Low")]


def test_planted_hub_is_a_lead(spark):
    import random

    rng = random.Random(7)
    start = datetime(2025, 1, 1).timestamp()
    rows = []
    add = lambda s, r, a: rows.append((f"t{len(rows):05d}", datetime.fromtimestamp(start + rng.random() * 300 * 86400).isoformat(), s, r, a))
    for k in range(60):
        add(f"w{k:03d}", f"w{(k + 1) % 60:03d}", rng.lognormvariate(-3, 0.8))
        add(f"w{(k + 1) % 60:03d}", f"w{k:03d}", rng.lognormvariate(-3, 0.8))
    for _ in range(700):
        a, b = rng.sample(range(60), 2)
        add(f"w{a:03d}", f"w{b:03d}", rng.lognormvariate(-3, 0.8))
    for k in range(5, 50):
        for _ in range(rng.randint(1, 3)):
            add(f"w{k:03d}", "w000", rng.uniform(0.5, 3))
    t = ledger(spark, rows)
    a, b = analyse(t), analyse(t.repartition(7))
    first = {r["wallet"]: r["anomaly_score"] for r in a.anomaly.collect()}
    assert first == {r["wallet"]: r["anomaly_score"] for r in b.anomaly.collect()}
    leads = {r["wallet"]: r for r in a.leads.collect()}
    assert leads["w000"]["priority_rank"] == 1
    assert 3 <= sum(r["anomaly_prediction"] == "Anomalous" for r in a.anomaly.collect()) <= 9


def test_bursts_and_gaps_of_any_times(spark):
    """Bursts around noon and midnight and of equal times, gaps of equal times; a leg is shown to another span only near its start,
    and no id is shuffled for times."""
    rng = random.Random(3)
    base = [0, 12 * 3600, 24 * 3600, 36 * 3600]
    rows = [("w", rng.choice(base) + rng.choice([-3600, -1800, -1, 0, 0, 1, 1800, 3599, 3600])) for _ in range(60)] + [("one", 5), ("two", 7), ("two", 7)]
    legs_ = spark.createDataFrame([(w, f"t{k}", datetime(2026, 1, 5) + timedelta(seconds=s)) for k, (w, s) in enumerate(rows)], "wallet string, transaction_id string, ts timestamp_ntz")
    times = {w: sorted(s for v, s in rows if v == w) for w, _ in rows}
    burst = features.activity_burst(legs_)
    assert {r[0]: r[1] for r in burst.collect()} == {w: max(sum(t <= u < t + 3600 for u in ts) for t in ts) for w, ts in times.items()}
    assert {r["wallet"]: r["activity_burst"] for r in features.activity_burst(legs_, 200_000).collect()} == {w: max(sum(t <= u < t + 200_000 for u in ts) for t in ts) for w, ts in times.items()}
    got = features.time_features(legs_)
    gaps = {w: [b - a for a, b in zip(ts, ts[1:], strict=False)] for w, ts in times.items()}
    assert {r["wallet"]: (r["time_since_previous_tx"], r["dormancy_duration"]) for r in got.collect()} == {w: (g[-1] / 3600, max(g) / 3600) if g else (None, None) for w, g in gaps.items()}
    assert "transaction_id" not in got._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
