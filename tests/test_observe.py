"""Live observation as a stream against the same by a plain replay, with history before it and restarts between its batches."""

import random
from datetime import datetime, timedelta

import pytest

from trailmark.streaming import observe, sessions

EVENT = "observation_id string, transaction_id string, wallet string, device_id string, ip_address string, observed_at timestamp_ntz"
START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def settings(spark):
    """Other tests' streams keep the usual settings."""
    yield
    for name in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"):
        spark.conf.unset(name)


def run(spark, tmp_path, batches, schema, build, mode):
    """Each batch of rows is a run of its own from the same checkpoint; returns what all of them gave."""
    observe.live_settings(spark)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(schema).parquet(source))
        write = lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def test_transfers_get_the_device_last_used(spark, tmp_path):
    rng = random.Random(5)
    at = lambda: START + timedelta(seconds=rng.randint(0, 9000))
    seen = lambda k: (f"o{k:04d}", None, f"w{rng.randint(0, 4)}", f"d{rng.randint(0, 3)}", rng.choice(["1.1.1.1", "2.2.2.2", None]), at())
    history = [(f"h{k}", None, f"w{k}", f"d{k}", "9.9.9.9", START + timedelta(seconds=3000)) for k in range(2)]
    batches, k = [], 0
    for _ in range(3):
        rows = []
        for _ in range(30):
            k += 1
            rows.append(seen(k) if rng.random() < 0.4 else (f"o{k:04d}", f"t{k}", f"w{rng.randint(0, 5)}", None, None, at()))
        batches.append(rows + [("x", None, None, "d1", None, START), ("y", None, "w1", "d1", None, None)])
    known = {w: (t, o, d, ip) for o, _, w, d, ip, t in history}
    want = []
    for rows in batches:
        for o, x, w, d, ip, t in sorted((r for r in rows if r[2] and r[5]), key=lambda r: (r[5], r[0])):
            if d is not None and (w not in known or (t, o) >= known[w][:2]):
                known[w] = (t, o, d, ip)
            d, ip = (d, ip) if d is not None else known.get(w, (None,) * 4)[2:]
            want.append((o, x, w, d, ip, t))
    past = spark.createDataFrame(history, EVENT)
    got = run(spark, tmp_path, batches, EVENT, lambda s: observe.live_devices(s, past), "append")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert any(r[1] and r[3] for r in want) and any(r[1] and r[3] is None for r in want)


def test_both_sides_of_a_transfer(spark):
    t = spark.createDataFrame([("t1", START, "a", "b")], "transaction_id string, ts timestamp_ntz, sender string, receiver string")
    got = {tuple(r) for r in observe.ledger_events(t).collect()}
    assert got == {("obs-t1-S", "t1", "a", None, None, START), ("obs-t1-R", "t1", "b", None, None, START)}


def test_sessions_of_any_age(spark, tmp_path):
    """Rows come in any order, so that pieces older than what is kept are touched again; the settled result is that of one table."""
    rng = random.Random(9)
    schema = "device_id string, observation_id string, observed_at timestamp_ntz"
    row = lambda k: (f"d{rng.randint(0, 2)}", f"o{k}", START + timedelta(minutes=rng.choice([rng.randint(0, 40_000), rng.randint(0, 600)])))
    rows = [row(k) for k in range(260)] + [("edge", "e0", START), ("edge", "e1", START + timedelta(hours=2)), ("edge", "e2", START + timedelta(hours=4, seconds=1)), (None, "n", START), ("d0", "n", None)]
    joined = [("join", f"j{k}", START + timedelta(minutes=m)) for k, m in enumerate((0, 180, 90))]  # the third row makes one of two
    first, rest = rows[:60], rows[60:]
    batches = [rest[k::3] + some for k, some in enumerate((joined[:2], [], joined[2:]))]
    past = observe.session_pieces(sessions.sessions(spark.createDataFrame(first, schema)))
    updates = run(spark, tmp_path, batches, schema, lambda s: observe.live_sessions(s, past, keep_hours=12), "update")
    facts = lambda df: sorted((r["device_id"], r["session_no"], r["first_at"], r["last_at"], r["n"]) for r in df.collect())
    want = facts(sessions.sessions(spark.createDataFrame(rows + joined, schema)))
    assert facts(observe.settle_sessions(updates, past)) == want
    assert len(want) > 50 and updates.where("n = 0").count() > 0
    with pytest.raises(ValueError):
        observe.live_sessions(spark.createDataFrame([], schema), keep_hours=2)
