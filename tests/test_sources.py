"""Files, validation, ingestion and streams."""

import json
from datetime import datetime

import pytest

from trailmark import schemas
from trailmark.operators import validate
from trailmark.sources import files
from trailmark.streaming import monitor, sessions

BASE = {
    "timestamp": "2025-10-01T06:17:43Z", "txid": "AB" * 32, "legacy_transaction_id": "syn-1", "sender_wallet": "w1", "receiver_wallet": "w2", "amount_btc": 0.9, "fee_btc": 0.00001, "script_type": "P2PKH",
    "input_addresses": ["a1", "a2"], "input_amounts": [0.6, 0.40001], "output_addresses": ["b1", "b2"], "output_amounts": [0.9, 0.1], "src_ip": "8.8.8.8", "dst_ip": "2001:DB8::0001", "src_port": 1, "dst_port": 8333, "geo_country": "de", "asn": 1, "asn_org": "x",
}


def rich(spark, *changes):
    rows = [BASE | c for c in changes]
    names = [f.split(" ")[0] for f in schemas.RICH.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schemas.RICH)
    return validate.check_rich(validate.normalise_rich(df))


def test_rich_record_is_normalised(spark):
    r = rich(spark, {"timestamp": "2025-10-01T08:17:43+02:00"}).first()
    assert (r["reasons"], r["txid"], r["script_type"], r["geo_country"], r["dst_ip_ok"], r["ts"]) == ("", "ab" * 32, "p2pkh", "DE", "2001:db8::1", datetime(2025, 10, 1, 6, 17, 43))


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"txid": "xyz"}, "txid"), ({"script_type": "p2x"}, "script_type"), ({"fee_btc": -1.0}, "fee_btc"), ({"input_amounts": [1.00001]}, "differ in length"), ({"input_addresses": [], "input_amounts": []}, "no inputs"),
        ({"output_amounts": [0.9, 0.1, 1e-10], "output_addresses": ["b", "c", "d"]}, "1 satoshi"), ({"fee_btc": 0.0000102}, "balance"), ({"input_addresses": ["a b", "c"]}, "addresses"), ({"src_ip": "300.1.1.1"}, "IP"),
        ({"src_port": 70000}, "port"), ({"geo_country": "DEU"}, "geo_country"), ({"amount_btc": 0.5}, "amount_btc"), ({"receiver_wallet": "w1"}, "must differ"), ({"timestamp": "soon"}, "timestamp"),
    ],
)
def test_rich_rejects(spark, change, reason):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert reason in rich(spark, change).first()["reasons"]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_balance_tolerance(spark):
    assert rich(spark, {"fee_btc": 0.00001001}).first()["reasons"] == "" and "balance" in rich(spark, {"fee_btc": 0.00001002}).first()["reasons"]


def test_four_formats_agree(spark, tmp_path):
    record = BASE | {"dst_ip": "1.1.1.1"}
    (tmp_path / "r.json").write_text(json.dumps([record]))
    (tmp_path / "w.json").write_text(json.dumps({"transactions": [record]}))
    (tmp_path / "r.jsonl").write_text(json.dumps(record) + "\n\n{broken\n")
    cell = lambda v: '"' + json.dumps(v).replace('"', '""') + '"' if isinstance(v, list) else str(v)
    (tmp_path / "r.csv").write_text(",".join(record) + "\n" + ",".join(cell(v) for v in record.values()) + "\n")
    lists = lambda k, v: "".join(f"<{'address' if 'addresses' in k else 'amount'}>{x}</{'address' if 'addresses' in k else 'amount'}>" for x in v)
    body = "".join(f"<{k}>{lists(k, v) if isinstance(v, list) else v}</{k}>" for k, v in record.items())
    (tmp_path / "r.xml").write_text(f"<transactions><transaction>{body}</transaction></transactions>")
    names = [f.split(" ")[0] for f in schemas.RICH.split(", ")]
    one = lambda df: df.where("txid is not null").select(*names).collect()
    got = [one(files.read_rich_json(spark, str(tmp_path / "r.json"))), one(files.read_rich_json(spark, str(tmp_path / "w.json"))), one(files.read_rich_csv(spark, str(tmp_path / "r.csv"))), one(files.read_rich_xml(spark, str(tmp_path / "r.xml")))]
    lines = files.read_rich_jsonl(spark, str(tmp_path / "r.jsonl")).cache()
    assert lines.where("_corrupt_record is not null").count() == 1
    got.append(one(lines))
    assert len(got[0]) == 1 and all(g == got[0] for g in got)
    (tmp_path / "bad.xml").write_text('<!DOCTYPE x [<!ENTITY e "boom">]><transactions/>')
    with pytest.raises(ValueError, match="not allowed"):
        files.read_rich_xml(spark, str(tmp_path / "bad.xml"))
    with pytest.raises(ValueError, match="at most"):
        files.guard(spark, str(tmp_path / "r.json"), 10)


def test_import_rich(spark):
    recs = rich(spark, {}, {}, {"fee_btc": 0.0, "input_amounts": [0.6, 0.4]}, {"txid": "CD" * 32, "legacy_transaction_id": "none"}, {"txid": "EF" * 32, "sender_wallet": "other"}, {"txid": "01" * 32, "legacy_transaction_id": None, "sender_wallet": None})
    from pyspark.sql import functions as F

    recs = recs.withColumn("position", F.monotonically_increasing_id())
    stored = spark.createDataFrame([("syn-1", datetime(2025, 10, 1, 6, 17, 43), "w1", "w2", 0.9)], "transaction_id string, ts timestamp_ntz, sender string, receiver string, amount double")
    got = validate.import_rich(recs, stored, spark.createDataFrame([], "txid string, transaction_id string, signature string")).orderBy("position").collect()
    assert [r["outcome"] for r in got] == ["attached", "duplicate", "rejected", "created", "rejected", "rejected"]
    ins, outs = validate.explode_sides(recs.limit(1))
    assert ins.count() == 2 and outs.orderBy("position").first()["amount"] == 0.9


def test_ledger_file(spark, tmp_path):
    t = spark.createDataFrame([("x", datetime(2025, 1, 1, 1), "a", "b", 1.5), ("y", datetime(2025, 1, 2), "b", "a", 2.5)], "transaction_id string, ts timestamp_ntz, sender string, receiver string, amount double")
    files.write_ledger(t, str(tmp_path / "l"))
    back = files.read_ledger(spark, str(tmp_path / "l"))
    assert back.count() == 4 and files.ledger_breaks(back).isEmpty()
    assert files.ledger_breaks(back.where("not (wallet_address = 'a' and direction = 'Incoming')")).count() == 1
    assert {(r["transaction_id"], r["sender"]) for r in files.collapse_ledger(back).collect()} == {("syn-000001", "a"), ("syn-000002", "b")}


def test_sessions_merge_at_exactly_the_gap(spark):
    rows = [("d", "1", datetime(2025, 1, 1, 22)), ("d", "2", datetime(2025, 1, 2, 0)), ("d", "3", datetime(2025, 1, 2, 2, 0, 0, 1)), ("e", "4", datetime(2025, 1, 1))]
    df = spark.createDataFrame(rows, "device_id string, observation_id string, observed_at timestamp_ntz")
    got = {(r["device_id"], r["session_no"], r["n"]) for r in sessions.sessions(df).collect()}
    assert got == {("d", 0, 2), ("d", 1, 1), ("e", 0, 1)}


def test_monitor(spark, tmp_path):
    box, ledger, rejects = (str(tmp_path / x) for x in ("in", "ledger", "rejects"))
    (tmp_path / "in").mkdir()
    row = lambda i, s, a: json.dumps({"transaction_id": i, "ts": "2025-01-01T00:00:00", "sender": s, "receiver": "z", "amount": a, "input_count": 1, "output_count": 1})
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([row("t1", "a", 1), row("t2", "z", 1), row("t1", "a", 1)]))
    seen = []
    run = lambda: monitor.monitor(spark, box, ledger, rejects, str(tmp_path / "cp"), after=lambda df: seen.append(df.count())).awaitTermination()
    run()
    (tmp_path / "in" / "b.jsonl").write_text("\n".join([row("t1", "a", 1), row("t1", "a", 2), row("t3", "b", 5)]))
    run()
    assert seen == [1, 2]
    assert {r["transaction_id"] for r in monitor.known(spark, ledger).collect()} == {"t1", "t3"}
    assert {(r["transaction_id"], r["reason"]) for r in spark.read.parquet(rejects).collect()} == {("t2", "sender and receiver must differ"), ("t1", "conflict")}


def test_session_stream(spark, tmp_path):
    src = str(tmp_path / "obs")
    schema = "device_id string, observation_id string, observed_at timestamp_ntz"
    spark.createDataFrame([("d", "1", datetime(2025, 1, 1, 0)), ("d", "2", datetime(2025, 1, 1, 1)), ("d", "3", datetime(2025, 1, 1, 5))], schema).coalesce(1).write.parquet(src)
    out = sessions.stream_sessions(spark.readStream.schema(schema).parquet(src))
    q = out.writeStream.format("memory").queryName("sess").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["first_at"].hour, r["n"]) for r in spark.sql("select * from sess").collect()} == {(0, 2), (5, 1)}


def test_session_stream_with_late_rows(spark, tmp_path):
    """Rows in any order over several batches: the last update per session is what the batch operator finds."""
    import random

    rng, src = random.Random(4), str(tmp_path / "obs")
    schema = "device_id string, observation_id string, observed_at timestamp_ntz"
    rows = [(rng.choice("abc"), str(k), datetime(2025, 1, 1 + rng.randrange(9), rng.randrange(24), rng.randrange(60))) for k in range(120)]
    (tmp_path / "obs").mkdir()
    stream = sessions.stream_sessions(spark.readStream.schema(schema).parquet(src))
    latest = {}

    def keep(batch, _):
        for r in batch.collect():
            latest[r["device_id"], r["session_id"]] = (r["first_at"], r["last_at"], r["n"])

    for k in range(0, 120, 40):
        spark.createDataFrame(rows[k : k + 40], schema).coalesce(1).write.mode("append").parquet(src)
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = {(r["device_id"], r["first_at"], r["last_at"], r["n"]) for r in sessions.sessions(spark.createDataFrame(rows, schema)).collect()}
    assert {(d, *v) for (d, _), v in latest.items() if v[2]} == want


def test_inbox_limits_csv_and_failures(spark, tmp_path):
    box, ledger, rejects, cp = (str(tmp_path / x) for x in ("in", "ledger", "rejects", "cp"))
    (tmp_path / "in").mkdir()
    head = "transaction_id,source_ref,ts,sender,receiver,amount,input_count,output_count\n"
    (tmp_path / "in" / "a.csv").write_text(head + "t1,,2025-01-01T00:00:00,a,b,1.5,1,1\n")

    def fail(_):
        raise RuntimeError("no analysis")

    monitor.monitor(spark, box, ledger, rejects, cp, after=fail).awaitTermination()
    assert [(r["error"], r["message"], r["ledger_rows"]) for r in monitor.failures(spark, cp).collect()] == [("RuntimeError", "no analysis", 1)]
    rows = [(f"x{k}", None, datetime(2025, 1, 1), "a", "b", 1.0, 1, 1, f, n) for f, n, c in (("big", 11 << 20, 1), ("long", 10, 3), ("fine", 10, 2)) for k in range(c)]
    batch = spark.createDataFrame(rows, monitor.INBOX + ", file string, file_bytes long")
    monitor.absorb(batch, 7, ledger, rejects, most_rows=2)
    assert {r["transaction_id"] for r in monitor.known(spark, ledger).collect()} == {"t1", "x0", "x1"}
    assert {r["reason"] for r in spark.read.parquet(rejects).where("batch = 7").collect()} == {"big has 11534336 bytes", "long has 3 rows"}


def test_observation_files_and_guards(spark, tmp_path):
    from trailmark.sources import files

    row = ("obs-1-S", "t1", "a", "1.2.3.4", "dev-1", "ua", "wifi", "sess-1", "EU", datetime(2025, 1, 1, 0, 0, 9), "made", True)
    df = spark.createDataFrame([row], schemas.OBSERVATION)
    files.write_observations(df, str(tmp_path / "obs"))
    assert [tuple(r) for r in files.read_observations(spark, str(tmp_path / "obs")).collect()] == [row]
    transfers = spark.createDataFrame([("t1", datetime(2025, 1, 1), "a", "b")], "transaction_id string, ts timestamp_ntz, sender string, receiver string")
    seen = df.withColumnRenamed("wallet_address", "wallet")
    bad = seen.selectExpr("observation_id", "'zz' as transaction_id", "wallet", "ip_address", "device_id", "observed_at").unionAll(seen.selectExpr("'obs-1-R'", "transaction_id", "wallet", "ip_address", "device_id", "observed_at"))
    every = bad.unionAll(seen.select(*bad.columns))
    assert sorted(r["reasons"] for r in validate.check_observations(every, transfers).collect()) == ["", "unknown transaction", "wallet is not that party of the transaction"]
    (tmp_path / "x.json").write_bytes(b"\xff\xfe\x00[")
    with pytest.raises(ValueError, match="UTF-8"):
        files.guard(spark, str(tmp_path / "x.json"))
    with pytest.raises(ValueError, match="at most 1"):
        files.guard_records(spark.range(2), 1)
    blocks = spark.createDataFrame([("a", (5,), 0), ("b", (5,), 1), ("c", (6,), 0)], "txid string, status struct<block_height: bigint>, index int")
    assert {r["txid"] for r in files.block_slice(blocks, 1, 5).collect()} == {"c"} and {r["txid"] for r in files.block_slice(blocks, per_block=1, heights=[5]).collect()} == {"a"}
    with pytest.raises(ValueError, match="7"):
        files.block_slice(blocks, heights=[5, 7])


def test_positions_do_not_depend_on_splits(spark, tmp_path):
    """A CSV with quoted line breaks, quotes in quotes, blank lines and rows of another shape: the same records and numbers in 1 and in
    many splits, and those of Python's csv module."""
    import csv
    import io
    import random

    from trailmark.sources import records

    rng = random.Random(7)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["a", "b", "c"])
    for k in range(400):
        writer.writerow([k, rng.choice(["plain", "two\nlines", 'say ""hi""', "x,y\n\n,z", '"', "é" * rng.randrange(30)]), rng.random()][: rng.choice([3, 3, 3, 2])] + ["more"] * rng.choice([0, 0, 1]))
        if rng.random() < 0.1:
            out.write("\n")
    (tmp_path / "t.csv").write_text(out.getvalue())
    reader, want = csv.reader(io.StringIO(out.getvalue())), []
    line = 0
    for row in reader:
        if row:
            want.append((line + 1, row))
        line = reader.line_num
    size, got = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    for part in (size, "700b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", part)
        spark.conf.set("spark.sql.files.openCostInBytes", "4m" if part == size else "0")
        try:
            df = records.read_csv(spark, str(tmp_path / "t.csv"), "a string, b string, c string").drop("file")
            got.append(sorted((r["record"], r["line"], r["a"], r["b"] or "", r["shape"]) for r in df.collect()))
            assert records.numbered_lines(spark, str(tmp_path / "t.csv")).select("split").distinct().count() == (1 if part == size else -(-len(out.getvalue().encode()) // 700))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[0] == got[1] == [(k, n, r[0], r[1], None if len(r) == 3 else len(r)) for k, (n, r) in enumerate(want) if k]


def test_ledger_rows_know_their_lines(spark, tmp_path):
    head = "timestamp,wallet_address,amount_btc,direction,input_count,output_count,counterparty_wallet\n"
    body = "2025-01-01 00:00:00,b,1.0,Outgoing,1,1,a\n\n2025-01-01 00:00:00,a,2.0,Outgoing,1,1,b\n2025-01-01 00:00:00,a,1.0,Incoming,1,1,b\n"
    (tmp_path / "l.csv").write_text(head + body)
    got = files.collapse_ledger(files.read_numbered_ledger(spark, str(tmp_path / "l.csv"))).orderBy("transaction_id").collect()
    assert [(r["transaction_id"], r["sender"], r["source_ref"]) for r in got] == [("syn-000001", "b", "row:2"), ("syn-000002", "a", "row:4")]
    (tmp_path / "bad.csv").write_text(head + body + "2025-01-01 00:00:00,a,x\n")
    with pytest.raises(Exception, match="row 6 is no ledger row"):
        files.read_numbered_ledger(spark, str(tmp_path / "bad.csv")).collect()


def test_only_the_asked_blocks_are_read(spark, tmp_path):
    rows = [(f"t{h}-{i}", (h is not None, h, 0), [], [], i) for h in (7, 8, 9, None) for i in range(3)]
    df = spark.createDataFrame(rows, f"{schemas.EXPLORER}, `index` bigint")
    folder = str(tmp_path / "blocks")
    files.write_blocks(df, folder)
    got = files.read_blocks(spark, folder, heights=[7, 9])
    assert {(r["txid"], r["height"]) for r in got.collect()} == {(f"t{h}-{i}", h) for h in (7, 9) for i in range(3)}
    assert {f.split("height=")[1][0] for f in got.inputFiles()} == {"7", "9"}
    assert {r["height"] for r in files.read_blocks(spark, folder, newest=2).collect()} == {8, 9} and files.read_blocks(spark, folder, heights=[]).count() == 0
    assert files.block_slice(got, per_block=2, heights=[7]).count() == 2
    with pytest.raises(ValueError, match="no block at height"):
        files.read_blocks(spark, folder, heights=[7, 11])
    (tmp_path / "blocks" / "height=8" / "broken.json").write_text("{nonsense\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_blocks(spark, folder, heights=[8]).collect()
    assert files.read_blocks(spark, folder, heights=[9]).count() == 3
