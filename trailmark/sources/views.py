"""Domain views over generic tables: transfers, network observations, address-level transactions and flows.

Each view has a Spark form and the same in SQL, so that the checks on both sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(prefix: str, width: int, c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(prefix), F.lpad(c.cast("string"), width, "0"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transaction_id, ts, sender, receiver, amount: the events table read as a ledger with microsecond times."""
    e = table(spark, sf_dir, "events")
    return e.select(
        _code("tx-", 10, "event_id").alias("transaction_id"), "ts", _code("w", 6, "user_id").alias("sender"),
        _code("w", 6, F.get_json_object("props", "$.k").cast("long")).alias("receiver"), F.col("value").alias("amount"),
    ).where("sender <> receiver and amount > 0")


def wide_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns from lineitem and orders: the volume form, with day-granular times and many ties."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").dropDuplicates(["o_orderkey"])
    key = F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 8, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    got = li.join(o, li.l_orderkey == o.o_orderkey).select(
        key.alias("transaction_id"), F.col("l_shipdate").alias("ts"), _code("w", 6, "o_custkey").alias("sender"), _code("w", 6, "l_partkey").alias("receiver"),
        F.col("l_extendedprice").alias("amount"),
    )
    return got.where("sender <> receiver and amount > 0")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observation_id, transaction_id, wallet, ip_address, device_id, observed_at, per event: a device stands for a ten-minute
    bucket of one event type and k, an address for k and the hour of that type."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    ten = F.concat(F.date_format("ts", "yyyyMMddHH"), F.floor(F.minute("ts") / 10).cast("string"))
    return e.select(
        _code("obs-", 10, "event_id").alias("observation_id"), _code("tx-", 10, "event_id").alias("transaction_id"), _code("w", 6, "user_id").alias("wallet"),
        F.concat_ws("-", F.lit("ip"), "k").alias("ip_address"), F.concat_ws("-", F.lit("dev"), "k", "event_type", ten).alias("device_id"), F.col("ts").alias("observed_at"),
    )


def _address(quantity) -> F.Column:
    return F.concat_ws("-", F.lit("a"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), quantity.cast("long").cast("string"))


def rich_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(inputs, outputs) of address-level transactions: transaction_id, position, address, amount. An order is a transaction, and
    a part, supplier and quantity are an address, so that orders seldom spend from the same one. Even lines pay to
    addresses of that kind too, odd ones to an address per supplier."""
    li = table(spark, sf_dir, "lineitem")
    tx, pos, quantity = _code("o", 8, "l_orderkey").alias("transaction_id"), F.col("l_linenumber").alias("position"), F.col("l_quantity").cast("long")
    paid = F.when(F.col("l_linenumber") % 2 == 0, _address(quantity % 50 + 1)).otherwise(_code("b", 6, "l_suppkey"))
    return (
        li.select(tx, pos, _address(quantity).alias("address"), F.col("l_extendedprice").alias("amount")),
        li.select(tx, pos, paid.alias("address"), F.col("l_quantity").alias("amount")),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transaction_id, ts, sender, src_ip, country, asn, dst_port: who sent an order from where."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 7")
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    o = o.groupBy("o_orderkey").agg(F.min("o_custkey").alias("o_custkey"), F.min("o_orderdate").alias("ts"))
    o = o.join(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    # by order, so that lines are told apart and meet their order after one shuffle
    got = li.select("l_orderkey", "l_linenumber").repartition("l_orderkey").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return got.select(
        _code("o", 8, "l_orderkey").alias("transaction_id"), "ts", _code("w", 6, "o_custkey").alias("sender"), F.concat(F.lit("ip-"), F.col("o_custkey").cast("string")).alias("src_ip"),
        F.col("n_name").alias("country"), F.col("c_nationkey").cast("int").alias("asn"), F.when(F.col("l_linenumber") == 1, 8333).otherwise(8000 + F.col("l_linenumber")).cast("int").alias("dst_port"),
    )


def order_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transaction_id, sender, receiver: the parties of the address-level transactions (customer and least supplier)."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("o_custkey"))
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(_code("o", 8, "l_orderkey").alias("transaction_id"), _code("w", 6, "o_custkey").alias("sender"), _code("w", 6, "l_suppkey").alias("receiver"))


SQL = {
    "t": """t AS (SELECT * FROM (SELECT 'tx-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS transaction_id, ts, 'w' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS sender,
  'w' || lpad(regexp_extract(props, '"k": *(-?[0-9]+)', 1), 6, '0') AS receiver, value AS amount FROM events) WHERE sender <> receiver AND amount > 0)""",
    "tw": """t AS (SELECT * FROM (SELECT lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 8, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS transaction_id,
  l_shipdate AS ts, 'w' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS sender, 'w' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS receiver, l_extendedprice AS amount
  FROM lineitem JOIN (SELECT o_orderkey, min(o_custkey) AS o_custkey FROM orders GROUP BY 1) ON l_orderkey = o_orderkey) WHERE sender <> receiver AND amount > 0)""",
    "legs": """legs AS (SELECT transaction_id, ts, sender AS wallet, receiver AS counterparty, 'Outgoing' AS direction, amount FROM t
  UNION ALL SELECT transaction_id, ts, receiver, sender, 'Incoming', amount FROM t)""",
    "obs": """obs AS (SELECT 'obs-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS observation_id, 'tx-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS transaction_id, 'w' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS wallet,
  'ip-' || k AS ip_address, 'dev-' || k || '-' || event_type || '-' || strftime(ts, '%Y%m%d%H') || CAST(CAST(floor(minute(ts) / 10.0) AS INTEGER) AS VARCHAR) AS device_id, ts AS observed_at
  FROM (SELECT *, regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS k FROM events))""",
    "inp": """li AS (SELECT *, 'o' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS transaction_id, 'a-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' AS place, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
inp AS (SELECT transaction_id, l_linenumber AS position, place || CAST(q AS VARCHAR) AS address, l_extendedprice AS amount FROM li),
outp AS (SELECT transaction_id, l_linenumber AS position, CASE WHEN l_linenumber % 2 = 0 THEN place || CAST(q % 50 + 1 AS VARCHAR) ELSE 'b' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') END AS address, l_quantity AS amount FROM li)""",
    "flows": """flows AS (SELECT 'o' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS transaction_id, ts, 'w' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS sender, 'ip-' || CAST(o_custkey AS VARCHAR) AS src_ip, n_name AS country, c_nationkey AS asn,
  CAST(CASE WHEN l_linenumber = 1 THEN 8333 ELSE 8000 + l_linenumber END AS INTEGER) AS dst_port
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 7) JOIN (SELECT o_orderkey, min(o_custkey) AS o_custkey, min(o_orderdate) AS ts FROM orders GROUP BY 1) ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "ot": """ot AS (SELECT 'o' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS transaction_id, 'w' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS sender, 'w' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS receiver
  FROM (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1) JOIN (SELECT o_orderkey, min(o_custkey) AS o_custkey FROM orders GROUP BY 1) ON l_orderkey = o_orderkey)""",
}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """SQL text: the named views, then the body (which may begin with further CTEs, after 'WITH')."""
    heads = ",\n".join(SQL[v] for v in views)
    body = body.strip()
    rest = body[4:].lstrip() if body.startswith("WITH") else None
    return f"WITH {'RECURSIVE ' if recursive else ''}{heads}{',' if rest else ''}\n{rest or body}"
