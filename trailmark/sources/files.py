"""Readers and writers of the domain's file formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark import schemas
from trailmark.plans.shared import Folder
from trailmark.sources import records

MAX_BYTES, MAX_RECORDS = 30 << 20, 20_000
LISTS = {"input_addresses": "array<string>", "input_amounts": "array<double>", "output_addresses": "array<string>", "output_amounts": "array<double>"}


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The mirrored ledger CSV: a header of exactly the seven columns, no nulls."""
    return spark.read.schema(schemas.LEDGER).options(header=True, enforceSchema=False, mode="FAILFAST", timestampNTZFormat="yyyy-MM-dd HH:mm:ss").csv(path)


def ledger_breaks(ledger: DataFrame) -> DataFrame:
    """Rows of a mirrored ledger that break its rules, with the reason."""
    nulls = " or ".join(f"`{c}` is null" for c in ledger.columns)
    flip = F.when(F.col("direction") == "Incoming", "Outgoing").otherwise("Incoming")
    mirror = ledger.select("timestamp", F.col("counterparty_wallet").alias("wallet_address"), "amount_btc", flip.alias("direction"), "input_count", "output_count", F.col("wallet_address").alias("counterparty_wallet"))
    bad = lambda cond, why: ledger.where(cond).withColumn("reason", F.lit(why))
    return (
        bad(nulls, "null value").unionAll(bad("direction not in ('Incoming', 'Outgoing')", "direction")).unionAll(bad("amount_btc <= 0", "amount"))
        .unionAll(ledger.exceptAll(mirror).withColumn("reason", F.lit("no mirror row")))
    )


def read_numbered_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``read_ledger`` with each row's file and line, the same however the file is split. A row of another shape, or a cell that does
    not parse, fails the read."""
    rows = records.read_csv(spark, path, schemas.LEDGER)
    bad = F.col("shape").isNotNull() | reduce(lambda a, c: a | F.col(c).isNull(), [f.name for f in T._parse_datatype_string(schemas.LEDGER).fields], F.lit(False))
    why = F.concat(F.lit("row "), F.col("line").cast("string"), F.lit(" is no ledger row"))
    return rows.withColumn("line", F.when(bad, F.raise_error(why)).otherwise(F.col("line"))).drop("record", "shape")


def collapse_ledger(ledger: DataFrame) -> DataFrame:
    """Transfers from the outgoing rows, numbered syn-000001 on by time. Rows of one time go by file and line, if these are known
    (then source_ref says row:<line>), else by all columns."""
    from trailmark.operators.fusion import ordinal

    known = "line" in ledger.columns
    out = ledger.where("direction = 'Outgoing'").select(
        F.col("timestamp").alias("ts"), F.col("wallet_address").alias("sender"), F.col("counterparty_wallet").alias("receiver"), F.col("amount_btc").alias("amount"), "input_count", "output_count", *(["file", "line"] if known else [])
    )
    order = ("ts", "file", "line") if known else out.columns
    got = ordinal(out, *[F.asc(c) for c in order], name="n")
    ref = [F.concat(F.lit("row:"), F.col("line").cast("string")).alias("source_ref")] if known else []
    return got.select(F.format_string("syn-%06d", "n").alias("transaction_id"), *[c for c in out.columns if c not in ("file", "line")], *ref)


def write_ledger(transfers: DataFrame, path: str) -> None:
    from trailmark.operators.features import legs

    both = legs(transfers)
    both.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("wallet").alias("wallet_address"), F.col("amount").alias("amount_btc"), "direction", F.lit(1).alias("input_count"), F.lit(1).alias("output_count"), F.col("counterparty").alias("counterparty_wallet")).write.mode("overwrite").option("header", True).csv(path)


def guard(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> None:
    """Refuse an upload beyond its size limit, or one that is no UTF-8 text (a byte order mark is allowed), before it is parsed."""
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the file has {size} bytes; at most {max_bytes} are allowed")
    if not files.where(~F.is_valid_utf8(F.col("content").cast("string"))).isEmpty():
        raise ValueError("the file is no UTF-8 text")


def guard_records(records: DataFrame, most: int = MAX_RECORDS) -> DataFrame:
    """The records, if there are no more than the limit (counted up to one beyond it)."""
    if records.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} records are allowed")
    return records


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Network observations from CSV with exactly the fixed twelve columns."""
    return spark.read.schema(schemas.OBSERVATION).options(header=True, enforceSchema=False, mode="FAILFAST", timestampNTZFormat="yyyy-MM-dd HH:mm:ss").csv(path)


def write_observations(observations: DataFrame, path: str) -> None:
    names = [f.name for f in T._parse_datatype_string(schemas.OBSERVATION).fields]
    observations.select(*names).write.mode("overwrite").options(header=True, timestampNTZFormat="yyyy-MM-dd HH:mm:ss").csv(path)


def _indexed(df: DataFrame) -> DataFrame:
    return df.withColumn("position", F.monotonically_increasing_id())


def read_rich_csv(spark: SparkSession, path: str) -> DataFrame:
    """Records with JSON arrays in their list cells; cells that do not parse become null and fail validation. ``position`` is the
    record's number (from 0, behind the header), ``line`` its first line, ``shape`` its number of cells if that is not the header's
    (validation should refuse it)."""
    raw = records.read_csv(spark, path, schemas.RICH_CSV)
    return raw.withColumns({c: F.from_json(c, t) for c, t in LISTS.items()}).withColumn("position", F.col("record") - 1).drop("record", "file")


def read_rich_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, or an object that holds them under ``transactions``."""
    record = T._parse_datatype_string(schemas.RICH)
    raw = spark.read.schema(T.StructType([*record.fields, T.StructField("transactions", T.ArrayType(record))])).option("multiLine", True).json(path)
    flat = raw.where("transactions is null").drop("transactions")
    return _indexed(flat.unionByName(raw.where("transactions is not null").select(F.inline("transactions"))))


def read_rich_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One record per line; blank lines are skipped, lines that do not parse stay, with ``_corrupt_record``."""
    return _indexed(spark.read.schema(schemas.RICH + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path))


def read_rich_xml(spark: SparkSession, path: str) -> DataFrame:
    """<transaction> records. Files with a document type or entities are refused before they are parsed."""
    text = spark.read.text(path, wholetext=True)
    if not text.where(F.col("value").rlike("(?i)<!(DOCTYPE|ENTITY)")).isEmpty():
        raise ValueError("document types and entities are not allowed")
    raw = spark.read.schema(schemas.RICH_XML).options(rowTag="transaction", mode="PERMISSIVE").xml(path)
    return _indexed(raw.withColumns({c: F.col(f"{c}.{'address' if 'addresses' in c else 'amount'}") for c in LISTS}))


def read_explorer(spark: SparkSession, path: str) -> DataFrame:
    """Explorer transactions from JSON files (one array or one object per line)."""
    return spark.read.schema(schemas.EXPLORER).option("multiLine", True).json(path)


def write_blocks(transactions: DataFrame, path: str) -> None:
    """Explorer transactions with a folder per block height; those without a block are left out."""
    t = transactions.withColumn("height", F.col("status.block_height")).where("height is not null")
    t.repartition("height").write.mode("overwrite").partitionBy("height").json(path)


def read_blocks(spark: SparkSession, path: str, newest: int = 0, heights: list[int] | None = None) -> DataFrame:
    """The transactions of the ``newest`` blocks, or of the given heights, with height. Only the folders of those blocks are read. All or
    nothing: a height that is missing, or a block that does not parse, fails the read."""
    there = {int(x.removeprefix("height=")) for x in Folder(spark, path).names("") if x.startswith("height=")}
    if heights is not None and (missing := sorted(set(heights) - there)):
        raise ValueError(f"no block at height {missing}")
    chosen = sorted(there)[-newest:] if heights is None and newest else sorted(set(heights or ()))
    reader = spark.read.schema(f"{schemas.EXPLORER}, `index` bigint, height bigint").options(basePath=path, mode="FAILFAST")
    return reader.json([f"{path}/height={h}" for h in chosen]) if chosen else spark.createDataFrame([], f"{schemas.EXPLORER}, `index` bigint, height bigint")


def block_slice(transactions: DataFrame, newest: int = 0, per_block: int = 25, heights: list[int] | None = None) -> DataFrame:
    """The first ``per_block`` transactions (by ``index``) of the ``newest`` blocks, or of the given heights, of which none may be missing."""
    there = transactions.select(F.col("status.block_height").alias("h")).where("h is not null").distinct()
    chosen = there.orderBy(F.desc("h")).limit(newest) if heights is None else there.where(F.col("h").isin(heights))
    if heights is not None and (missing := set(heights) - {r["h"] for r in chosen.collect()}):
        raise ValueError(f"no block at height {sorted(missing)}")
    t = transactions.withColumn("h", F.col("status.block_height")).join(chosen, "h")
    return t.withColumn("k", F.row_number().over(W.partitionBy("h").orderBy("index"))).where(F.col("k") <= per_block).drop("k", "h")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=False).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
