"""Continuous ingestion: an inbox of files, micro-batches that are validated, deduplicated and appended, and a refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmark.operators.validate import check_transfers, ingest, split_valid
from trailmark.streaming.wallets import keep_number, keep_spans, last_number, number

#: Limits of an inbox file (fixed values), and what is kept of a failed analysis.
MOST_BYTES, MOST_ROWS = 10 << 20, 50_000
FAILURE = "batch long, ledger_rows long, error string, message string"
INBOX = "transaction_id string, source_ref string, ts timestamp_ntz, sender string, receiver string, amount double, input_count int, output_count int"


def inbox(spark: SparkSession, folder: str, files_per_tick: int = 10, archive: str | None = None) -> DataFrame:
    """A stream over the JSONL and CSV files of a folder, oldest first, with each row's file and its size. Files that are done with move
    to ``archive``, if given. A producer must move finished files in, since a file is read once."""
    options = {"maxFilesPerTrigger": files_per_tick, "latestFirst": False} | ({"cleanSource": "archive", "sourceArchiveDir": archive} if archive else {})
    read = lambda kind: spark.readStream.schema(INBOX).options(**options).option("pathGlobFilter", f"*.{kind}")
    of = lambda df: df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_bytes"))
    return of(read("jsonl").json(folder)).unionAll(of(read("csv").option("header", True).csv(folder)))


def absorb(batch: DataFrame, batch_id: int, ledger: str, rejects: str, source: str = "synthetic", most_bytes: int = MOST_BYTES, most_rows: int = MOST_ROWS) -> None:
    """Append what a batch adds to the ledger, and the reasons for what it does not. Late rows are accepted at any age. A file beyond
    a limit is refused whole, with one reject. Rows without an id get the next numbers. Wallets' spans and the highest number are
    kept in ``<ledger>-state``. All writes overwrite the batch's own part, so a batch that is run again after a failure is not
    counted twice, and gets the same numbers."""
    spark = batch.sparkSession
    refused = spark.createDataFrame([], "transaction_id string, reason string")
    if "file" in batch.columns:
        files = batch.groupBy("file").agg(F.max("file_bytes").alias("bytes"), F.count("*").alias("rows"))
        large = files.where((F.col("bytes") > most_bytes) | (F.col("rows") > most_rows)).persist()
        why = F.when(F.col("bytes") > most_bytes, F.format_string("%s has %d bytes", "file", "bytes")).otherwise(F.format_string("%s has %d rows", "file", "rows"))
        refused = large.select(F.lit(None).cast("string").alias("transaction_id"), why.alias("reason"))
        batch = batch.join(F.broadcast(large.select("file")), "file", "left_anti").drop("file", "file_bytes")
    good, bad = split_valid(check_transfers(batch.withColumn("position", F.monotonically_increasing_id())))
    before = last_number(spark, f"{ledger}-state", batch_id)
    good = number(good, before)
    stored = known(spark, ledger)
    outcome = ingest(good, stored.where(F.col("batch") != batch_id), source).persist()
    outcome.where("outcome = 'accepted'").drop("outcome", "position").withColumn("source", F.lit(source)).write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")
    taken = outcome.where("outcome = 'accepted'")
    keep_spans(taken, f"{ledger}-state", batch_id)
    keep_number(taken, f"{ledger}-state", batch_id, before)
    lost = bad.select("transaction_id", F.col("reasons").alias("reason")).unionAll(outcome.where("outcome not in ('accepted', 'duplicate')").select("transaction_id", F.col("outcome").alias("reason")))
    lost.unionAll(refused).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
    outcome.unpersist()


def known(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger so far; empty before the first batch."""
    schema = f"{INBOX}, source string, batch long"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(ledger)


def monitor(spark: SparkSession, folder: str, ledger: str, rejects: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None, seconds: int | None = None, archive: str | None = None) -> StreamingQuery:
    """Start the stream: each tick absorbs new files, then calls ``after`` with the whole ledger if it grew. Without
    ``seconds`` it takes what is there and stops. A failing ``after`` is written down (see ``failures``) and not tried again
    until the ledger changes."""
    if seconds is not None and not 1 <= seconds <= 3600:
        raise ValueError("the interval is 1 to 3600 seconds")
    failed: dict[str, int] = {}

    def tick(batch: DataFrame, batch_id: int) -> None:
        absorb(batch, batch_id, ledger, rejects)
        if after is not None:
            now = known(spark, ledger)
            n = now.count()
            if failed.get("at") != n:
                try:
                    after(now)
                    failed.clear()
                except Exception as e:  # the stream goes on; the analysis waits for other data
                    failed["at"] = n
                    row = spark.createDataFrame([(batch_id, n, type(e).__name__, str(e))], FAILURE)
                    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{checkpoint}-failures")

    writer = inbox(spark, folder, archive=archive).writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def failures(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The analyses that failed: batch, ledger_rows, error, message, at."""
    return spark.read.schema(f"{FAILURE}, at timestamp").parquet(f"{checkpoint}-failures")


def status(query: StreamingQuery) -> dict:
    """Whether the stream runs, what it does now, and its last batch."""
    last = query.lastProgress
    return {"active": query.isActive, "message": query.status["message"], "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0, "error": str(query.exception()) if query.exception() else None}


def weekly_counts(transfers: DataFrame, watermark: str | None = None) -> DataFrame:
    """Transfers and amount per seven days of a stream (or table), in windows from Monday 1970-01-05."""
    t = transfers.withWatermark("ts", watermark) if watermark else transfers
    return t.groupBy(F.window(F.col("ts").cast("timestamp"), "7 days", startTime="4 days").alias("w")).agg(F.count("*").alias("transfers"), F.sum("amount").alias("amount"))
