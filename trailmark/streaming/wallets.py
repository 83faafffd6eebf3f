"""What ingestion keeps beside the ledger, from each batch alone: when each wallet was first and last seen, and how far numbers have gone.

Both are kept as parts, one per batch, that merge in any order: a batch that comes late or is run again changes its own part only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators.fusion import ordinal
from trailmark.plans.shared import Folder

SPANS = "wallet string, first_seen timestamp_ntz, last_seen timestamp_ntz, n long"
PREFIX = "syn-"


def spans(transfers: DataFrame) -> DataFrame:
    """wallet, first_seen, last_seen, n (transfers on either side; one to oneself counts once)."""
    w = transfers.select("ts", F.explode(F.array_distinct(F.array("sender", "receiver"))).alias("wallet"))
    return w.groupBy("wallet").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


def merge_spans(*parts: DataFrame) -> DataFrame:
    """The spans of all transfers behind some parts, from the parts."""
    return reduce(DataFrame.unionByName, parts).groupBy("wallet").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"))


def _batches(files: Folder, name: str) -> list[int]:
    return sorted(int(x.removeprefix("batch=")) for x in files.names(name) if x.startswith("batch="))


def _base(files: Folder) -> int | None:
    """The last batch that the newest complete base holds."""
    return max((int(x.removeprefix("upto=")) for x in files.names("base") if x.startswith("upto=") and "_SUCCESS" in files.names(f"base/{x}")), default=None)


def keep_spans(accepted: DataFrame, folder: str, batch_id: int) -> None:
    """Write the part of a batch, in place of an earlier one of the same number. A batch below the base is in it already."""
    base = _base(Folder(accepted.sparkSession, folder))
    if base is None or batch_id > base:
        spans(accepted).write.mode("overwrite").parquet(f"{folder}/parts/batch={batch_id}")


def wallet_spans(spark: SparkSession, folder: str) -> DataFrame:
    """wallet, first_seen, last_seen, n of all batches so far; empty before the first."""
    files = Folder(spark, folder)
    base = _base(files)
    paths = [f"parts/batch={b}" for b in _batches(files, "parts") if base is None or b > base] + ([] if base is None else [f"base/upto={base}"])
    if not paths:
        return spark.createDataFrame([], SPANS)
    return merge_spans(spark.read.schema(SPANS).parquet(*[f"{folder}/{p}" for p in paths]))


def compact(spark: SparkSession, folder: str, leave: int = 1) -> int | None:
    """Merge all parts but the ``leave`` newest (which may be run again) into a new base; returns the last batch that it holds. The new
    base counts once it is complete, and what it holds is deleted after that, so a run that stops halfway changes nothing."""
    files = Folder(spark, folder)
    base = _base(files)
    fresh = [b for b in _batches(files, "parts") if base is None or b > base]
    fold = fresh[: max(0, len(fresh) - leave)]
    if fold:
        paths = [f"{folder}/parts/batch={b}" for b in fold] + ([] if base is None else [f"{folder}/base/upto={base}"])
        merge_spans(spark.read.schema(SPANS).parquet(*paths)).write.mode("overwrite").parquet(f"{folder}/base/upto={fold[-1]}")
    now = _base(files)
    for b in _batches(files, "parts"):
        if now is not None and b <= now:
            files.delete(f"parts/batch={b}")
    for x in files.names("base"):
        if x.startswith("upto=") and now is not None and int(x.removeprefix("upto=")) < now:
            files.delete(f"base/{x}")
    return now


def number(batch: DataFrame, last: int, prefix: str = PREFIX) -> DataFrame:
    """A batch (transaction_id, position, ...) whose rows without an id get the numbers behind ``last``, gapless in the order of
    position, such as syn-000124. Ranks come from range partitions with offsets, so no task holds a whole batch."""
    new = ordinal(batch.where("transaction_id is null"), F.asc("position"), name="_k")
    given = F.concat(F.lit(prefix), F.format_string("%06d", F.col("_k") + last))
    return batch.where("transaction_id is not null").unionByName(new.withColumn("transaction_id", given).drop("_k"))


def last_number(spark: SparkSession, folder: str, batch_id: int | None = None) -> int:
    """The highest number in use (before a batch, if one is given, so that a batch that is run again gets the same numbers)."""
    files = Folder(spark, folder)
    there = [b for b in _batches(files, "numbers") if batch_id is None or b < batch_id]
    return max((int(files.names(f"numbers/batch={b}")[0]) for b in there), default=0)


def keep_number(accepted: DataFrame, folder: str, batch_id: int, before: int, prefix: str = PREFIX) -> int:
    """Note the highest number that a batch has used, whether it was given or came with the row; returns it."""
    digits = F.substring("transaction_id", len(prefix) + 1, 20).try_cast("long")
    used = accepted.where(F.col("transaction_id").startswith(prefix)).agg(F.max(digits)).first()[0] or 0
    files, last = Folder(accepted.sparkSession, folder), max(before, used)
    files.delete(f"numbers/batch={batch_id}")
    files.create(f"numbers/batch={batch_id}/{last}")
    for b in [b for b in _batches(files, "numbers") if b < batch_id][:-1]:  # one mark before this one is enough to run it again
        files.delete(f"numbers/batch={b}")
    return last
