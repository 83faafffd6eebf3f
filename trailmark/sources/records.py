"""Line and record numbers of text files that are read in many splits, and CSV on top of them.

A split's rows come in the order of the file. So a line's number is its place in its split plus the lines of the splits before it,
and whether a line begins inside quotes follows from the quotes before it, summed the same way. No task reads a file whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLIT = ("file", "split")


def _over_splits(rows: DataFrame, order: str, **counts) -> DataFrame:
    """rows (of SPLIT) with, per name, the sum of a column over all rows of the file before this one, in the order of splits and of
    ``order`` inside them. Only one row per split is ordered over a whole file."""
    inside = W.partitionBy(*SPLIT).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = rows.groupBy(*SPLIT).agg(*[F.sum(c).alias(f"_{n}") for n, c in counts.items()])
    sums = sums.select(*SPLIT, *[F.coalesce(F.sum(f"_{n}").over(before), zero).alias(f"_{n}") for n in counts])
    got = rows.join(sums, list(SPLIT)).withColumns({n: F.coalesce(F.sum(c).over(inside), zero) + F.col(f"_{n}") for n, c in counts.items()})
    return got.drop(*[f"_{n}" for n in counts])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, in the order of the file, empty ones too), value, quotes (how many '"' it has)."""
    raw = spark.read.text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    rows = rows.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    return _over_splits(rows, "at", line=F.lit(1)).withColumn("line", F.col("line") + 1)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (from 0, the header), line (its first), text: the records of CSV files, with line breaks inside quotes. Blank lines
    between records are none. A record is put together by its number, so it may lie in two splits."""
    lines = numbered_lines(spark, path)
    lines = _over_splits(lines, "line", open=F.col("quotes")).withColumn("starts", ((F.col("open") % 2 == 0) & ~((F.trim("value") == "") & (F.col("quotes") == 0))).cast("int"))
    lines = lines.where("open % 2 = 1 or starts = 1")
    lines = _over_splits(lines, "line", record=F.col("starts")).withColumn("record", F.col("record") + F.col("starts") - 1)
    parts = F.array_sort(F.collect_list(F.struct("line", "value")))
    return lines.groupBy("file", "record").agg(F.min("line").alias("line"), F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: str, shape: str = "shape") -> DataFrame:
    """The columns of ``schema`` (by their place) of all records behind the header, with file, record, line, and ``shape``: null, or how
    many cells the record has if these are not as many as the header's."""
    rows = csv_records(spark, path).withColumn("text", F.regexp_replace("text", "^﻿", ""))
    # a cell ends at a comma outside quotes: with all quoted parts taken out, the commas that are left part the cells
    cells = F.size(F.split(F.regexp_replace("text", '"[^"]*"', ""), ",", -1))
    rows = rows.withColumn("_cells", cells)
    heads = rows.where("record = 0").select("file", F.col("_cells").alias("_all"))  # a row per file
    rows = rows.where("record > 0").join(heads, "file")
    got = rows.select("file", "record", "line", F.from_csv("text", schema, {"escape": '"', "mode": "PERMISSIVE", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}).alias("r"), F.when(F.col("_cells") != F.col("_all"), F.col("_cells")).alias(shape))
    return got.select("r.*", "file", "record", "line", shape)
