"""Exact ranks and percentiles of columns without a task that sees all of their values.

Values are counted first (ties and hot values cost a row per task), the counts are range-partitioned by column and value and
written down, and each partition goes on from the counts before it. Only sums per partition meet in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.plans.shared import cut


def cumulative(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name, value, n, upto, total: for each distinct value (as a double) of each column, how many rows have it, how many have
    it or a lesser one, and how many have any. Nulls do not count; NaN sorts last."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = rows.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))
    placed = cut(counts.repartitionByRange("name", "value").withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("name", "_part").agg(F.sum("n").alias("_n"))
    before = W.partitionBy("name").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("name", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy("name")).alias("total"))
    inside = F.sum("n").over(W.partitionBy("_part", "name").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("upto", inside).join(sums, ["name", "_part"]).select("name", "value", "n", (F.col("upto") + F.col("_before")).alias("upto"), "total")


def percentiles(rows: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: for each (column, share) of ``wanted`` its linearly interpolated percentile, under the given name (null for a
    column without values)."""
    ranks = cumulative(rows, sorted({c for c, _ in wanted.values()}))
    out = []
    for name, (column, share) in wanted.items():
        at = F.lit(float(share)) * (F.col("total") - 1)
        value = lambda k: F.min(F.when((F.col("name") == column) & (F.col("upto") > k), F.col("value")))  # noqa: B023, E731
        low, high = value(F.floor(at)), value(F.ceil(at))
        rest = F.max(F.when(F.col("name") == column, at - F.floor(at)))
        out.append((low + (high - low) * rest).alias(name))
    return ranks.agg(*out)
