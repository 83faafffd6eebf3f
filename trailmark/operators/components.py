"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.plans.shared import remove_since, tables_written, written


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node id reachable.

    Node ids may be of any orderable type. Null ends and self-loops are ignored. Hubs are safe: minima are
    pre-aggregated per task, and the joins that follow are ones that adaptive execution can split. A round's edges are a
    compressed table, which goes when the next one's is there.
    """
    spark, mark = edges.sparkSession, tables_written()
    e = (
        edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .distinct()
    )
    e = written(e, "component-edges")
    before = _signature(e)
    for _ in range(max_rounds):
        sym = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b"), F.col("a")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.unionAll(low2.select("a", F.col("m").alias("b"))).distinct(), "component-edges")
        remove_since(spark, mark, keep=1)
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
