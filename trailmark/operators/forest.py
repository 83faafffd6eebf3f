"""Isolation forest (Liu, Ting and Zhou 2008): trees are grown in parallel on small hashed samples and scored with Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.config import CONTAMINATION, FEATURES, FOREST_SEED, FOREST_TREES
from trailmark.operators.features import finite
from trailmark.operators.ranks import percentiles
from trailmark.plans.shared import cut

PSI = 256
NODE = "tree int, node int, feature int, split double, left int, right int, size long"


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, split, left, right, size) of one tree; leaves have feature -1."""
    nodes: list[list] = [[-1, 0.0, -1, -1, len(x)]]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 and depth < limit else []
        if not len(spread):
            continue
        f = int(rng.choice(spread))
        split = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        left = part[:, f] <= split
        nodes[at][:4] = [f, split, len(nodes), len(nodes) + 1]
        for side in (left, ~left):
            todo.append((len(nodes), rows[side], depth + 1))
            nodes.append([-1, 0.0, -1, -1, int(side.sum())])
    return [tuple(n) for n in nodes]


def isolation_forest(features: DataFrame, columns=FEATURES, trees: int = FOREST_TREES, contamination: float = CONTAMINATION, seed: int = FOREST_SEED) -> DataFrame:
    """wallet, anomaly_score, anomaly_prediction for wallets (one row each, or it raises) whose features are all defined.

    A tree's sample is the ``PSI`` wallets of least hash of (wallet, tree, seed), so results do not depend on the
    partitioning. Only rows under a hash threshold that leaves about four times as many are ranked. The grown forest is
    bounded (trees x 511 nodes) and broadcast. The decision is taken before the score is rounded.
    """
    spark = features.sparkSession
    columns = list(columns)
    x = features.where(finite(columns)).select("wallet", *[F.col(c).cast("double").alias(c) for c in columns])
    n, wallets = x.agg(F.count("*"), F.count_distinct("wallet")).first()
    if n != wallets:
        raise ValueError("a wallet has more than one row of features")
    psi = min(PSI, n)
    share = min(1.0, 4 * psi / max(n, 1))
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("wallet", t, F.lit(seed)).alias("h")))
    low = F.filter(draws, lambda d: d["h"].cast("double") < F.lit(-(2.0**63) + share * 2.0**64))
    rows = x.withColumn("d", F.explode(low)).select("*", "d.*")
    sample = rows.withColumn("k", F.row_number().over(W.partitionBy("tree").orderBy("h", "wallet"))).where(F.col("k") <= psi)
    limit = int(np.ceil(np.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        tree = int(pdf["tree"].iloc[0])
        nodes = grow(pdf[columns].to_numpy(float), np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([(tree, k, *node) for k, node in enumerate(nodes)], columns=["tree", "node", "feature", "split", "left", "right", "size"])

    forest = sample.groupBy("tree").applyInPandas(build, NODE).toPandas().sort_values(["tree", "node"])
    shared = spark.sparkContext.broadcast([tuple(g[c].to_numpy() for c in ("feature", "split", "left", "right", "size")) for _, g in forest.groupby("tree")])
    norm = float(average_path(psi)) or 1.0

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        m = np.column_stack([c.to_numpy(float) for c in cols])
        total = np.zeros(len(m))
        for feature, split, left, right, size in shared.value:
            at, depth = np.zeros(len(m), int), np.zeros(len(m))
            live = np.flatnonzero(feature[at] >= 0)
            while len(live):
                node = at[live]
                go = m[live, feature[node]] <= split[node]
                at[live] = np.where(go, left[node], right[node])
                depth[live] += 1
                live = live[feature[at[live]] >= 0]
            total += depth + average_path(size[at])
        return pd.Series(2.0 ** (-(total / max(len(shared.value), 1)) / norm))

    scored = cut(x.select("wallet", score(*columns).alias("raw")))
    limit = percentiles(scored, {"cut": ("raw", 1 - contamination)})
    flag = F.when(F.col("raw") > F.col("cut"), "Anomalous").otherwise("Normal")
    return scored.crossJoin(F.broadcast(limit)).select("wallet", F.round("raw", 6).alias("anomaly_score"), flag.alias("anomaly_prediction"))
