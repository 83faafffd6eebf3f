"""Device sessions, in batch and as a stateful stream, and a reproducible sample of a ledger's parties."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.config import FOREST_SEED, RECEIVER_COVERAGE, SENDER_COVERAGE, SESSION_GAP_SECONDS
from trailmark.functions.scalars import micros, uniform
from trailmark.operators.features import legs

SESSION = "device_id string, session_id string, first_at timestamp_ntz, last_at timestamp_ntz, n long"


def sessions(observations: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """device_id, session_no (from 0), first_at, last_at, n: a gap of more than ``gap_seconds`` begins a new session.

    Rows of a device are numbered inside days first: whether a row begins a session needs only the row before, and
    running counts are carried from day to day, so a device that sends a third of all rows is spread over its days.
    """
    day, gap = 86_400_000_000, gap_seconds * 1_000_000
    o = observations.where("device_id is not null and observed_at is not null").select("device_id", "observation_id", "observed_at", micros("observed_at").alias("us")).withColumn("day", F.floor(F.col("us") / day))
    inside = W.partitionBy("device_id", "day").orderBy("us", "observation_id")
    o = o.withColumn("new", (F.col("us") - F.lag("us").over(inside) > gap).cast("int"))
    days = o.groupBy("device_id", "day").agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.coalesce(F.sum("new"), F.lit(0)).alias("inner"))
    w = W.partitionBy("device_id").orderBy("day")
    days = days.withColumn("starts", F.coalesce((F.col("lo") - F.lag("hi").over(w) > gap).cast("int"), F.lit(1)))
    days = days.withColumn("before", F.sum(F.col("starts") + F.col("inner")).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("inner") - 1)
    running = F.coalesce(F.sum("new").over(inside.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    o = o.withColumn("k", running).join(days.select("device_id", "day", "before"), ["device_id", "day"])
    return o.groupBy("device_id", (F.col("k") + F.col("before")).alias("session_no")).agg(F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.count("*").alias("n"))


def stream_sessions(observations: DataFrame, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """The same sessions on a stream (device_id, observed_at), however late a row comes: updates, of which the last per device_id and
    session_id counts. A session that a late row moved to an earlier start, or joined to another one, is closed by n = 0.

    A device's state is the intervals of its sessions (three integers each); rows and intervals are merged as arrays."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    gap = gap_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = [np.array(x, np.int64) for x in (state.get if state.exists else ((), (), ()))]
        t = pd.concat([b["observed_at"] for b in batches]).dropna().to_numpy("datetime64[us]").astype(np.int64)
        first, last, n = np.concatenate([old[0], t]), np.concatenate([old[1], t]), np.concatenate([old[2], np.ones(len(t), np.int64)])
        if not len(first):
            return
        order = np.argsort(first, kind="stable")
        first, last, n = first[order], last[order], n[order]
        start = np.flatnonzero(np.append(True, first[1:] > np.maximum.accumulate(last)[:-1] + gap))
        first, last, n = first[start], np.maximum.reduceat(last, start), np.add.reduceat(n, start)
        state.update((first.tolist(), last.tolist(), n.tolist()))
        was = dict(zip(old[0].tolist(), zip(old[1].tolist(), old[2].tolist(), strict=True), strict=True))
        rows = [(f, z, c) for f, z, c in zip(first.tolist(), last.tolist(), n.tolist(), strict=True) if was.get(f) != (z, c)]
        rows += [(f, was[f][0], 0) for f in was.keys() - set(first.tolist())]
        out = pd.DataFrame(rows, columns=["first_at", "last_at", "n"])
        out["first_at"], out["last_at"] = pd.to_datetime(out["first_at"], unit="us"), pd.to_datetime(out["last_at"], unit="us")
        out.insert(0, "session_id", f"sess-{key[0]}-" + out["first_at"].dt.strftime("%Y%m%d%H%M%S.%f"))
        out.insert(0, "device_id", key[0])
        yield out

    state = "first array<bigint>, last array<bigint>, n array<bigint>"
    return observations.where("device_id is not null and observed_at is not null").groupBy("device_id").applyInPandasWithState(step, SESSION, state, "update", GroupStateTimeout.NoTimeout)


def party_sample(transfers: DataFrame, seed: int = FOREST_SEED, sender_share: float = SENDER_COVERAGE, receiver_share: float = RECEIVER_COVERAGE) -> DataFrame:
    """transaction_id, side, wallet, u: a sample of the transfers' parties by reproducible hashes (80 % of senders and 50 % of
    receivers), the same under any partitioning."""
    rows = legs(transfers).withColumn("side", F.when(F.col("direction") == "Outgoing", "S").otherwise("R"))
    rows = rows.withColumn("u", uniform(F.lit(seed), F.lit("cover"), "transaction_id", "side"))
    return rows.where(F.col("u") < F.when(F.col("side") == "S", sender_share).otherwise(receiver_share)).select("transaction_id", "side", "wallet", "u")
