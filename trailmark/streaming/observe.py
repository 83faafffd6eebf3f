"""Live observation: each new transfer is given the device and address that its parties last used, and each device's sessions go on.

Both are keyed state (`transformWithState`) that starts from what batch operators derive from the observations so far, so a stream can be
begun behind a ledger of any length. A wallet's state is one row; a device's holds the pieces of its sessions of the last ``keep_hours``
before its newest one, and none once it has been silent for as long. What a late row adds behind that is a piece of its own, and
``settle_sessions`` joins the pieces, so nothing is lost at any age. Both need the state store on RocksDB (``live_settings``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailmark.config import SESSION_GAP_SECONDS
from trailmark.functions.scalars import micros
from trailmark.operators.records import device_state

KNOWN = "device_id string, ip_address string, us long, key string"
OBSERVED = "observation_id string, transaction_id string, wallet string, device_id string, ip_address string, observed_at timestamp_ntz"
PIECES = "device_id string, piece long, version long, first_at timestamp_ntz, last_at timestamp_ntz, n long"
KEPT_PIECES = "piece long, version long, first_us long, last_us long, n long"
HOUR = 3_600_000_000


def live_settings(spark: SparkSession) -> None:
    """What the stateful operators here need of a session. Timers are looked at with the next rows of any device: batches without
    rows would follow each other without end, since Spark plans one for as long as a timer could expire."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _us(column: pd.Series) -> np.ndarray:
    return column.to_numpy("datetime64[us]").astype(np.int64)


def _times(us) -> pd.Series:
    return pd.Series(np.array(us, np.int64).astype("datetime64[us]"))


# ---- devices of transfers -----------------------------------------------------------------------------------------------------
def ledger_events(transfers: DataFrame) -> DataFrame:
    """Both sides of each transfer as events of a wallet, to be observed: the columns of ``observed`` without device and address."""
    side = F.explode(F.array(F.struct(F.lit("S").alias("role"), F.col("sender").alias("wallet")), F.struct(F.lit("R").alias("role"), F.col("receiver").alias("wallet")))).alias("s")
    t = transfers.select("transaction_id", "ts", side)
    return t.select(
        F.concat_ws("-", F.lit("obs"), "transaction_id", "s.role").alias("observation_id"), "transaction_id", "s.wallet",
        F.lit(None).cast("string").alias("device_id"), F.lit(None).cast("string").alias("ip_address"), F.col("ts").alias("observed_at"),
    )


class _Attribute(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", KNOWN)

    def handleInitialState(self, key, initial: pd.DataFrame, timer) -> None:
        self.known.update(tuple(initial[["device_id", "ip_address", "us", "id"]].iloc[0]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        known = self.known.get() if self.known.exists() else None
        device, ip, us, last = known if known is not None else (None, None, None, None)
        batch = pd.concat(list(rows)).sort_values(["observed_at", "observation_id"], kind="stable").reset_index(drop=True)
        devices, ips, seen = [], [], False
        for own, address, at, name in zip(batch["device_id"], batch["ip_address"], _us(batch["observed_at"]).tolist(), batch["observation_id"], strict=True):
            if isinstance(own, str):
                if us is None or (at, name) >= (us, last):
                    device, ip, us, last, seen = own, address if isinstance(address, str) else None, at, name, True
                devices.append(own)
                ips.append(address if isinstance(address, str) else None)
            else:
                devices.append(device)
                ips.append(ip)
        if seen:
            self.known.update((device, ip, us, last))
        batch["device_id"], batch["ip_address"] = pd.Series(devices, dtype=object), pd.Series(ips, dtype=object)
        yield batch[["observation_id", "transaction_id", "wallet", "device_id", "ip_address", "observed_at"]]

    def close(self) -> None:
        pass


def live_devices(events: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """A stream of events (observation_id, transaction_id, wallet, device_id, ip_address, observed_at), in which those without a
    device (see ``ledger_events``) get the device and address that their wallet used last.

    "Last" is by time, then observation_id, among what came in earlier batches, earlier in the same batch, or in ``history`` (a
    table of observations). A late observation never takes the place of a newer one. A wallet with no device so far keeps
    null: none is made up. Events without a wallet or a time are left out."""
    initial = None
    if history is not None:
        o = history.where("wallet is not null and device_id is not null and observed_at is not null")
        last = o.groupBy("wallet").agg(F.max(F.struct(micros("observed_at").alias("us"), F.col("observation_id").alias("id"))).alias("last"))
        initial = device_state(o).join(last, "wallet").select("wallet", "device_id", "ip_address", "last.us", "last.id").groupBy("wallet")
    e = events.where("wallet is not null and observed_at is not null").select("observation_id", "transaction_id", "wallet", "device_id", "ip_address", "observed_at")
    return e.groupBy("wallet").transformWithStateInPandas(_Attribute(), OBSERVED, "Append", "None", initial)


# ---- sessions ---------------------------------------------------------------------------------------------------------------------
class _Sessions(StatefulProcessor):
    """The pieces of a device's sessions that are not older than a bound; numbers of pieces are never given twice."""

    def __init__(self, gap: int, keep: int):
        self.gap, self.keep = gap, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", KEPT_PIECES)
        self.next = handle.getValueState("next", "piece long")

    def handleInitialState(self, key, initial: pd.DataFrame, timer) -> None:
        new = zip(initial["piece"].tolist(), initial["version"].tolist(), _us(initial["first_at"]).tolist(), _us(initial["last_at"]).tolist(), initial["n"].tolist(), strict=True)
        self.next.update((int(initial["next"].iloc[0]),))
        self._keep([tuple(int(x) for x in p) for p in [*self.pieces.get(), *new]], timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        old = [tuple(int(x) for x in p) for p in self.pieces.get()]
        number = int(self.next.get()[0]) if self.next.exists() else 0
        # what there is already is folded with the batch in the order of first times: (first, last, n, its pieces)
        t = np.sort(np.concatenate([_us(b["observed_at"]) for b in rows]))
        start = np.flatnonzero(np.append(True, np.diff(t) > self.gap))
        runs = [(f, z, n, []) for f, z, n in zip(t[start].tolist(), t[np.append(start[1:], len(t)) - 1].tolist(), np.diff(np.append(start, len(t))).tolist(), strict=True)]
        merged: list[tuple[int, int, int, list]] = []
        for f, z, n, own in sorted(runs + [(p[2], p[3], p[4], [p]) for p in old], key=lambda x: (x[0], x[1])):
            if merged and f - merged[-1][1] <= self.gap:
                a = merged[-1]
                merged[-1] = (a[0], max(a[1], z), a[2] + n, a[3] + own)
            else:
                merged.append((f, z, n, own))
        out, now = [], []
        for f, z, n, own in merged:
            if len(own) == 1 and own[0][2:] == (f, z, n):
                now.append(own[0])
                continue
            own.sort()
            if own:
                piece, version = own[0][0], own[0][1] + 1
            else:
                piece, version, number = number, 0, number + 1
            now.append((piece, version, f, z, n))
            out.append((piece, version, f, z, n))
            out += [(p, v + 1, a, b, 0) for p, v, a, b, _ in own[1:]]  # joined to the first one
        self.next.update((number,))
        newest = max(p[3] for p in now)
        self._keep([p for p in now if p[3] >= newest - self.keep], timer)
        yield self._rows(key, out)

    def _keep(self, pieces: list, timer) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.pieces.put(pieces)
        self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + self.keep // 1000)

    def handleExpiredTimer(self, key, timer, expired) -> Iterator[pd.DataFrame]:
        self.pieces.clear()  # their last updates stand; later rows begin new pieces
        yield self._rows(key, [])

    @staticmethod
    def _rows(key, rows: list) -> pd.DataFrame:
        piece, version, first, last, n = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
        return pd.DataFrame({"device_id": pd.Series([key[0]] * len(rows), dtype=object), "piece": pd.Series(piece, dtype="int64"), "version": pd.Series(version, dtype="int64"), "first_at": _times(first), "last_at": _times(last), "n": pd.Series(n, dtype="int64")})

    def close(self) -> None:
        pass


def session_pieces(sessions: DataFrame) -> DataFrame:
    """The sessions of a table (see ``sessions``) as settled pieces: initial state, and what updates of a stream are joined to."""
    return sessions.select("device_id", F.col("session_no").cast("long").alias("piece"), F.lit(0).cast("long").alias("version"), "first_at", "last_at", F.col("n").cast("long").alias("n"))


def live_sessions(observations: DataFrame, history: DataFrame | None = None, gap_seconds: int = SESSION_GAP_SECONDS, keep_hours: int = 72) -> DataFrame:
    """Updates of pieces of sessions (device_id, piece, version, first_at, last_at, n) from a stream of observations; ``history``
    are pieces that are known (``session_pieces``). A device keeps those that ended within ``keep_hours`` (more than the gap) before its
    newest one, and a number; a timer removes them when it has sent nothing for that long. Rows of any age count (see ``settle_sessions``).
    Rows without a device or a time are left out."""
    if keep_hours * 3600 <= gap_seconds:
        raise ValueError("sessions must be kept for longer than the gap between them")
    initial = None
    if history is not None:  # no more of a device than it would have kept
        ends = history.groupBy("device_id").agg(F.max("last_at").alias("newest"), (F.max("piece") + 1).alias("next"))
        recent = history.join(ends, "device_id").where(micros("last_at") >= micros("newest") - keep_hours * HOUR)
        initial = recent.drop("newest").groupBy("device_id")
    o = observations.where("device_id is not null and observed_at is not null").select("device_id", "observed_at")
    return o.groupBy("device_id").transformWithStateInPandas(_Sessions(gap_seconds * 1_000_000, keep_hours * HOUR), PIECES, "Update", "ProcessingTime", initial)


def settle_sessions(updates: DataFrame, history: DataFrame | None = None, gap_seconds: int = SESSION_GAP_SECONDS) -> DataFrame:
    """device_id, session_no (from 0), first_at, last_at, n: what all updates so far amount to. The last version of a piece counts;
    pieces no further apart than the gap are one session, however late the row that joins them came."""
    rows = updates if history is None else updates.unionByName(history)
    last = rows.groupBy("device_id", "piece").agg(F.max_by(F.struct("first_at", "last_at", "n"), "version").alias("x")).where("x.n > 0").select("device_id", "x.*")
    order = W.partitionBy("device_id").orderBy("first_at", "last_at")
    until = F.max("last_at").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((micros("first_at") - micros(until) > gap_seconds * 1_000_000).cast("int"), F.lit(0))
    numbered = last.withColumn("new", new).withColumn("session_no", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("device_id", "session_no").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("n").alias("n"))
