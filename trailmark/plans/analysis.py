"""The analysis of one source: features, forest, rules, fusion, ranking, leads; and what is kept of its runs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.config import FEATURES, MIN_SCORED_WALLETS, RUN_HISTORY
from trailmark.operators import features as feats
from trailmark.operators import fusion as fus
from trailmark.operators import rules
from trailmark.operators.forest import isolation_forest
from trailmark.operators.hops import hop_distance
from trailmark.plans.shared import Folder, written


RUN = "source string, run_id long, status string, transfer_count long, started_at timestamp_ntz, finished_at timestamp_ntz, error string"


@dataclass(frozen=True)
class Analysis:
    features: DataFrame
    anomaly: DataFrame
    findings: DataFrame
    fusion: DataFrame
    ranked: DataFrame
    leads: DataFrame


def analyse(transfers: DataFrame, hops: bool = True, columns=FEATURES) -> Analysis:
    """Analyse a ledger of one source. Features are written once, since thresholds, samples and scores all read them.
    Wallets with an undefined feature are left unscored; fewer than 20 scored wallets are an error."""
    got = feats.wallet_features(transfers, hop_distance(transfers) if hops else None)
    columns = [c for c in columns if hops or c != "hop_distance"]
    table = written(got, "features")
    scored = table.where(feats.finite(columns))
    if scored.limit(MIN_SCORED_WALLETS).count() < MIN_SCORED_WALLETS:
        raise ValueError(f"fewer than {MIN_SCORED_WALLETS} wallets can be scored")
    anomaly = written(isolation_forest(scored, columns), "anomaly")
    found = rules.with_findings(scored)
    fusion = fus.fuse(rules.rule_results(found), anomaly)
    ranked = fus.priority(fusion)
    return Analysis(table, anomaly, rules.findings(found), fusion, ranked, fus.leads(ranked))


def merge_leads(previous: DataFrame, current: DataFrame, now) -> DataFrame:
    """The current leads (one per wallet) with first_flagged_at kept from before; those no longer flagged go."""
    first = previous.select("wallet", F.col("first_flagged_at").alias("_first"))
    return current.join(first, "wallet", "left").withColumn("first_flagged_at", F.coalesce("_first", F.lit(now).cast("timestamp_ntz"))).drop("_first")


def lead_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """wallet, change: new, kept or gone, of all leads before and now."""
    p, c = previous.select("wallet", F.lit(1).alias("_p")), current.select("wallet", F.lit(1).alias("_c"))
    change = F.when(F.col("_p").isNull(), "new").when(F.col("_c").isNull(), "gone").otherwise("kept")
    return p.join(c, "wallet", "full").select("wallet", change.alias("change"))


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Write a table's partitions by ``keys`` in place of the ones of equal keys; all others stay."""
    spark = df.sparkSession
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        df.write.mode("overwrite").partitionBy(*keys).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)


def replace_source(df: DataFrame, path: str, source: str) -> None:
    """Delete and replace what a table (chains, candidates, findings, confidence, ...) holds of one source."""
    replace_partitions(df.withColumn("source", F.lit(source)), path, "source")


#: The tables of a run, and how long an analysis may hold its source before another takes it for lost.
TABLES = ("features", "anomaly", "findings", "fusion", "leads")
LOCK_SECONDS = 6 * 3600


def current_run(spark: SparkSession, folder: str, source: str) -> int | None:
    """The run whose tables are a source's state: the newest one with a manifest, which is the last thing that a run writes."""
    done = [int(x) for x in Folder(spark, folder).names(f"_manifests/source={source}") if x.isdigit()]
    return max(done, default=None)


def current(spark: SparkSession, folder: str, name: str, source: str) -> DataFrame | None:
    """A table of a source's state; only that run's files are read. None before the first run is done."""
    run = current_run(spark, folder, source)
    return None if run is None else spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}/source={source}/run_id={run}")


def save_run(result: Analysis, folder: str, source: str, run_id: int, now: datetime | None = None) -> None:
    """Make a run's tables the state of its source. Leads keep the time at which they were first flagged; those that are gone go.

    Tables are written under source= and run_id= folders that nobody reads yet; then the manifest appears, at once; then
    older runs' tables go. A run that stops before the manifest leaves the state as it was, and writing it again begins anew."""
    spark = result.leads.sparkSession
    files, before = Folder(spark, folder), current(spark, folder, "leads", source)
    now = (now or datetime.now(UTC)).replace(tzinfo=None)
    leads = result.leads.withColumn("first_flagged_at", F.lit(now).cast("timestamp_ntz")) if before is None else merge_leads(before, result.leads, now)
    for name in TABLES:
        df = leads if name == "leads" else getattr(result, name)
        df.write.mode("overwrite").parquet(f"{folder}/{name}/source={source}/run_id={run_id}")
    files.create(f"_manifests/source={source}/{run_id}")
    for name in TABLES:
        for old in files.names(f"{name}/source={source}"):
            if old.startswith("run_id=") and int(old.removeprefix("run_id=")) < run_id:
                files.delete(f"{name}/source={source}/{old}")
    for old in files.names(f"_manifests/source={source}"):
        if old.isdigit() and int(old) < run_id:
            files.delete(f"_manifests/source={source}/{old}")


def note_run(spark: SparkSession, folder: str, row: tuple, keep: int = RUN_HISTORY) -> None:
    """Write a record (RUN) of a run, in place of one of the same number, and drop all but the ``keep`` newest of its source."""
    source, run_id, files = row[0], row[1], Folder(spark, folder)
    spark.createDataFrame([row], RUN).drop("source", "run_id").coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs/source={source}/run_id={run_id}")
    there = sorted(int(x.removeprefix("run_id=")) for x in files.names(f"runs/source={source}") if x.startswith("run_id="))
    for old in there[:-keep]:
        files.delete(f"runs/source={source}/run_id={old}")


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of runs (RUN); empty before the first."""
    return spark.read.schema(RUN).parquet(f"{folder}/runs") if Folder(spark, folder).names("runs") else spark.createDataFrame([], RUN)


def run_analysis(transfers: DataFrame, folder: str, source: str, lock_seconds: float = LOCK_SECONDS) -> int:
    """Analyse a source, make the result its state and note the run; returns the run's id. One run of a source at a time: a second
    one raises, unless the first began more than ``lock_seconds`` ago and so is taken for lost. A run that fails is noted with its
    error, which is raised on."""
    spark = transfers.sparkSession
    files, lock = Folder(spark, folder), f"_running-{source}"
    if not files.create(lock):
        if files.age(lock) <= lock_seconds:
            raise RuntimeError(f"an analysis of {source} is running")
        files.delete(lock)
        if not files.create(lock):
            raise RuntimeError(f"an analysis of {source} has just begun")
    try:
        run_id = 1 + max((int(x.removeprefix("run_id=")) for x in files.names(f"runs/source={source}") if x.startswith("run_id=")), default=0)
        began, error, n = datetime.now(UTC).replace(tzinfo=None), None, transfers.count()
        note_run(spark, folder, (source, run_id, "running", n, began, None, None))
        try:
            save_run(analyse(transfers), folder, source, run_id)
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            raise
        finally:
            note_run(spark, folder, (source, run_id, "failed" if error else "completed", n, began, datetime.now(UTC).replace(tzinfo=None), error))
    finally:
        files.delete(lock)
    return run_id


def run_history(runs: DataFrame, keep: int = RUN_HISTORY) -> DataFrame:
    """The newest runs of each source."""
    from pyspark.sql import Window as W

    return runs.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy(F.desc("run_id")))).where(F.col("k") <= keep).drop("k")


def latest_run(runs: DataFrame, source: str) -> DataFrame:
    """The newest completed run of a source (RUN; one row, or none)."""
    return runs.where((F.col("source") == source) & (F.col("status") == "completed")).orderBy(F.desc("run_id")).limit(1)


def stale(runs: DataFrame, transfers: DataFrame, source: str) -> bool:
    """Whether a source's newest completed run saw another number of its transfers than there are now. An empty ledger is not stale."""
    n, last = transfers.count(), latest_run(runs, source).first()
    return n > 0 and (last is None or last["transfer_count"] != n)


def case_states(events: DataFrame) -> DataFrame:
    """case_id with its current title, status and priority, from an append-only event table (case_id, at, field, value)."""
    got = events.groupBy("case_id", "field").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
    return got.groupBy("case_id").pivot("field", ["title", "status", "priority"]).agg(F.first("value"))


def review_status(wallets: DataFrame, reviews: DataFrame, case_items: DataFrame) -> DataFrame:
    """wallet, status (Unreviewed, Under Review, Case Created), case_ids."""
    cases = case_items.where("item_type = 'wallet'").groupBy(F.col("item_id").alias("wallet")).agg(F.array_sort(F.collect_set("case_id")).alias("case_ids"))
    seen = reviews.select("wallet").distinct().withColumn("_seen", F.lit(True))
    j = wallets.select("wallet").join(cases, "wallet", "left").join(seen, "wallet", "left")
    status = F.when(F.col("case_ids").isNotNull(), "Case Created").when(F.col("_seen"), "Under Review").otherwise("Unreviewed")
    return j.select("wallet", status.alias("status"), "case_ids")
