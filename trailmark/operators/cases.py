"""The workflow of cases as a fold over an append-only table of events.

Events: seq (their order, unique), at, actor, case_id, action (create, set, note, add, remove, review), field, value, item_type, item_id.
Nothing is stored but events: which of them count, and why others do not, follows from the events before them. Each rule
looks back along one case's field or item only, so the fold is a few windows and no loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What cases and items may be.
STATUSES, PRIORITIES = ("Open", "Under investigation", "Closed"), ("High", "Medium", "Low")
FIELDS, ITEM_TYPES = ("title", "description", "status", "priority", "assigned_to"), ("lead", "wallet", "transaction", "cluster", "entity")
MOST_TITLE, MOST_DESCRIPTION, MOST_ASSIGNED = 200, 5000, 80
EVENTS = "seq long, at timestamp_ntz, actor string, case_id string, action string, field string, value string, item_type string, item_id string"


def with_evidence(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds snapshot to events that add or review an item: the evidence (item_type, item_id, at, evidence) that held when they
    happened, null if there was none yet. Of versions of one moment the greatest text holds."""
    e = events.withColumn("_kind", F.lit(1)).withColumn("_says", F.lit(None).cast("string"))
    v = evidence.where("evidence is not null").select("item_type", "item_id", "at", F.lit(0).alias("_kind"), F.col("evidence").alias("_says"))
    order = W.partitionBy("item_type", "item_id").orderBy("at", "_kind", F.asc_nulls_first("_says"), "seq")
    both = e.where("action in ('add', 'review')").unionByName(v, allowMissingColumns=True)
    seen = both.withColumn("snapshot", F.last("_says", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).where("_kind = 1")
    rest = e.where("action not in ('add', 'review') or action is null").withColumn("snapshot", F.lit(None).cast("string"))
    return seen.unionByName(rest).drop("_kind", "_says")


def judge(events: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """The events with reason (empty: it counts), old (what a field was before) and, with ``evidence``, snapshot.

    A case begins with its first create, as Open; what comes before, and a second create, does not count. A field that is set to
    what it is, or to what it may not be, stays. An item is added once until it is removed; only items of a case can be
    removed or reviewed. With ``evidence`` an item must have been known when it was added."""
    e = with_evidence(events, evidence) if evidence is not None else events.withColumn("snapshot", F.lit(None).cast("string"))
    text = F.nullif(F.trim("value"), F.lit(""))
    e = e.withColumn("value", F.when(F.col("action").isin("create", "set"), text).otherwise(F.col("value"))).withColumn("field", F.when(F.col("action") == "create", F.lit("title")).otherwise(F.col("field")))
    begun = e.where("action = 'create' and value is not null").groupBy("case_id").agg(F.min("seq").alias("_begun"))
    e = e.join(begun, "case_id", "left")
    too_long = lambda f, n: (F.col("field") == f) & (F.length("value") > n)
    own = (  # what an event lacks by itself, or against its case's beginning
        F.when(F.col("action").isNull() | ~F.col("action").isin("create", "set", "note", "add", "remove", "review"), "unknown action")
        .when((F.col("action") == "create") & F.col("value").isNull(), "a case needs a title")
        .when(F.col("_begun").isNull() | (F.col("seq") < F.col("_begun")), "no such case")
        .when((F.col("action") == "create") & (F.col("seq") > F.col("_begun")), "the case exists")
        .when((F.col("action") == "set") & (F.col("field").isNull() | ~F.col("field").isin(*FIELDS)), "unknown field")
        .when((F.col("action") == "set") & F.col("field").isin("title", "status") & F.col("value").isNull(), "the field cannot be empty")
        .when((F.col("action") == "set") & (F.col("field") == "status") & ~F.col("value").isin(*STATUSES), "unknown status")
        .when((F.col("action") == "set") & (F.col("field") == "priority") & ~F.col("value").isin(*PRIORITIES), "unknown priority")
        .when(too_long("title", MOST_TITLE) | too_long("description", MOST_DESCRIPTION) | too_long("assigned_to", MOST_ASSIGNED), "too long")
        .when((F.col("action") == "note") & (F.coalesce(F.trim("value"), F.lit("")) == ""), "an empty note")
        .when(F.col("action").isin("add", "remove", "review") & (F.col("item_id").isNull() | ~F.coalesce(F.col("item_type").isin(*ITEM_TYPES), F.lit(False))), "unknown item")
    )
    if evidence is not None:
        own = F.coalesce(own, F.when((F.col("action") == "add") & F.col("snapshot").isNull(), "nothing is known of the item"))
    e = e.withColumn("_own", own)
    # what counts by itself decides what fields and items were before; whether it is a repetition does not change that
    sets = F.col("action").isin("create", "set") & F.col("_own").isNull()
    moves = F.col("action").isin("add", "remove") & F.col("_own").isNull()
    by_field, by_item = W.partitionBy("case_id", "field").orderBy("seq"), W.partitionBy("case_id", "item_type", "item_id").orderBy("seq")
    back = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    was = F.last(F.when(sets, F.struct("value")), ignorenulls=True).over(back(by_field))
    e = e.withColumn("_was", was).withColumn("_move", F.last(F.when(moves, F.col("action")), ignorenulls=True).over(back(by_item)))
    old = F.when(F.col("_was").isNotNull(), F.col("_was.value")).when(F.col("field") == "status", "Open")
    e = e.withColumn("old", F.when(F.col("action") == "set", old))
    there = F.coalesce(F.col("_move") == "add", F.lit(False))
    reason = (
        F.when(F.col("_own").isNotNull(), F.col("_own")).when((F.col("action") == "set") & F.col("old").eqNullSafe(F.col("value")), "no change")
        .when((F.col("action") == "add") & there, "the item is in the case").when(F.col("action").isin("remove", "review") & ~there, "the item is not in the case").otherwise("")
    )
    return e.withColumn("reason", reason).drop("_begun", "_own", "_was", "_move")


def history(judged: DataFrame) -> DataFrame:
    """case_id, seq, at, actor, action, detail of all events that count."""
    arrow = F.concat(F.coalesce("old", F.lit("none")), F.lit(" → "), F.coalesce("value", F.lit("none")))
    item = F.concat_ws(" ", "item_type", "item_id")
    action = F.when(F.col("action") == "set", F.concat("field", F.lit(" changed"))).when(F.col("action").isin("add", "remove", "review"), F.concat("item_type", F.lit(" "), F.when(F.col("action") == "add", "added").when(F.col("action") == "remove", "removed").otherwise("reviewed"))).otherwise(F.col("action"))
    detail = F.when(F.col("action") == "set", F.when(F.col("field") == "description", "new description").otherwise(arrow)).when(F.col("action").isin("add", "remove", "review"), F.concat_ws(". ", item, "value")).otherwise(F.col("value"))
    return judged.where("reason = ''").select("case_id", "seq", "at", "actor", action.alias("action"), detail.alias("detail"))


def _until(judged: DataFrame, at) -> DataFrame:
    counts = judged.where("reason = ''")
    return counts if at is None else counts.where(F.col("at") <= F.lit(at).cast("timestamp_ntz"))


def case_items(judged: DataFrame, at=None) -> DataFrame:
    """case_id, item_type, item_id, added_at, snapshot: what is in each case (at a moment), with the evidence as it stood when added."""
    last = _until(judged, at).where("action in ('add', 'remove')").groupBy("case_id", "item_type", "item_id").agg(F.max_by(F.struct("action", "at", "snapshot"), "seq").alias("x"))
    return last.where("x.action = 'add'").select("case_id", "item_type", "item_id", F.col("x.at").alias("added_at"), F.col("x.snapshot").alias("snapshot"))


def case_state(judged: DataFrame, at=None) -> DataFrame:
    """case_id, its fields, created_at, updated_at, items: each case (at a moment)."""
    counts = _until(judged, at)
    latest = lambda f: F.max_by("value", F.when(F.col("action").isin("create", "set") & (F.col("field") == f), F.col("seq")))
    got = counts.groupBy("case_id").agg(*[latest(f).alias(f) for f in FIELDS], F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    items = case_items(judged, at).groupBy("case_id").agg(F.count("*").alias("items"))
    return got.join(items, "case_id", "left").withColumn("status", F.coalesce("status", F.lit("Open"))).withColumn("items", F.coalesce("items", F.lit(0).cast("long")))
