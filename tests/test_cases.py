"""The case workflow against a plain replay of its events."""

import random
from datetime import datetime, timedelta

from trailmark.operators import cases as C

T0 = datetime(2025, 1, 1)


def replay(events, evidence):
    """(reasons by seq, cases, items) after all events, one by one."""
    reasons, state, items = {}, {}, {}
    for seq, at, _, case, action, field, value, kind, item in sorted(events):
        known = [e for k, i, t, e in evidence if (k, i) == (kind, item) and t <= at and e is not None]
        snapshot = max((t, e) for k, i, t, e in evidence if (k, i) == (kind, item) and t <= at and e is not None)[1] if known else None
        text = (value or "").strip() or None
        if action not in ("create", "set", "note", "add", "remove", "review"):
            why = "unknown action"
        elif action == "create" and text is None:
            why = "a case needs a title"
        elif action == "create" and case in state:
            why = "the case exists"
        elif action != "create" and case not in state:
            why = "no such case"
        elif action == "set" and field not in C.FIELDS:
            why = "unknown field"
        elif action == "set" and field in ("title", "status") and text is None:
            why = "the field cannot be empty"
        elif action == "set" and field == "status" and text not in C.STATUSES:
            why = "unknown status"
        elif action == "set" and field == "priority" and text is not None and text not in C.PRIORITIES:
            why = "unknown priority"
        elif action == "note" and text is None:
            why = "an empty note"
        elif action in ("add", "remove", "review") and (item is None or kind not in C.ITEM_TYPES):
            why = "unknown item"
        elif action == "add" and snapshot is None:
            why = "nothing is known of the item"
        elif action == "set" and state[case].get(field) == text:
            why = "no change"
        elif action == "add" and (case, kind, item) in items:
            why = "the item is in the case"
        elif action in ("remove", "review") and (case, kind, item) not in items:
            why = "the item is not in the case"
        else:
            why = ""
            if action == "create":
                state[case] = {"title": text, "status": "Open", "created_at": at}
            elif action == "set":
                state[case][field] = text
            elif action == "add":
                items[case, kind, item] = (at, snapshot)
            elif action == "remove":
                del items[case, kind, item]
            state[case]["updated_at"] = at
        reasons[seq] = why
    return reasons, state, items


def some_events(seed, n=400):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        action = rng.choice(["create", "set", "set", "set", "note", "add", "add", "remove", "review", "close"] if rng.random() < 0.95 else [None])
        field = rng.choice([*C.FIELDS, "colour", None]) if action == "set" else None
        value = rng.choice(["Open", "Closed", "High", "Low", "x", "  ", None]) if action != "create" else rng.choice(["Title", " ", None, "Other"])
        item = (rng.choice(["wallet", "cluster", "planet"]), rng.choice(["w1", "w2", None])) if action in ("add", "remove", "review") else (None, None)
        out.append((seq, T0 + timedelta(hours=seq // 2), "me", f"k{rng.randrange(4)}", action, field, value, *item))
    return out


def test_against_replay(spark):
    for seed in (1, 2):
        events = some_events(seed)
        evidence = [("wallet", "w1", T0, "first"), ("wallet", "w1", T0 + timedelta(hours=70), "then"), ("wallet", "w2", T0 + timedelta(hours=50), "late"), ("cluster", "w1", T0, "of a cluster"), ("cluster", "w1", T0, "of a cluster, again"), ("cluster", "w2", T0, None)]
        df = spark.createDataFrame(events, C.EVENTS).repartition(4)
        judged = C.judge(df, spark.createDataFrame(evidence, "item_type string, item_id string, at timestamp_ntz, evidence string")).cache()
        for at in (None, T0 + timedelta(hours=40)):
            reasons, state, items = replay([e for e in events if at is None or e[1] <= at], evidence)
            got = {r["seq"]: r["reason"] for r in judged.collect()}
            assert {k: got[k] for k in reasons} == reasons
            assert {(r["case_id"], r["item_type"], r["item_id"]): (r["added_at"], r["snapshot"]) for r in C.case_items(judged, at).collect()} == items
            fields = (*C.FIELDS, "created_at", "updated_at")
            assert {r["case_id"]: tuple(r[f] for f in fields) for r in C.case_state(judged, at).collect()} == {k: tuple(v.get(f) for f in fields) for k, v in state.items()}
        assert C.history(judged).count() == sum(x == "" for x in replay(events, evidence)[0].values())
        judged.unpersist()


def test_words_of_the_history(spark):
    events = [(1, T0, "me", "k", "create", None, " Case ", None, None), (2, T0, "me", "k", "set", "status", "Closed", None, None), (3, T0, "me", "k", "add", None, "odd", "wallet", "w"), (4, T0, "me", "k", "set", "description", "long text", None, None), (5, T0, "me", "k", "set", "priority", "High", None, None), (6, T0, "me", "k", "set", "priority", None, None, None)]
    got = C.history(C.judge(spark.createDataFrame(events, C.EVENTS))).orderBy("seq").collect()
    assert [(r["action"], r["detail"]) for r in got] == [("create", "Case"), ("status changed", "Open → Closed"), ("wallet added", "wallet w. odd"), ("description changed", "new description"), ("priority changed", "none → High"), ("priority changed", "High → none")]
    assert C.judge(spark.createDataFrame([], C.EVENTS)).count() == 0
