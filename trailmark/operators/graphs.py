"""Iterative graph operators: shared-infrastructure clusters, communities, chains, risk, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.config import PEEL_HOPS, PEEL_SHARE, RISK_DECAY, RISK_HOPS, RISK_NODES, RISK_SEEDS
from trailmark.functions.scalars import micros
from trailmark.operators.components import connected_components
from trailmark.operators.hops import undirected_edges
from trailmark.plans.shared import cut, remove_since, tables_written, written


#: A round that raises the modularity by less than this is the last of its kind; what it gains is kept.
LEAST_GAIN = 1e-4
#: A node's gain (in units of weight, rounded to nine digits) over staying of this or less is taken for rounding.
LEAST_MOVE = 5e-9
#: Rounds whose matches are held apart before they are put together.
FOLD = 20
#: Keys of more events than this are spread over their days.
BUSY = 1 << 20


def star_edges(members: DataFrame, group: str, member: str) -> DataFrame:
    """src, dst: each group's least member to its others; connects what all pairs would, in one row per membership."""
    m = members.select(F.col(group).alias("g"), F.col(member).alias("m")).where("g is not null and m is not null").distinct()
    return m.join(m.groupBy("g").agg(F.min("m").alias("least")), "g").where("m <> least").select(F.col("least").alias("src"), F.col("m").alias("dst"))


def network_clusters(observations: DataFrame, keys=("ip_address", "device_id", "session_id")) -> DataFrame:
    """cluster_id, wallet: wallets linked by any shared key; clusters of two or more, named NET- and the least wallet."""
    keys = [k for k in keys if k in observations.columns]
    shown = observations.select("wallet", F.explode(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), k)) for k in keys])).alias("key"))
    groups = connected_components(star_edges(shown, "key", "wallet"))
    return groups.select(F.concat(F.lit("NET-"), "component").alias("cluster_id"), F.col("node").alias("wallet"))


def modularity(ends: DataFrame, label: DataFrame, m: float, resolution: float = 1.0) -> float:
    """Of the communities (label: u, c, k = weighted degree) of a graph (ends: u, v, w in both directions, loops once) of total weight m."""
    inside = ends.join(label.select("u", "c"), "u").join(label.select(F.col("u").alias("v"), F.col("c").alias("d")), "v").where("c = d")
    within = inside.agg(F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(F.col("w") / 2)).alias("x"))
    squares = label.groupBy("c").agg(F.sum("k").alias("tot")).agg((F.sum(F.col("tot") * F.col("tot")) * (-resolution / (4 * m))).alias("x"))
    return sum(r["x"] or 0.0 for r in within.unionAll(squares).collect()) / m


def best_moves(ends: DataFrame, label: DataFrame, m: float, resolution: float) -> DataFrame:
    """u, c, to, more: where each node gains most by moving, if it gains (``more`` than by staying)."""
    size = label.groupBy("c").agg(F.sum("k").alias("tot"))
    near = ends.where("u <> v").join(label.select(F.col("u").alias("v"), F.col("c").alias("to")), "v").groupBy("u", "to").agg(F.sum("w").alias("win"))
    options = near.unionAll(label.select("u", F.col("c").alias("to"), F.lit(0.0).alias("win"))).groupBy("u", "to").agg(F.sum("win").alias("win"))
    gain = options.join(label, "u").join(size.withColumnRenamed("c", "to"), "to")
    tot = F.col("tot") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
    gain = gain.withColumn("gain", F.round(F.col("win") - F.lit(resolution) * F.col("k") * tot / (2 * m), 9))
    stay = F.max(F.when(F.col("to") == F.col("c"), F.col("gain")))
    best = gain.groupBy("u", "c").agg(F.min_by("to", F.struct((-F.col("gain")).alias("g"), (F.col("to") != F.col("c")).alias("s"), "to")).alias("to"), (F.max("gain") - stay).alias("more"))
    return best.where((F.col("to") != F.col("c")) & (F.col("more") > LEAST_MOVE))


def not_adjacent(moves: DataFrame, ends: DataFrame, turn: int) -> DataFrame:
    """Of the moves those whose node comes first, in an order by hash that differs each turn, of all moving nodes next to it: a colour
    class of the graph of movers, which holds a fixed share of them on average, whatever the graph's diameter."""
    first = F.struct(F.xxhash64("u", F.lit(turn)).alias("h"), "u")
    movers = moves.select("u", first.alias("mine"))
    beside = ends.where("u <> v").join(movers, "u").join(movers.select(F.col("u").alias("v"), F.col("mine").alias("other")), "v")
    later = beside.where("other < mine").select("u").distinct()
    return moves.join(later, "u", "left_anti")


def apart(moves: DataFrame) -> DataFrame:
    """Of the moves those that gain most (ties: the least node) of all that leave or enter either of their communities. Their gains
    add up exactly."""
    first = F.struct((-F.col("more")).alias("g"), "u")
    most = moves.select("u", "more", F.explode(F.array("c", "to")).alias("x")).groupBy("x").agg(F.min(first).alias("first"))
    a, b = most.select(F.col("x").alias("c"), F.col("first.u").alias("ua")), most.select(F.col("x").alias("to"), F.col("first.u").alias("ub"))
    return moves.join(a, "c").join(b, "to").where("u = ua and u = ub")


#: Shares of the nodes that gain by moving which move at once, by hash, before only those move that do not touch.
SHARES = (2, 8)


def settled(ends: DataFrame, label: DataFrame, m: float, resolution: float, max_rounds: int) -> DataFrame:
    """The labels (u, c, k) after local moving. A round moves a hashed share of the nodes that gain. Where that raises the
    modularity by less than LEAST_GAIN (nodes that move at once may miss each other, or crowd a community; a loss is undone), a
    smaller share moves from then on, then a colour class, then only moves of communities that no other move touches; then it
    is over. Rounds follow neither the diameter nor, in a dense graph, the number of colours."""
    reached, caution = modularity(ends, label, m, resolution), 0
    for turn in range(max_rounds):
        moves = written(best_moves(ends, label, m, resolution), "moves")
        if moves.isEmpty():
            return label
        if caution < len(SHARES):
            moves = moves.where(F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(SHARES[caution])) == 0)
        else:
            moves = not_adjacent(moves, ends, turn) if caution == len(SHARES) else apart(moves)
        tried = written(label.join(moves.select("u", "to"), "u", "left").select("u", F.coalesce("to", "c").alias("c"), "k"), "labels")
        got = modularity(ends, tried, m, resolution)
        gain = got - reached
        if gain > 0:
            label, reached = tried, got
        if gain < LEAST_GAIN:
            if caution > len(SHARES):
                return label
            caution += 1
    raise RuntimeError(f"communities did not settle in {max_rounds} rounds")


def communities(edges: DataFrame, resolution: float = 1.0, max_rounds: int = 10_000) -> DataFrame:
    """community_id, wallet: modularity communities of two or more on weighted undirected edges (a, b, weight).

    Louvain's local moving, made parallel: in each round a set of nodes moves to the neighbouring community of the largest
    modularity gain (ties: the least label) if it beats staying (``settled``). Then communities become
    the next level's nodes, until a level brings no gain. Deterministic under any partitioning. Labels are least members,
    so ids are TXC- and the least wallet. Each round gains, so all ends; ``max_rounds`` (a level) only guards by raising. All
    state is in tables, whose sizes the optimizer knows.
    """
    spark = edges.sparkSession
    e = written(edges.select("a", "b", F.col("weight").cast("double").alias("w")), "edges")
    m = e.agg(F.sum("w")).first()[0] or 1.0
    of = written(e.select(F.explode(F.array("a", "b")).alias("wallet")).distinct().withColumn("node", F.col("wallet")), "nodes")
    while True:
        mark = tables_written()
        ends = e.select("a", "b", "w").unionAll(e.where("a <> b").select("b", "a", "w"))
        ends = written(ends.toDF("u", "v", "w").groupBy("u", "v").agg(F.sum("w").alias("w")), "ends")
        label = written(ends.groupBy("u").agg(F.sum(F.when(F.col("u") == F.col("v"), 2 * F.col("w")).otherwise(F.col("w"))).alias("k")).select("u", F.col("u").alias("c"), "k"), "labels")
        label = settled(ends, label, m, resolution, max_rounds)
        name = label.groupBy("c").agg(F.min("u").alias("name"))
        label = written(label.join(name, "c").select(F.col("u").alias("node"), "name"), "names")
        done = label.where("node <> name").isEmpty()
        la, lb = label.select(F.col("node").alias("a"), F.col("name").alias("na")), label.select(F.col("node").alias("b"), F.col("name").alias("nb"))
        e = written(e.join(la, "a").join(lb, "b").groupBy(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).agg(F.sum("w").alias("w")), "edges")
        of = written(of.join(label, "node").select("wallet", F.col("name").alias("node")), "nodes")
        remove_since(spark, mark, keep=2)
        if done:
            break
    names = of.groupBy("node").agg(F.min("wallet").alias("least"), F.count("*").alias("n")).where("n > 1")
    return of.join(names, "node").select(F.concat(F.lit("TXC-"), "least").alias("community_id"), "wallet")


def transaction_communities(transfers: DataFrame) -> DataFrame:
    return communities(undirected_edges(transfers).withColumnRenamed("transfers", "weight"))


def stable_ids(new: DataFrame, old: DataFrame, group: str = "cluster_id", member: str = "wallet") -> DataFrame:
    """default_id, stable_id: clusters keep the id of the old cluster that they overlap most, each old id once.

    Greedy by overlap: a pair that is the best on both sides is always greedy's choice, so all such pairs are taken at once,
    round by round until no pair is left (the best pair left is always one). New clusters without a match keep their own id; where
    an old cluster has or had it, they get the least suffix from -2 on that neither an old cluster nor another new one has.
    """
    pairs = new.select(F.col(group).alias("fresh"), F.col(member).alias("m")).join(old.select(F.col(group).alias("kept"), F.col(member).alias("m")), "m")
    left = cut(pairs.groupBy("fresh", "kept").agg(F.count("*").alias("n")))
    taken = []
    order = F.struct((-F.col("n")).alias("n"), (F.col("fresh") != F.col("kept")).alias("d"), F.col("kept"), F.col("fresh"))
    while not left.isEmpty():
        a = left.groupBy("fresh").agg(F.min(order).alias("o")).select("o.fresh", "o.kept")
        b = left.groupBy("kept").agg(F.min(order).alias("o")).select("o.fresh", "o.kept")
        both = cut(a.join(b, ["fresh", "kept"]))
        taken = [cut(reduce(DataFrame.unionAll, [*taken, both]))] if len(taken) >= FOLD else [*taken, both]
        left = cut(left.join(both.select("fresh"), "fresh", "left_anti").join(both.select("kept"), "kept", "left_anti"))
    names = new.select(F.col(group).alias("fresh")).distinct()
    matched = reduce(DataFrame.unionAll, taken) if taken else names.select("fresh", F.col("fresh").alias("kept")).limit(0)
    got = names.join(matched, "fresh", "left")
    before = old.select(F.col(group).alias("fresh")).distinct()
    rest = got.where("kept is null").select("fresh")
    clash = rest.join(before, "fresh", "left_semi")
    # of the numbers from 2 on that stand behind each name in ids that are in use, those before the first gap
    parts = before.unionAll(rest).distinct().select(F.regexp_extract("fresh", r"^(.*)-([1-9][0-9]{0,8})$", 1).alias("base"), F.regexp_extract("fresh", r"-([1-9][0-9]{0,8})$", 1).try_cast("int").alias("i"))
    used = parts.where("i >= 2").join(clash.select(F.col("fresh").alias("base")), "base", "left_semi")
    in_row = used.withColumn("k", F.row_number().over(W.partitionBy("base").orderBy("i"))).where("i = k + 1").groupBy(F.col("base").alias("fresh")).agg(F.max("i").alias("last"))
    suffix = clash.join(in_row, "fresh", "left").select("fresh", F.concat("fresh", F.lit("-"), (F.coalesce("last", F.lit(1)) + 1).cast("string")).alias("other"))
    return got.join(suffix, "fresh", "left").select(F.col("fresh").alias("default_id"), F.coalesce("kept", "other", "fresh").alias("stable_id"))


def previous_event(events: DataFrame, key: str, us: str, order: list[str], columns: list[str]) -> DataFrame:
    """Adds ``previous`` (a struct of columns, null for the first) of the event before, per key in (us, *order).

    Found inside the key, or inside the days of a busy one (of which there are few), so that it is spread over them. Then only the
    first and last events are put in a row by key: before the first of a day stands the last of a day before."""
    day = 86_400_000_000
    busy = events.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > BUSY).select(key, F.lit(True).alias("_busy"))
    e = events.join(F.broadcast(busy), key, "left").withColumn("_day", F.when(F.col("_busy"), F.floor(F.col(us) / day)).otherwise(0)).drop("_busy")
    now, inside = F.struct(*columns), W.partitionBy(key, "_day").orderBy(us, *order)
    e = e.withColumn("previous", F.lag(now).over(inside)).withColumn("_last", F.lead(F.lit(True)).over(inside).isNull()).drop("_day")
    ends = e.where("previous is null or _last").withColumn("_first", F.col("previous").isNull()).drop("previous", "_last")
    first = ends.withColumn("previous", F.lag(now).over(W.partitionBy(key).orderBy(us, *order))).where("_first").drop("_first")
    return e.where("previous is not null").drop("_last").unionByName(first)


def peeling_links(transfers: DataFrame, share: float = PEEL_SHARE) -> DataFrame:
    """transaction_id, predecessor: a wallet's first spend after a receipt that passes on ``share`` of it or more."""
    t = transfers.select("transaction_id", micros("ts").alias("us"), "sender", "receiver", "amount")
    side = lambda w, k: F.struct(F.col(w).alias("wallet"), F.lit(k).alias("kind"))
    events = t.withColumn("s", F.explode(F.array(side("sender", "out"), side("receiver", "in")))).select("transaction_id", "us", "amount", "s.*")
    e = previous_event(events, "wallet", "us", ["transaction_id"], ["transaction_id", "kind", "amount"])
    p = F.col("previous")
    ok = (F.col("kind") == "out") & (p["kind"] == "in") & (p["amount"] > 0) & (F.col("amount") >= F.lit(share) * p["amount"])
    return e.where(ok).select("transaction_id", p["transaction_id"].alias("predecessor"))


def chain_positions(links: DataFrame) -> DataFrame:
    """transaction_id, root, depth (0 at the root) for all transactions on a chain, by pointer doubling. Links are read
    more than once and found only once."""
    links = written(links, "chain-links")
    roots = links.select("predecessor").join(links.select(F.col("transaction_id").alias("predecessor")), "predecessor", "left_anti").distinct()
    open_ = cut(links.select("transaction_id", F.col("predecessor").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        nxt = open_.select(F.col("transaction_id").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        step = cut(open_.join(nxt, "root", "left").select("transaction_id", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("went")))
        if step.where("went").isEmpty():
            break
        open_ = step.drop("went")
    return open_.unionAll(roots.select(F.col("predecessor").alias("transaction_id"), F.col("predecessor").alias("root"), F.lit(0).cast("long").alias("depth")))


def peeling_hops(transfers: DataFrame, share: float = PEEL_SHARE, min_hops: int = PEEL_HOPS) -> DataFrame:
    """chain_id, hop_index (from 1), transaction_id, from_wallet, to_wallet, amount of chains with enough hops."""
    at = chain_positions(peeling_links(transfers, share))
    long = at.groupBy("root").agg(F.max("depth").alias("d")).where(F.col("d") + 1 >= min_hops).select("root")
    got = at.join(long, "root").join(transfers, "transaction_id")
    return got.select(F.concat(F.lit("PEEL-"), "root").alias("chain_id"), (F.col("depth") + 1).alias("hop_index"), "transaction_id", F.col("sender").alias("from_wallet"), F.col("receiver").alias("to_wallet"), "amount")


def peeling_chains(hops: DataFrame) -> DataFrame:
    """chain_id, hop_count, start_wallet, end_wallet, start_amount, end_amount."""
    first = lambda c: F.min_by(c, "hop_index")
    last = lambda c: F.max_by(c, "hop_index")
    return hops.groupBy("chain_id").agg(F.count("*").alias("hop_count"), first("from_wallet").alias("start_wallet"), last("to_wallet").alias("end_wallet"), first("amount").alias("start_amount"), last("amount").alias("end_amount"))


def neighbour_links(edges: DataFrame, frontier: DataFrame, known: DataFrame) -> DataFrame:
    """candidate, parent, transfers: edges (a, b, transfers) from the frontier to wallets that are not known yet."""
    sides = edges.select("a", "b", "transfers").unionAll(edges.select("b", "a", "transfers")).toDF("parent", "candidate", "transfers")
    return sides.join(frontier.select(F.col("wallet").alias("parent")), "parent", "left_semi").join(known.select(F.col("wallet").alias("candidate")), "candidate", "left_anti")


def expand(edges: DataFrame, seeds: DataFrame, max_hops: int, max_nodes: int | None) -> DataFrame:
    """wallet, hop, parent, path: breadth-first from the seeds, strongest link first, up to a number of wallets (None: all).

    The number of rounds and (by max_nodes) of rows kept is bounded; each round is one join of the frontier with the edges.
    """
    known = cut(seeds.select("wallet", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent"), F.array("wallet").alias("path")))
    n, frontier = known.count(), known
    for hop in range(1, max_hops + 1):
        if max_nodes is not None and n >= max_nodes:
            break
        links = neighbour_links(edges, frontier, known)
        best = links.groupBy("candidate").agg(F.sum("transfers").alias("total"), F.min_by("parent", F.struct((-F.col("transfers")).alias("t"), "parent")).alias("parent"))
        if max_nodes is not None:
            best = best.orderBy(F.desc("total"), "candidate").limit(max_nodes - n)
        frontier = cut(best.join(known.select(F.col("wallet").alias("parent"), "path"), "parent").select(F.col("candidate").alias("wallet"), F.lit(hop).alias("hop"), "parent", F.concat("path", F.array("candidate")).alias("path")))
        got = frontier.count()
        if not got:
            break
        known, n = cut(known.unionAll(frontier)), n + got
    return known


def propagate_risk(transfers: DataFrame, seeds: list[str], decay: float = RISK_DECAY, max_hops: int = RISK_HOPS, max_nodes: int | None = RISK_NODES) -> DataFrame:
    """wallet, propagated_score (decay^hop), hop_distance, path from the seeds (1 to 50 known wallets); up to ``max_nodes`` wallets
    (None: all within ``max_hops``)."""
    seeds = list(dict.fromkeys(seeds))
    if not 1 <= len(seeds) <= RISK_SEEDS:
        raise ValueError(f"between 1 and {RISK_SEEDS} seed wallets are needed")
    spark = transfers.sparkSession
    frame = spark.createDataFrame([(s,) for s in seeds], "wallet string")
    edges = cut(undirected_edges(transfers))
    missing = frame.join(edges.select(F.explode(F.array("a", "b")).alias("wallet")), "wallet", "left_anti").limit(RISK_SEEDS).collect()
    if missing:
        raise LookupError("unknown wallets: " + ", ".join(sorted(r[0] for r in missing)))
    got = expand(edges, frame, max_hops, max_nodes)
    return got.select("wallet", F.pow(F.lit(decay), F.col("hop")).alias("propagated_score"), F.col("hop").alias("hop_distance"), "path")


def _meet(edges: DataFrame, start: str, end: str) -> list[str] | None:
    """The least (in the order of its wallets) of the shortest paths along edges (u, v). Two searches meet: the smaller frontier goes
    on, each wallet with the least path to it. The first wallets that both have reached lie on all shortest paths."""
    spark = edges.sparkSession
    there = edges.select(F.explode(F.array("u", "v")).alias("wallet")).where(F.col("wallet").isin(start, end)).distinct().count()
    if start == end or there < 2:
        return None
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    sides = []
    for wallet, along, join in ((start, edges, lambda path, w: F.concat(path, F.array(w))), (end, turned, lambda path, w: F.concat(F.array(w), path))):
        front = written(spark.createDataFrame([(wallet, [wallet])], "wallet string, path array<string>"), "path-front")
        sides.append({"edges": along, "front": front, "seen": front.select("wallet"), "n": 1, "add": join})
    while True:
        side = min(sides, key=lambda x: x["n"])
        step = side["edges"].join(side["front"].withColumnRenamed("wallet", "u"), "u").join(side["seen"].select(F.col("wallet").alias("v")), "v", "left_anti")
        step = step.groupBy(F.col("v").alias("wallet")).agg(F.min(side["add"](F.col("path"), F.col("v"))).alias("path"))
        side["front"] = written(step, "path-front")
        side["n"] = side["front"].count()
        if not side["n"]:
            return None
        side["seen"] = written(side["seen"].unionAll(side["front"].select("wallet")), "path-seen")
        a, b = sides[0]["front"], sides[1]["front"].select("wallet", F.col("path").alias("rest"))
        whole = a.join(b, "wallet").agg(F.min(F.concat("path", F.expr("slice(rest, 2, size(rest) - 1)"))).alias("path")).first()["path"]
        if whole:
            return whole


def trace_path(transfers: DataFrame, start: str, end: str) -> DataFrame:
    """A row per hop of a shortest path: hop (from 1), mode (directed along transfers; undirected if there is no such path),
    from_wallet, to_wallet, forward and backward (transfers either way), amount (what went forward). No rows for equal or unknown
    wallets, or where no path is. Of equally short paths it is the least in the order of their wallets."""
    spark, mark = transfers.sparkSession, tables_written()
    flow = written(transfers.where("sender <> receiver").groupBy(F.col("sender").alias("u"), F.col("receiver").alias("v")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount")), "path-flows")
    either = flow.select("u", "v").unionAll(flow.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    schema, rows = "hop int, mode string, from_wallet string, to_wallet string", []
    for mode, edges in (("directed", flow.select("u", "v")), ("undirected", either)):
        path = _meet(edges, start, end)
        if path:
            rows = [(k + 1, mode, a, b) for k, (a, b) in enumerate(zip(path, path[1:], strict=False))]
            break
    hops = spark.createDataFrame(rows, schema)
    forward = flow.select(F.col("u").alias("from_wallet"), F.col("v").alias("to_wallet"), F.col("n").alias("forward"), "amount")
    backward = flow.select(F.col("v").alias("from_wallet"), F.col("u").alias("to_wallet"), F.col("n").alias("backward"))
    zero = F.lit(0).cast("long")
    got = hops.join(forward, ["from_wallet", "to_wallet"], "left").join(backward, ["from_wallet", "to_wallet"], "left")
    got = written(got.select("hop", "mode", "from_wallet", "to_wallet", F.coalesce("forward", zero).alias("forward"), F.coalesce("backward", zero).alias("backward"), F.coalesce("amount", F.lit(0.0)).alias("amount")), "path")
    remove_since(spark, mark, keep=1)
    return got


def shortest_path(transfers: DataFrame, start: str, end: str) -> DataFrame:
    """position (from 0), wallet of the path that ``trace_path`` finds; empty if none."""
    hops = trace_path(transfers, start, end)
    each = F.explode(F.when(F.col("hop") == 1, F.array("from_wallet", "to_wallet")).otherwise(F.array("to_wallet")))
    return hops.select("hop", "to_wallet", each.alias("wallet")).select((F.col("hop") - (F.col("wallet") != F.col("to_wallet")).cast("int")).alias("position"), "wallet")


def time_paths(transfers: DataFrame, within_days: float | None = None) -> DataFrame:
    """a, b, c, d with the three transfers' ids: simple three-hop paths whose times strictly increase, within a span of days if one
    is given. The output has a row per path by definition.

    With a span the joins are on wallet and day bucket, so that only transfers of nearby times meet."""
    t = transfers.select("transaction_id", micros("ts").alias("us"), "sender", "receiver")
    if within_days is None:
        t, later, soon = t.withColumn("span", F.lit(0)), F.array(F.lit(0)), "true"
    else:
        size = int(within_days * 86_400_000_000)
        t, later, soon = t.withColumn("span", F.floor(F.col("us") / size)), F.array("span", F.col("span") - 1), f"us{{k}} < us1 + {size}"
    nxt = lambda k: t.select(F.col("transaction_id").alias(f"t{k}"), F.col("us").alias(f"us{k}"), F.col("sender").alias(f"s{k}"), F.col("receiver").alias(f"r{k}"), F.explode(later).alias("span"))
    first = t.select(F.col("transaction_id").alias("t1"), F.col("us").alias("us1"), F.col("sender").alias("s1"), F.col("receiver").alias("r1"), "span")
    a = first.withColumnRenamed("r1", "w").join(nxt(2).withColumnRenamed("s2", "w"), ["w", "span"]).where(f"us2 > us1 and {soon.format(k=2)} and r2 <> s1")
    a = a.withColumnRenamed("w", "b").withColumnRenamed("r2", "w")
    b = a.join(nxt(3).withColumnRenamed("s3", "w"), ["w", "span"]).where(f"us3 > us2 and {soon.format(k=3)} and r3 <> s1 and r3 <> b")
    return b.select(F.col("s1").alias("a"), "b", F.col("w").alias("c"), F.col("r3").alias("d"), "t1", "t2", "t3")


#: How many of the first senders to a wallet (and last receivers from it) decide: one may be the middle's other end, and of two more
#: one differs from whatever is taken on the other side.
ENDS_KEPT = 3


def time_path_middles(transfers: DataFrame) -> DataFrame:
    """transaction_id, b, c: transfers that are the middle of a simple three-hop path with strictly increasing times, at any distance
    in time. Linear in the transfers: each wallet's first three distinct senders and last three distinct receivers decide."""
    t = transfers.select("transaction_id", micros("ts").alias("us"), "sender", "receiver").where("sender <> receiver")

    def ends(wallet: str, other: str, time, order) -> DataFrame:
        each = t.groupBy(F.col(wallet).alias("wallet"), F.col(other).alias("other")).agg(time.alias("us"))
        top = each.withColumn("k", F.row_number().over(W.partitionBy("wallet").orderBy(order, "other"))).where(F.col("k") <= ENDS_KEPT)
        return top.groupBy("wallet").agg(F.collect_list(F.struct("us", "other")).alias("ends"))

    first = ends("receiver", "sender", F.min("us"), F.asc("us")).select(F.col("wallet").alias("sender"), F.col("ends").alias("firsts"))
    last = ends("sender", "receiver", F.max("us"), F.desc("us")).select(F.col("wallet").alias("receiver"), F.col("ends").alias("lasts"))
    a = F.filter("firsts", lambda x: (x["us"] < F.col("us")) & (x["other"] != F.col("receiver")))
    d = F.filter("lasts", lambda x: (x["us"] > F.col("us")) & (x["other"] != F.col("sender")))
    got = t.join(first, "sender").join(last, "receiver").select("transaction_id", "sender", "receiver", a.alias("a"), d.alias("d"))
    differ = (F.size("a") > 1) | (F.size("d") > 1) | (F.col("a")[0]["other"] != F.col("d")[0]["other"])
    return got.where((F.size("a") > 0) & (F.size("d") > 0) & differ).select("transaction_id", F.col("sender").alias("b"), F.col("receiver").alias("c"))
