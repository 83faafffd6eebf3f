"""Mean breadth-first distance from each wallet to all it can reach, in the undirected transfer graph."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.fusion import ordinal
from trailmark.plans.shared import remove_since, tables_written, written

#: 64-bit masks of a row: the search goes from 64 times as many wallets at once in each row.
MASKS = 8
#: Up to how many busy wallets, one of them at each link, carry the search alone.
COVER = 2048
#: Distances of a tile that stays for many, and of one that is held against it; a distance of NONE is no path.
TILE, PART, NONE = 1 << 20, 1 << 16, (1 << 16) - 1


def undirected_edges(transfers: DataFrame) -> DataFrame:
    """a, b (a < b), transfers: one row per unordered pair."""
    pair = transfers.select(F.least("sender", "receiver").alias("a"), F.greatest("sender", "receiver").alias("b")).where("a < b")
    return pair.groupBy("a", "b").agg(F.count("*").alias("transfers"))


def _search(sym: DataFrame, sources: DataFrame, masks: int, level_of) -> list[DataFrame]:
    """``level_of(state, level)`` of each level of one search from all sources (k, j: numbered from 0) along the links (u, v).

    A row of the state per wallet k and block of 64 x ``masks`` sources: s has a bit for each source that has reached it, f for each
    that has just done so. A level is a join of what is new with the links and a bitwise or per wallet and block."""
    each, zero = range(masks), F.lit(0).cast("long")
    bit = F.expr("shiftleft(1L, cast(j % 64 as int))")
    start = [F.when(F.floor(F.col("j") / 64) % masks == i, bit).otherwise(zero) for i in each]
    state = written(sources.select("k", F.floor(F.col("j") / (64 * masks)).alias("block"), *[x.alias(f"s{i}") for i, x in enumerate(start)], *[x.alias(f"f{i}") for i, x in enumerate(start)]), "hop-state")
    some = " or ".join(f"f{i} <> 0" for i in each)
    level, found = 0, []
    while True:
        level += 1
        front = state.where(some).select(F.col("k").alias("v"), "block", *[f"f{i}" for i in each])
        reach = sym.join(front, "v").groupBy(F.col("u").alias("k"), "block").agg(*[F.bit_or(f"f{i}").alias(f"r{i}") for i in each])
        seen = state.select("k", "block", *[f"s{i}" for i in each])
        met = reach.join(seen, ["k", "block"], "full")
        s, r = [F.coalesce(f"s{i}", zero) for i in each], [F.coalesce(f"r{i}", zero) for i in each]
        state = written(met.select("k", "block", *[x.bitwiseOR(y).alias(f"s{i}") for i, (x, y) in enumerate(zip(s, r, strict=True))], *[y.bitwiseAND(F.bitwise_not(x)).alias(f"f{i}") for i, (x, y) in enumerate(zip(s, r, strict=True))]), "hop-state")
        got = written(level_of(state.where(some), level), "hop-level")
        if got.isEmpty():
            return found
        found.append(got)


def _counted(masks: int):
    """k, n, d: how many sources reach a wallet at a level, and the sum of their distances."""
    new = reduce(lambda x, y: x + y, [F.bit_count(f"f{i}") for i in range(masks)])
    return lambda new_bits, level: new_bits.groupBy("k").agg(F.sum(new).alias("n")).select("k", "n", (F.col("n") * level).alias("d"))


def _profiles(near: DataFrame, size: int, masks: int) -> DataFrame:
    """k, profile: a wallet's distances from sources 0 to ``size`` - 1 as 16-bit numbers, of (k, level, block, words)."""
    wide = 64 * masks

    def run(batches):
        for b in batches:
            out = []
            for seen in b.column(1).to_pylist():
                p = np.full(-(-size // wide) * wide, NONE, np.uint16)
                for x in seen:
                    p[x["block"] * wide : (x["block"] + 1) * wide][np.unpackbits(np.array(x["words"], np.int64).view(np.uint8), bitorder="little").view(bool)] = x["level"]
                out.append(p[:size].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["k", "profile"])

    return near.groupBy("k").agg(F.collect_list(F.struct("level", "block", "words")).alias("seen")).mapInArrow(run, "k long, profile binary")


def _tiles(classes: DataFrame, size: int, most: int) -> DataFrame:
    """profiles, weights, ids: classes (id, profile, n) side by side, up to ``most`` distances in a row."""
    def run(batches):
        for whole in batches:
            for b in (whole.slice(a, max(1, most // size)) for a in range(0, whole.num_rows, max(1, most // size))):
                cols = [b"".join(b.column(1).to_pylist()), b.column(2).to_numpy().tobytes(), b.column(0).to_numpy().tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], names=["profiles", "weights", "ids"])

    return classes.select("id", "profile", "n").mapInArrow(run, "profiles binary, weights binary, ids binary")


def _sums(dist: np.ndarray, weights: np.ndarray) -> tuple[int, int]:
    """How many have a path, and the sum of their distances."""
    there = np.where(dist == NONE, 0, weights)
    return int(there.sum()), int((dist * there).sum())


def _by_cover(of: DataFrame, sym: DataFrame, heads: DataFrame, size: int, masks: int) -> DataFrame:
    """k, n, d (wallets reached, sum of distances), where every link has an end in ``heads`` (k, j). The search goes from the heads
    alone. All neighbours of another wallet are heads, so from there any wallet is one step beyond the nearest of them: wallets of
    equal distances from the heads are a class, and tiles of classes are held against each other."""
    spark = of.sparkSession
    tag = lambda bits, level: bits.select("k", F.lit(level).alias("level"), "block", F.array(*[f"f{i}" for i in range(masks)]).alias("words"))
    near = reduce(DataFrame.unionAll, _search(sym, heads, masks, tag))
    words = F.aggregate("words", F.lit(0), lambda n, x: n + F.bit_count(x))
    reached = near.groupBy("k").agg(F.sum(words).alias("n"), F.sum(words * F.col("level")).alias("d"))
    rest = near.join(heads.select("k"), "k", "left_anti")
    profiles = written(_profiles(rest, size, masks), "hop-profiles")
    classes = written(profiles.groupBy("profile").agg(F.min("k").alias("id"), F.count("*").alias("n")), "hop-classes")

    def columns(batches):
        for b in batches:
            dist = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, size).astype(np.int64)
            sums = [_sums(dist[:, j], b.column(2).to_numpy()) for j in range(size)]
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*sums, strict=True))], names=["j", "n", "d"])

    def pairs(batches):
        for b in batches:
            for mine, ids, theirs, weights in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mine, theirs = (np.frombuffer(x, np.uint16).reshape(-1, size) for x in (mine, theirs))
                theirs, weights = np.ascontiguousarray(theirs.T), np.frombuffer(weights, np.int64)
                sums = []
                for p in mine:
                    dist = theirs[np.flatnonzero(p == 1)].min(axis=0)
                    n, d = _sums(dist.astype(np.int64), weights)
                    sums.append((n, d + n))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), *(pa.array(x, pa.int64()) for x in zip(*sums, strict=True))], names=["id", "n", "d"])

    a = written(_tiles(classes, size, PART).select("profiles", "ids").repartition(4 * spark.sparkContext.defaultParallelism), "hop-parts")
    b = written(_tiles(classes, size, TILE).select(F.col("profiles").alias("theirs"), "weights"), "hop-tiles")
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)  # a row is a tile
    try:
        met = written(a.crossJoin(b.hint("shuffle_replicate_nl")).mapInArrow(pairs, "id long, n long, d long"), "hop-met")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    # a class stands for each of its wallets, which are two steps from themselves through any neighbour
    of_rest = profiles.join(classes.select("id", "profile"), "profile").select("id", "k").join(met.groupBy("id").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "id")
    of_rest = of_rest.select("k", F.col("n") - 1, F.col("d") - 2)
    of_heads = heads.join(classes.select("id", "profile", "n").mapInArrow(columns, "j long, n long, d long"), "j").select("k", "n", "d")
    return reached.unionAll(of_rest).unionAll(of_heads)


def hop_distance(transfers: DataFrame, masks: int = MASKS, cover: int = COVER) -> DataFrame:
    """wallet, hop_distance: null for a wallet that reaches no other (one without a link to another has no row).

    Where every link has one of ``cover`` wallets or fewer at an end (the busier end of each link is taken), they carry the search
    (see ``_by_cover``). Else it goes from all wallets at once: levels (at most the diameter) are the only loop. Distances are
    symmetric, so what reaches a wallet at a level counts for its own mean. Exact; rows (tiles' distances) are wallets squared
    over the bits of a row, by definition of the measure.
    """
    spark, mark = transfers.sparkSession, tables_written()
    edges = undirected_edges(transfers).select("a", "b")
    of = written(ordinal(edges.select(F.explode(F.array("a", "b")).alias("wallet")).distinct(), F.asc("wallet"), name="k").withColumn("k", F.col("k") - 1), "hop-wallets")
    a, b = of.select(F.col("wallet").alias("a"), F.col("k").alias("u")), of.select(F.col("wallet").alias("b"), F.col("k").alias("v"))
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    sym = written(edges.join(a, "a").join(b, "b").select(both.alias("e")).select("e.*"), "hop-edges")
    if sym.isEmpty():
        return of.select("wallet", F.lit(None).cast("double").alias("hop_distance"))
    links = sym.groupBy("u").agg(F.count("*").alias("links"))
    end = lambda c: links.select(F.col("u").alias(c), F.struct("links", F.col("u").alias("k")).alias(f"{c}_end"))
    busier = sym.where("u < v").join(end("u"), "u").join(end("v"), "v").select(F.greatest("u_end", "v_end")["k"].alias("k")).distinct()
    heads = written(busier, "hop-heads")
    size = heads.limit(cover + 1).count()
    if size <= cover:
        found = _by_cover(of, sym, written(ordinal(heads, F.asc("k"), name="j").withColumn("j", F.col("j") - 1), "hop-heads"), size, masks)
    else:
        found = reduce(DataFrame.unionAll, _search(sym, of.select("k", F.col("k").alias("j")), masks, _counted(masks)))
    sums = found.groupBy("k").agg((F.sum("d") / F.sum("n")).alias("hop_distance"))
    got = written(of.join(sums, "k", "left").select("wallet", "hop_distance"), "hop-distance")
    remove_since(spark, mark, keep=1)
    return got
