"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.llm.common import table, written

K = 5
SHARD_ROWS = 4096
LEAF_ROWS = 64
#: Queries searched at once: they are broadcast, so a block is bounded whatever the number of queries.
QUERY_BLOCK = 4096
#: Sums of products below these are exact in float64 and in int64, whatever the order they are added in.
FLOAT_EXACT, LONG_EXACT = 2.0**52, 2.0**62
#: No row; and what stands for scores of a long's range or more, which sort right but cannot be returned.
NONE = -(1 << 63) + 1
LOW, HIGH = NONE + 1, (1 << 63) - 1


def build_tree(ids: np.ndarray, x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict:
    """A ball tree over rows: points in leaf order, and per node its centre, radius, parent, range and least id."""
    order = np.arange(len(ids))
    nodes, todo = [], [(0, len(ids), -1)]
    while todo:
        a, b, parent = todo.pop()
        at = len(nodes)
        part = x[order[a:b]]
        centre = part.mean(axis=0)
        radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
        leaf = b - a <= leaf_rows or radius == 0
        nodes.append((centre, radius, parent, a, b, leaf))
        if not leaf:
            far = part[((part - part[0]) ** 2).sum(axis=1).argmax()]
            other = part[((part - far) ** 2).sum(axis=1).argmax()]
            side = part @ (other - far)
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(side, mid)]
            todo += [(a, a + mid, at), (a + mid, b, at)]
    for _, _, _, a, b, leaf in nodes:
        if leaf:
            order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
    ids, x = ids[order], x[order]
    return {
        "ids": ids, "x": x, "centre": np.array([n[0] for n in nodes]), "radius": np.array([n[1] for n in nodes]), "parent": np.array([n[2] for n in nodes]),
        "a": np.array([n[3] for n in nodes]), "b": np.array([n[4] for n in nodes]), "leaf": np.array([n[5] for n in nodes]),
        "least": np.array([ids[n[3] : n[4]].min() for n in nodes]),
    }


def merge(score: np.ndarray, vec: np.ndarray, more: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of (score, vec) and (more, ids) in each row: by score descending, then id ascending."""
    k = score.shape[1]
    s, v = np.concatenate([score, more], axis=1), np.concatenate([vec, ids], axis=1)
    pick = np.lexsort((v, -s), axis=1)[:, :k]
    return np.take_along_axis(s, pick, axis=1), np.take_along_axis(v, pick, axis=1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The exact inner products of rows of integers (as float64), held to LOW and HIGH: in float64 where that is exact, else
    in int64, else in Python integers."""
    out = np.empty((len(q), len(x)), np.int64)
    size = q.shape[1] * np.abs(q).max(axis=1) * np.abs(x).max()
    quick, long = size < FLOAT_EXACT, size < LONG_EXACT
    if quick.all():
        return (q @ x.T).astype(np.int64)
    out[quick] = (q[quick] @ x.T).astype(np.int64)
    if (some := long & ~quick).any():
        out[some] = q[some].astype(np.int64) @ x.astype(np.int64).T
    if not long.all():
        whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object)
        got = whole(q[~long]) @ whole(x).T
        out[~long] = np.minimum(np.maximum(got, LOW), HIGH).astype(np.int64)
    return out


def _packed(x: np.ndarray) -> np.ndarray:
    """Whole numbers as int32 if all fit, else as they are."""
    return x.astype(np.int32) if not x.size or np.abs(x).max() < 1 << 31 else x


def search_tree(tree: dict, q: np.ndarray, qid: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
    """Improve each query's current k best (score, vec: one row per query, in place) by the rows of one tree.

    A query visits the leaves in the order of their upper bounds (a node's bound is the least along its path) and
    stops when a bound falls below its current kth score; at an equal bound a leaf counts only if it holds a smaller id
    than the kth. All queries take a step at a time, so that those at one leaf share one matrix product.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        norm, far = np.sqrt((q * q).sum(axis=1))[:, None], np.sqrt((tree["centre"] ** 2).sum(axis=1))[None, :]
        bound = q @ tree["centre"].T + norm * tree["radius"][None, :]
        bound += 1e-9 * (1 + norm * (far + tree["radius"][None, :]))  # beyond the rounding of terms that cancel out
    bound[np.isnan(bound)] = np.inf
    for n in range(1, bound.shape[1]):  # parents come first
        np.minimum(bound[:, n], bound[:, tree["parent"][n]], out=bound[:, n])
    leaves = np.flatnonzero(tree["leaf"])
    bound = np.floor(bound[:, leaves])
    rank = np.argsort(-bound, axis=1, kind="stable")
    alive = np.arange(len(q))
    for step in range(len(leaves)):
        at = rank[alive, step]
        best = bound[alive, at]
        alive = alive[best >= score[alive, -1]]
        at = rank[alive, step]
        tie = (bound[alive, at] == score[alive, -1]) & (tree["least"][leaves[at]] > vec[alive, -1])
        if not len(alive):
            break
        go, where = alive[~tie], at[~tie]
        by = np.argsort(where, kind="stable")
        for rows in np.split(by, np.flatnonzero(np.diff(where[by])) + 1) if len(by) else []:
            who, n = go[rows], leaves[where[rows[0]]]
            a, b = tree["a"][n], tree["b"][n]
            ids = tree["ids"][a:b]
            got = products(q[who], tree["x"][a:b])
            own = ids[None, :] == qid[who][:, None]
            got[own] = NONE
            k = score.shape[1]
            if b - a > 4 * k:  # ids ascend in a leaf: a stable sort breaks ties by id
                top = np.argsort(-got, axis=1, kind="stable")[:, :k]
                got, ids = np.take_along_axis(got, top, axis=1), ids[top]
            else:
                ids = np.broadcast_to(ids, got.shape)
            ids = np.where(got == NONE, np.iinfo(np.int64).max, ids)
            score[who], vec[who] = merge(score[who], vec[who], got, ids)


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, dim, x: components become floor(256 x), x as double; vectors null, empty or with null or non-finite
    components are left out, as are rows of null id."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    whole = lambda v: F.when(F.abs(v) < F.lit(2.0**53), F.floor(v).cast("double")).otherwise(v)
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = rows.where(F.col(vec_id).isNotNull() & (F.size(embedding) > 0) & ok)
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.size(embedding).alias("dim"), F.transform(x, lambda v: whole(v * 256)).alias("x"))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column(2)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), x.flatten().to_numpy(), x.offsets.to_numpy()


def ball_trees(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: the tree of at most ``shard_rows`` rows of one task (no shuffle), per dimension."""

    def run(batches):
        held: dict[int, list] = {}

        def flush(dim, parts):
            tree = build_tree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            return {"dim": dim, **{k: np.ascontiguousarray(_packed(v) if k == "x" else v).tobytes() for k, v in tree.items()}}

        def out(rows):
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("dim", pa.int32()), *((k, pa.binary()) for k in TREE)]))

        for b in batches:
            ids, dims, flat, offsets = _matrix(b)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                x = flat[(offsets[rows][:, None] + np.arange(dim)[None, :])]
                for a in range(0, len(rows), shard_rows):
                    part = held.setdefault(dim, [])
                    part.append((ids[rows[a : a + shard_rows]], x[a : a + shard_rows]))
                    if sum(len(p[0]) for p in part) >= shard_rows:
                        yield out([flush(dim, held.pop(dim))])
        for dim, part in held.items():
            yield out([flush(dim, part)])

    return vectors.mapInArrow(run, ", ".join(["dim int", *(f"{k} binary" for k in TREE)]))


TREE = {"ids": np.int64, "x": np.uint8, "centre": np.float64, "radius": np.float64, "parent": np.int64, "a": np.int64, "b": np.int64, "leaf": np.bool_, "least": np.int64}


def _search(trees: DataFrame, queries, floors, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each task's trees, in which each query's kth score is carried on from
    tree to tree and starts at ``floors`` (a bound that k other rows are known to reach)."""

    def run(batches):
        states: dict[int, list] = {}
        for b in batches:
            for row in b.to_pylist():
                dim = row["dim"]
                if dim not in queries.value:
                    continue
                qid, q = queries.value[dim]
                if dim not in states:
                    low = floors.value[dim] if floors else np.full(len(qid), NONE)
                    # a floor stands as k places that any row of that score takes
                    states[dim] = [np.repeat(low[:, None], k, axis=1), np.full((len(qid), k), np.iinfo(np.int64).max)]
                tree = {n: np.frombuffer(row[n], t) for n, t in TREE.items()}
                kind = np.int32 if len(tree["x"]) == 4 * dim * len(tree["ids"]) else np.float64  # as _packed() left them
                tree["x"], tree["centre"] = tree["x"].view(kind).reshape(-1, dim).astype(float), tree["centre"].reshape(-1, dim)
                search_tree(tree, q.astype(float), qid, *states[dim])
        for dim, (score, vec) in states.items():
            at, col = np.nonzero(vec != np.iinfo(np.int64).max)
            qid = queries.value[dim][0]
            yield pa.RecordBatch.from_arrays([pa.array(qid[at]), pa.array(vec[at, col]), pa.array(score[at, col])], names=["query_id", "vec_id", "score"])

    return trees.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by integer inner product (all, if fewer), ties to the
    smaller vec_id. ``vectors`` and ``queries`` come from integer_vectors().

    A row is no candidate for a query of its own id, nor for one of another dimension. Rows that repeat a vec_id are
    candidates each; a query id that repeats is searched once. Scores are exact at any magnitude; one that a long cannot
    hold raises an error if it is among the k best. Queries go in blocks of at most ``query_block`` (broadcast, some
    MB at most): per block, a first pass over one shard gives each query a floor for its kth score, which all tasks of
    the second pass share and raise as they go from shard to shard. Only k rows per query and task are shuffled.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    trees = written(ball_trees(vectors, shard_rows), "ball-trees")
    parts = trees.rdd.getNumPartitions()
    asked = queries.dropDuplicates(["vec_id"])
    n = asked.agg(F.count("*")).first()[0]
    blocks = max(1, -(-n // query_block))
    asked = written(asked.withColumn("block", F.expr(f"cast(pmod(xxhash64(vec_id), {blocks}) as int)")), "queries")
    found = None
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).toArrow()
        dims = rows.column("dim").to_numpy()
        ids, x = rows.column("vec_id").to_numpy(), rows.column("x")
        by_dim = {}
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            by_dim[dim] = (ids[at], _packed(np.array(x.take(pa.array(at)).to_pylist(), float)))
        shared, floors = sc.broadcast(by_dim), None
        if parts > 1 and by_dim:
            pilot = _search(trees.limit(1), shared, None, k).groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n"))
            low = {r[0]: r[1] for r in pilot.where(F.col("n") >= k).collect()}
            floors = sc.broadcast({dim: np.array([low.get(i, NONE) for i in qid.tolist()], np.int64) for dim, (qid, _) in by_dim.items()})
        got = _search(trees, shared, floors, k)
        found = got if found is None else found.unionAll(got)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    held = F.when((F.col("score") > LOW) & (F.col("score") < HIGH), F.col("score")).otherwise(F.raise_error(F.lit("an inner product exceeds the range of a long")).cast("long"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", held.alias("score"))


def op2_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all rows for each row whose vec_id is divisible by 50."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
