"""SimHash near-dedup by generalised pigeonhole search in Hamming space.

If the thresholds of m bit partitions satisfy sum(t_i + 1) = t + 1 (with t_i = -1: not probed), any two fingerprints
within t bits are within t_i bits on some partition i. Correlated bits share a partition, thresholds are allocated by
dynamic programming on candidate counts estimated from a bounded sample, and the number of partitions is the cheapest.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import byte_column, cut, table, written
from trailmark.operators.components import connected_components

BITS = 64
#: Fingerprints that the search plan is fitted on (those of smallest hash); every fingerprint is indexed.
SAMPLE = 4096
#: Cost of a candidate pair against that of a key row, as measured here.
PAIR_COST = 0.02
#: Keys with more fingerprints than this are linked by way of midpoints instead of pairs (thresholds of 2 or less).
HOT = 1024
#: A partition's neighbourhood may have so many points at most, and a plan counts as if for so many fingerprints at least.
MOST_POINTS, LEAST_NODES = 2048, 1024
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle of the lower-cased text, repeats included; the whole sequence if shorter."""
    words = text.translate(LOWER).split() if text else []
    n, h = len(words), xxhash.xxh64_intdigest
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= k:
        return np.array([h(joined, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, n) + 1
    end = np.cumsum(size)
    starts, ends = (end - size)[: n - k + 1].tolist(), (end - 1)[k - 1 :].tolist()
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, n - k + 1)


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """Bit i is 1 if it is set in over half of the hashes; zero for none."""
    if not len(hashes):
        return np.uint64(0)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[a : a + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)[0]


def fingerprints(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), words (digest of the lower-cased word sequence), n_shingles."""

    def run(batches):
        for b in batches:
            fps, digests, sizes = [], [], []
            for x in byte_column(b, "text"):
                h = shingle_hashes(x, k)
                fps.append(fingerprint(h))
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(b" ".join(x.translate(LOWER).split()) if x else b""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "fp", "words", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long, words binary, n_shingles long")


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Bit positions in ``parts`` groups of near equal size: each grows by the bit most correlated with it."""
    x = bits - bits.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0))
    corr = np.abs((x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for p in range(parts):
        size = BITS // parts + (p < BITS % parts)
        left = sorted(free)
        group = [left[int(corr[np.ix_(left, left)].sum(axis=1).argmax())]]
        free.discard(group[0])
        while len(group) < size:
            left = sorted(free)
            group.append(left[int(corr[np.ix_(left, group)].sum(axis=1).argmax())])
            free.discard(group[-1])
        out.append(sorted(group))
    return out


def ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def allocate(cost: list[list[float]], threshold: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = threshold + 1 of least total cost; cost[i][t] for t >= 0."""
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * (threshold + 1)
    for c in cost:
        best = [
            min(((best[s - u][0] + (c[u - 1] if u else 0.0), [*best[s - u][1], u - 1]) for u in range(min(s, len(c)) + 1)), key=lambda x: x[0])
            for s in range(threshold + 2)
        ]
    return best[threshold + 1]


def search_plan(sample: np.ndarray, n: int, threshold: int) -> list[tuple[list[int], int]]:
    """(bit positions, threshold) of each partition to probe, for n fingerprints of which ``sample`` is known."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((1, BITS))
    options = []
    for parts in range(1, threshold + 3):
        costs, groups = [], group_bits(bits, parts)
        for g in groups:
            x = bits[:2048, g]
            ones = x.sum(axis=1)
            d = ones[:, None] + ones[None, :] - 2 * (x @ x.T)
            d = d[np.triu_indices(len(x), 1)]
            row = []
            for t in range(threshold + 1):
                chance = max((d <= t).mean() if len(d) else 0.0, ball(len(g), t) / 2 ** len(g))
                points = ball(len(g), -(-t // 2))
                row.append(max(n, LEAST_NODES) * points + PAIR_COST * n * n / 2 * chance if points <= MOST_POINTS else float("inf"))
            costs.append(row)
        total, thresholds = allocate(costs, threshold)
        options.append((total, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def flips(bits: list[int], radius: int) -> list[int]:
    """The signed longs that flip up to ``radius`` of these bits."""
    out = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def key_rows(nodes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """part, key, and all columns of nodes: a row per partition and point within half its threshold (rounded up), so
    that two nodes within the threshold on a partition share a key."""
    long = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("long")

    def one(p: int, bits: list[int], t: int):
        base = F.col("fp").bitwiseAND(long(sum(1 << b for b in bits)))
        near = F.array(*[F.lit(x).cast("long") for x in flips(bits, -(-t // 2))])
        return F.transform(near, lambda x: F.struct(F.lit(p).alias("part"), base.bitwiseXOR(x).alias("key")))

    arrays = [one(p, bits, t) for p, (bits, t) in enumerate(plan)]
    return nodes.withColumn("_k", F.explode(F.concat(*arrays))).select("_k.part", "_k.key", *nodes.columns)


def fit_plan(nodes: DataFrame, threshold: int) -> list[tuple[list[int], int]]:
    """The search plan for nodes (node, fp, ...), from a bounded sample of them."""
    n = nodes.agg(F.count("*")).first()[0]
    rows = nodes.orderBy(F.xxhash64("fp", "node"), "node").limit(SAMPLE).select("fp").toArrow()
    return search_plan(rows.column("fp").to_numpy().astype(np.int64).view(np.uint64), n, threshold)


def share_key(rows: DataFrame, columns: list[str], threshold: int, also=None) -> DataFrame:
    """a, b (node a < node b): nodes that share a key and lie within ``threshold`` bits, once each."""
    side = lambda s: rows.select("part", "key", *[F.col(c).alias(f"{c}_{s}") for c in columns]).alias(s)
    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= threshold
    on = (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & (F.col("node_a") < F.col("node_b")) & near
    return side("a").join(side("b"), on if also is None else on & also).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def close_pairs(nodes: DataFrame, threshold: int, hot: int = HOT) -> DataFrame:
    """a, b: links between nodes (node, fp; distinct nodes) within ``threshold`` bits.

    Every such pair is returned, but (at threshold 2) for keys that more than ``hot`` nodes share: those nodes each link
    to the least node of every point one bit away from them, which connects exactly the same nodes in 65 rows a node. At
    other thresholds all pairs are probed; adaptive execution splits the hot keys.
    """
    index = key_rows(nodes, fit_plan(nodes, threshold))
    if threshold != 2:
        return share_key(index, nodes.columns, threshold)
    many = cut(index.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("part", "key"))
    if many.isEmpty():
        return share_key(index, nodes.columns, threshold)
    pairs = share_key(index.join(many, ["part", "key"], "left_anti"), nodes.columns, threshold)
    members = index.join(many, ["part", "key"], "left_semi").select("node", "fp").distinct()
    one = F.array(*[F.lit(x).cast("long") for x in flips(list(range(BITS)), 1)])
    points = members.select("node", F.explode(F.transform(one, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    least = points.groupBy("point").agg(F.min("node").alias("a"))
    return pairs.unionAll(points.join(least, "point").where("a != node").select("a", F.col("node").alias("b")).distinct())


def simhash_components(docs: DataFrame, shingle: int = 3, threshold: int = 2, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id: documents linked by fingerprints at most ``threshold`` bits apart.

    A-Z are lower-cased; words are runs of characters other than space and the controls 9 to 13. Null and wordless texts
    have fingerprint 0, which links like any other. component_id is the smallest doc_id reachable (null only where all
    are null). Repeated rows repeat in the result. Documents of equal fingerprint are one node, so copies cost nothing.
    """
    fps = written(fingerprints(docs, shingle).select("doc_id", "fp"), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    links = close_pairs(nodes.select(F.col("fp").alias("node"), "fp"), threshold, hot)
    comps = connected_components(links, "a", "b").withColumnRenamed("node", "fp")
    named = nodes.join(comps, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: 3-word shingles, links at 2 or fewer differing bits."""
    got = simhash_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
