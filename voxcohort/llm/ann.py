"""Approximate nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is cut into equal parts by
recursive bisection (a spectral order, halved, then swaps that lower the cut). A small
network learns each vector's distribution of neighbours over the parts. Every row of
the table goes to its most probable part; a query goes to the parts that together
reach a probability, which is the least one that finds the wanted recall on sample
queries kept out of the fit, and to as many more as hold ``k`` rows. Within a part,
queries and rows meet in blocks of bounded size and are ranked by the exact measure.

Of equal vectors only the k + 1 smallest ids can be in a result, so no more are kept,
before anything is shuffled. The driver holds the sample, the network and a count per
part, all bounded by parameters. Nearness is the inner product in double precision.

Cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows without id or of another dimension than the most common one; of
rows with equal ids and vectors one counts, and of those with equal ids and different
vectors the nearest; ties go to smaller ids; tables smaller than k give all candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 20
SAMPLE = 6000              # rows used for fitting
TESTS = 600                # of these, queries that measure the recall
PARTS = 32
NEIGHBOURS = 10
HIDDEN, EPOCHS, BATCH = 128, 40, 256
RECALL = 0.96              # wanted on the sample
QUERIES, ROWS = 1024, 4096     # rows in a block


def _bisected(edges: np.ndarray, nodes: np.ndarray, parts: int, rng) -> np.ndarray:
    """Part of each node, all parts of equal size within one."""
    out = np.zeros(len(nodes), int)
    if parts == 1 or len(nodes) < 2:
        return out
    place = np.full(nodes.max() + 1, -1)
    place[nodes] = np.arange(len(nodes))
    inside = (np.isin(edges, nodes)).all(1)
    a, b = place[edges[inside]].T
    n = len(nodes)
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1.0
    v = rng.normal(size=n)
    for _ in range(60):      # second eigenvector of the lazy random walk
        v -= (v * degree).sum() / degree.sum()
        v = (2 * v + np.bincount(a, v[b], n) + np.bincount(b, v[a], n)) / (degree + 1)
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(n, int)
    side[np.argsort(v, kind="stable")[n // 2:]] = 1
    for _ in range(10):      # swap the nodes that gain most by changing sides, as many from each
        here = lambda s: np.bincount(a, side[b] == s, n) + np.bincount(b, side[a] == s, n)
        gain = np.where(side == 0, here(1) - here(0), here(0) - here(1))
        p, q = [np.flatnonzero(side == s)[np.argsort(-gain[side == s], kind="stable")] for s in (0, 1)]
        m = min(len(p), len(q), max(1, n // 50))
        m = int((gain[p[:m]] + gain[q[:m]] > 2).sum())
        if not m:
            break
        side[p[:m]], side[q[:m]] = 1, 0
    for s in (0, 1):
        out[side == s] = _bisected(edges, nodes[side == s], parts // 2, rng) + s * (parts // 2)
    return out


@dataclass
class Router:
    """A network of one hidden layer that gives the parts' probabilities."""

    layers: list[np.ndarray]
    mass: float
    dims: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _forward(_unit(x), self.layers)[1]


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forward(x, layers):
    hidden = np.maximum(x @ layers[0] + layers[1], 0)
    z = hidden @ layers[2] + layers[3]
    e = np.exp(z - z.max(1, keepdims=True))
    return hidden, e / e.sum(1, keepdims=True)


def _learned(x: np.ndarray, target: np.ndarray, rng) -> list[np.ndarray]:
    width = min(HIDDEN, 4 * x.shape[1])
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], width)) * 2, np.zeros(width), rng.normal(0, np.sqrt(1 / width), (width, target.shape[1])), np.zeros(target.shape[1])]
    m, s, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            i = order[at:at + BATCH]
            hidden, q = _forward(x[i], p)
            d = (q - target[i]) / len(i)
            back = (d @ p[2].T) * (hidden > 0)
            step += 1
            for k, g in enumerate((x[i].T @ back, back.sum(0), hidden.T @ d, d.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return p


def _nearest(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``x`` nearest to the rows ``queries`` of it, without themselves."""
    out = []
    for at in range(0, len(queries), 512):
        q = queries[at:at + 512]
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def fit(x: np.ndarray, parts: int = PARTS, k: int = K, recall: float = RECALL) -> Router:
    """Partition the sample's neighbour graph, learn to route, and choose the probability to reach."""
    rng = np.random.default_rng(11)
    x = x.astype(np.float64)
    parts = max(1, min(parts, 1 << int(np.log2(max(1, len(x) // 8)))))
    tests = rng.permutation(len(x))[:min(TESTS, len(x) // 4)]
    rest = np.setdiff1d(np.arange(len(x)), tests)
    if parts == 1 or len(rest) <= k:
        return Router([np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1.0, x.shape[1])
    near = _nearest(x, np.arange(len(x)), min(NEIGHBOURS, len(x) - 1))
    edges = np.stack([np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()], 1)
    part = _bisected(edges, np.arange(len(x)), parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (edges[:, 0], part[edges[:, 1]]), 1 / near.shape[1])
    target = 0.5 * target + 0.5 * np.eye(parts)[part]
    layers = _learned(_unit(x)[rest], target[rest], rng)
    p = _forward(_unit(x), layers)[1]
    home = p.argmax(1)
    true = _nearest(x, tests, min(k, len(x) - 1))
    order = np.argsort(-p[tests], axis=1)
    reach = np.cumsum(np.take_along_axis(p[tests], order, 1), 1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(tests), 0), 1)
    needed = np.take_along_axis(np.c_[np.zeros(len(tests)), reach], np.take_along_axis(rank, home[true], 1), 1)      # mass before a neighbour's part
    return Router(layers, float(np.nextafter(np.quantile(needed, recall, method="higher"), 2)), x.shape[1])


def _usable(vectors: DataFrame) -> DataFrame:
    v: Column = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v")) \
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v) for v in column]) if len(column) else np.zeros((0, 0))


def _ranked(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Exact k nearest of each query within two blocks."""
    if queries.empty or rows.empty:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    q, c, ids, out = _matrix(queries["qv"]), _matrix(rows["v"]), rows["vec_id"].to_numpy(), []
    s = q @ c.T
    for n, own in enumerate(queries["query_id"]):
        s[n, ids == own] = -np.inf
        m = min(k, len(ids))
        least = np.partition(s[n], len(ids) - m)[len(ids) - m]
        at = np.flatnonzero((s[n] >= least - 1e-9 * (1 + abs(least))) & np.isfinite(s[n]))
        exact = (q[n] * c[at]).sum(1)      # the same sum for equal vectors, wherever they stand
        best = at[(order := np.lexsort((ids[at], -exact)))[:k]]
        out.append(pd.DataFrame({"query_id": own, "vec_id": ids[best], "score": exact[order[:k]]}))
    return pd.concat(out)


def nearest(vectors: DataFrame, every: int = 20, k: int = K, parts: int = PARTS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: k nearest of the rows whose id is divisible by ``every``."""
    usable = _usable(vectors)
    fitted = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    result = "query_id long, rank int, vec_id long, score double"
    if fitted.empty:
        return vectors.sparkSession.createDataFrame([], result)
    router = fit(_matrix(fitted.sort_values("vec_id")["v"]), parts, k)

    @F.pandas_udf("array<double>")
    def probabilities(v: pd.Series) -> pd.Series:
        return pd.Series(list(router.probabilities(_matrix(v))))

    few = W.partitionBy("v").orderBy("vec_id")
    kept = usable.dropDuplicates(["vec_id", "v"]).withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1).drop("n")
    p = F.col("p")
    rows = kept.withColumn("p", probabilities("v")).withColumn("part", F.array_position(p, F.array_max(p)).cast("int") - 1).drop("p")
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}      # one row per part
    held = F.array(*[F.lit(sizes.get(n, 0)) for n in range(router.layers[3].shape[0])])
    ordered = F.sort_array(F.transform(p, lambda x, i: F.struct((-x).alias("p"), i.alias("part"))))
    step = lambda acc, x: F.struct((acc["mass"] - x["p"]).alias("mass"), (acc["rows"] + F.get(held, x["part"])).alias("rows"),
                                   F.when((acc["mass"] < router.mass) | (acc["rows"] < k + 1), F.concat(acc["go"], F.array(x["part"]))).otherwise(acc["go"]).alias("go"))
    routes = F.aggregate(ordered, F.struct(F.lit(0.0).alias("mass"), F.lit(0).cast("long").alias("rows"), F.array().cast("array<int>").alias("go")), step, lambda acc: acc["go"])
    queries = usable.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).withColumn("p", probabilities("v")) \
        .select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.explode(routes).alias("part"))
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    blocks = lambda counts, size: F.get(F.array(*[F.lit(max(1, -(-counts.get(n, 0) // size))) for n in range(router.layers[3].shape[0])]), F.col("part"))
    block = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    q_blocks, r_blocks = blocks(asked, QUERIES), blocks(sizes, ROWS)
    left = queries.withColumn("x", block("query_id", q_blocks)).withColumn("y", all_of(r_blocks))
    right = rows.withColumn("y", block("vec_id", r_blocks)).withColumn("x", all_of(q_blocks)).select(
        F.col("part").alias("rp"), F.col("x").alias("rx"), F.col("y").alias("ry"), "vec_id", "v")
    found = left.groupBy("part", "x", "y").cogroup(right.groupBy("rp", "rx", "ry")).applyInPandas(
        lambda a, b: _ranked(a, b, k), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best).cast("int")) \
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
