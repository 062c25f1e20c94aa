"""Approximate nearest neighbours over learned, balanced partitions."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pitval.session import cut

from .common import first_rows, table

SAMPLE_ROWS = 16_384
PART_ROWS = 1_024
MAX_PARTS = 256
BLOCK_ROWS = 4_096
GRAPH = 10
GOAL = 0.97


@dataclass(frozen=True)
class Router:
    """A softmax over partitions, and how many of the most probable ones a query asks."""
    shift: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift) @ self.weights + self.bias

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of every row, in blocks."""
    out, norm = np.empty((len(x), k), np.int64), (x * x).sum(1)
    for lo in range(0, len(x), 1024):
        d = norm[None, :] - 2 * x[lo:lo + 1024] @ x.T
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out[lo:lo + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, passes: int = 8) -> np.ndarray:
    """Partition numbers that cut few edges of the graph, none above its even share plus ``slack``.

    Starts from halves along the main direction, again and again, which is balanced;
    then rows move to the partition most of their neighbours are in, largest gain first,
    while there is room.
    """
    label = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for g in groups:
            y = x[g] - x[g].mean(0)
            axis = np.linalg.eigh(y.T @ y)[1][:, -1]
            order = np.argsort(y @ axis, kind="stable")
            halves += [g[order[:len(g) // 2]], g[order[len(g) // 2:]]]
        groups = halves
    for i, g in enumerate(groups):
        label[g] = i
    size, most = np.bincount(label, minlength=parts), int(np.ceil(len(x) / parts * (1 + slack)))
    least = int(len(x) / parts * (1 - slack))
    a = np.r_[np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()]
    b = np.r_[graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])]
    for _ in range(passes):
        votes = np.bincount(a * parts + label[b], minlength=len(x) * parts).reshape(len(x), parts)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most and size[label[i]] > least:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def fit(x: np.ndarray, parts: int, goal: float = GOAL, steps: int = 150) -> Router:
    """Learn the router on sampled rows: partition their neighbour graph, then fit a softmax to it.

    ``probes`` is the smallest number of partitions that hold ``goal`` of the sampled
    rows' true neighbours.
    """
    x = np.ascontiguousarray(x, np.float64)
    if parts <= 1 or len(x) <= GRAPH + 1:
        return Router(np.zeros(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, GRAPH)
    label = balanced_partition(x, graph, parts)
    shift, scale = x.mean(0), x.std() or 1.0
    y, hot = (x - shift) / scale, np.zeros((len(x), parts))
    hot[np.arange(len(x)), label] = 1.0
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = y @ w + b
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        for k, (p, g) in enumerate(((w, y.T @ (z - hot) / len(y)), (b, (z - hot).mean(0)))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    router = Router(shift, w / scale, b, 1)
    order = router.nearest(x, parts)
    rank = np.empty_like(order)
    rank[np.arange(len(x))[:, None], order] = np.arange(parts)
    needed = rank[np.repeat(np.arange(len(x)), GRAPH), order[:, 0][graph.ravel()]]
    return Router(shift, w / scale, b, int(np.quantile(needed, goal, method="higher")) + 1)


def _usable(vector: str) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0)


def _route(router: Router, vector: str, n: int) -> Column:
    @F.arrow_udf("array<int>")
    def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.array(batch.to_pylist(), np.float64).reshape(len(batch), -1)
            yield pa.array(router.nearest(x, n).tolist() if len(batch) else [], pa.list_(pa.int32()))

    return parts(F.col(vector))


def _rank(asked: pd.DataFrame, stored: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest stored rows of each query of one block."""
    out = []
    if len(asked) and len(stored):
        stored = stored.drop_duplicates("id").sort_values("id")
        ids, y = stored["id"].to_numpy(), np.stack(stored["vector"].to_numpy()).astype(np.float64)
        for q, v in asked.drop_duplicates("query")[["query", "point"]].itertuples(index=False):
            d = np.sqrt(((y - np.asarray(v, np.float64)) ** 2).sum(1))
            d[ids == q] = np.inf
            n = min(k, int(np.isfinite(d).sum()))
            if n:
                edge = np.partition(d, n - 1)[n - 1]
                near = np.flatnonzero(d <= edge)
                near = near[np.lexsort((ids[near], d[near]))][:n]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[near], "score": d[near]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})


def search(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10,
           sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS, goal: float = GOAL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of every row that meets ``queries``.

    The router is fitted on at most ``sample_rows`` rows (smallest key hash) with a
    partition for every ``part_rows`` rows, ``max_parts`` at most. Every row is stored in
    its most probable partition; a query asks its most probable ones and all candidates
    there are ranked by their exact Euclidean distance in double precision, ties to
    the smaller key. A partition is worked on in hashed blocks of about 4,096 rows, so
    many equal vectors in one partition spread over tasks and no block grows.

    Vectors that are null, empty, zero, of another length than most sampled ones, or
    hold a null or non-finite component take no part; rows with a null key neither.
    Rows repeating a key count once. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    good = vectors.where(_usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asks"))
    sample = first_rows(good.select("id", "vector"), "id", sample_rows).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample:
        return empty
    lengths = [len(r["vector"]) for r in sample]
    width = max(set(lengths), key=lambda n: (lengths.count(n), -n))
    x = np.array([r["vector"] for r in sample if len(r["vector"]) == width], np.float64)
    good = good.where(F.size("vector") == width)
    wanted = max(1, min(max_parts, len(x) // 64, good.count() // part_rows))
    parts = 1 << (wanted.bit_length() - 1)
    router = fit(x, parts, goal)
    stored = cut(good.withColumn("part", F.get(_route(router, "vector", 1), F.lit(0))))
    counts = stored.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    blocks = F.broadcast(counts)  # one row per partition, so at most max_parts
    rows = stored.select("id", "vector", "part").join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    routed = stored.where("asks").select(F.col("id").alias("query"), F.col("vector").alias("point"), F.explode(_route(router, "vector", router.probes)).alias("part"))
    asked = routed.join(blocks, "part").select("query", "point", F.col("part").alias("in_part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("in_block"))
    near = (asked.groupBy("in_part", "in_block").cogroup(rows.select("id", "vector", "part", "block").groupBy("part", "block"))
            .applyInPandas(lambda a, b: _rank(a, b, k), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
