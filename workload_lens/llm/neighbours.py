"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into parts of equal size by recursive spectral bisection. A small
network learns to tell a vector's part, and so extends the parts to all vectors. Every vector is stored in its most
probable part; a query is sent to its several most probable parts, where it is compared with every vector: to as many
as the network expects to hold a given share of its neighbours, few if the vectors have structure, many if not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors that parts are learned from (the bound of what the driver gets), vectors of a part, and most parts.
SAMPLE, PART_SIZE, MAX_PARTS = 8192, 256, 32
#: Neighbours of a vector in the graph, and the share of a query's neighbours that the parts it is sent to should hold.
GRAPH, COVER = 10, 0.95
#: Units of the network, passes, vectors of a step and weight decay.
UNITS, PASSES, BATCH, DECAY = 128, 15, 256, 1e-3
#: Vectors of a part, and queries, that are compared in one task at a time.
BLOCK, QUERIES = 8192, 1024
#: Nearest vectors of a query.
NEAREST = 10


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    value = vector.cast("array<double>")
    odd = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(value, lambda x: x != 0)


def neighbour_graph(vectors: np.ndarray, k: int = GRAPH) -> np.ndarray:
    """Links (from, to) to the k nearest other vectors of the sample."""
    n = len(vectors)
    k = min(k, n - 1)
    norm, out = (vectors * vectors).sum(axis=1), []
    for at in range(0, n, 512):
        far = norm - 2 * vectors[at : at + 512] @ vectors.T
        far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        out.append(np.stack([np.repeat(np.arange(at, at + len(far)), k), near.ravel()], axis=1))
    return np.concatenate(out)


def balanced_parts(links: np.ndarray, n: int, parts: int, seed: int = 5) -> np.ndarray:
    """Part of each node: halves along the second eigenvector of the graph, halved again until there are enough.

    ``parts`` is a power of two; parts differ by one node at most for each level.
    """
    label, make = np.zeros(n, np.int64), np.random.default_rng(seed)
    both = np.concatenate([links, links[:, ::-1]])
    for _ in range(parts.bit_length() - 1):
        inside = both[label[both[:, 0]] == label[both[:, 1]]]
        degree = np.bincount(inside[:, 0], minlength=n) + 1.0
        size = np.bincount(label)
        weight = np.bincount(label, degree)
        value = make.normal(size=n)
        for _ in range(150):  # all parts of a level at once: no link leaves a part
            value -= (np.bincount(label, value * degree) / weight)[label]
            value = 0.5 * value + 0.5 * (value + np.bincount(inside[:, 0], value[inside[:, 1]], minlength=n)) / degree
            value /= np.sqrt(np.bincount(label, value * value) / size + 1e-300)[label]
        order = np.lexsort((value, label))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.concatenate([[0], np.cumsum(size)[:-1]])[label[order]]
        label = 2 * label + (rank >= (size // 2)[label])
    return label


class Router:
    """A network with one hidden layer that gives the probabilities of parts.

    It learns for each vector of the sample the shares of parts among the vector itself and its neighbours.
    """

    def __init__(self, vectors: np.ndarray, label: np.ndarray, links: np.ndarray, parts: int, seed: int = 5):
        make = np.random.default_rng(seed)
        self.parts, self.mean, self.scale = parts, vectors.mean(axis=0), vectors.std() + 1e-12
        x = (vectors - self.mean) / self.scale
        d = x.shape[1]
        self.w = [make.normal(0, d**-0.5, (d, UNITS)), np.zeros(UNITS), make.normal(0, UNITS**-0.5, (UNITS, parts)), np.zeros(parts)]
        share = np.zeros((len(x), parts))
        np.add.at(share, (links[:, 0], label[links[:, 1]]), 1.0)
        share[np.arange(len(x)), label] += 1
        share /= share.sum(axis=1, keepdims=True)
        first, second, step = [np.zeros_like(v) for v in self.w], [np.zeros_like(v) for v in self.w], 0
        for _ in range(PASSES if parts > 1 else 0):
            order = make.permutation(len(x))
            for at in range(0, len(x), BATCH):
                part = order[at : at + BATCH]
                hidden, probable = self._forward(x[part])
                probable = (probable - share[part]) / len(part)
                back = (probable @ self.w[2].T) * (hidden > 0)
                step += 1
                for i, g in enumerate((x[part].T @ back, back.sum(axis=0), hidden.T @ probable, probable.sum(axis=0))):
                    g = g + DECAY * self.w[i]
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    self.w[i] -= 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(x @ self.w[0] + self.w[1], 0)
        out = hidden @ self.w[2] + self.w[3]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return hidden, out / out.sum(axis=1, keepdims=True)

    def probable_parts(self, vectors: np.ndarray, cover: float) -> list[np.ndarray]:
        """For each vector its most probable parts, the most probable first, until their probabilities add up to ``cover``."""
        share = self._forward((vectors - self.mean) / self.scale)[1]
        order = np.argsort(-share, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(share, order, axis=1), axis=1)
        n = 1 + (before < cover).sum(axis=1)
        return [row[:k] for row, k in zip(order, n, strict=True)]


def learn(vectors: DataFrame, sample: int = SAMPLE) -> Router | None:
    """Parts from at most ``sample`` vectors, the first by a hash; None if there is no vector."""
    rows = vectors.select("vec_id", "vector").orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "vector").limit(sample).collect()
    if not rows:
        return None
    x = np.array([r["vector"] for r in rows])
    parts = 1
    while parts * 2 <= MAX_PARTS and parts * 2 * PART_SIZE <= len(x):
        parts *= 2
    links = neighbour_graph(x) if parts > 1 else np.zeros((0, 2), np.int64)
    return Router(x, balanced_parts(links, len(x), parts), links, parts)


def _routed(vectors: DataFrame, router: Router, cover: float) -> DataFrame:
    """Vectors with the array of their most probable parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                parts = router.probable_parts(x, cover)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], ["vec_id", "vector", "parts"])

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<double>, parts array<int>")


_FOUND = "query_id long, query_key long, vec_id long, score double"


def _compared(key: tuple, base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The nearest vectors of a block for each query, by exact distances of all that could be among them."""
    out: list[pd.DataFrame] = []
    if len(base) and len(queries):
        ids, x = base["vec_id"].to_numpy(), np.stack(base["vector"].to_numpy()).astype(np.float64)
        q_ids, q_keys = queries["q_vec_id"].to_numpy(), queries["q_query_key"].to_numpy()
        q = np.stack(queries["q_vector"].to_numpy()).astype(np.float64)
        norm = (x * x).sum(axis=1)
        for at in range(0, len(q), 128):
            block = q[at : at + 128]
            own = (block * block).sum(axis=1)
            rough = norm + own[:, None] - 2 * block @ x.T
            rough[ids == q_ids[at : at + 128, None]] = np.inf
            k = min(NEAREST, len(x)) - 1
            limit = np.partition(rough, k, axis=1)[:, k] + 1e-9 * (own + norm.max() + 1)
            for i in range(len(block)):
                near = np.flatnonzero((rough[i] <= limit[i]) & np.isfinite(rough[i]))
                score = np.sqrt(((x[near] - block[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], score))[:NEAREST]
                out.append(pd.DataFrame({"query_id": q_ids[at + i], "query_key": q_keys[at + i], "vec_id": ids[near[best]], "score": score[best]}))
    empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "query_key": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    return pd.concat(out, ignore_index=True) if out else empty


def _searched(routed: DataFrame, queries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every query against all vectors of its parts. A part is dealt in blocks of rows, and its queries in blocks too.

    queries: vec_id, query_key, vector, parts. sizes has a row for each part, MAX_PARTS at most.
    """
    wanted = queries.select("vec_id", "query_key", "vector", F.explode("parts").alias("part"))
    counts = wanted.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    dealt = F.broadcast(sizes.join(counts, "part"))
    base = (
        routed.select("vec_id", "vector", F.col("parts")[0].alias("part"))
        .join(dealt, "part")
        .withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int"))
        .select("vec_id", "vector", "part", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    )
    asked = (
        wanted.join(dealt, "part")
        .withColumn("group", F.pmod(F.xxhash64("query_key"), F.col("groups")).cast("int"))
        .select(
            *[F.col(c).alias(f"q_{c}") for c in ("vec_id", "query_key", "vector", "part", "group")],
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q_block"),
        )
    )
    one, two = base.groupBy("part", "block", "group"), asked.groupBy("q_part", "q_block", "q_group")
    return one.cogroup(two).applyInPandas(_compared, _FOUND)


def nearest(vectors: DataFrame, cover: float = COVER, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id and score of the NEAREST nearest vectors found for each vector whose id is divisible by ``every``.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids, nor vectors of
    another length than most have (of equally frequent ones the smallest). Equal rows count once, and rows that share
    the query's id are its own. Ties go to the smaller vec_id. A query for which the parts hold too few vectors is
    searched for in all parts.
    """
    vector = F.col("embedding").cast("array<double>").alias("vector")
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), vector)
    common = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    good = good.where(F.size("vector") == (common[0]["n"] if common else 0)).distinct()
    router = learn(good)
    if router is None:
        return good.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    routed = stored(_routed(good, router, cover))
    sizes = stored(routed.groupBy(F.col("parts")[0].alias("part")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    queries = routed.where(F.col("vec_id") % every == 0).withColumn("query_key", F.xxhash64("vec_id", "vector"))
    found = stored(_searched(routed, queries, sizes))
    total = routed.select("vec_id").distinct().limit(NEAREST + 1).count() - 1
    enough = found.groupBy("query_key").agg(F.count("*").alias("n")).where(F.col("n") >= min(NEAREST, total))
    everywhere = F.array(*[F.lit(i) for i in range(router.parts)])
    short = queries.join(enough, "query_key", "left_anti").withColumn("parts", everywhere)
    if not short.isEmpty():
        found = found.join(enough, "query_key", "left_semi").unionByName(_searched(routed, short, sizes))
    order = Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEAREST)
    return ranked.select("query_id", "rank", "vec_id", "score")
