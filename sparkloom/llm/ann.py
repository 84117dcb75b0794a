"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives every vector a string of ``BITS`` signs of random projections.
A tree is the array of these strings in order; all vectors whose strings share a
prefix are neighbours in it. A query descends in each tree to the longest prefix
it shares with anything, and then ascends in all trees together, one bit at a
time, until the vectors under its prefixes number enough; these candidates are
ranked by their exact inner product in double precision. Vectors get one more
coordinate (sqrt(M^2 - |x|^2), M the largest norm) so that the largest inner
product is the smallest angle.

The index is sharded: rows are dealt evenly to shards of about ``shard_rows``
vectors, each with a forest of its own, and every shard answers every query.
How many candidates are enough is calibrated per shard: for ``sample`` of its
queries the true neighbours are computed, and the smallest number of a ladder
with a recall of ``recall`` is taken (the last step is every vector). Queries
reach the shards in blocks of at most ``block`` (bounded broadcasts).

Edge cases: null and zero vectors, vectors with null or non-finite components,
or of another length than most, take no part; null ids take no part either; rows
with one id are one query and one candidate, whose score is the largest of theirs
(repeated rows change nothing); fewer candidates than k give them all; empty tables
give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, table

BITS = 32


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (array of doubles) of the rows that take part."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(finite & F.exists("v", lambda x: x != 0))
    most = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return v.filter(F.size("v") == (most.d if most else 0))


class Forest:
    """Trees over the rows of ``x``."""

    def __init__(self, x: np.ndarray, trees: int, seed: int = 17):
        norms = np.linalg.norm(x, axis=1)
        lifted = np.column_stack((x, np.sqrt(np.maximum(norms.max() ** 2 - norms**2, 0))))
        self.planes = np.random.default_rng(seed).standard_normal((trees, BITS, x.shape[1] + 1))
        self.order, self.keys = [], []
        for p in self.planes:
            h = self.strings(lifted, p)
            order = np.argsort(h, kind="stable")
            self.order.append(order)
            self.keys.append(h[order])

    @staticmethod
    def strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        """The sign strings as numbers, first projection in the highest bit."""
        return ((x @ planes.T) > 0) @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every prefix length and tree, the part of the sorted array that shares it with each query: [length, tree, query]."""
        lifted = np.column_stack((q, np.zeros(len(q))))
        lo = np.empty((BITS + 1, len(self.keys), len(q)), np.int64)
        hi = np.empty_like(lo)
        for t, (keys, planes) in enumerate(zip(self.keys, self.planes)):
            h = self.strings(lifted, planes)
            for length in range(BITS + 1):
                low = (h >> np.uint64(BITS - length)) << np.uint64(BITS - length)
                lo[length, t] = np.searchsorted(keys, low, "left")
                hi[length, t] = np.searchsorted(keys, low + (np.uint64(1) << np.uint64(BITS - length)), "left")
        return lo, hi

    def candidates(self, lo: np.ndarray, hi: np.ndarray, enough: int) -> list[np.ndarray]:
        """Row numbers under each query's prefixes after the synchronous ascent."""
        total = (hi - lo).sum(1)
        length = (BITS - np.argmax(total[::-1] >= min(enough, total[0].min()), axis=0)).astype(int)  # the longest prefix with enough
        return [np.unique(np.concatenate([o[lo[k, t, i] : hi[k, t, i]] for t, o in enumerate(self.order)])) for i, k in enumerate(length)]


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, as a sum over an array is."""
    return np.add.accumulate(x * q, axis=1)[:, -1]


def search_shard(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, trees: int, recall: float, sample: int):
    """``query_id, vec_id, score`` of the best k candidates of this shard for every query."""
    forest = Forest(x, trees)
    sample_at = np.linspace(0, len(q) - 1, min(sample, len(q))).astype(int)
    exact = [set(top(s := np.where(ids == q_ids[i], -np.inf, x @ q[i]), ids, k).tolist()) for i in sample_at]
    lo, hi = forest.ranges(q[sample_at])
    copies = int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 1
    enough = 8 * k * copies
    while enough < trees * len(x):
        found = forest.candidates(lo, hi, enough)
        if np.mean([len(e.intersection(c.tolist())) / max(len(e), 1) for e, c in zip(exact, found)]) >= recall:
            break
        enough *= 2
    for at in range(0, len(q), 256):
        lo, hi = forest.ranges(q[at : at + 256])
        for i, c in enumerate(forest.candidates(lo, hi, enough), at):
            c = c[ids[c] != q_ids[i]]
            rough = x[c] @ q[i]
            most = k * copies  # rows of one id count once
            if len(c) > 4 * most:  # a margin for rounding, then the exact measure
                c = c[rough >= np.partition(rough, len(c) - most)[len(c) - most] - 1e-9 * (1 + np.abs(rough).max())]
            s = inner(x[c], q[i])
            best = top(s, ids[c], most)
            if copies > 1:
                best = best[np.sort(np.unique(ids[c[best]], return_index=True)[1])[:k]]
            yield np.full(len(best), q_ids[i]), ids[c[best]], s[best]


def search(vectors: DataFrame, is_query, k: int = 20, trees: int = 10, shard_rows: int = 16_384, block: int = 65_536, recall: float = 0.95, sample: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of each row for which ``is_query`` holds."""
    sc = vectors.sparkSession.sparkContext
    v = valid(vectors)
    n_shards = max(1, -(-v.count() // shard_rows))
    rows = cut(v.repartition(n_shards))  # dealt once, read by every block of queries
    queries = rows.filter(is_query).distinct()
    n_blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(n_blocks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toPandas()  # about `block` rows
        held = sc.broadcast((part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_list()) if len(part) else np.zeros((0, 1))))

        def run(batches, held=held):
            ids, x = [], []
            for rb in batches:
                ids.append(rb.column(0).to_numpy())
                x.append(rb.column(1).flatten().to_numpy().reshape(rb.num_rows, -1))
            q_ids, q = held.value
            if not ids or not len(q_ids):
                return
            for found in _grouped(search_shard(np.concatenate(ids).astype(np.int64), np.concatenate(x), q_ids, q, k, trees, recall, sample)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

        got = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
        out = got if out is None else out.union(got)
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _grouped(found, size: int = 512):
    held = []
    for f in found:
        held.append(f)
        if len(held) == size:
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def op9_prefix_forest(spark, sf_dir: str) -> DataFrame:
    """Contract query: the 20 nearest found of every 20th vector."""
    return search(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"))
