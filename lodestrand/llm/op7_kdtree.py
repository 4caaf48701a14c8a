"""Exact top-k by inner product with one KD-tree a shard.

Vectors are dealt to shards of about ``SHARD`` rows by a hash of their id, so no value of any column
makes a shard large. Each shard becomes a KD-tree: nodes split at the median of the dimension in
which their tight bounding box is widest, down to leaves of ``LEAF`` vectors; the trees are a
written table. A query block visits a shard's tree best first: a box can hold no score above
sum(max(q * low, q * high)), so the search ends at the first box that cannot beat the k-th score
so far. That k-th score is propagated: every block first searches one shard, and what it finds
there is where the search of all other shards starts.

Queries are a stated set, cut into blocks of ``BLOCK``; a block meets each shard once.

Components become floor(256 * x). Scores are exact integers: sums beyond 2**53 are made with
Python's whole numbers, and end at the limits of a long. Vectors are compared with those of the same length only. Vectors that are
null, empty or hold null or non-finite components take no part, nor do rows whose id is null;
rows that repeat an id and its vector count once; no row with a query's id is its candidate.
Ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exchange import to_batch
from .storage import Scratch

SHARD, LEAF, BLOCK = 8192, 64, 1024
PACKED = "dim int, part int, ids binary, vectors binary"
HITS = "query_id long, vec_id long, score long"


def scaled(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v, dim): usable vectors as whole numbers in doubles."""
    v = F.col(vector)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(usable, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), F.transform(v, lambda x: F.rint(F.lit(256.0) * x.cast("double") - F.pmod(F.lit(256.0) * x.cast("double"), F.lit(1.0)))).alias("v"), F.size(v).alias("dim"))


def packed(rows: DataFrame, parts: int) -> DataFrame:
    """One row for each (dim, part): the ids and the matrix of its vectors."""

    def pack(t: pa.Table) -> pa.Table:
        v = np.concatenate([np.asarray(c.flatten()) for c in t.column("v").chunks])
        ids = np.asarray(t.column("id"))
        order = np.argsort(ids, kind="stable")
        return pa.Table.from_batches([to_batch([(t.column("dim")[0].as_py(), t.column("part")[0].as_py(), ids[order].tobytes(), v.reshape(len(ids), -1)[order].tobytes())], PACKED)])

    return rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).groupBy("dim", "part").applyInArrow(pack, PACKED)


class Tree:
    """Nodes in heap order of their making: box, children or the rows of a leaf."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.low, self.high, self.child, self.rows = [], [], [], []
        self.vectors, self.ids = vectors, ids
        self._split(np.arange(len(ids)))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.least = np.array([r.min() if len(r) else 0 for r in (ids[rows] for rows in self.rows)])

    def _split(self, root: np.ndarray) -> None:
        queue = [root]
        for at in queue:
            box = self.vectors[at]
            low, high = box.min(axis=0), box.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.rows.append(at)
            wide = int((high - low).argmax())
            if len(at) <= LEAF or high[wide] == low[wide]:
                self.child.append(None)
                continue
            order = at[np.argsort(box[:, wide], kind="stable")]
            half = len(order) // 2
            self.child.append((len(queue), len(queue) + 1))
            queue += [order[:half], order[half:]]

    def bytes(self) -> bytes:
        child = np.array([c or (0, 0) for c in self.child], np.int64)
        leaves = [r if c is None else r[:0] for r, c in zip(self.rows, self.child, strict=True)]
        size = np.array([len(x) for x in leaves], np.int64)
        head = np.array([len(child), self.vectors.shape[1], len(self.ids)], np.int64)
        order = np.concatenate(leaves)
        return b"".join(x.tobytes() for x in (head, child, size, self.low, self.high, self.least, self.ids[order], self.vectors[order]))


class Search:
    """A stored tree, read for searching."""

    def __init__(self, data: bytes):
        nodes, dim, n = np.frombuffer(data, np.int64, 3)
        at = 24

        def take(count: int, kind, *shape):
            nonlocal at
            out = np.frombuffer(data, kind, count, at).reshape(*shape) if shape else np.frombuffer(data, kind, count, at)
            at += count * 8
            return out

        self.child = take(nodes * 2, np.int64, nodes, 2)
        size = take(nodes, np.int64)
        self.low, self.high = take(nodes * dim, np.float64, nodes, dim), take(nodes * dim, np.float64, nodes, dim)
        self.least = take(nodes, np.int64)
        self.ids, self.vectors = take(n, np.int64), take(n * dim, np.float64, n, dim)
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.large = max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0))

    def best(self, query: np.ndarray, own: int, bound: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, -id) of this tree that reach ``floor``; bound: each box's highest score."""
        top: list[tuple[int, int]] = []
        exact = self.large * np.abs(query).max(initial=0) * len(query) < 2**53
        slack = 0.0 if exact else 1e-9 * self.large * float(np.abs(query).sum()) + 1
        queue = [(-bound[0], 0)]
        while queue:
            high, node = heapq.heappop(queue)
            worst = top[0] if len(top) == k else (floor, -math.inf)
            if -high + slack < worst[0]:
                break
            if exact and len(top) == k and -high == worst[0] and -self.least[node] < worst[1]:
                continue
            if self.child[node, 0]:
                for c in self.child[node]:
                    heapq.heappush(queue, (-bound[c], int(c)))
                continue
            rows = slice(self.first[node], self.first[node + 1])
            ids = self.ids[rows]
            if exact:
                score = (self.vectors[rows] @ query).astype(np.int64)
                near = np.flatnonzero((score >= worst[0]) & (ids != own))
                if len(near) > k:  # of a leaf only its k best count
                    near = near[np.lexsort((ids[near], -score[near]))[:k]]
                found = zip(score[near].tolist(), (-ids[near]).tolist(), strict=True)
            else:
                q = [int(x) for x in query]
                found = [(min(max(sum(a * int(b) for a, b in zip(q, v, strict=True)), -(2**63)), 2**63 - 1), -int(i)) for v, i in zip(self.vectors[rows], ids, strict=True) if i != own]
            for hit in found:
                if hit[0] < floor:
                    continue
                if len(top) < k:
                    heapq.heappush(top, hit)
                elif hit > top[0]:
                    heapq.heapreplace(top, hit)
        return top


def searched(pairs: DataFrame, k: int) -> DataFrame:
    """pairs: (ids, vectors, floors) of a query block beside a tree; the block's hits in that shard."""

    def run(batches):
        for batch in batches:
            for ids, vectors, floors, tree in zip(*(batch.column(c) for c in ("ids", "vectors", "floors", "tree")), strict=True):
                s = Search(tree.as_py())
                own = np.frombuffer(ids.as_py(), np.int64)
                q = np.frombuffer(vectors.as_py(), np.float64).reshape(len(own), -1)
                floor = np.frombuffer(floors.as_py(), np.float64) if floors.is_valid else np.full(len(own), -math.inf)
                bound = np.maximum(q, 0) @ s.high.T + np.minimum(q, 0) @ s.low.T
                out = [(int(own[i]), -h[1], h[0]) for i in range(len(own)) for h in s.best(q[i], own[i], bound[i], k, floor[i])]
                yield to_batch(out, HITS)

    return pairs.mapInArrow(run, HITS)


def top_k(spark: SparkSession, rows: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores. queries: which rows are queries."""
    scratch = Scratch(spark, "kdtree")
    good = scaled(rows, vec_id, vector).dropDuplicates(["id", "v"])
    asked = scaled(rows.filter(queries), vec_id, vector).dropDuplicates(["id", "v"])
    n, m = good.count(), asked.count()
    shards, blocks = max(1, math.ceil(n / SHARD)), max(1, math.ceil(m / BLOCK))

    def plant(batches):
        for batch in batches:
            out = []
            for dim, part, ids, vectors in zip(*(batch.column(c).to_pylist() for c in ("dim", "part", "ids", "vectors")), strict=True):
                ids = np.frombuffer(ids, np.int64)
                out.append((dim, part, Tree(np.frombuffer(vectors, np.float64).reshape(len(ids), dim), ids).bytes()))
            yield to_batch(out, "dim int, shard int, tree binary")

    trees = scratch.write(packed(good, shards).mapInArrow(plant, "dim int, shard int, tree binary"), "trees")
    asking = scratch.write(packed(asked, blocks), "queries")
    # first, one shard a block: the k-th score found there
    seen = trees.groupBy("dim").agg(F.sort_array(F.collect_list("shard")).alias("all"))
    home = asking.join(seen, "dim").withColumn("shard", F.element_at("all", (F.col("part") % F.size("all")) + 1))
    first = scratch.write(searched(home.withColumn("floors", F.lit(None).cast("binary")).join(trees, ["dim", "shard"]), k), "first")
    # a query's floor, in the order of its block's ids
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("low").cast("double").alias("low"))
    again = asked.join(kth, "id", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        ids = np.asarray(t.column("id"))
        order = np.argsort(ids, kind="stable")
        low = np.asarray(t.column("low").fill_null(-math.inf))[order]
        v = np.concatenate([np.asarray(c.flatten()) for c in t.column("v").chunks]).reshape(len(ids), -1)[order]
        return pa.Table.from_batches([to_batch([(t.column("dim")[0].as_py(), t.column("part")[0].as_py(), ids[order].tobytes(), v.tobytes(), low.tobytes())], PACKED + ", floors binary")])

    known = again.select("id", "v", "dim", "part", "low").groupBy("dim", "part").applyInArrow(pack, PACKED + ", floors binary")
    rest = known.join(seen, "dim").withColumn("home", F.element_at("all", (F.col("part") % F.size("all")) + 1)).withColumn("shard", F.explode("all")).filter("shard != home")
    second = searched(rest.join(trees, ["dim", "shard"]), k)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    merged = first.unionByName(second).dropDuplicates(["query_id", "vec_id", "score"])
    return merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
