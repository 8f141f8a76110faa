"""Operator 8: nearest vectors by inner product, from a forest of random-projection trees.

Vectors get one more component, which makes the largest inner product the least distance.  Each tree
splits the rows at the median of their projection on the line between two random groups' means; it is
fitted to at most about `FIT_ROWS` rows (a documented bound), and every row is then put into its leaf.
A query opens the leaves of all trees in the order of one shared priority queue, best margin first,
until it has seen `SHARE` of the forest's leaves.  Leaf rows are compared exactly, in double precision, and
the best of all leaves are merged.

Equal vectors are one candidate that carries its smallest ids, as many as a query can return; a query's own
id is left out.  Leaves meet queries in groups of leaves, cut into blocks of bounded size.

Defined results: vectors that are null, zero or have null or non-finite components take no part, nor
do rows without vec_id; shorter vectors count as ending in zeros; ties go to the smaller vec_id; a
repeated row is one vector; of several vectors with one id each is searched and found; fewer candidates
than wanted are all returned; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stash
from .vectors import BLOCK, bounded_sample, matrix, rows_of

NEAREST, EVERY = 20, 20
FIT_ROWS = 20_000
TREES, LEAF_ROWS, MOST_LEAVES = 8, 512, 1024
#: Share of all trees' leaves that a query opens; recall of 0.9 on vectors without structure needs this much.
SHARE = 0.14
#: Leaves that meet their queries together.
TOGETHER = 16


class Tree:
    def __init__(self, rows: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals, self.cuts, self.below, self.leaves = [], [], [], 0
        self.root = self._split(rows, np.arange(len(rows)), leaf, rng)
        self.normals = np.array(self.normals).reshape(-1, rows.shape[1])
        self.cuts = np.array(self.cuts)

    def _split(self, rows, idx, leaf, rng) -> int:
        """A node's number, or -1 - leaf."""
        if len(idx) > leaf:
            own = rows[idx]
            a, b = own[rng.choice(len(own), 2, replace=False)]
            for _ in range(3):
                p = own @ (a - b)
                far = p > np.median(p)
                if far.all() or not far.any():
                    break
                a, b = own[far].mean(0), own[~far].mean(0)
            normal = (a - b) / max(np.sqrt(((a - b) ** 2).sum()), 1e-12)
            p = own @ normal
            cut = float(np.median(p))
            far = p > cut
            if far.any():
                node = len(self.normals)
                self.normals.append(normal)
                self.cuts.append(cut)
                self.below.append(None)
                self.below[node] = (self._split(rows, idx[~far], leaf, rng), self._split(rows, idx[far], leaf, rng))
                return node
        self.leaves += 1
        return -self.leaves

    def place(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, idx = todo.pop()
            if node < 0:
                out[idx] = -1 - node
                continue
            far = rows[idx] @ self.normals[node] > self.cuts[node]
            todo += [(self.below[node][0], idx[~far]), (self.below[node][1], idx[far])]
        return out


class Forest:
    def __init__(self, sample: np.ndarray, total: int):
        leaves = min(MOST_LEAVES, max(1, total // min(LEAF_ROWS, max(16, total // 64))))
        leaf = max(4, -(-len(sample) // leaves))
        rng = np.random.default_rng(3)
        self.trees = [Tree(sample, leaf, rng) for _ in range(TREES)]
        self.open = max(TREES, int(np.ceil(SHARE * sum(t.leaves for t in self.trees))))

    def search(self, rows: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query the (tree, leaf) it opens."""
        margins = [rows @ t.normals.T - t.cuts for t in self.trees]
        out = []
        for i in range(len(rows)):
            queue = [(-np.inf, k, t.root) for k, t in enumerate(self.trees)]
            got = []
            while queue and len(got) < self.open:
                worst, k, node = heapq.heappop(queue)
                if node < 0:
                    got.append((k, -1 - node))
                    continue
                m, (low, high) = margins[k][i, node], self.trees[k].below[node]
                heapq.heappush(queue, (max(worst, -m), k, high))
                heapq.heappush(queue, (max(worst, m), k, low))
            out.append(got)
        return out


def nearest(table: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`."""
    spark = table.sparkSession
    prepare(spark)
    rows = rows_of(table)
    # The k + 1 smallest ids of each vector: cut before the shuffle, and so never a long list.
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    classes = stash(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    shape = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"), F.max(norm).alias("norm")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not shape.n:
        return spark.createDataFrame([], schema)
    width, longest = shape.width, shape.norm * (1 + 1e-12)

    def lifted(column) -> np.ndarray:
        x = matrix(column, width) / longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]], 1)

    sample = bounded_sample(classes, FIT_ROWS, shape.n).select("embedding").toArrow()
    made = Forest(lifted(sample.column(0)) if len(sample) else np.ones((1, width + 1)), shape.n)
    known = spark.sparkContext.broadcast(made)

    def index(batches):
        for b in batches:
            x = lifted(b.column(0))
            for t, tree in enumerate(known.value.trees):
                leaf = tree.place(x)
                yield pa.RecordBatch.from_arrays([pa.array(t * 1000 + leaf // TOGETHER, pa.int64()), pa.array(leaf, pa.int64()), b.column(0), b.column(1)], names=["g", "leaf", "embedding", "ids"])

    def ask(batches):
        for b in batches:
            x = matrix(b.column(1), width)
            x = np.concatenate([x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros((len(x), 1))], 1)
            gs, leaves, where = [], [], []
            for i, opened in enumerate(known.value.search(x)):
                by: dict[int, list[int]] = {}
                for t, leaf in opened:
                    by.setdefault(t * 1000 + leaf // TOGETHER, []).append(leaf)
                gs += by.keys()
                leaves += by.values()
                where += [i] * len(by)
            picked = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), b.column(0).take(picked), b.column(1).take(picked)], names=["g", "leaves", "query_id", "embedding"])

    indexed = stash(classes.mapInArrow(index, "g long, leaf long, embedding array<float>, ids array<long>"))
    asked = stash(rows.where(F.col("vec_id") % every == 0).mapInArrow(ask, "g long, leaves array<long>, query_id long, embedding array<float>"))
    # One row a group of leaves, so bounded by the forest's size.
    held = {r.g: r.n for r in indexed.groupBy("g").agg(F.count("*").alias("n")).collect()}
    wants = {r.g: r.n for r in asked.groupBy("g").agg(F.count("*").alias("n")).collect()}
    size = TOGETHER * BLOCK // 4
    blocks = F.broadcast(spark.createDataFrame([(g, -(-held[g] // size), -(-wants.get(g, 1) // BLOCK)) for g in held], "g long, nc int, nq int"))
    left = indexed.join(blocks, "g").withColumn("c", F.pmod(F.xxhash64("embedding", F.lit(11)), F.col("nc")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select("g", "c", "q", "leaf", "embedding", "ids")
    right = asked.join(blocks, "g").withColumn("q", F.pmod(F.xxhash64("query_id", F.lit(11)), F.col("nq")).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("nc") - 1))).select("g", "c", "q", "leaves", "query_id", "embedding")

    def compare(key, holds: pa.Table, asks: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if len(holds) and len(asks):
            x, y = matrix(asks["embedding"], width), matrix(holds["embedding"], width)
            leaf = holds["leaf"].to_numpy()
            wanted = [set(w) for w in asks["leaves"].to_pylist()]
            ids = holds["ids"].to_pylist()
            queries = asks["query_id"].to_pylist()
            by_leaf = {n: np.flatnonzero(leaf == n) for n in np.unique(leaf)}
            for i, w in enumerate(wanted):
                own = [by_leaf[n] for n in w if n in by_leaf]
                if not own:
                    continue
                at = np.concatenate(own)
                score = (y[at] * x[i]).sum(1)
                if len(at) > k + 1:
                    least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    keep = score >= least
                    at, score = at[keep], score[keep]
                best = sorted((-s, v) for a, s in zip(at.tolist(), score.tolist()) for v in ids[a] if v != queries[i])[:k]
                out_q += [queries[i]] * len(best)
                out_s += [-s for s, _ in best]
                out_v += [v for _, v in best]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    found = left.groupBy("g", "c", "q").cogroup(right.groupBy("g", "c", "q")).applyInArrow(compare, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
