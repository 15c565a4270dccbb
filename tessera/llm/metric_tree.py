"""Exact top-k by inner product in M-trees, searched best first.

Candidates are dealt into blocks. A task bulk-loads an M-tree of one block once: pages of routing objects with covering radii and the
distances to their parent, and leaves that keep each object's distance to the leaf's routing object. Queries then stream past it, so
a task's memory depends neither on the table nor on how many queries there are. Every query first meets one block; the k-th score that it
finds there is one that the whole answer reaches too, so its searches in all other blocks begin with it and return nothing below.

For a routing object p of radius r and any x below it, q.x = q.p + q.(x - p) <= q.p + |q| r. From what was computed for the parent o,
q.p <= q.o + |q| d(o, p), so a child is passed over without computing q.p when q.o + |q| (d(o, p) + r) can't reach the k-th score; an
object likewise with r = 0. Pages wait in a queue by their bound, and the search ends when the best bound can't reach the k-th score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.words import tidy

LEAF, FANOUT = 1024, 16
CANDIDATES = 16_384
SLACK = 1e-6  # scores are whole numbers; bounds are rounded


@dataclass
class Node:
    pivots: np.ndarray  # routing objects of the children, or the objects of a leaf
    distance: np.ndarray  # of each to this node's own routing object
    radius: np.ndarray  # covering radius of each child; 0 for objects
    children: list[Node] = field(default_factory=list)
    ids: np.ndarray | None = None


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - p) ** 2).sum(-1, dtype=np.float64))


def build(x: np.ndarray, ids: np.ndarray, parent: np.ndarray) -> Node:
    """x: objects, float64 whole numbers; parent: the routing object above."""
    if len(x) <= LEAF:
        d = _distances(x, parent)
        order = np.argsort(d, kind="stable")
        return Node(x[order], d[order], np.zeros(len(x)), ids=ids[order])
    picks = x[np.linspace(0, len(x) - 1, FANOUT).astype(int)]
    to = ((picks**2).sum(1) - 2 * (x @ picks.T)).argmin(1)
    parts = [np.flatnonzero(to == i) for i in range(FANOUT)]
    parts = [p for p in parts if len(p)]
    if len(parts) == 1 or max(map(len, parts)) > 0.9 * len(x):  # hardly anything to tell apart
        parts = np.array_split(np.argsort(_distances(x, x[0]), kind="stable"), FANOUT)
    pivots = np.stack([x[p].mean(0).round() for p in parts])
    children = [build(x[p], ids[p], c) for p, c in zip(parts, pivots)]
    radius = np.array([_distances(x[p], c).max() for p, c in zip(parts, pivots)])
    return Node(pivots, _distances(pivots, parent), radius, children)


def search(root: Node, zero: np.ndarray, q: np.ndarray, own: int, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best objects that score `floor` at least, but those with the id `own`; best first, ties to the smaller id."""
    norm = float(np.sqrt((q * q).sum()))
    best_s, best_i, kth, n = np.empty(0), np.empty(0, np.int64), floor, 0
    queue = [(-np.inf, n, float(q @ zero), root)]
    while queue:
        bound, _, at, node = heapq.heappop(queue)
        if -bound < kth - SLACK:
            break
        able = np.flatnonzero(at + norm * (node.distance + node.radius) >= kth - SLACK)
        if not len(able):
            continue
        scores = node.pivots[able] @ q
        if node.ids is None:
            for c, s, b in zip(able.tolist(), scores.tolist(), (scores + norm * node.radius[able]).tolist()):
                if b >= kth - SLACK:
                    n += 1
                    heapq.heappush(queue, (-b, n, s, node.children[c]))
            continue
        ids = node.ids[able]
        good = (scores >= kth) & (ids != own)
        best_s, best_i = np.concatenate([best_s, scores[good]]), np.concatenate([best_i, ids[good]])
        if len(best_s) >= k:
            order = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i, kth = best_s[order], best_i[order], best_s[order[-1]]
    order = np.lexsort((best_i, -best_s))[:k]
    return best_s[order], best_i[order]


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component; null for a vector that is null, empty, or holds a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.when((F.size(vector) > 0) & fine, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose vec_id is divisible by `every`, the k other rows of highest inner product.

    vectors: vec_id and embedding; other columns are ignored. Components become floor(scale * x) and must stay below 2 ** 23 for scores to
    be exact. Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null vec_id. Only vectors
    of one length are compared. Equal rows are one; rows that share a vec_id are one row to each other, so none is the other's result. An
    empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding", scale).alias("v"))
    rows = rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").distinct()
    total, asked = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    if not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = -(-total // CANDIDATES)
    spread = lambda seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks)).cast("int")
    rows = rows.select("vec_id", "v", F.size("v").alias("size"), F.xxhash64("vec_id", "v").alias("query"))
    candidates = rows.select("size", spread(2).alias("b"), F.lit(False).alias("asks"), "vec_id", "query", "v", F.lit(None).cast("double").alias("floor"))
    queries = rows.filter(F.col("vec_id") % every == 0).withColumn("home", spread(1))
    first = queries.select("size", F.col("home").alias("b"), F.lit(True).alias("asks"), "vec_id", "query", "v", F.lit(None).cast("double").alias("floor"))
    found = written(met(candidates.unionByName(first), k), "first-scores")
    if blocks > 1:
        floors = found.groupBy("query_id", "query").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
        known = queries.join(floors, (F.col("vec_id") == F.col("query_id")) & (queries["query"] == floors["query"]), "left").select("size", "home", "vec_id", queries["query"], "v", "floor")
        others = known.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).filter("b <> home")
        others = others.select("size", "b", F.lit(True).alias("asks"), "vec_id", "query", "v", "floor")
        found = found.unionByName(met(candidates.unionByName(others), k))
    order = W.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def met(rows: DataFrame, k: int) -> DataFrame:
    """query_id, query, vec_id and score: what each asking row finds among the candidates of its block. rows: size, b, asks, vec_id, query, v, floor."""

    @tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, root, zero = None, [], None, None
        for batch in batches:
            size, b, asks, ids, query, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "b", "asks", "vec_id", "query", "floor"))
            keys = np.stack([size, b, asks], 1).astype(np.int64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                x = batch.column("v").slice(start, end - start).flatten().to_numpy().astype(np.float64).reshape(end - start, -1)
                if (now := (int(size[start]), int(b[start]))) != key:
                    key, parts, root = now, [], None
                if not asks[start]:
                    parts.append((ids[start:end], x))
                    continue
                if root is None and parts:  # a block's candidates come before its queries
                    every = np.concatenate([p[0] for p in parts])
                    objects, order = np.concatenate([p[1] for p in parts]), np.argsort(every, kind="stable")
                    zero, parts = objects.mean(0).round(), []
                    root = build(objects[order], every[order], zero)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for i in range(start, end if root is not None else start):
                    least = float(floor[i])
                    scores, got = search(root, zero, x[i - start], int(ids[i]), k, -np.inf if np.isnan(least) else least)
                    for column, values in zip(out, (np.full(len(got), ids[i]), np.full(len(got), query[i]), got, scores.astype(np.int64))):
                        column.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["query_id", "query", "vec_id", "score"])

    dealt = rows.repartition("size", "b").sortWithinPartitions("size", "b", "asks")
    return dealt.mapInArrow(task, "query_id long, query long, vec_id long, score long")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
