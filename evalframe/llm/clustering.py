"""Centroid clustering of integer vectors with a vantage-point tree.

Each round builds a vantage-point tree over the centroids and broadcasts it.
A task searches it for all vectors of a batch at once, each vector best first:
the open node with the smallest lower bound is next, and a vector is done when
no open node can hold a centroid as near as its best.  Bounds come from square
roots, so a node is given up only when it is further off than the best by more
than their rounding errors; the comparison includes equality, and distances
themselves are exact integers.  So ties are seen and go to the smaller number.

Centroids are a parameter-sized table (``k`` rows); what a task returns of a
round is at most one row for each centroid, summed by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm._store import stored, swept_shuffles

SCALE = 64
LIMIT = 1 << 27          # components are held within this, so that distances fit a long
LEAF = 4                 # centroids of a leaf
BATCH = 2_048            # vectors searched together
MAX_CENTROIDS = 65_536   # bound of what is broadcast; more is an error


@dataclass
class Node:
    """Centroids ``own``: all of a leaf, or the vantage point.  ``near`` and ``far``
    are nodes; ``*_range`` the least and largest distance of theirs to the vantage point."""
    own: np.ndarray
    near: int = -1
    far: int = -1
    near_range: tuple[float, float] = (0.0, 0.0)
    far_range: tuple[float, float] = (0.0, 0.0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired integer rows (one side may be a single row)."""
    d = a - b
    return np.einsum("...j,...j->...", d, d)


def build_tree(centroids: np.ndarray, leaf: int = LEAF) -> list[Node]:
    """Nodes, the root first.  The vantage point of a node is its centroid furthest from
    the node's first one; the others are split at the median distance to it."""
    nodes: list[Node] = []

    def grow(ids: np.ndarray) -> int:
        at = len(nodes)
        if len(ids) <= leaf:
            nodes.append(Node(ids))
            return at
        v = ids[np.argmax(squared(centroids[ids], centroids[ids[0]]))]
        rest = ids[ids != v]
        d = np.sqrt(squared(centroids[rest], centroids[v]).astype(float))
        by = np.argsort(d, kind="stable")
        half = (len(rest) + 1) // 2
        nodes.append(Node(np.array([v])))
        for side, part in (("near", by[:half]), ("far", by[half:])):
            if len(part):
                setattr(nodes[at], f"{side}_range", (float(d[part].min()), float(d[part].max())))
                setattr(nodes[at], side, grow(rest[part]))
        return at

    if len(centroids):
        grow(np.arange(len(centroids)))
    return nodes


def search(nodes: list[Node], centroids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row of ``x`` (ties: smaller number), its squared
    distance, and how many distances were computed."""
    n = len(x)
    best = np.full(n, np.iinfo(np.int64).max)
    number = np.full(n, -1, np.int64)
    bound = np.full((n, len(nodes)), np.inf)      # of open nodes; infinite: unopened or done
    if len(nodes):
        bound[:, 0] = 0.0
    active = np.arange(n)
    work = 0
    while len(active):
        node_of = bound[active].argmin(1)
        low = bound[active, node_of]
        going = low <= np.sqrt(best[active].astype(float)) * (1 + 1e-12)     # equality stays
        going &= np.isfinite(low)
        active, node_of = active[going], node_of[going]
        bound[active, node_of] = np.inf
        for k in np.unique(node_of):
            node, rows = nodes[k], active[node_of == k]
            for c in node.own:
                d = squared(x[rows], centroids[c])
                work += len(rows)
                take = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
                best[rows[take]], number[rows[take]] = d[take], c
            if node.near >= 0 or node.far >= 0:
                root = np.sqrt(d.astype(float))
                for child, (lo, hi) in ((node.near, node.near_range), (node.far, node.far_range)):
                    if child >= 0:
                        slack = (root + hi) * 1e-12
                        bound[rows, child] = np.maximum(np.maximum(root - hi, lo - root) - slack, 0.0)
    return number, best, work


def clean(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v): vectors of exactly ``dim`` finite components, floor(64 x) as longs.

    Null vectors, other lengths and null or non-finite components are left
    out.  Beyond +-2^27 a component is held at that bound (a squared distance
    of larger ones is no long).
    """
    v = F.col(vec_col).cast("array<double>")
    ok = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))))
    return vectors.filter(F.coalesce(ok, F.lit(False))).select(
        F.col(id_col).alias("id"), held.cast("array<bigint>").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def _parts(batches: Iterator[pa.RecordBatch], dim: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part, _matrix(part.column("v"), dim)


def _sums(model, dim: int):
    def run(batches):
        nodes, centroids = model.value
        n = np.zeros(len(centroids), np.int64)
        total = np.zeros((len(centroids), dim), np.int64)
        for _, x in _parts(batches, dim):
            number, _, _ = search(nodes, centroids, x)
            np.add.at(total, number, x)
            n += np.bincount(number, minlength=len(centroids))
        for c in np.flatnonzero(n):
            yield pa.RecordBatch.from_pydict({"cluster": pa.array([int(c)], pa.int32()), "n": pa.array([int(n[c])], pa.int64()),
                                              "total": pa.array([total[c].tolist()], pa.list_(pa.int64()))})
    return run


def _assign(model, dim: int):
    def run(batches):
        nodes, centroids = model.value
        for part, x in _parts(batches, dim):
            number, best, _ = search(nodes, centroids, x)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(number, pa.int32()), pa.array(best, pa.int64())],
                                             ["id", "cluster", "distance"])
    return run


def seeds(rows: DataFrame, k: int) -> np.ndarray:
    """The ``k`` rows whose ids have the smallest hashes (null ids last, equal hashes by
    their components); all rows if there are fewer."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    first = rows.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, k: int = 16,
            rounds: int = 3) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), centroids) after ``rounds`` rounds and one more assignment.

    ``id`` has its own name and type.  Repeated rows count as often as they
    stand there; null ids are assigned like others.  An empty table, or one
    without a usable vector, gives an empty result and no centroids.
    """
    if not 1 <= k <= MAX_CENTROIDS:
        raise ValueError(f"k must be from 1 to {MAX_CENTROIDS}")
    spark = vectors.sparkSession
    rows = stored(clean(vectors, id_col, vec_col, dim), "cluster-vectors")
    centroids = seeds(rows, k)
    id_type = rows.schema["id"].dataType.simpleString()
    if not len(centroids):
        return rows.select(F.col("id").alias(id_col), F.lit(None).cast("int").alias("cluster"),
                           F.lit(None).cast("bigint").alias("distance")), centroids
    for _ in range(rounds):
        model = spark.sparkContext.broadcast((build_tree(centroids), centroids))
        part = rows.select("v").mapInArrow(_sums(model, dim), "cluster int, n bigint, total array<bigint>")
        whole = (part.select("cluster", "n", F.posexplode("total"))
                 .groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total")))
        with swept_shuffles(spark):
            got = whole.collect()          # k * dim numbers
        model.destroy()
        centroids = centroids.copy()
        for r in got:
            centroids[r["cluster"], r["pos"]] = int(r["total"]) // r["n"]
    model = spark.sparkContext.broadcast((build_tree(centroids), centroids))
    out = rows.mapInArrow(_assign(model, dim), f"id {id_type}, cluster int, distance bigint")
    return stored(out, "cluster-assigned").withColumnRenamed("id", id_col), centroids


def describe(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia (sums of its distances) and centroid_sha256.

    A sum beyond a long is held at its bound.
    """
    longest = (1 << 63) - 1
    sums = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}      # one row for each centroid
    every = min(sum(sums.values()), longest)
    side = assigned.sparkSession.createDataFrame(
        [(i, min(sums.get(i, 0), longest), every, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
         for i, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(side), "cluster", "left")
