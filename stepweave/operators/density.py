"""Density clusters of vectors, by joins of near pairs.

A vector is core if at least ``min_points`` rows, itself included, lie within
the radius. Core vectors within the radius of each other share a cluster, named
by its least core key; any other vector joins the least cluster it reaches, and
those that reach none are noise, -1.

Near pairs are exact, and never stored: groups of vectors that may hold some are
compared in ``pairs``, and each two groups hand on sums and links of single vectors.
Distances by products only choose: those close to the radius are taken again, place by
place. Where all vectors are near each other the work is that of all pairs, what is
dealt and stored is not. Equal vectors are one node with a number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.operators import pairs
from stepweave.operators.pairs import CHUNK, Chunk
from stepweave.sources.tables import cut


def _near(v: np.ndarray, w: np.ndarray, radius: float) -> np.ndarray:
    """Which rows of v and w lie within the radius."""
    middle = v.mean(axis=0)
    middle = np.where(np.isfinite(middle), middle, 0.0)
    x, y = v - middle, w - middle
    a, b = (x * x).sum(axis=1), (y * y).sum(axis=1)
    # The square of the distance less that of the radius, as one product.
    size = max(a.max(), b.max()) + radius * radius
    kind = np.float32 if size < 1e30 else np.float64
    far = np.c_[x, a - radius * radius, np.ones(len(a))].astype(kind) @ np.c_[-2 * y, np.ones(len(b)), b].astype(kind).T
    slack = 4 * (v.shape[1] + 8) * float(np.finfo(kind).eps) * (size if np.isfinite(size) else np.inf)
    near, may = far <= -slack, far <= slack
    if np.count_nonzero(near) < np.count_nonzero(may):
        i, j = np.nonzero(may & ~near)
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            total = np.zeros(len(p))
            for k in range(v.shape[1]):
                total += (v[p, k] - w[q, k]) ** 2
            near[p, q] = np.sqrt(total) <= radius
    return near


def _copies(near: np.ndarray, copies: pa.Array) -> np.ndarray:
    """Copies of the columns that are near each row."""
    n = copies.to_numpy()
    return near.sum(axis=1) if (n == 1).all() else (near.astype(float) @ n).astype(np.int64)


def _counts(radius: float, least: int):
    """node and n, the copies within the radius; where both chunks' rows have ``least``
    already, no more are counted."""

    def look(a: list[Chunk], b: list[Chunk]) -> Iterator[pa.RecordBatch]:
        n, m = ([np.zeros(len(c.names), np.int64) for c in side] for side in (a, b))
        for i, j in pairs.between(a, b, radius):
            x, y, other = (a[i], b[j], m) if b else (a[i], a[j], n)
            if n[i].min() >= least and other[j].min() >= least:
                continue
            near = _near(x.v, y.v, radius)
            n[i] += _copies(near, y.held)
            if x is not y:
                other[j] += _copies(near.T, x.held)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.names for c in a + b]), pa.array(np.concatenate(n + m))], ["node", "n"])

    return look


def _links(radius: float):
    """a and b: edges that join what the near pairs of two groups join, fewer than rows."""

    def look(a: list[Chunk], b: list[Chunk]) -> Iterator[pa.RecordBatch]:
        at = pairs.starts(a + b)
        label = np.arange(at[-1])
        for i, j in pairs.between(a, b, radius):
            to = len(a) + j if b else j
            rows, columns = label[at[i] : at[i + 1]], label[at[to] : at[to + 1]]
            if (rows == rows[0]).all() and (columns == rows[0]).all():
                continue
            near = _near(a[i].v, (b or a)[j].v, radius)
            # Each row and each column in turn names one that it is not joined with yet.
            while (apart := near & (rows[:, None] != columns[None, :])).any():
                p, q = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
                ends = np.r_[p, apart[:, q].argmax(axis=0)], np.r_[apart[p].argmax(axis=1), q]
                pairs.joined(label, at[i] + ends[0], at[to] + ends[1])
        names, moved = pa.concat_arrays([c.names for c in a + b]), np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(moved)), names.take(pa.array(label[moved]))], ["a", "b"])

    return look


def _least_root(radius: float):
    """node and the least root of the core rows within the radius, where there are any.
    Rows of the second side come by root."""

    def look(a: list[Chunk], b: list[Chunk]) -> Iterator[pa.RecordBatch]:
        waiting = [np.arange(len(c.names)) for c in a]
        for i, j in pairs.between(a, b, radius):
            if len(waiting[i]):
                near = _near(a[i].v[waiting[i]], b[j].v, radius)
                hit = near.any(axis=1)
                yield pa.RecordBatch.from_arrays([a[i].names.take(pa.array(waiting[i][hit])), b[j].held.take(pa.array(near[hit].argmax(axis=1)))], ["node", "root"])
                waiting[i] = waiting[i][~hit]

    return look


def _roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component: in each round a node
    takes the least root around it, and then that root's own root."""
    now = cut(nodes.select("node", F.col("node").alias("root")))
    while True:
        around = edges.join(now.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("low"))
        least = now.join(around.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("low", "root")).alias("via"))
        jump = now.select(F.col("node").alias("via"), F.col("root").alias("up"))
        moved = cut(least.join(jump, "via").select("node", "was", F.least("via", "up").alias("root")))
        now = moved.select("node", "root")
        if moved.where("root <> was").isEmpty():
            return now


def clusters(vectors: DataFrame, radius: float, min_points: int, key: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """Key, core and cluster_id of every row. Null vectors are noise; all
    vectors have equal lengths; without any, all rows are noise."""
    if radius <= 0:
        raise ValueError("the radius must be positive")
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    nodes = cut(rows.where("key is not null and v is not null").groupBy("v").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("copies")))
    kind = nodes.schema["node"].dataType.simpleString()
    every = pairs.packed(pairs.placed(nodes, "copies", chunk), "copies", chunk)
    degrees = pairs.met(every, None, _counts(radius, min_points), f"node {kind}, n long", radius)
    core = cut(degrees.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= min_points).select("node"))
    inner = nodes.join(core, "node", "left_semi")
    dense = pairs.packed(pairs.placed(inner, "copies", chunk), "copies", chunk)
    edges = cut(pairs.met(dense, None, _links(radius), f"a {kind}, b {kind}", radius))
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = _roots(core, edges)
    # Core rows have their root; the others take the least that they reach.
    rest = pairs.packed(pairs.placed(nodes.join(core, "node", "left_anti"), "copies", chunk), "copies", chunk)
    rooted = inner.join(roots, "node").repartitionByRange(pairs.groups(inner, chunk), "root", "node").sortWithinPartitions("root", "node")
    reached = pairs.met(rest, pairs.packed(rooted, "root", chunk), _least_root(radius), f"node {kind}, root {kind}", radius).groupBy("node").agg(F.min("root").alias("root"))
    named = roots.unionByName(reached).select(F.col("node").alias("a"), F.col("root").alias("cluster_id"))
    of = nodes.join(named.withColumnRenamed("a", "node"), "node").join(core.withColumn("core", F.lit(True)), "node", "left").select("v", "cluster_id", "core")
    whole = rows.join(of, "v", "left")
    noise = F.lit(-1).cast(rows.schema["key"].dataType)
    return whole.select(F.col("key").alias(key), F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("cluster_id", noise).alias("cluster_id"))
