"""The graph of nearest neighbours of vectors, and a layout by its edges.

Vectors are put in order several times over ("trees"): by the signs of random
projections against their medians, read as a Gray code so that vectors in line
differ in few signs, and cut into blocks of bounded size. Within a block all
distances are taken at once; the nearest of all blocks are a vector's
neighbours. Work is in proportion to rows, trees and block size, whatever the
density: equal vectors are one node with a number of copies. Up to ``block``
different vectors the graph is exact; beyond, ``recall`` measures it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.sources.tables import cut

#: Orders, vectors that are compared at once, signs of an order, and the bound of
#: the sample (by hash) that the medians are taken of.
TREES, BLOCK, SIGNS, SAMPLE = 12, 512, 24, 1024
_BLOCKS = 16  # to a task


def nodes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """node, v and copies of each different vector; null keys and vectors have none."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("key is not null and v is not null").groupBy("v").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("copies"))


def _directions(rows: DataFrame, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("v"), "node").limit(SAMPLE).collect()], float)
    if not len(sample):
        return np.zeros((trees, 1, SIGNS)), np.zeros((trees, SIGNS))
    made = np.random.default_rng(seed).normal(size=(trees, sample.shape[1], SIGNS))
    return made, np.median(np.einsum("nd,tds->tns", sample, made), axis=1)


def in_blocks(rows: DataFrame, compare: Callable[[list[pa.RecordBatch]], pa.RecordBatch | None], schema: str, trees: int = TREES, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """What ``compare`` makes of each block of ``rows`` (node, v and others), in
    each order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size, tree = 0, None
        for batch in batches:
            trees_of = batch.column("_tree").to_numpy()
            at = 0
            while at < batch.num_rows:
                if waiting and (size == block or trees_of[at] != tree):
                    if (made := compare(waiting)) is not None:
                        yield made
                    waiting, size = [], 0
                tree = trees_of[at]
                stop = min(at + block - size, at + int(np.searchsorted(trees_of[at:], tree, side="right")))
                waiting.append(batch.slice(at, stop - at))
                size += stop - at
                at = stop
        if waiting and (made := compare(waiting)) is not None:
            yield made

    n = rows.count()
    if n <= block:  # one block holds them all
        return rows.withColumn("_tree", F.lit(0)).coalesce(1).sortWithinPartitions("node").mapInArrow(run, schema)
    directions, medians = _directions(rows, trees, seed)
    held = rows.columns

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                v = stacked([batch], "v").astype(float)
                for tree, (made, median) in enumerate(zip(directions, medians, strict=True)):
                    far = v @ made - median
                    gray = far > 0
                    place = np.logical_xor.accumulate(gray, axis=1) @ (1 << np.arange(SIGNS - 1, -1, -1))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(v), tree)), pa.array(place), pa.array(far[:, 0])], [*held, "_tree", "_place", "_far"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(order, f"{fields}, _tree long, _place long, _far double")
    keys = ["_tree", "_place", "_far", "node"]
    return placed.repartitionByRange(-(-n * trees // (_BLOCKS * block)), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def stacked(waiting: list[pa.RecordBatch], column: str) -> np.ndarray:
    """The values of a column of batches; vectors as rows of a matrix."""
    parts = [b.column(column) for b in waiting]
    if pa.types.is_list(parts[0].type):
        widths = np.unique(np.concatenate([pc.list_value_length(p).to_numpy(zero_copy_only=False) for p in parts]))
        if len(widths) != 1:
            raise ValueError(f"vectors of several lengths: {widths[:5]}")
        return np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts]).reshape(-1, int(widths[0]))
    if pa.types.is_primitive(parts[0].type):
        return np.concatenate([p.to_numpy(zero_copy_only=False) for p in parts])
    return np.concatenate([np.array(p.to_pylist()) for p in parts])


def distances(v: np.ndarray) -> np.ndarray:
    """All distances within a block, good enough to choose by."""
    squares = (v * v).sum(axis=1)
    return np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * v @ v.T, 0))


def graph(points: DataFrame, k: int, trees: int = TREES, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """a and near, the (distance, b, copies) of a node's k nearest other nodes, by
    distance; all of them where there are fewer. ``points`` are ``nodes``."""
    kind = points.schema["node"].dataType.simpleString()
    near = f"array<struct<distance:double,b:{kind},copies:long>>"

    def compare(waiting: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        v = stacked(waiting, "v").astype(float)
        if len(v) < 2:
            return None
        names, copies = (pa.concat_arrays([b.column(c) for b in waiting]) for c in ("node", "copies"))
        far = distances(v)
        np.fill_diagonal(far, np.inf)
        most = min(k, len(v) - 1)
        # A few more by the rough distances; the exact ones then order them.
        some = min(most + 4, len(v) - 1)
        chosen = np.argpartition(far, some - 1, axis=1)[:, :some]
        exact = np.sqrt(((v[:, None, :] - v[chosen]) ** 2).sum(axis=2))
        flat = pa.array(chosen.ravel())
        members = pa.StructArray.from_arrays([pa.array(exact.ravel()), names.take(flat), copies.take(flat)], ["distance", "b", "copies"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * some), members)
        return pa.RecordBatch.from_arrays([names, lists], ["a", "near"])

    found = in_blocks(points, compare, f"a {kind}, near {near}", trees, block, seed)
    # At most trees * (k + 4) candidates a node.
    best = F.array_distinct(F.flatten(F.collect_list("near")))
    return found.groupBy("a").agg(F.slice(F.array_sort(best), 1, k).alias("near"))


def nearest_of(points: DataFrame, queries: list[tuple], k: int) -> DataFrame:
    """a and d, the k least distances of each of a few queries (node, v) to other
    nodes, by comparing them with all: each task hands on its k best."""
    names, held = [q[0] for q in queries], np.array([q[1] for q in queries], float)
    kind = points.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(names), k), np.inf)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                v, own = np.array(batch.column("v").to_pylist(), float), batch.column("node").to_pylist()
                far = np.stack([np.sqrt(((v - q) ** 2).sum(axis=1)) for q in held])
                far[[[n == o for o in own] for n in names]] = np.inf
                best = np.sort(np.concatenate([best, far], axis=1), axis=1)[:, :k]
        yield pa.RecordBatch.from_pydict({"a": pa.array(names, pa.from_numpy_dtype(np.int64) if isinstance(names[0], int) else None), "d": pa.array([r[np.isfinite(r)].tolist() for r in best], pa.list_(pa.float64()))})

    rows = points.select("node", "v").mapInArrow(run, f"a {kind}, d array<double>")
    return rows.groupBy("a").agg(F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k).alias("d"))


def recall(points: DataFrame, made: DataFrame, k: int, most: int = 500) -> DataFrame:
    """queries and recall: the share of the k nearest nodes that the graph has,
    over ``most`` nodes taken by hash (all, if fewer) that are compared with all
    others. Nodes as near as the k-th count."""
    queries = [(r["node"], r["v"]) for r in points.orderBy(F.xxhash64("node"), "node").limit(most).select("node", "v").collect()]
    if not queries:
        return points.sparkSession.createDataFrame([(0, None)], "queries long, recall double")
    both = nearest_of(points, queries, k).join(made, "a", "left")
    hits = F.size(F.filter(F.coalesce(F.col("near.distance"), F.array().cast("array<double>")), lambda x: x <= F.array_max("d") * (1 + 1e-9)))
    n = F.size("d")
    return both.agg(F.count(F.lit(1)).alias("queries"), (F.sum(F.least(hits, n)) / F.sum(n)).alias("recall"))


def layout(points: DataFrame, made: DataFrame, dimensions: int = 2, rounds: int = 15, rest: int = 256, seed: int = 42) -> DataFrame:
    """node and xy: places of the nodes in few dimensions, near where an edge of
    the graph says so. Nodes begin on random projections; in each round edges pull
    their ends together, by weights that fall from a node's nearest to its
    farthest neighbour, and a fresh sample of ``rest`` nodes (a bound, by hash)
    pushes all others away, scaled to all nodes."""
    n = points.count()
    if not n:
        return points.select("node", F.array().cast("array<double>").alias("xy"))
    edges = made.select("a", F.inline("near")).join(made.select("a", F.col("near")[0]["distance"].alias("low"), F.greatest(F.try_element_at("near", F.size("near"))["distance"], F.lit(1e-12)).alias("high")), "a")
    pull = edges.select("a", "b", F.exp(-(F.col("distance") - F.col("low")) / F.col("high")).alias("w"))
    pull = pull.unionByName(pull.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w"))
    pull = cut(pull)
    size = len(points.select("v").first()["v"])
    axes = np.random.default_rng(seed).normal(size=(dimensions, size)) / math.sqrt(size)
    dot = lambda axis: F.aggregate(F.zip_with("v", F.lit(axis.tolist()), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    now = points.select("node", F.array(*[dot(a) for a in axes]).alias("xy"))
    spread = now.agg(*[F.stddev_pop(F.col("xy")[i]).alias(f"s{i}") for i in range(dimensions)]).first()
    scale = 10 / max([*[s for s in spread if s], 1e-12][0], 1e-12)
    now = cut(now.select("node", F.transform("xy", lambda x: x * scale).alias("xy")))
    gap = lambda p, q: F.zip_with(p, q, lambda x, y: x - y)
    squared = lambda d: F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)
    for step in range(rounds):
        rate = 1.0 - step / rounds
        ends = pull.join(now.select(F.col("node").alias("a"), F.col("xy").alias("p")), "a").join(now.select(F.col("node").alias("b"), F.col("xy").alias("q")), "b")
        force = ends.select("a", gap("q", "p").alias("d"), "w").withColumn("f", F.col("w") / (1 + squared(F.col("d"))))
        sums = force.groupBy("a").agg(*[F.sum(F.col("f") * F.col("d")[i]).alias(f"p{i}") for i in range(dimensions)], F.sum("w").alias("w"))
        others = [r["xy"] for r in now.orderBy(F.xxhash64("node", F.lit(step)), "node").limit(rest).collect()]
        pushed = now.withColumn("_o", F.lit(np.array(others).tolist()))
        # The push of one node falls with the square of its distance.
        away = F.aggregate("_o", F.array(*[F.lit(0.0)] * dimensions), lambda s, o: F.zip_with(s, gap("xy", o), lambda t, d: t + d / ((0.01 + squared(gap("xy", o))) * (1 + squared(gap("xy", o))))))
        pushed = pushed.select("node", "xy", away.alias("r"))
        weight = 2.0 / len(others) * 5
        move = lambda i: rate * (F.coalesce(F.col(f"p{i}") / F.greatest("w", F.lit(1e-12)), F.lit(0.0)) + weight * F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("r")[i])))
        now = cut(pushed.join(sums.withColumnRenamed("a", "node"), "node", "left").select("node", F.array(*[F.col("xy")[i] + move(i) for i in range(dimensions)]).alias("xy")))
    return now
