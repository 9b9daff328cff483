"""All pairs of vectors, compared as matrices by pairs of groups.

Vectors are put in order of their nearest pivot and their distance from it. A
partition of that order is a group; it is packed into chunks with a centre and a
reach. Each two groups meet in one task, unless no near pair can lie between
them, and the task hands on what it finds of single vectors, not pairs.

A table has ``GROUPS`` groups until these would hold more than ``GROUP_BYTES``,
so up to there a vector travels as often at any size. Beyond, the number of groups
grows with the table, and so does the number of a vector's journeys. A task holds
two groups. The comparisons themselves are those of all pairs where all lie near.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from stepweave.operators.neighbours import stacked
from stepweave.sources.tables import cut

#: Bound of the vectors, taken by hash, that are sent to the tasks as pivots.
PIVOTS = 64
#: Vectors of a chunk; groups of a table; the most bytes of vectors in a group.
CHUNK, GROUPS, GROUP_BYTES = 2048, 12, 32 << 20
#: Tasks that pairs of groups are dealt over at most.
TASKS = 4096


class Chunk(NamedTuple):
    """Vectors that lie together: names, values of a further column, matrix."""

    names: pa.Array
    held: pa.Array
    v: np.ndarray
    centre: np.ndarray
    reach: float


def _groups(n: int, width: int, chunk: int) -> int:
    most = max(chunk, GROUP_BYTES // (8 * max(1, width)))
    return max(1, -(-n // most), min(GROUPS, -(-n // chunk)))


def groups(nodes: DataFrame, chunk: int) -> int:
    """Groups of a table of vectors."""
    first = nodes.select("v").first()
    return _groups(nodes.count(), len(first["v"]) if first else 1, chunk)


def placed(nodes: DataFrame, more: str, chunk: int = CHUNK) -> DataFrame:
    """``nodes`` (node, v and ``more``) in order of nearest pivot and distance, a
    group to a partition."""
    # At most PIVOTS rows.
    pivots = np.array([r["v"] for r in nodes.orderBy(F.xxhash64("v"), "node").limit(PIVOTS).collect()], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                v = stacked([batch], "v").astype(float)
                far = np.sqrt(((v[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(axis=1)), pa.array(far.min(axis=1))], [*batch.schema.names, "pivot", "far"])

    kind, value = (nodes.schema[c].dataType.simpleString() for c in ("node", more))
    found = nodes.select("node", more, "v").mapInArrow(run, f"node {kind}, {more} {value}, v array<double>, pivot long, far double")
    return found.repartitionByRange(groups(nodes, chunk), "pivot", "far", "node").sortWithinPartitions("pivot", "far", "node").drop("pivot", "far")


def packed(rows: DataFrame, more: str, chunk: int = CHUNK) -> DataFrame:
    """Chunks of rows (node, v and ``more``) in their order: id, group, names, values
    of ``more``, the vectors as bytes, their centre, its greatest distance from them."""
    kind, value = (rows.schema[c].dataType.simpleString() for c in ("node", more))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                v = stacked([batch], "v").astype(float)
                centre = v.mean(axis=0)
                reach = float(np.sqrt(((v - centre) ** 2).sum(axis=1)).max())
                lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in ("node", more)]
                short = v.astype(np.float32)  # if it loses nothing
                yield pa.RecordBatch.from_arrays([*lists, pa.array([(short if (short == v).all() else v).tobytes()], pa.binary()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([reach])], ["names", "held", "v", "centre", "reach"])

    made = rows.select("node", more, "v").mapInArrow(run, f"names array<{kind}>, held array<{value}>, v binary, centre array<double>, reach double")
    made = cut(made.withColumns({"id": F.monotonically_increasing_id(), "part": F.spark_partition_id()}))
    # Partitions are groups; where a session deals rows over more of them, several are one.
    n, width, parts = made.agg(F.sum(F.size("names")), F.max(F.size("centre")), F.max("part") + 1).first()
    return made.withColumn("group", F.floor(F.col("part") * _groups(n or 0, width or 1, chunk) / F.lit(parts or 1)).cast("int")).drop("part")


def between(a: list[Chunk], b: list[Chunk], radius: float = np.inf) -> Iterator[tuple[int, int]]:
    """Places in a and b of chunks that may hold a near pair; without b, each two
    chunks of a once."""
    for i, x in enumerate(a):
        for j, y in enumerate(b or a[: i + 1]):
            # Not turned round: a gap that is no number rules nothing out.
            if not np.sqrt(((x.centre - y.centre) ** 2).sum()) > (x.reach + y.reach + radius) * (1 + 1e-9):
                yield i, j


def starts(chunks: list[Chunk]) -> list[int]:
    """Where each chunk's rows begin among those of all."""
    return np.cumsum([0, *(len(c.names) for c in chunks)]).tolist()


def met(left: DataFrame, right: DataFrame | None, look: Callable[[list[Chunk], list[Chunk]], Iterator[pa.RecordBatch]], schema: str, radius: float = np.inf) -> DataFrame:
    """What ``look`` makes of the chunks of each two groups that may hold a near pair,
    in the order of their ids. Without ``right``, of each two groups of ``left``
    once, and of each group with no chunks beside it."""
    once = right is None
    tables = {"a": left, "b": left if once else right}
    gap = F.sqrt(F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    a, b = (t.select(F.col("group").alias(f"g{k}"), F.col("centre").alias(f"c{k}"), F.col("reach").alias(f"r{k}")) for k, t in tables.items())
    pairs = a.crossJoin(b).where("ga <= gb") if once else a.crossJoin(b)
    pairs = pairs.where(gap <= (F.col("ra") + F.col("rb") + radius) * (1 + 1e-9)).select("ga", "gb").distinct()
    # A few numbers a pair of groups, not of vectors.
    pairs = cut(pairs.select("ga", "gb", (F.row_number().over(W.Window.orderBy("ga", "gb")) - 1).alias("pair")))
    tasks = max(1, min(TASKS, pairs.count()))
    columns = ["pair", "side", "id", "names", "held", "v", "centre", "reach"]
    sides = [
        t.join(F.broadcast((pairs if k == "a" or not once else pairs.where("ga <> gb")).withColumnRenamed(f"g{k}", "group")), "group").withColumn("side", F.lit(side)).select(*columns)
        for side, (k, t) in enumerate(tables.items())
    ]
    dealt = sides[0].unionByName(sides[1]).repartitionById(tasks, (F.col("pair") % tasks).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for whole in batches:
            for k in range(whole.num_rows):
                c = {n: whole.column(n)[k] for n in columns}
                if (pair := c["pair"].as_py()) != now:
                    if now is not None:
                        yield from look(*held)
                    now, held = pair, ([], [])
                names = c["names"].values
                centre, v = np.array(c["centre"].as_py(), float), c["v"].as_py()
                v = np.frombuffer(v, np.float32 if len(v) == 4 * len(names) * len(centre) else float)
                held[c["side"].as_py()].append(Chunk(names, c["held"].values, v.reshape(len(names), -1).astype(float), centre, c["reach"].as_py()))
        if now is not None:
            yield from look(*held)

    return dealt.sortWithinPartitions("pair", "side", "id").mapInArrow(run, schema)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Components of rows when edges join a and b: in ``label``, each row's least row."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while ((up := label[label]) != label).any():
            label[:] = up
