"""Clusters of several densities: a tree of density clusters, cut by stability.

Two vectors reach each other at the greatest of their distance and of both core
distances (to the ``min_points``-th row, the vector itself included). Both come of
comparing all vectors, by pairs of groups (``pairs``). A minimum spanning tree of all
is one of the trees of the parts that cover all edges: each two groups hand on the
edges of their own tree, fewer than their rows, and rounds over these edges alone give
the whole one: each component takes its least edge to another, and components are
joined along these edges.

The tree is read at ``levels`` distances at once: components of the edges up to
each level follow from one run of joins over (level, node), not level by level.
A component of ``min_cluster`` rows or more is a cluster; it goes on through the
levels below until it splits into two or more of that size. Its stability is the
sum over levels of its rows times the step of 1 / distance; clusters are chosen
so that the sum of stabilities is greatest, never the one of all rows. Rows of no chosen
cluster are noise, -1; a cluster is named by its least node.

Results are those of the exact hierarchy with distances rounded up to a level.
Comparisons grow with the square of the number of different vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.operators import neighbours, pairs
from stepweave.operators.pairs import CHUNK, Chunk
from stepweave.sources.tables import cut

LEVELS = 32
#: Edges that a task holds before it keeps those of their tree alone.
EDGES = 1 << 20


def _roots(pairs: DataFrame, now: DataFrame) -> DataFrame:
    """id and root, the least id of each component: ``now`` has every id as its
    own root, ``pairs`` are links (a, b) both ways. Ids may be structs.

    In each round an id, and its root too, moves to the least root of a root that a
    neighbour has. As roots are hooked and not ids alone, rounds grow with the
    logarithm of a chain's length, not with the length."""
    now = cut(now)
    while True:
        now = now.join(now.select(F.col("id").alias("root"), F.col("root").alias("up")), "root")
        around = pairs.join(now.select(F.col("id").alias("b"), "up"), "b").groupBy("a").agg(F.min("up").alias("low"))
        least = now.join(around.withColumnRenamed("a", "id"), "id", "left").select("id", "root", F.least("up", F.coalesce("low", "up")).alias("via"))
        hooks = least.where("via < root").groupBy(F.col("root").alias("id")).agg(F.min("via").alias("hook"))
        moved = cut(least.join(hooks, "id", "left").select("id", F.col("root").alias("was"), F.least("via", F.coalesce("hook", "via")).alias("root")))
        now = moved.select("id", "root")
        if moved.where("root <> was").isEmpty():
            return now


def cores(points: DataFrame, made: DataFrame, min_points: int) -> DataFrame:
    """``points`` with core, the distance within which min_points rows lie."""
    nearer = F.transform(F.coalesce("near", F.array().cast(made.schema["near"].dataType)), lambda x, i: F.struct(x["distance"].alias("distance"), F.aggregate(F.slice("near", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, y: s + y["copies"]).alias("rows")))
    enough = F.filter(nearer, lambda x: x["rows"] + F.col("copies") >= min_points)
    far = F.coalesce(F.try_element_at(enough, F.lit(1))["distance"], F.try_element_at(nearer, F.lit(-1))["distance"], F.lit(0.0))
    return points.join(made.withColumnRenamed("a", "node"), "node", "left").withColumn("core", F.when(F.col("copies") >= min_points, 0.0).otherwise(far)).drop("near")


def _squares(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Squares of all distances of v and w, good enough to choose by."""
    middle = v.mean(axis=0)
    middle = np.where(np.isfinite(middle), middle, 0.0)
    x, y = v - middle, w - middle
    far = np.c_[x, (x * x).sum(axis=1), np.ones(len(x))] @ np.c_[-2 * y, np.ones(len(y)), (y * y).sum(axis=1)].T
    # What is no number is as far as can be.
    return np.clip(far, 0, None, out=far) if np.isfinite(far.sum()) else np.fmax(np.fmin(far, np.finfo(float).max), 0)


def nearest(points: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """a and near, the (distance, b, copies) of a node's k nearest other nodes, by
    distance; all of them where there are fewer. ``points`` are ``neighbours.nodes``."""
    kind = points.schema["node"].dataType.simpleString()
    near = f"array<struct<distance:double,b:{kind},copies:long>>"
    some = k + 4  # a few more by the rough distances; the exact ones then order them

    def keep(best: np.ndarray, at: np.ndarray, far: np.ndarray, start: int) -> None:
        rows = np.flatnonzero(far.min(axis=1) < best.max(axis=1))
        if len(rows):
            few = min(some, far.shape[1])
            found = far[rows]
            columns = np.argpartition(found, few - 1, axis=1)[:, :few]
            both = np.c_[best[rows], np.take_along_axis(found, columns, axis=1)]
            order = np.argpartition(both, some - 1, axis=1)[:, :some]
            best[rows] = np.take_along_axis(both, order, axis=1)
            at[rows] = np.take_along_axis(np.c_[at[rows], start + columns], order, axis=1)

    def look(a: list[Chunk], b: list[Chunk]) -> Iterator[pa.RecordBatch]:
        chunks, starts = a + b, pairs.starts(a + b)
        held = [(np.full((len(c.names), some), np.inf), np.zeros((len(c.names), some), np.int64)) for c in chunks]
        for i, j in pairs.between(a, b):
            to = len(a) + j if b else j
            far = _squares(chunks[i].v, chunks[to].v)
            if i == to:
                np.fill_diagonal(far, np.inf)
            keep(*held[i], far, starts[to])
            if i != to:
                keep(*held[to], far.T, starts[i])
        names, copies = (pa.concat_arrays([getattr(c, x) for c in chunks]) for x in ("names", "held"))
        v = np.concatenate([c.v for c in chunks])
        for c, (best, at) in zip(chunks, held, strict=True):
            exact = np.where(np.isinf(best), np.inf, np.sqrt(((c.v[:, None, :] - v[at]) ** 2).sum(axis=2)))
            order = np.argsort(exact, axis=1, kind="stable")[:, :k]
            exact, at = np.take_along_axis(exact, order, axis=1), np.take_along_axis(at, order, axis=1)
            known = np.isfinite(exact)
            flat = pa.array(at[known])
            members = pa.StructArray.from_arrays([pa.array(exact[known]), names.take(flat), copies.take(flat)], ["distance", "b", "copies"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, known.sum(axis=1).cumsum()].astype(np.int32)), members)
            yield pa.RecordBatch.from_arrays([c.names, lists], ["a", "near"])

    found = pairs.met(pairs.packed(pairs.placed(points, "copies", chunk), "copies", chunk), None, look, f"a {kind}, near {near}")
    # At most k candidates a node and group.
    return found.groupBy("a").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _grown(far: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges of a minimum spanning tree of rows and columns, numbered on
    from the rows, or of rows alone where both are the same: from node to node."""
    n = len(far)
    size = n if same else n + far.shape[1]
    back = far if same else np.ascontiguousarray(far.T)
    # Nodes of the tree stay at inf: out is added to what reaches them.
    best, via, out = np.full(size, np.inf), np.zeros(size, np.int64), np.zeros(size)
    ends, at = np.zeros((2, size - 1), np.int64), 0
    for step in range(size - 1):
        best[at] = out[at] = np.inf
        row = far[at] if at < n else back[at - n]
        start = 0 if same or at >= n else n
        row = row + out[start : start + len(row)]
        less = start + (row < best[start : start + len(row)]).nonzero()[0]
        best[less] = row[less - start]
        via[less] = at
        at = int(best.argmin())
        ends[:, step] = at, via[at]
    return ends[0], ends[1]


def _lightest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest of n rows."""
    order = np.argsort(w, kind="stable")
    label, chosen = np.arange(n), []
    while True:
        x, y = label[a[order]], label[b[order]]
        order, x, y = order[x != y], x[x != y], y[x != y]
        if not len(order):
            return np.unique(np.concatenate(chosen)) if chosen else order
        first = np.full(n, len(order))
        for ends in (x, y):  # the last that is written is the first in order
            mine = np.full(n, len(order))
            mine[ends[::-1]] = np.arange(len(order))[::-1]
            first = np.minimum(first, mine)
        picked = order[np.unique(first[first < len(order)])]
        chosen.append(picked)
        pairs.joined(label, a[picked], b[picked])


def _edges(a: list[Chunk], b: list[Chunk]) -> Iterator[pa.RecordBatch]:
    """a, b and w of the edges of a minimum spanning tree of two groups, of the edges
    between them, or of one group; ``held`` is the core distance."""
    chunks, starts = a + b, pairs.starts(a + b)
    core = [c.held.to_numpy() for c in chunks]
    none = np.zeros(0, np.int64)
    held, waiting = (none, none, np.zeros(0)), []

    def lightest() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, q, w = (np.concatenate(x) for x in zip(held, *waiting, strict=True))
        kept = _lightest(starts[-1], p, q, w)
        return p[kept], q[kept], w[kept]

    for i, j in pairs.between(a, b):
        to = len(a) + j if b else j
        far = _squares(chunks[i].v, chunks[to].v)
        np.maximum(far, (core[i] ** 2)[:, None], out=far)
        np.maximum(far, (core[to] ** 2)[None, :], out=far)
        p, q = _grown(far, i == to)
        n = len(far)
        rows, columns = (p, q) if i == to else (np.minimum(p, q), np.maximum(p, q) - n)
        waiting.append((starts[i] + rows, starts[to] + columns, far[rows, columns]))
        if sum(len(x[0]) for x in waiting) > EDGES:
            held, waiting = lightest(), []
    p, q, _ = lightest()
    names, v, core = pa.concat_arrays([c.names for c in chunks]), np.concatenate([c.v for c in chunks]), np.concatenate(core)
    for at in range(0, len(p), 1 << 14):
        x, y = p[at : at + (1 << 14)], q[at : at + (1 << 14)]
        w = np.maximum(np.maximum(core[x], core[y]), np.sqrt(((v[x] - v[y]) ** 2).sum(axis=1)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), names.take(pa.array(y)), pa.array(w)], ["a", "b", "w"])


def spanning_tree(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """a, b and w of the edges of a minimum spanning tree; ``points`` have core.
    Among equal weights there may be edges to spare: they join what is joined."""
    kind = points.schema["node"].dataType.simpleString()
    found = pairs.met(pairs.packed(pairs.placed(points, "core", chunk), "core", chunk), None, _edges, f"a {kind}, b {kind}, w double")
    edges, tree = cut(found.where("not isnan(w)").select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y"))), None
    while True:
        ends = edges.unionByName(edges.select("a", "b", "w", F.col("y").alias("x"), F.col("x").alias("y")))
        least = cut(ends.groupBy("x").agg(F.min(F.struct("w", "a", "b", "y")).alias("e")).select("x", "e.*"))
        if least.isEmpty():
            return tree if tree is not None else least.select("a", "b", "w")
        tree = cut(least.select("a", "b", "w") if tree is None else tree.unionByName(least.select("a", "b", "w")))
        links = cut(least.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(least.select(F.col("y").alias("a"), F.col("x").alias("b"))))
        roots = _roots(links, links.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("root")))
        # Every component that has an edge is among the roots.
        moved = edges.join(roots.select(F.col("id").alias("x"), F.col("root").alias("_x")), "x").join(roots.select(F.col("id").alias("y"), F.col("root").alias("_y")), "y")
        edges = cut(moved.where("_x <> _y").select("a", "b", "w", F.col("_x").alias("x"), F.col("_y").alias("y")))


def _grid(tree: DataFrame, levels: int) -> list[float]:
    """Distances in equal ratios from the least edge above 0 to the greatest."""
    low, high = tree.agg(F.min(F.when(F.col("w") > 0, F.col("w"))), F.max("w")).first()
    if high is None or high <= 0:
        return [1.0]
    steps = np.geomspace(low, high, max(2, levels)) if low < high else np.array([high])
    steps[-1] = high
    return [float(s) for s in steps]


def clusters(vectors: DataFrame, min_points: int = 3, min_cluster: int = 5, levels: int | Sequence[float] = LEVELS, key: str = "vec_id", vector: str = "embedding", block: int = CHUNK) -> DataFrame:
    """Key, cluster_id and stability of every row's cluster. Null vectors and keys
    are noise, with no stability. ``block`` vectors are compared at once."""
    points = cut(neighbours.nodes(vectors, key, vector))
    made = nearest(points, min_points, block)
    points = cut(cores(points, made, min_points))
    tree = spanning_tree(points, block)
    grid = _grid(tree, levels) if isinstance(levels, int) else sorted(levels)
    named = _chosen(points, tree, grid, min_cluster)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    of = points.select("v", "node").join(named, "node").select("v", "cluster_id", "stability")
    noise = F.lit(-1).cast(rows.schema["key"].dataType)
    # A null key has no node of its own, yet its vector may be another's.
    return rows.join(of, "v", "left").select(F.col("key").alias(key), F.coalesce("cluster_id", noise).alias("cluster_id"), "stability")


def _chosen(points: DataFrame, tree: DataFrame, grid: list[float], min_cluster: int) -> DataFrame:
    """node, cluster_id and stability of the nodes in chosen clusters."""
    n = len(grid)
    # The first level that an edge is part of; a tree of more than the last is cut there.
    first = F.size(F.filter(F.lit(grid), lambda d: d < F.col("w")))
    spans = tree.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(F.col("level") >= first)
    at = lambda c: F.struct("level", F.col(c).alias("node"))
    links = cut(spans.select(at("a").alias("a"), at("b").alias("b")).unionByName(spans.select(at("b").alias("a"), at("a").alias("b"))))
    ids = links.select(F.col("a").alias("id")).distinct()
    roots = _roots(links, ids.select("id", F.col("id").alias("root")))
    each = points.select("node", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("level"))
    roots = roots.select(F.col("id.level").alias("level"), F.col("id.node").alias("node"), F.col("root.node").alias("root"))
    member = each.join(roots, ["level", "node"], "left").select("level", "node", F.coalesce("root", "node").alias("root"))
    sizes = member.join(points.select("node", "copies"), "node").groupBy("level", "root").agg(F.sum("copies").alias("rows")).where(F.col("rows") >= min_cluster)
    member = cut(member.join(sizes, ["level", "root"]))
    big = member.select("level", "root", "rows").distinct()
    # The component one level up; a root's own membership there names it.
    up = member.select((F.col("level") - 1).alias("level"), F.col("node").alias("root"), F.col("root").alias("up"))
    big = big.join(up, ["level", "root"], "left")
    siblings = big.where("up is not null").groupBy("level", "up").agg(F.count(F.lit(1)).alias("siblings"))
    big = cut(big.join(siblings, ["level", "up"], "left"))
    # A component goes on the cluster above it if it is that one's only part of size.
    step = F.when(F.col("level") == n - 1, 0.0).otherwise(1 / F.get(F.lit(grid), F.col("level") + 1))
    big = big.withColumn("mass", F.col("rows") * (1 / F.get(F.lit(grid), F.col("level")) - step))
    node = lambda level, root: F.struct(level.alias("level"), root.alias("node"))
    own, above = node(F.col("level"), F.col("root")), node(F.col("level") + 1, F.col("up"))
    chain = F.when(F.col("siblings") == 1, above).otherwise(own)
    top = cut(big.select(own.alias("id"), chain.alias("via"), F.when(F.col("up").isNotNull(), above).alias("above"), "mass"))
    heads = top.select("id", F.col("via").alias("head"))
    while True:  # pointers to the head of each chain, twice as far in each round
        moved = cut(heads.join(heads.select(F.col("id").alias("head"), F.col("head").alias("next")), "head").select("id", F.col("next").alias("head"), (F.col("next") != F.col("head")).alias("moved")))
        heads = moved.select("id", "head")
        if moved.where("moved").isEmpty():
            break
    mass = top.join(heads, "id").groupBy("head").agg(F.sum("mass").alias("stability"))
    parents = top.where("id = via and above is not null").join(heads.select(F.col("id").alias("above"), F.col("head").alias("parent")), "above").select(F.col("id").alias("head"), "parent")
    tree_of = cut(mass.join(parents, "head", "left").select("head", "parent", "stability"))
    best = _best(tree_of)
    chosen = best.where("chosen").select("head", "stability")
    held = member.select(F.struct("level", F.col("root").alias("node")).alias("head"), "node").join(chosen, "head")
    return held.groupBy("node").agg(F.max(F.struct(F.col("head.level").alias("level"), F.col("head.node").alias("cluster_id"), "stability")).alias("m")).select("node", "m.cluster_id", "m.stability")


def _best(tree_of: DataFrame) -> DataFrame:
    """head, stability and whether a cluster is chosen: its stability is at least
    that of the best choice among its parts, and no cluster above it is chosen;
    never the one that holds all, where there is one."""
    single = tree_of.where("parent is null").limit(2).count() == 1
    tree_of = tree_of.withColumn("whole", F.col("parent").isNull() & F.lit(single))
    waiting = tree_of
    done = None
    while True:  # from the leaves up: clusters whose parts are all done
        parts = waiting.where("parent is not null").select(F.col("parent").alias("head")).distinct()
        ready = waiting.join(parts, "head", "left_anti")
        if done is not None:
            below = done.where("parent is not null").groupBy(F.col("parent").alias("head")).agg(F.sum("worth").alias("below"))
            ready = ready.join(below, "head", "left")
        else:
            ready = ready.withColumn("below", F.lit(None).cast("double"))
        keeps = ~F.col("whole") & (F.col("stability") >= F.coalesce("below", F.lit(0.0)))
        ready = ready.withColumns({"keeps": keeps, "worth": F.when(keeps, F.col("stability")).otherwise(F.coalesce("below", F.lit(0.0)))})
        ready = cut(ready.select("head", "parent", "stability", "keeps", "worth"))
        if ready.isEmpty():
            break
        done = ready if done is None else cut(done.unionByName(ready))
        waiting = cut(waiting.join(ready.select("head"), "head", "left_anti"))
    if done is None:
        return tree_of.withColumn("chosen", F.lit(False))
    # From the roots down: a cluster is open while none above it is chosen.
    out = cut(done.where("parent is null").withColumn("chosen", F.col("keeps")))
    front = out
    while True:
        opened = front.where("not chosen").select(F.col("head").alias("parent"))
        front = cut(done.join(opened, "parent").select("head", "parent", "stability", "keeps", "worth", F.col("keeps").alias("chosen")))
        if front.isEmpty():
            return out
        out = cut(out.unionByName(front))
