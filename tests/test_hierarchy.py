"""The graph of neighbours, its layout, and clusters of several densities."""

from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.operators import hierarchy, neighbours
from stepweave.sources.tables import cut


def two_densities(seed=3, dims=3):
    """Tight and loose groups, scattered points, copies, null vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims)) * 6
    parts = [c + s * rng.normal(size=(n, dims)) for c, s, n in zip(centres, (0.05, 0.05, 0.4, 0.4, 1.0), (25, 20, 40, 30, 30))]
    points = np.concatenate([*parts, rng.uniform(-12, 12, size=(15, dims))])
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    return [*rows, *((1000 + i, points[3].tolist()) for i in range(7)), (2000, None), (None, points[30].tolist())]


def plain(rows, min_points, min_cluster, levels):
    """The same hierarchy by whole matrices, level by level."""
    known = {}
    for k, v in rows:
        if k is not None and v is not None:
            known.setdefault(tuple(v), []).append(k)
    v, names, copies = np.array(list(known)), [min(k) for k in known.values()], np.array([len(k) for k in known.values()])
    far = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    core = np.array([np.repeat(d, copies)[np.argsort(np.repeat(d, copies), kind="stable")][min(min_points, copies.sum()) - 1] for d in far])
    reach = np.maximum(np.maximum(core[:, None], core[None]), far)
    comps = []
    for level in levels:
        comp = list(range(len(v)))
        for i in range(len(v)):
            stack, comp_i = [i], comp[i]
            if comp_i != i:
                continue
            while stack:
                for j in np.flatnonzero(reach[stack.pop()] <= level):
                    if comp[j] != i and j > i:
                        comp[j] = i
                        stack.append(j)
        comps.append(np.array(comp))

    def parts(level, members):
        """Components of size one level down."""
        found = {}
        for i in members:
            found.setdefault(comps[level][i], []).append(i)
        return [m for m in found.values() if copies[m].sum() >= min_cluster]

    def follow(level, members):
        """(stability, best sum, chosen) of the cluster that begins at a level."""
        stability, top = 0.0, members
        while True:
            step = 0.0 if level == len(levels) - 1 else 1 / levels[level + 1]
            stability += copies[members].sum() * (1 / levels[level] - step)
            below = parts(level - 1, members) if level else []
            if len(below) != 1:
                break
            level, members = level - 1, below[0]
        made = [follow(level - 1, m) for m in below]
        under = sum(b for _, b, _ in made)
        if stability >= under:
            return stability, stability, [(top, stability)]
        return stability, under, [c for _, _, chosen in made for c in chosen]

    def all_rows(level, members):
        """Never chosen: only what it splits into."""
        while level:
            below = parts(level - 1, members)
            if len(below) != 1:
                return [c for m in below for c in follow(level - 1, m)[2]]
            level, members = level - 1, below[0]
        return []

    tops = parts(len(levels) - 1, range(len(v)))
    chosen = all_rows(len(levels) - 1, tops[0]) if len(tops) == 1 else [c for m in tops for c in follow(len(levels) - 1, m)[2]]
    out = {}
    for members, stability in chosen:
        for i in members:
            out[tuple(v[i])] = (min(names[j] for j in members), round(float(stability), 6))
    return sorted(((k, *out.get(tuple(x) if x else None, (-1, None))) for k, x in rows), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def found(frame):
    return sorted(((r["vec_id"], r["cluster_id"], r["stability"] and round(r["stability"], 6)) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("levels", [[0.03 * 1.7**i for i in range(12)], [0.05, 0.5, 1.0, 2.5]])
def test_equals_the_plain_hierarchy(spark, levels):
    rows = two_densities()
    want = plain(rows, 3, 5, levels)
    assert found(hierarchy.clusters(table(spark, rows).repartition(5), levels=levels)) == want
    assert len({c for _, c, _ in want}) >= 4 and (2000, -1, None) in want


def test_small_blocks_find_the_same_groups(spark):
    """Blocks of 64 vectors: an inexact graph, whose groups must still be those."""
    rows = [r for r in two_densities(5) if r[1] is not None and r[0] is not None][:145]
    levels = [0.03 * 1.7**i for i in range(12)]
    want = {k: c for k, c, _ in plain(rows, 3, 5, levels)}
    got = {k: c for k, c, _ in found(hierarchy.clusters(table(spark, rows), levels=levels, block=64))}
    together = lambda c: np.array([[c[i] == c[j] and c[i] != -1 for i in range(145)] for j in range(145)])
    assert (together(want) == together(got)).mean() > 0.97


def test_odd_tables(spark):
    none = table(spark, [])
    assert hierarchy.clusters(none).count() == 0
    assert found(hierarchy.clusters(table(spark, [(1, None), (2, [0.0]), (3, [1.0])]))) == [(1, -1, None), (2, -1, None), (3, -1, None)]
    same = table(spark, [(i, [1.0, 2.0]) for i in range(9)])
    assert {c for _, c, _ in found(hierarchy.clusters(same))} == {-1}  # one cluster of all rows is none


def test_graph_and_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 32))
    v = (centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 32))).tolist()
    points = cut(neighbours.nodes(table(spark, list(enumerate(v))), "vec_id", "embedding"))
    made = cut(neighbours.graph(points, 10))
    assert made.count() == 3000
    row = neighbours.recall(points, made, 10, most=200).first()
    assert row["queries"] == 200 and row["recall"] >= 0.9
    far = neighbours.distances(np.array(v[:40]))
    few = cut(neighbours.nodes(table(spark, list(enumerate(v[:40]))), "vec_id", "embedding"))
    for r in neighbours.graph(few, 5).collect():
        assert [x["b"] for x in r["near"]] == [int(i) for i in np.argsort(far[r["a"]])[1:6]]


def test_layout_keeps_groups_apart(spark):
    rng = np.random.default_rng(7)
    v = np.concatenate([c + 0.1 * rng.normal(size=(40, 8)) for c in 3 * rng.normal(size=(4, 8))])
    points = cut(neighbours.nodes(table(spark, list(enumerate(v.tolist()))), "vec_id", "embedding"))
    made = cut(neighbours.graph(points, 8))
    xy = {r["node"]: r["xy"] for r in neighbours.layout(points, made).collect()}
    places = np.array([xy[i] for i in range(160)])
    far = neighbours.distances(places)
    np.fill_diagonal(far, np.inf)
    assert np.mean([far[i].argmin() // 40 == i // 40 for i in range(160)]) > 0.95 and np.isfinite(places).all()
    assert neighbours.layout(points.where("false"), made.where("false")).count() == 0


def test_rounds_of_a_long_chain(spark, monkeypatch):
    """Components of a chain in no order take rounds by the logarithm of its length."""
    ids = np.random.default_rng(3).permutation(2000).tolist()
    links = spark.createDataFrame([p for a, b in pairwise(ids) for p in ((a, b), (b, a))], "a long, b long")
    written = []
    monkeypatch.setattr(hierarchy, "cut", lambda df: written.append(1) or cut(df))
    rows = hierarchy._roots(links, spark.createDataFrame([(i, i) for i in [*ids, 5000]], "id long, root long")).collect()
    assert {r["id"]: r["root"] for r in rows} == {i: 0 for i in ids} | {5000: 5000}
    assert len(written) <= 14


@pytest.mark.parametrize("block", [16, 100])
def test_no_edge_is_lost_between_blocks(spark, block):
    """However few vectors are compared at once: the exact hierarchy, and a tree of
    the least weight of all pairs."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 8)) * 2
    v = centres[rng.integers(0, 12, 300)] + rng.uniform(0.2, 1.0, size=(300, 1)) * rng.normal(size=(300, 8))
    rows = list(enumerate(v.tolist())) + [(1000, v[5].tolist()), (1001, v[5].tolist())]
    levels = [0.4 * 1.3**i for i in range(9)]
    want = plain(rows, 3, 5, levels)
    assert found(hierarchy.clusters(table(spark, rows), levels=levels, block=block)) == want
    assert len({c for _, c, _ in want}) >= 4
    points = cut(neighbours.nodes(table(spark, rows), "vec_id", "embedding").withColumn("core", F.lit(0.0)))
    tree = {tuple(sorted((r["a"], r["b"]))): r["w"] for r in hierarchy.spanning_tree(points, block).collect()}
    far = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    best, total, out = far[0].copy(), 0.0, np.zeros(300, bool)
    out[0] = True
    for _ in range(299):
        at = np.where(out, np.inf, best).argmin()
        total, out[at] = total + best[at], True
        best = np.minimum(best, far[at])
    assert len(tree) == 299 and abs(sum(tree.values()) - total) < 1e-9
