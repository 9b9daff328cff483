"""Density clusters against a plain version, and on odd inputs."""

import time

import numpy as np
import pytest

from stepweave.operators import density, pairs
from stepweave.sources.tables import cut


def plain(rows, radius, least):
    known = [(k, np.array(v)) for k, v in rows if k is not None and v is not None]
    near = {k: [j for j, w in known if np.sqrt(((v - w) ** 2).sum()) <= radius] for k, v in known}
    core = {k for k in near if len(near[k]) >= least}
    root = {k: k for k in core}
    while True:
        new = {k: min(root[j] for j in near[k] if j in core) for k in core}
        if new == root:
            break
        root = new
    return {k: (k in core, min((root[j] for j in near.get(k, ()) if j in core), default=-1)) for k, _ in rows}


def found(df, radius, least):
    return {r["vec_id"]: (r["core"], r["cluster_id"]) for r in density.clusters(df, radius, least).collect()}


@pytest.mark.parametrize("radius", [0.3, 1.5])
def test_equals_plain(spark, radius):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 4)) * 3
    points = np.concatenate([c + 0.2 * rng.normal(size=(30, 4)) for c in centres] + [rng.normal(size=(40, 4)) * 5])
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(1000 + i, points[7].tolist()) for i in range(20)] + [(2000, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain(rows, radius, 5)
    assert len({c for _, c in want.values()}) > 3 and want[2000] == (False, -1)
    assert found(df, radius, 5) == want


def test_odd_inputs(spark):
    schema = "vec_id long, embedding array<double>, pivot string"
    assert found(spark.createDataFrame([], schema), 1.0, 2) == {}
    assert found(spark.createDataFrame([(1, None, "a"), (None, [0.0], "b"), (3, [0.0], "c")], schema), 1.0, 1) == {1: (False, -1), None: (True, 3), 3: (True, 3)}
    with pytest.raises(ValueError, match="radius"):
        density.clusters(spark.createDataFrame([], schema), 0.0, 2)


def test_vectors_in_many_chunks(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([c + 0.4 * rng.normal(size=(20, 3)) for c in rng.normal(size=(5, 3)) * 3])
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["core"], r["cluster_id"]) for r in density.clusters(df, 0.6, 4, chunk=7).collect()}
    assert got == plain(rows, 0.6, 4) and len(set(got.values())) > 3


def test_groups_of_many_partitions(spark):
    """Rows that are dealt over more partitions than there are groups."""
    rows = [(i, 1, [float(i), 0.5]) for i in range(300)]
    made = pairs.packed(spark.createDataFrame(rows, "node long, copies long, v array<double>").repartitionByRange(50, "node"), "copies", 16)
    held = sorted((r["group"], min(r["names"]), len(r["names"])) for r in made.collect())
    assert {g for g, _, _ in held} == set(range(12)) and sum(n for _, _, n in held) == 300
    assert [k for _, k, _ in held] == sorted(k for _, k, _ in held)


def shuffled(spark):
    """Bytes that all tasks so far have written to shuffles."""
    time.sleep(1)  # the store of figures lags behind
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_what_is_dealt_grows_with_the_vectors(spark, monkeypatch):
    """Vectors all near each other: pairs of chunks grow with the square of their
    number; bytes dealt and links stored must not."""
    links = []

    def noted(df):
        made = cut(df)
        if made.columns == ["a", "b"]:
            links.append(made.count())
        return made

    monkeypatch.setattr(density, "cut", noted)
    sizes = []
    for n in (400, 1600):
        v = 0.1 * np.random.default_rng(n).normal(size=(n, 32))
        df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
        before = shuffled(spark)
        got = density.clusters(df, 2.0, 4, chunk=16).collect()
        sizes.append(shuffled(spark) - before)
        assert len(got) == n and {(r["core"], r["cluster_id"]) for r in got} == {(True, 0)}
        assert links[-1] <= 13 * n
    assert sizes[1] < 6 * sizes[0]
