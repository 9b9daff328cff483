"""Histogram boosting against a plain version, in one block and in many."""

import math

import numpy as np
import pytest

from stepweave.operators import boosting

NAMES = ["a", "b", "c"]


def made(n, classes, seed=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.normal(size=n) > 0.4).astype(int)
    if classes == 3:
        y = y + (x[:, 2] > 0.5)
    return x, y, np.arange(n) % 3


def plain(x, y, learns, classes, marks, rounds, depth):
    """Margins of all rows by trees of the rows that learn, one tree at a time."""
    bins = [[sum(m < v for m in marks[j]) for j, v in enumerate(row)] for row in x.tolist()]
    width = 1 if classes == 2 else classes
    margins = [[0.0] * width for _ in bins]

    def leaf(rows, g, h):
        return -boosting.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1)

    def grow(rows, every, g, h, left):
        def score(part):
            return sum(g[i] for i in part) ** 2 / (sum(h[i] for i in part) + 1)

        best = (0.0, None)
        for j in range(len(bins[0])):
            for b in range(len(marks[j]) + 1):
                low, high = [i for i in rows if bins[i][j] <= b], [i for i in rows if bins[i][j] > b]
                if min(sum(h[i] for i in low), sum(h[i] for i in high)) < 1:
                    continue
                gain = round(score(low) + score(high) - score(rows), 9)
                if gain > best[0] + 1e-12:
                    best = (gain, (j, b, low, high))
        if not left or best[1] is None:
            return dict.fromkeys(every, leaf(rows, g, h))
        j, b, low, high = best[1]
        return grow(low, [i for i in every if bins[i][j] <= b], g, h, left - 1) | grow(high, [i for i in every if bins[i][j] > b], g, h, left - 1)

    for _ in range(rounds):
        steps = []
        for c in range(width):
            if width == 1:
                p = [1 / (1 + math.exp(-f[0])) for f in margins]
                hit = [v == 1 for v in y]
            else:
                p = [math.exp(f[c]) / sum(map(math.exp, f)) for f in margins]
                hit = [v == c for v in y]
            g, h = [a - b for a, b in zip(p, hit)], [max(a * (1 - a) * (1 if width == 1 else 2), 1e-16) for a in p]
            steps.append(grow([i for i in range(len(y)) if learns[i]], range(len(y)), g, h, depth))
        margins = [[f + s[i] for f, s in zip(m, steps)] for i, m in enumerate(margins)]
    return np.array(margins)


@pytest.mark.parametrize("classes", [2, 3])
@pytest.mark.parametrize("block_rows", [50_000, 40])
def test_equals_the_plain_version(spark, classes, block_rows):
    x, y, fold = made(150, classes)
    df = spark.createDataFrame([(*r, int(a), int(b), i) for i, (r, a, b) in enumerate(zip(x.tolist(), y, fold))], "a double, b double, c double, label int, fold int, pattern long")
    model = boosting.fit(df, NAMES, folds=3, classes=classes, rounds=3, depth=3, block_rows=block_rows)
    got = {r["pattern"]: r["p"] for r in boosting.scored(df, model, "fold").collect()}
    for m in range(3):
        want = boosting.probabilities(plain(x, y, fold != m, classes, model.marks, 3, 3))
        for i in np.flatnonzero(fold == m):
            assert np.atleast_1d(got[i]) == pytest.approx(want[i], abs=1e-7)
    every = boosting.probabilities(plain(x, y, fold >= 0, classes, model.marks, 3, 3))
    got = {r["pattern"]: r["p"] for r in boosting.scored(df, model).collect()}
    assert all(np.atleast_1d(got[i]) == pytest.approx(every[i], abs=1e-7) for i in got)
    assert sum(model.importances().values()) == pytest.approx(1)


def test_blocks_make_no_difference(spark):
    x, y, fold = made(300, 2)
    rows = [(*r, int(a), int(b)) for r, a, b in zip(x.tolist(), y, fold)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label int, fold int")
    runs = [boosting.fit(df.repartition(n), NAMES, folds=3, rounds=5, block_rows=size) for n, size in ((1, 1000), (4, 100), (7, 33))]
    for other in runs[1:]:
        for s, t in zip(runs[0].trees, other.trees, strict=True):
            assert (s.feature == t.feature).all() and (s.bin == t.bin).all() and (s.value == t.value).all()


def test_odd_rows(spark):
    schema = "a double, b double, c double, label int, fold int"
    none = spark.createDataFrame([], schema)
    model = boosting.fit(none, NAMES, rounds=2)
    assert boosting.scored(none, model).count() == 0
    rows = spark.createDataFrame([(None, 1.0, 2.0, 1, 0), (1.0, None, None, None, 1), (1.0, 1.0, 1.0, 0, None)] * 5, schema)
    got = boosting.scored(rows, boosting.fit(rows, NAMES, rounds=2)).collect()
    assert len(got) == 15 and all(0 <= r["p"] <= 1 for r in got)
