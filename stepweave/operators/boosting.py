"""Boosted trees by histograms: all folds, and all classes, in the same passes.

Rows are binned once and packed into blocks. Each level of a round's trees takes
one aggregate over (model, class, node, feature, bin) for all models together:
one model leaves out each fold, and a last one learns from all rows. Gradients
are summed as whole numbers, so a histogram, and with it every tree, is the same
for any number and order of blocks. The driver sees histograms and trees only,
whose size is that of the models, not of the rows. Rows that fit one block are
boosted within one task, by the same code.

Loss and trees: logistic loss for two classes, softmax for more (labels 0, 1,
...), second-order leaf values with ridge 1, least child weight 1.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.sources.tables import cut

ROUNDS, DEPTH, RATE, BINS = 200, 4, 0.1, 32
RIDGE, LEAST_WEIGHT = 1.0, 1.0
#: Rows of a block.
BLOCK_ROWS = 50_000
_UNIT = float(1 << 32)


@dataclass
class Trees:
    """One round: for every model and class a tree as a heap of nodes."""

    feature: np.ndarray  # -1: a leaf
    bin: np.ndarray  # rows of a greater bin go right
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, models: int, classes: int, depth: int) -> Trees:
        shape = (models, classes, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape), np.zeros(shape))

    def places(self, m: int, c: int, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row reaches."""
        feature, mark = self.feature[m, c], self.bin[m, c]
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(depth):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (bins[rows, np.maximum(f, 0)] > mark[node]), node)
        return node


@dataclass
class Model:
    features: list[str]
    marks: list[list[float]]
    folds: int
    classes: int
    depth: int
    trees: list[Trees] = field(default_factory=list)

    def margins(self, m: int, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), self.classes))
        for t in self.trees:
            for c in range(self.classes):
                out[:, c] += t.value[m, c][t.places(m, c, bins, self.depth)]
        return out

    def importances(self) -> dict[str, float]:
        """Mean gain of a feature's splits as a share of all features', averaged
        over the models that leave out a fold."""
        total = np.zeros(len(self.features))
        for m in range(self.folds):
            gain, times = np.zeros(len(self.features)), np.zeros(len(self.features))
            for t in self.trees:
                used = t.feature[m] >= 0
                np.add.at(gain, t.feature[m][used], t.gain[m][used])
                np.add.at(times, t.feature[m][used], 1)
            mean = gain / np.maximum(times, 1)
            total += mean / max(mean.sum(), 1e-300)
        return dict(zip(self.features, (total / max(self.folds, 1)).tolist(), strict=True))


def probabilities(margins: np.ndarray) -> np.ndarray:
    """Of label 1 for one margin a row, else of each class."""
    if margins.shape[1] == 1:
        return 1 / (1 + np.exp(-margins))
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class _Block:
    bins: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    grown: int = 0
    margins: np.ndarray | None = None
    slopes: tuple[np.ndarray, np.ndarray] | None = None

    def histogram(self, model: Model, now: Trees, level: int) -> np.ndarray:
        """Sums of gradients and curvatures of the level's nodes, in whole units."""
        n, width = self.bins.shape
        models, classes = model.folds + 1, model.classes
        if self.margins is None or self.grown > len(model.trees):
            self.margins, self.grown, self.slopes = np.zeros((models, classes, n)), 0, None
        while self.grown < len(model.trees):
            t = model.trees[self.grown]
            for m in range(models):
                for c in range(classes):
                    self.margins[m, c] += t.value[m, c][t.places(m, c, self.bins, model.depth)]
            self.grown, self.slopes = self.grown + 1, None
        if self.slopes is None:
            p = np.stack([probabilities(f.T).T for f in self.margins])
            y = self.label[None, :] == (np.array([[1]]) if classes == 1 else np.arange(classes)[:, None])
            learns = (self.fold[None, :] != np.arange(models)[:, None])[:, None, :]
            curve = np.maximum(p * (1 - p) * (1 if classes == 1 else 2), 1e-16)
            self.slopes = tuple(np.rint(np.where(learns, v, 0) * _UNIT).astype(np.int64) for v in (p - y[None], curve))
        nodes, first = 2**level, 2**level - 1
        out = np.zeros((models, classes, nodes, width, BINS, 2), np.int64)
        for m in range(models):
            for c in range(classes):
                place = now.places(m, c, self.bins, level) - first
                on = (place >= 0) & (self.fold != m)
                at = ((place[on, None] * width + np.arange(width)) * BINS + self.bins[on]).ravel()
                for k, s in enumerate(self.slopes):
                    # Exact: halves of a whole number's bits are summed apart.
                    v = np.repeat(s[m, c][on], width)
                    high, low = v >> 20, v & ((1 << 20) - 1)
                    sums = [np.bincount(at, w, nodes * width * BINS) for w in (high, low)]
                    out[m, c, ..., k] = ((sums[0].astype(np.int64) << 20) + sums[1].astype(np.int64)).reshape(nodes, width, BINS)
        return out


def _split(now: Trees, sums: np.ndarray, level: int, rate: float) -> bool:
    """Set the best splits of a level's nodes, and the values of their children."""
    hist = sums / _UNIT
    left = hist.cumsum(axis=4)
    whole = left[:, :, :, :1, -1:, :]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + RIDGE)
    gain = score(left) + score(right) - score(whole)
    gain[(left[..., 1] < LEAST_WEIGHT) | (right[..., 1] < LEAST_WEIGHT)] = -1
    gain = np.round(gain, 9)
    flat = gain.reshape(*gain.shape[:3], -1)
    best = flat.argmax(axis=3)  # the first of equals
    any_split = False
    for m, c, k in np.ndindex(*best.shape):
        node = 2**level - 1 + k
        if level and now.feature[m, c, (node - 1) // 2] < 0:
            continue
        totals = whole[m, c, k, 0, 0]
        if level == 0:
            now.value[m, c, 0] = -rate * totals[0] / (totals[1] + RIDGE)
        if flat[m, c, k, best[m, c, k]] <= 0:
            continue
        f, b = divmod(int(best[m, c, k]), BINS)
        now.feature[m, c, node], now.bin[m, c, node], now.gain[m, c, node] = f, b, flat[m, c, k, best[m, c, k]]
        for child, s in ((2 * node + 1, left[m, c, k, f, b]), (2 * node + 2, right[m, c, k, f, b])):
            now.value[m, c, child] = -rate * s[0] / (s[1] + RIDGE)
        any_split = True
    return any_split


def _grow(model: Model, rounds: int, rate: float, histograms: Callable[[Model, Trees, int], np.ndarray]) -> Model:
    for _ in range(rounds):
        now = Trees.empty(model.folds + 1, model.classes, model.depth)
        for level in range(model.depth):
            if not _split(now, histograms(model, now, level), level, rate):
                break
        model.trees.append(now)
    return model


def _packed_trees(trees: list[Trees]) -> bytes:
    held = io.BytesIO()
    names = ("feature", "bin", "value", "gain")
    np.savez_compressed(held, **{n: np.stack([getattr(t, n) for t in trees]) for n in names})
    return held.getvalue()


def _unpacked_trees(data: bytes) -> list[Trees]:
    held = np.load(io.BytesIO(data))
    return [Trees(*parts) for parts in zip(*(held[n] for n in ("feature", "bin", "value", "gain")), strict=True)]


def _marks(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """Bounds of the bins: a value's bin is the number of bounds below it."""
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 1000 * BINS).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(m or ())) for m in found]


def _binned(batch: pa.RecordBatch, features: list[str], marks: list[list[float]]) -> np.ndarray:
    """Bins of the features; a null counts as the least value."""
    values = [batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]
    return np.stack([np.searchsorted(m, np.nan_to_num(v, nan=-np.inf), side="left").astype(np.uint8) for v, m in zip(values, marks, strict=True)], axis=1) if batch.num_rows else np.zeros((0, len(features)), np.uint8)


#: Margins of the blocks that this worker has seen, so that a round need not begin
#: anew; a worker without them makes them from the trees.
_SEEN: dict[tuple[str, int], _Block] = {}


def fit(rows: DataFrame, features: list[str], label: str = "label", fold: str = "fold", folds: int = 5, classes: int = 2, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, block_rows: int = BLOCK_ROWS) -> Model:
    """Models of the labelled rows that each leave out one fold (0 to folds - 1),
    and one of all rows, the last."""
    model = Model(features, [], folds, 1 if classes == 2 else classes, depth)
    lean = rows.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(label).cast("int").alias("label"), F.col(fold).cast("int").alias("fold"))
    lean = cut(lean.where("label is not null and fold is not null"))
    model.marks = marks = _marks(lean, [f"f{i}" for i in range(len(features))])
    names = [f"f{i}" for i in range(len(features))]
    blocks = max(1, -(-lean.count() // block_rows))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            bins = np.concatenate([_binned(b, names, marks) for b in held])
            parts = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]).astype(np.int32).tobytes() for c in ("label", "fold")]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (bins.tobytes(), *parts)], ["bins", "label", "fold"])

    dealt = lean.coalesce(1) if blocks == 1 else lean.repartition(blocks)
    packed = dealt.mapInArrow(pack, "bins binary, label binary, fold binary")
    width = len(features)

    def block(row: dict) -> _Block:
        return _Block(np.frombuffer(row["bins"], np.uint8).reshape(-1, width), np.frombuffer(row["label"], np.int32), np.frombuffer(row["fold"], np.int32))

    if blocks == 1:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    made = _grow(model, rounds, rate, block(row).histogram)
                    yield pa.RecordBatch.from_arrays([pa.array([_packed_trees(made.trees)], pa.binary())], ["trees"])

        found = packed.mapInArrow(whole, "trees binary").collect()
        model.trees = _unpacked_trees(found[0]["trees"]) if found else []
        return model

    packed = cut(packed.withColumn("id", F.monotonically_increasing_id()))
    run = uuid.uuid4().hex

    def histograms(model: Model, now: Trees, level: int) -> np.ndarray:
        shape = (folds + 1, model.classes, 2**level, width, BINS, 2)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shape, np.int64)
            for old in [k for k in _SEEN if k[0] != run]:
                del _SEEN[old]
            for batch in batches:
                for row in batch.to_pylist():
                    held = _SEEN.setdefault((run, row["id"]), None) or block(row)
                    _SEEN[run, row["id"]] = held
                    sums += held.histogram(model, now, level)
            flat = sums.ravel()
            cells = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(flat[cells])], ["cell", "n"])

        out = np.zeros(shape, np.int64).ravel()
        made = packed.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out[made.column("cell").to_numpy()] = made.column("n").to_numpy()
        return out.reshape(shape)

    return _grow(model, rounds, rate, histograms)


def scored(rows: DataFrame, model: Model, fold: str | None = None) -> DataFrame:
    """``rows`` with p: the probability of label 1, or of each class, by the model
    that leaves out the row's own fold, or by the one of all rows."""
    lean = rows.withColumns({f"_f{i}": F.col(f).cast("double") for i, f in enumerate(model.features)} | {"_m": F.col(fold).cast("int") if fold else F.lit(model.folds)})
    names = [f"_f{i}" for i in range(len(model.features))]
    held = rows.columns
    kind = "double" if model.classes == 1 else "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, of = _binned(batch, names, model.marks), batch.column("_m").to_numpy(zero_copy_only=False)
            p = np.zeros((batch.num_rows, model.classes))
            for m in range(model.folds + 1):
                own = of == m
                if own.any():
                    p[own] = probabilities(model.margins(m, bins[own]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(p[:, 0]) if model.classes == 1 else pa.array(p.tolist(), pa.list_(pa.float64()))], [*held, "p"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return lean.mapInArrow(run, f"{fields}, p {kind}")
