"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
texts. A text that compresses better with the good dictionary resembles the
good texts: the difference of its two compressed sizes, divided by the larger
one, is turned into a probability by a logistic calibration, together with the
like difference of its worst chunk and that to the text's own size, which tells
repetitive texts, as both dictionaries serve them alike.

It is fitted on bounded samples, both parameters of ``fit``: at most
SAMPLE_PER_CLASS labelled rows of each class, and for each dictionary at most
PIECES_PER_CLASS kilobyte pieces of all those of these rows' whole texts.

Defined cases: null and empty texts have no chunks and get the calibrated score
of a zero difference; a text of any length is compressed whole, chunk by chunk;
labels with null fields are left out; no labels, or labels of one class, give
the smoothed prior; keys are of any type; samples follow hashes, and ties go by
key or by content; repeated rows get equal scores each; an empty table gives no
row; other columns of the inputs are kept aside and never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import bounded, fit_logistic, sigmoid, slices

#: Bounds of the sample of labelled rows that the model is fitted on.
SAMPLE_PER_CLASS = 4000
CHUNK_BYTES = 1024
#: Bound of the pieces that a dictionary is trained on.
PIECES_PER_CLASS = 16_000
DICTIONARY_BYTES = 110_000
#: Size differences of a text, and the logarithm of the share of its size that
#: prose keeps at least: below it the slope may be another.
FEATURES, LEAST_KEPT = 5, -1.5
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    beta: tuple[float, ...]


def _chunks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]


class _Sizer:
    """Compressed sizes of a text's chunks under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def compressor(raw: bytes):
            options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if raw:
                options["dict_data"] = zstandard.ZstdCompressionDict(raw)
            return zstandard.ZstdCompressor(**options)

        self.pair = compressor(good), compressor(bad)

    def features(self, text: str | None) -> list[float]:
        chunks = _chunks(text)
        if not chunks:
            return [0.0] * FEATURES
        good, bad = ([len(c.compress(x)) for x in chunks] for c in self.pair)
        g, b, n = sum(good), sum(bad), sum(map(len, chunks))
        diff = (b - g) / max(b, g)
        low = min((y - x) / max(x, y) for x, y in zip(good, bad, strict=True))
        kept = math.log(g / n)
        return [diff, min(diff, 0.0), low, kept, min(kept - LEAST_KEPT, 0.0)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS, pieces_per_class: int = PIECES_PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled texts of each class (those with the
    smallest hash of their key): half for the dictionaries, half for the
    calibration, weighted back to the classes' shares of all labels."""
    import zstandard

    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("_k"), (F.col(label) > 0).cast("int").alias("_y")).dropna()
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = F.xxhash64("_k", F.lit(17))
    picked = []
    for y in sorted(counts):
        picked += known.where(F.col("_y") == y).distinct().orderBy(rank, "_k").limit(per_class).collect()
    if not picked:
        return Model(b"", b"", (0.0,) * (FEATURES + 1))
    # At most 2 * per_class rows of a key and two integers each.
    sample = spark.createDataFrame([(r["_k"], r["_y"], i % 2) for i, r in enumerate(picked)], f"_k {labels.schema[key].dataType.simpleString()}, _y int, _half int")
    rows = bounded(docs).select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(sample), "_k")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"y": [], "piece": []}
            for y, t in zip(*(batch.column(c).to_pylist() for c in ("_y", "text")), strict=True):
                for chunk in _chunks(t):
                    out["y"].append(y)
                    out["piece"].append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(out["y"], pa.int32()), pa.array(out["piece"], pa.binary())], ["y", "piece"])

    cut = rows.where("_half = 0").mapInArrow(pieces, "y int, piece binary").where(F.octet_length("piece") >= 16)
    made = {}
    for y in (1, 0):
        got = cut.where(F.col("y") == y).orderBy(F.xxhash64("piece"), "piece").limit(pieces_per_class).collect()
        parts = [bytes(r["piece"]) for r in got]
        try:
            made[y] = zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
        except (zstandard.ZstdError, ValueError):
            made[y] = b"".join(parts)[-DICTIONARY_BYTES:]  # too few pieces: their own bytes serve
    good, bad = made[1], made[0]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = _Sizer(good, bad)
        for batch in batches:
            x = [sizer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    seen = rows.where("_half = 1").mapInArrow(measured, "y int, x array<double>").collect()
    y = np.array([r["y"] for r in seen], float)
    x = np.array([r["x"] for r in seen], float).reshape(len(seen), FEATURES)
    share = {k: counts[k] / max(1, (y == k).sum()) for k in counts}
    w = np.array([share[int(v)] for v in y])
    w *= len(w) / max(w.sum(), 1e-9)
    return Model(good, bad, tuple(fit_logistic(x, y, w)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and score (0 to 1, higher: good likelier) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer, beta = _Sizer(model.good, model.bad), np.array(model.beta)
        for whole in batches:
            for batch in slices(whole):
                x = np.array([sizer.features(t) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, FEATURES)
                p = sigmoid(x @ beta[:-1] + beta[-1])
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(p)], [key, "score"])

    return bounded(docs).select(key, F.col(text).alias("text")).mapInArrow(scored, f"`{key}` {kind}, score double")


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least the threshold, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer, beta = _Sizer(model.good, model.bad), np.array(model.beta)
        for whole in batches:
            for batch in slices(whole, text):
                x = np.array([sizer.features(t) for t in batch.column(text).to_pylist()]).reshape(batch.num_rows, FEATURES)
                yield batch.filter(pa.array(sigmoid(x @ beta[:-1] + beta[-1]) >= threshold))

    return bounded(docs).mapInArrow(run, docs.schema)
