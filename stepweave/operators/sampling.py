"""Stratified samples in a seeded, reproducible order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from stepweave.sources.tables import cut


def seeded(key: str, seed: int) -> Column:
    """A fixed pseudo-random order of keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def stratified(rows: DataFrame, cells: list[str], target: int, key: str = "pattern", seed: int = 42) -> DataFrame:
    """``target`` rows: an equal share of each cell (one at least), filled up
    from the rest in seeded order, or cut in that order.

    A cell's rows beyond its first ``target`` can't be picked, so each task
    hands on no more of them, whatever share of the rows the cell holds. Only keys,
    which tell rows apart, and cells are put in order; the rows are fetched then."""
    place = F.row_number().over(W.Window.partitionBy(*cells).orderBy("_order", key))
    ranked = cut(rows.select(key, *cells).withColumn("_order", seeded(key, seed)).withColumn("_place", place).where(F.col("_place") <= target))
    share = ranked.where("_place = 1").agg(F.greatest(F.lit(1), F.floor(F.lit(target) / F.greatest(F.count(F.lit(1)), F.lit(1)))).alias("_share"))
    late = ranked.join(F.broadcast(share)).withColumn("_late", F.col("_place") > F.col("_share"))  # one row
    picked = late.orderBy("_late", "_order", key).limit(target).select(key)
    return rows.join(F.broadcast(picked), key, "left_semi")  # target rows


def two_strata(rows: DataFrame, cells: list[str], quotas: dict[str, int], stratum: str = "stratum", key: str = "pattern", seed: int = 42) -> DataFrame:
    """A stratified sample of each stratum, of its own size."""
    parts = [stratified(rows.where(F.col(stratum) == name), cells, n, key, seed) for name, n in quotas.items()]
    return reduce(DataFrame.unionByName, parts)


def representatives(pool: DataFrame, slice_rows: DataFrame, suites: DataFrame) -> DataFrame:
    """``pool`` (a bounded sample) with one example place of each pattern: the
    first in order of slices, places outside spec-suite files before others."""
    wanted = slice_rows.join(F.broadcast(pool.select("pattern")), "pattern", "left_semi")
    marked = wanted.join(suites.where("is_spec_suite").select("repo_slug", "file_path", F.lit(True).alias("_hit")), ["repo_slug", "file_path"], "left")
    first = marked.groupBy("pattern").agg(F.min(F.struct(F.coalesce("_hit", F.lit(False)).alias("on_suite"), "repo_slug", "file_path", "scenario", "position_start")).alias("e"))
    places = first.select("pattern", F.col("e.repo_slug").alias("example_repo"), F.col("e.file_path").alias("example_file"), F.col("e.scenario").alias("example_scenario"), F.col("e.on_suite").alias("example_on_outlier_file"))
    return pool.join(places, "pattern", "left")


#: The pilot's quotas (name, condition, order, rows, one for each L).
PILOT = [
    ("RQ3-cross-repo", "stratum = 'real_signal' AND scope_repo = 'RQ3' AND L >= 4 AND support_total >= 6", ["n_distinct_repos", "L"], 2, False),
    ("RQ2-within-repo", "stratum = 'real_signal' AND scope_repo = 'RQ2' AND L >= 3 AND max_within_repo_files >= 3", ["max_within_repo_files"], 2, False),
    ("RQ1-within-file", "stratum = 'real_signal' AND scope_repo = 'RQ1' AND max_within_file_recurrence >= 2", ["max_within_file_recurrence"], 2, True),
    ("L=2-weak-candidate", "stratum = 'real_signal' AND L = 2 AND support_total <= 5", [], 1, False),
    ("long-L", "stratum = 'real_signal' AND L >= 10", ["L"], 1, False),
    ("spec-dominated", "stratum = 'spec_dominated'", ["support_total"], 1, False),
    ("borderline", "stratum = 'real_signal' AND L BETWEEN 4 AND 7 AND support_total BETWEEN 5 AND 20", [], 1, False),
]


def pilot(pool: DataFrame, quotas: list[tuple[str, str, list[str], int, bool]] = PILOT, key: str = "pattern") -> DataFrame:
    """A few diverse rows of a bounded ``pool``, by quota; a row can serve two."""
    parts = []
    for name, condition, measures, n, apart in quotas:
        order = [*map(F.desc, measures), key]
        rows = pool.where(condition)
        if apart:
            rows = rows.withColumn("_first", F.row_number().over(W.Window.partitionBy("L").orderBy(*order))).where("_first = 1").drop("_first")
        parts.append(rows.orderBy(*order).limit(n).withColumn("quota", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def statistics(pool: DataFrame, *dimensions: str) -> DataFrame:
    """Rows of each value of each dimension, and of all, by grouping sets."""
    sets = [[F.col(d)] for d in dimensions]
    counts = pool.groupingSets([*sets, []], *map(F.col, dimensions)).agg(F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("_id"))
    top = 1 << len(dimensions)
    which = F.lit("all")
    for i, d in enumerate(dimensions):
        which = F.when(F.col("_id") == top - 1 - (1 << (len(dimensions) - 1 - i)), d).otherwise(which)
    return counts.select(which.alias("dimension"), F.coalesce(*[F.col(d).cast("string") for d in dimensions]).alias("value"), "rows")


def folds(rows: DataFrame, label: str = "label", key: str = "pattern", n: int = 5, seed: int = 42) -> DataFrame:
    """Labelled rows with a fold, the labels spread evenly. Places in the seeded
    order are counted within 4,096 slices of it, and then on from the slices
    before, so no task holds all rows of a label. ``rows`` are read twice."""
    cut = rows.withColumn("_order", seeded(key, seed)).withColumn("_slice", F.substring("_order", 1, 3))
    before = W.Window.partitionBy(label).orderBy("_slice").rowsBetween(W.Window.unboundedPreceding, -1)
    sizes = cut.groupBy(label, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select(F.col(label).alias("_label"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(W.Window.partitionBy(label, "_slice").orderBy("_order", key)) - 1
    # At most 4,096 rows a label.
    placed = cut.withColumn("_place", place).join(F.broadcast(ahead), F.col("_slice").eqNullSafe(F.col("_of")) & F.col(label).eqNullSafe(F.col("_label")))
    return placed.withColumn("fold", F.pmod(F.col("_place") + F.col("_ahead"), F.lit(n)).cast("int")).drop("_order", "_slice", "_label", "_of", "_place", "_ahead")


def assigned(pool: DataFrame, overlap: int, raters: list[str], key: str = "pattern", seed: int = 42) -> DataFrame:
    """``pool`` (a bounded sample) with ``assignment``: the first ``overlap``
    rows go to all raters, the others in equal runs, the last taking the rest."""
    size = F.greatest(F.lit(1), F.floor((F.count(F.lit(1)).over(W.Window.partitionBy()) - overlap) / len(raters)))
    place = F.row_number().over(W.Window.orderBy(seeded(key, seed), key)) - 1
    turn = F.least(F.floor((place - overlap) / size), F.lit(len(raters) - 1)).cast("int")
    name = F.element_at(F.array(*map(F.lit, raters)), turn + 1)
    return pool.withColumn("assignment", F.when(place < overlap, "overlap").otherwise(name))


#: Parts that a bootstrap deals its cells over; one row of sums a part comes back.
PARTS = 256
MEASURES = ("precision", "recall", "f1", "auc", "accuracy")


def resampled(rows: DataFrame, resamples: int = 1000, seed: int = 42, parts: int | None = None) -> np.ndarray:
    """MEASURES (rows) of each resample (columns) of (actual, predicted, score)
    rows, n of n with replacement; nan where a resample has one class only.

    Equal rows are one cell with a count, and weights are multinomial over cells:
    first over parts of the range of scores, then cell by cell within a part, by
    binomials of what is left, for all resamples at once. Running sums by score
    within a part, and on from the parts below, give the area under the curve."""
    cells = rows.groupBy("score", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    n_parts = parts or max(1, min(PARTS, -(-cells.count() // 2000)))
    keys = ["score", "actual", "predicted"]
    placed = cut(cells.repartitionByRange(n_parts, "score").select("*", F.spark_partition_id().alias("part")))
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return np.full((len(MEASURES), resamples), np.nan)
    total = sum(sizes.values())
    drawn = np.random.default_rng(seed).multinomial(total, [sizes[k] / total for k in names], size=resamples)
    share = {k: drawn[:, i] for i, k in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = None, None

        def close() -> pa.RecordBatch:
            sums = state["sums"] + [state["area"] + state["hits"] * (state["below"] + state["same"] / 2)]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.concatenate(sums).tolist()], pa.list_(pa.float64()))], ["part", "sums"])

        for batch in batches:
            for now, score, actual, predicted, n in zip(*(batch.column(c).to_pylist() for c in ("part", *keys, "n")), strict=True):
                if now != part:
                    if part is not None:
                        yield close()
                    part = now
                    zero = lambda: np.zeros(resamples)
                    state = {"rng": np.random.default_rng([seed, now]), "left": share[now].copy(), "of": sizes[now], "sums": [zero() for _ in range(4)], "area": zero(), "below": zero(), "same": zero(), "hits": zero(), "score": score}
                w = state["left"] if n >= state["of"] else state["rng"].binomial(state["left"], n / state["of"])
                state["left"], state["of"] = state["left"] - w, state["of"] - n
                state["sums"][2 * (1 - actual) + (1 - predicted if actual else predicted)] += w
                if score != state["score"]:
                    state["area"] += state["hits"] * (state["below"] + state["same"] / 2)
                    state["below"] = state["below"] + state["same"]
                    state["hits"], state["same"], state["score"] = np.zeros(resamples), np.zeros(resamples), score
                state["hits" if actual else "same"] = state["hits" if actual else "same"] + w
        if part is not None:
            yield close()

    made = placed.repartition("part").sortWithinPartitions("part", *keys).mapInArrow(run, "part int, sums array<double>")
    # tp, fn, tn, fp and the area within, of each part in order of score.
    found = np.array([r["sums"] for r in made.orderBy("part").collect()]).reshape(len(names), 5, resamples)
    tp, fn, tn, fp = found[:, :4].sum(axis=0)
    others = found[:, 2] + found[:, 3]
    below = np.cumsum(others, axis=0) - others
    area = (found[:, 4] + (found[:, 0] + found[:, 1]) * below).sum(axis=0)
    ratio = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    both = (tp + fn > 0) & (tn + fp > 0)
    auc = np.where(both, area / np.maximum((tp + fn) * (tn + fp), 1), np.nan)
    return np.stack([ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn), auc, (tp + tn) / total])


def bootstrap(rows: DataFrame, resamples: int = 1000, seed: int = 42, parts: int | None = None) -> DataFrame:
    """metric, median, low and high (95 %) over the resamples that have it."""
    out = []
    for name, values in zip(MEASURES, resampled(rows, resamples, seed, parts), strict=True):
        known = values[~np.isnan(values)]
        out.append((name, *(map(float, np.percentile(known, [50, 2.5, 97.5])) if len(known) else (None,) * 3), len(known)))
    return rows.sparkSession.createDataFrame(out, "metric string, median double, low double, high double, resamples long")
