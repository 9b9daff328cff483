"""Prevalence of recurring patterns in scenarios, files and repositories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from stepweave.functions.columns import owner
from stepweave.operators.sequences import KEY
from stepweave.sources.tables import cut, few

FLAGS = ("recurring", "rq1", "rq2", "rq3")


def scenario_flags(slice_rows: DataFrame, ranked: DataFrame, gate: Column | None = None) -> DataFrame:
    """Per scenario, whether it holds a recurring pattern of each scope; with a
    gate, only of patterns that pass it."""
    flags = ranked.where(gate) if gate is not None else ranked
    flags = flags.select("pattern", (F.col("max_within_file_recurrence") >= 2).alias("rq1"), (F.col("max_within_repo_files") >= 2).alias("rq2"), (F.col("n_distinct_orgs") >= 2).alias("rq3"))
    held = slice_rows.select("pattern", *KEY).distinct().join(flags.withColumn("recurring", F.lit(True)), "pattern", "left")
    return held.groupBy(*KEY).agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in FLAGS])


def unit_flags(rows: DataFrame, ranked: DataFrame, *unit: str, gate: Column | None = None) -> DataFrame:
    """Per unit, whether it holds a recurring pattern of each scope (with a gate,
    only of patterns that pass it), of rows with a pattern and the unit's columns;
    rows may come several times. The flags are the bits of one number."""
    held = (F.lit(True), F.col("max_within_file_recurrence") >= 2, F.col("max_within_repo_files") >= 2, F.col("n_distinct_orgs") >= 2)
    bits = reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(held)])
    known = (ranked.where(gate) if gate is not None else ranked).select("pattern", bits.alias("_bits"))
    # Few patterns: the bits of a unit come together before any shuffle.
    found = rows.select("pattern", *unit).join(few(known), "pattern", "left").groupBy(*unit).agg(F.coalesce(F.bit_or("_bits"), F.lit(0)).alias("_bits"))
    return found.select(*unit, *[(F.col("_bits").bitwiseAND(1 << i) > 0).alias(f) for i, f in enumerate(FLAGS)])


def prevalence(flags: DataFrame, *level: str) -> DataFrame:
    """Number and share (per cent) of the units of a level that have each flag."""
    units = flags.groupBy(*level).agg(*[F.bool_or(f).alias(f) for f in FLAGS])
    n = F.count(F.lit(1))
    return units.agg(n.alias("units"), *[F.count_if(f).alias(f"n_{f}") for f in FLAGS], *[(100.0 * F.count_if(f) / F.greatest(n, F.lit(1))).alias(f"pct_{f}") for f in FLAGS])


def patterns_per_repo(slice_rows: DataFrame, ranked: DataFrame) -> DataFrame:
    held = slice_rows.select("pattern", "repo_slug").distinct().join(ranked.select("pattern"), "pattern", "left_semi")
    counts = held.groupBy("repo_slug").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("repos"), *[F.percentile("n", v).alias(k) for k, v in {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}.items()], F.max("n").alias("max_n"))


def corpus_shape(steps: DataFrame, scenario_rows: DataFrame) -> DataFrame:
    """Repositories, owners, files, scenarios and steps: of all steps, and of
    the scenarios that have slices."""
    every = steps.agg(F.count(F.lit(1)).alias("n_steps"), F.countDistinct("repo_slug").alias("n_repos"))
    held = scenario_rows.groupBy("repo_slug", "file_path").agg(F.count(F.lit(1)).alias("scenarios"), F.sum("n").alias("steps"))
    held = held.groupBy("repo_slug").agg(F.count(F.lit(1)).alias("files"), F.sum("scenarios").alias("scenarios"), F.sum("steps").alias("steps"))
    held = held.agg(F.count(F.lit(1)).alias("n_repos_with_slices"), F.countDistinct(owner(F.col("repo_slug"))).alias("n_owners"), F.sum("files").alias("n_files_with_slices"), F.sum("scenarios").alias("n_scenarios_with_slices"), F.sum("steps").alias("n_steps_with_slices"))
    return every.join(F.broadcast(held))  # one row each


def by_level(flags: DataFrame) -> DataFrame:
    """Units and flagged units of each owner, repository and file, and of all,
    in one pass with a rollup."""
    levels = flags.withColumn("owner", owner(F.col("repo_slug"))).rollup("owner", "repo_slug", "file_path")
    return levels.agg(F.count(F.lit(1)).alias("scenarios"), *[F.count_if(f).alias(f"n_{f}") for f in FLAGS])


def percentiles(rows: DataFrame, by: str, value: str, marks: dict[str, float], ranges: int = 256) -> DataFrame:
    """Exact interpolated percentiles of each group, by name, and n. Values fall
    into ranges by estimated quantiles; counts tell which range holds a rank, and
    only the values of these ranges are put in order, each range by itself. Nulls
    are left out, and groups without a value."""
    counts = cut(rows.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    found = counts.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges)).first()[0] or []
    splits = F.array(*map(F.lit, sorted(set(found)))).cast("array<double>")
    counts = counts.withColumn("r", F.size(F.filter(splits, lambda s: s < F.col("v"))))
    # A row for each group and range.
    group = W.Window.partitionBy("g")
    sums = counts.groupBy("g", "r").agg(F.sum("n").alias("held"))
    sums = sums.withColumns({"total": F.sum("held").over(group), "ahead": F.sum("held").over(group.orderBy("r")) - F.col("held")})
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("mark"), (q * (F.col("total") - 1)).alias("place")) for k, q in marks.items()]))
    ends = F.explode(F.array(*[F.struct(F.lit(e).alias("end"), f("a.place").cast("long").alias("rank")) for e, f in (("low", F.floor), ("high", F.ceil))]))
    wanted = sums.select("*", asked.alias("a")).select("g", "r", "total", "ahead", "held", "a.mark", "a.place", ends.alias("e")).select("*", "e.*")
    wanted = wanted.where((F.col("rank") >= F.col("ahead")) & (F.col("rank") < F.col("ahead") + F.col("held"))).drop("e", "held")
    named = lambda t, tag: t.withColumnsRenamed({"g": f"g{tag}", "r": f"r{tag}"})
    here = wanted.select("g", "r").distinct()
    few = counts.join(named(here, "_"), F.col("g").eqNullSafe(F.col("g_")) & (F.col("r") == F.col("r_")), "left_semi")
    few = few.withColumn("below", F.sum("n").over(W.Window.partitionBy("g", "r").orderBy("v")) - F.col("n"))
    hit = named(wanted, "_").join(few, F.col("g").eqNullSafe(F.col("g_")) & (F.col("r") == F.col("r_")))
    hit = hit.where((F.col("rank") - F.col("ahead") >= F.col("below")) & (F.col("rank") - F.col("ahead") < F.col("below") + F.col("n")))
    at = lambda k, e: F.max(F.when((F.col("mark") == k) & (F.col("end") == e), F.col("v")))
    part = lambda k: F.max(F.when(F.col("mark") == k, F.col("place") - F.floor("place")))
    return hit.groupBy(F.col("g").alias(by)).agg(*[(at(k, "low") + (at(k, "high") - at(k, "low")) * part(k)).alias(k) for k in marks], F.max("total").alias("n"))
