"""Properties of patterns: generator artefacts, scopes, closure, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from stepweave.functions.columns import MECHANISMS, guarded_ratio, has_placeholder, mechanism_of, scope
from stepweave.sources.tables import few

FILE = ("repo_slug", "file_path")


def spec_suite_files(slice_rows: DataFrame, ranked: DataFrame, patterns: int = 50, recurrence: int = 100, template: float = 0.30) -> DataFrame:
    """Per file with patterns that recur in it: their number, the greatest
    recurrence, the share with template texts, and whether it is a spec suite."""
    inside = ranked.where("max_within_file_recurrence >= 2").select("pattern", "has_template_structure")
    if "scenarios" in slice_rows.columns:  # the rows of ``sequences.by_file``
        per_file = slice_rows.select("pattern", *FILE, "scenarios").join(few(inside), "pattern").groupBy("pattern", *FILE).agg(F.sum("scenarios").alias("scenarios"), F.first("has_template_structure").alias("has_template_structure"))
    else:
        per_file = slice_rows.groupBy("pattern", *FILE, "scenario").agg(F.lit(1).alias("one")).groupBy("pattern", *FILE).agg(F.count(F.lit(1)).alias("scenarios")).join(inside, "pattern")
    rows = per_file.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n_distinct_rq1_patterns"), F.max("scenarios").alias("top_pattern_recurrence"), F.avg(F.col("has_template_structure").cast("double")).alias("template_fraction"))
    suite = (F.col("n_distinct_rq1_patterns") > patterns) & ((F.col("top_pattern_recurrence") > recurrence) | (F.col("template_fraction") >= template))
    return rows.withColumn("is_spec_suite", suite)


def outlier_fraction(slice_rows: DataFrame, ranked: DataFrame, files: DataFrame) -> DataFrame:
    """``ranked`` with the share of each pattern's occurrences in spec suites."""
    if "scenarios" in slice_rows.columns:  # the rows of ``sequences.by_file``
        hits = slice_rows.join(few(files.where("is_spec_suite").select(*FILE)), list(FILE), "left_semi").groupBy("pattern").agg(F.sum("n").alias("_hits"))
        return ranked.join(hits, "pattern", "left").withColumn("outlier_fraction", F.coalesce("_hits", F.lit(0)) / F.col("support_total")).drop("_hits")
    per_file = slice_rows.groupBy("pattern", *FILE).agg(F.count(F.lit(1)).alias("n"))
    marked = per_file.join(files.where("is_spec_suite").select(*FILE, F.lit(1).alias("hit")), list(FILE), "left")
    share = marked.groupBy("pattern").agg((F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("outlier_fraction"))
    return ranked.join(share, "pattern", "left").fillna(0.0, ["outlier_fraction"])


def with_scopes(ranked: DataFrame) -> DataFrame:
    rest = F.col("max_within_repo_files"), F.col("max_within_file_recurrence")
    return ranked.withColumns({"scope_repo": scope(F.col("n_distinct_repos"), *rest), "scope_org": scope(F.col("n_distinct_orgs"), *rest)})


def candidate_features(ranked: DataFrame) -> DataFrame:
    """``ranked`` (with outlier_fraction) and what a classifier reads beside its
    counts: the scope one-hot, the template flag, and three ratios."""
    c = F.col
    one_hot = {f"scope_{s}": (c("scope_repo") == s).cast("int") for s in ("RQ1", "RQ2", "RQ3")}
    return with_scopes(ranked).withColumns(
        one_hot
        | {
            "has_template": c("has_template_structure").cast("int"),
            "ratio_within_file": guarded_ratio(c("max_within_file_recurrence"), c("support_total")),
            "ratio_within_repo": guarded_ratio(c("max_within_repo_files"), c("support_total")),
            "ratio_orgs": guarded_ratio(c("n_distinct_orgs"), c("n_distinct_repos")),
        }
    )


def non_closed(candidates: DataFrame, scope_column: str = "scope_org") -> DataFrame:
    """Patterns that some pattern of one more step, with equal support and
    scope, has as its prefix or suffix."""
    ids = F.split("pattern", ",")
    longer = candidates.select(F.col(scope_column), "support_total", (F.col("L") - 1).alias("L"), F.explode(F.array(F.slice(ids, 1, F.col("L") - 1), F.slice(ids, 2, F.col("L") - 1))).alias("part")).where("L >= 2")
    longer = longer.withColumn("pattern", F.array_join("part", ",")).drop("part")
    return candidates.join(longer, [scope_column, "support_total", "L", "pattern"], "left_semi").select("pattern")


RULES = ("templated_outline", "single_cluster", "single_scenario", "overlap_dominated", "mechanism_mismatch", "non_closed")


def qa_flags(candidates: DataFrame, mechanism: Column | None = None) -> DataFrame:
    """The six rules, the first that fails, and the quality score. A mechanism
    that is shared between owners is a mismatch with fewer than two of them."""
    rule = mechanism_of(F.col("scope_org"))
    open_ones = non_closed(candidates).distinct().withColumn("hit", F.lit(True))
    ratio = guarded_ratio(F.col("n_distinct_scenarios"), F.col("support_total"))
    rows = candidates.join(open_ones, "pattern", "left").withColumns({"mechanism_rule": rule, "mechanism": rule if mechanism is None else mechanism, "scen_ratio": ratio})
    flags = {
        "templated_outline": has_placeholder(F.col("canonical_text_seq")),
        "single_cluster": F.size(F.array_distinct(F.split("pattern", ","))) == 1,
        "single_scenario": F.col("n_distinct_scenarios") <= 1,
        "overlap_dominated": F.col("scen_ratio") < 0.20,
        "mechanism_mismatch": F.coalesce((F.col("mechanism") == MECHANISMS["RQ3"]) & (F.col("n_distinct_orgs") < 2), F.lit(False)),
        "non_closed": F.coalesce("hit", F.lit(False)),
    }
    rows = rows.withColumns(flags).drop("hit")
    reason = reduce(lambda rest, r: F.when(F.col(r), F.lit(r)).otherwise(rest), reversed(RULES), F.lit("kept"))
    score = F.col("n_distinct_scenarios") * F.sqrt("support_total") * F.when(F.col("mechanism") == MECHANISMS["RQ3"], F.greatest("n_distinct_orgs", F.lit(1))).otherwise(1)
    return rows.withColumns({"rejection_reason": reason, "quality_score": score})


def funnel(flagged: DataFrame) -> DataFrame:
    """Rows dropped by each rule in order, and those left after it."""
    counts = flagged.groupBy("rejection_reason").agg(F.count(F.lit(1)).alias("n"))
    steps = flagged.sparkSession.createDataFrame([(i, r) for i, r in enumerate(RULES)], "step int, rejection_reason string")
    total = flagged.agg(F.count(F.lit(1)).alias("total"))
    # Six rows, one per rule.
    done = F.sum("dropped").over(W.Window.orderBy("step"))
    rows = F.broadcast(steps).join(counts, "rejection_reason", "left").select("step", "rejection_reason", F.coalesce("n", F.lit(0)).alias("dropped"))
    return rows.join(F.broadcast(total)).withColumn("left", F.col("total") - done).drop("total")


def top_per_mechanism(flagged: DataFrame, n: int = 500) -> DataFrame:
    order = W.Window.partitionBy("mechanism").orderBy(F.desc("quality_score"), F.desc("support_total"), "pattern")
    return flagged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def call_sites(slice_rows: DataFrame, wanted: DataFrame, n: int = 3, more: tuple[str, ...] = ()) -> DataFrame:
    """The first n occurrences of each wanted pattern, in order of slices, with
    ``more`` columns of these."""
    order = W.Window.partitionBy("pattern").orderBy("repo_slug", "file_path", "scenario", "position_start")
    rows = slice_rows.join(wanted.select("pattern"), "pattern", "left_semi").withColumn("site", F.row_number().over(order))
    return rows.where(F.col("site") <= n).select("pattern", "site", "repo_slug", "file_path", "scenario", "position_start", *more)


def site_texts(slice_rows: DataFrame, wanted: DataFrame, numbered_steps: DataFrame, n: int = 3) -> DataFrame:
    """The call sites with ``texts``, the steps as they stand there: fetched by the
    numbers of the steps, for these sites alone."""
    sites = call_sites(slice_rows, wanted, n, ("at", "L"))
    spots = sites.withColumn("at", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("L") - 1)))
    rows = spots.join(numbered_steps.select("at", "text"), "at")
    key = [c for c in sites.columns if c not in ("at", "L")]
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "text")))["text"].alias("texts"))  # L steps at most


def call_site_lists(sites: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per pattern the list of its (bounded) call sites, and the number of
    repositories of all its occurrences, which ``ranked`` has."""
    place = F.struct("site", "repo_slug", "file_path", "scenario", "position_start")
    rows = sites.groupBy("pattern").agg(F.array_sort(F.collect_list(place)).alias("sites"))
    rows = rows.join(ranked.select("pattern", F.col("n_distinct_repos").alias("n_site_repos")), "pattern")
    return rows.select("pattern", "sites", "n_site_repos", F.size("sites").alias("n_sites"))


def distribution(rows: DataFrame, *dimensions: str) -> DataFrame:
    """Count and share (per cent) of each value of each dimension."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    counts = rows.select(pairs.alias("d")).groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("patterns"))
    return counts.withColumn("pct", 100.0 * F.col("patterns") / F.sum("patterns").over(W.Window.partitionBy("dimension")))
