"""The rows behind figures of models, judges and rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from stepweave.functions.columns import mechanism_of
from stepweave.operators import agreement, judging, patterns, sampling
from stepweave.plans import oracle
from stepweave.plans.catalogue import _PAIRS, _accepted, _numbered, _pairs, _qa, _slices, gbt_intervals, gbt_metrics, query
from stepweave.plans.labelling import _judged, _summary
from stepweave.sources.tables import cut

MEASURES = ("precision", "recall", "f1", "auc")


@query()
def mechanism_model_and_rule(spark, d):
    """Mechanisms of the patterns that are predicted yes, by the model and by the rule."""
    told = [F.struct(F.lit(k).alias("told_by"), F.col(c).alias("mechanism")) for k, c in (("model", "mechanism"), ("rule", "mechanism_rule"))]
    return _accepted(spark, d).select(F.inline(F.array(*told))).groupBy("told_by", "mechanism").agg(F.count(F.lit(1)).alias("patterns"))


@query()
def mechanism_rule_agreement(spark, d):
    """The share of the patterns predicted yes to which both give one mechanism."""
    same = F.avg((F.col("mechanism") == F.col("mechanism_rule")).cast("double"))
    return _accepted(spark, d).agg(F.count(F.lit(1)).alias("patterns"), same.alias("agreement"))


@query()
def fold_measures(spark, d):
    """Each measure in each fold, beside its median and 95 % interval over resamples."""
    folds = gbt_metrics(spark, d).where("fold is not null").unpivot(["fold"], list(MEASURES), "metric", "value")
    return folds.join(F.broadcast(gbt_intervals(spark, d).select("metric", "median", "low", "high")), "metric")  # a row a measure


@query()
def raters_f1(spark, d):
    """F1 of yes, with its 95 % interval, of the classifier out of fold and of each
    judge against the raters' label."""
    own = gbt_metrics(spark, d).where("fold is null").select(F.lit("classifier").alias("rater"), "f1")
    rows = [own.join(F.broadcast(_f1_interval(gbt_intervals(spark, d))))]  # one row each
    verdicts, human = _judged(spark, d)
    valid = verdicts.where(~F.col("verdict").isin(*judging.FAILURES)).join(human.where("label <> 'tie'").select("item", "label"), "item")
    yes = lambda c: (F.col(c) == "yes").cast("int")
    pairs = cut(valid.select("model", yes("label").alias("actual"), yes("verdict").alias("predicted"), yes("verdict").cast("double").alias("score")))
    for r in _summary(spark, d).select("model", "f1").orderBy("model").collect():  # a row a judge
        said = spark.createDataFrame([(r["model"], r["f1"])], "rater string, f1 double")
        rows.append(said.join(F.broadcast(_f1_interval(sampling.bootstrap(pairs.where(F.col("model") == r["model"]).drop("model"))))))
    return reduce(lambda a, b: a.unionByName(b), rows)


def _f1_interval(intervals):
    return intervals.where("metric = 'f1'").select("low", "high")


# The p-value as an integral of the normal density, by Simpson's rule.
_P = "(SELECT sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z + (40.0 - z) * i / 20000, 2) / 2)) * (40.0 - z) / 60000 FROM range(20001) t(i)) * sqrt(2 / pi())"


@query(
    _PAIRS
    + f"SELECT b, c, chi2, round({_P}, 7) AS p FROM (SELECT *, sqrt(chi2) AS z FROM (SELECT b, c, CASE WHEN b + c > 0 THEN pow(abs(b - c) - 1, 2) / CAST(b + c AS DOUBLE) ELSE 0.0 END AS chi2"
    + " FROM (SELECT count_if(predicted = actual AND (1 - toxic) <> actual) AS b, count_if(predicted <> actual AND (1 - toxic) = actual) AS c FROM pairs)))"
)
def mcnemar_test(spark, d):
    """Whether two predictors differ, with the p-value."""
    right = lambda c: c == F.col("actual")
    one = agreement.mcnemar(_pairs(spark, d).select(right(F.col("predicted")).alias("right_a"), right(1 - F.col("toxic")).alias("right_b"))).first()
    return spark.createDataFrame([(one["b"], one["c"], one["chi2"], round(agreement.erfc_p(one["chi2"]), 7))], "b long, c long, chi2 double, p double")


@query(
    oracle.qa(
        "li",
        "SELECT t.pattern AS pattern, mechanisms, CAST(site AS INTEGER) AS site, repo_slug, file_path, scenario, position_start"
        " FROM (SELECT pattern, array_to_string(list_sort(list(DISTINCT mechanism)), ',') AS mechanisms FROM ("
        + " UNION ALL ".join(f"SELECT pattern, mechanism FROM (SELECT *, row_number() OVER (PARTITION BY mechanism ORDER BY quality_score DESC, support_total DESC, pattern) AS rank FROM (SELECT pattern, quality_score, support_total, {c} AS mechanism FROM qa WHERE rejection_reason = 'kept')) WHERE rank <= 20" for c in ("mechanism", "CASE scope_org WHEN 'RQ3' THEN 'shared_higher_level_step' WHEN 'RQ2' THEN 'reusable_scenario' WHEN 'RQ1' THEN 'background' ELSE 'none' END"))
        + ") GROUP BY pattern) t JOIN (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY repo_slug, file_path, scenario, position_start) AS site FROM slices) s USING (pattern) WHERE site <= 3",
    )
)
def target_call_sites(spark, d):
    """The first places of all patterns that are among the best 20 of a mechanism,
    as repositories or as owners tell it; a pattern of several lists comes once."""
    kept = _qa(spark, d).where("rejection_reason = 'kept'")
    lists = [kept, kept.withColumn("mechanism", mechanism_of(F.col("scope_org")))]
    best = [patterns.top_per_mechanism(rows, 20).select("pattern", "mechanism") for rows in lists]
    targets = best[0].union(best[1]).groupBy("pattern").agg(F.array_join(F.array_sort(F.collect_set("mechanism")), ",").alias("mechanisms"))  # a mechanism a list
    return patterns.call_sites(_slices(spark, d), targets).join(targets, "pattern")


@query(
    oracle.qa(
        "li",
        "SELECT pattern, CAST(site AS INTEGER) AS site, repo_slug, file_path, scenario, position_start, array_to_string(text_seq, ' / ') AS texts"
        " FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY repo_slug, file_path, scenario, position_start) AS site FROM slices) WHERE site <= 3 AND pattern IN (SELECT pattern FROM (SELECT *, row_number() OVER (PARTITION BY mechanism ORDER BY quality_score DESC, support_total DESC, pattern) AS rank FROM qa WHERE rejection_reason = 'kept') WHERE rank <= 20)",
    )
)
def call_site_texts(spark, d):
    """What the steps say at the first places of the best 20 patterns of each mechanism."""
    best = patterns.top_per_mechanism(_qa(spark, d).where("rejection_reason = 'kept'"), 20)
    return patterns.site_texts(_slices(spark, d), best, _numbered(spark, d)).withColumn("texts", F.array_join("texts", " / "))
