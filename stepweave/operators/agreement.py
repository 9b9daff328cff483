"""Agreement of raters and measures of classifiers, as sums over labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Score ranges over which the sums of ``auc`` are dealt.
RANGES = 256


def fleiss_kappa(ratings: DataFrame, raters: int) -> DataFrame:
    """From (item, label) rows: items rated by all raters. 1 where chance
    agreement is 1, null without items."""
    counts = ratings.groupBy("item", "label").agg(F.count(F.lit(1)).alias("n"))
    complete = counts.withColumn("all", F.sum("n").over(W.Window.partitionBy("item"))).where(F.col("all") == raters)
    items = complete.groupBy("item").agg(((F.sum(F.col("n") * F.col("n")) - raters) / (raters * (raters - 1))).alias("p"))
    observed = items.agg(F.avg("p").alias("po"), F.count(F.lit(1)).alias("items"))
    shares = complete.groupBy("label").agg(F.sum("n").alias("c"))
    chance = shares.agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("pe"))
    kappa = F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return F.broadcast(observed).join(F.broadcast(chance)).select("items", kappa.alias("kappa"))  # one row each


def majority(ratings: DataFrame) -> DataFrame:
    """Per item the most frequent label, or ``tie``."""
    counts = ratings.groupBy("item", "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("item").agg(F.max("n").alias("top"))
    top = counts.join(best, "item").where("n = top").groupBy("item").agg(F.count(F.lit(1)).alias("k"), F.min("label").alias("label"))
    return top.select("item", F.when(F.col("k") > 1, "tie").otherwise(F.col("label")).alias("label"))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """From (a, b) rows."""
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy("a").agg(F.sum("n").alias("l")).withColumnRenamed("a", "label")
    right = cells.groupBy("b").agg(F.sum("n").alias("r")).withColumnRenamed("b", "label")
    chance = left.join(right, "label").agg(F.sum(F.col("l") * F.col("r")).alias("lr"))
    po, pe = F.col("same") / F.col("n"), F.col("lr") / (F.col("n") * F.col("n"))
    return F.broadcast(total).join(F.broadcast(chance)).select("n", po.alias("po"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))  # one row each


def binary_metrics(rows: DataFrame) -> DataFrame:
    """From (actual, predicted) of 0 and 1; a ratio without cases is 0."""
    tp, fp, fn, tn = (F.count_if((F.col("actual") == a) & (F.col("predicted") == p)).alias(k) for k, a, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = F.col
    return rows.agg(tp, fp, fn, tn).select(
        "tp", "fp", "fn", "tn",
        ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"),
        ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
        ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
    )


def macro_f1(rows: DataFrame) -> DataFrame:
    """Mean F1 over the classes of (actual, predicted)."""
    cells = rows.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.explode(F.array("actual", "predicted")).alias("label"), "actual", "predicted", "n").distinct()
    of = both.groupBy("label").agg(F.sum(F.when((F.col("actual") == F.col("label")) & (F.col("predicted") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("actual") != F.col("predicted"), F.col("n")).otherwise(0)).alias("off"))
    f1 = F.when(2 * F.col("tp") + F.col("off") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("off"))).otherwise(0.0)
    return of.select("label", f1.alias("f1"))


def auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve of (score, actual) by mid-ranks over groups of
    equal scores; null for a single class. Scores fall into ranges by estimated
    quantiles; sums run within a range and on from the ranges before, so no task
    holds all distinct scores. ``rows`` are read three times."""
    groups = rows.groupBy("score").agg(F.count_if(F.col("actual") == 1).alias("p"), F.count_if(F.col("actual") == 0).alias("q"))
    marks = groups.agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 100 * RANGES)).first()[0] or [0]
    splits = [-math.inf, *sorted({float(m) for m in marks if math.isfinite(m)} or {0.0}), math.inf]
    ranges = Bucketizer(splits=splits, inputCol="_score", outputCol="_range", handleInvalid="keep")
    ranged = ranges.transform(groups.withColumn("_score", F.col("score").cast("double")))
    ranged = ranged.withColumn("_range", F.when(F.col("score").isNull(), -1.0).otherwise(F.col("_range")))  # null sorts first
    before = W.Window.orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a range
    ahead = ranged.groupBy("_range").agg(F.sum("q").alias("held")).select("_range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"))
    within = F.sum("q").over(W.Window.partitionBy("_range").orderBy("score").rowsBetween(W.Window.unboundedPreceding, -1))
    below = F.coalesce("within", F.lit(0)) + F.col("ahead")
    sums = ranged.withColumn("within", within).join(F.broadcast(ahead), "_range").withColumn("below", below).agg(F.sum(F.col("p") * (2 * F.col("below") + F.col("q"))).alias("u2"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u2") / (2 * F.col("p") * F.col("q"))).alias("auc"))


def mcnemar(rows: DataFrame) -> DataFrame:
    """Discordant counts of two predictors (right_a, right_b) and the
    continuity-corrected chi-square."""
    counts = rows.agg(F.count_if(F.col("right_a") & ~F.col("right_b")).alias("b"), F.count_if(~F.col("right_a") & F.col("right_b")).alias("c"))
    b, c = F.col("b"), F.col("c")
    return counts.withColumn("chi2", F.when(b + c > 0, F.pow(F.abs(b - c) - 1, F.lit(2)) / (b + c)).otherwise(0.0))


def erfc_p(chi2: float) -> float:
    """The p-value of a chi-square of one degree of freedom (a summary's scalar)."""
    return math.erfc(math.sqrt(chi2 / 2))


def pairwise(ratings: DataFrame) -> DataFrame:
    """From (item, rater, label) rows: for each two raters, the items that both
    rated and the share on which they agree."""
    others = ratings.select("item", F.col("rater").alias("other"), F.col("label").alias("other_label"))
    both = ratings.join(others, "item").where("rater < other")  # an item has few raters
    agree = F.avg((F.col("label") == F.col("other_label")).cast("double"))
    return both.groupBy("rater", "other").agg(F.count(F.lit(1)).alias("items"), agree.alias("agreement"))


def distributions(ratings: DataFrame) -> DataFrame:
    """Count and share of each label of each rater."""
    counts = ratings.groupBy("rater", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.Window.partitionBy("rater")))


def by_rater(ratings: DataFrame, raters: int) -> DataFrame:
    """Per item a map of rater to label, the number of raters, and the label:
    the majority's if all rated it, else that of the first rater by name."""
    held = F.map_from_entries(F.array_sort(F.collect_list(F.struct("rater", "label"))))
    rows = ratings.groupBy("item").agg(held.alias("labels_per_rater"), F.count(F.lit(1)).alias("n_raters"), F.min_by("label", "rater").alias("_first"))
    rows = rows.join(majority(ratings.select("item", "label")), "item")
    return rows.withColumn("label", F.when(F.col("n_raters") == raters, F.col("label")).otherwise(F.col("_first"))).drop("_first")


def judge_summary(verdicts: DataFrame, human: DataFrame, failures: Sequence[str]) -> DataFrame:
    """Per model of (model, item, verdict, mechanism) against (item, label,
    mechanism): failures, agreement on all labels and on yes against the rest,
    and the mechanisms where both say yes. Ties of the human raters are left
    out; a ratio without cases is 0, and a kappa without chance to differ null."""
    c = F.col
    known = human.select("item", c("label").alias("_human"), c("mechanism").alias("_mechanism"))
    rows = verdicts.join(known, "item", "left").withColumn("_valid", ~c("verdict").isin(*failures))
    compared = c("_valid") & c("_human").isNotNull() & (c("_human") != "tie")
    h, m = c("_human") == "yes", c("verdict") == "yes"
    count = lambda cond: F.count_if(cond)
    sums = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_total"), count(c("_valid")).alias("n_valid"), count(~c("_valid")).alias("n_failed"), count(compared).alias("n_compared"),
        count(compared & (c("_human") == c("verdict"))).alias("_same"),
        count(compared & h & m).alias("_tp"), count(compared & ~h & m).alias("_fp"), count(compared & h & ~m).alias("_fn"), count(compared & ~h & ~m).alias("_tn"),
        count(c("_valid") & h & m).alias("n_yes_yes"), count(c("_valid") & h & m & (c("mechanism") == c("_mechanism"))).alias("_mech"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = c("n_compared")
    left = rows.where(compared).groupBy("model", c("_human").alias("label")).agg(F.count(F.lit(1)).alias("l"))
    right = rows.where(compared).groupBy("model", c("verdict").alias("label")).agg(F.count(F.lit(1)).alias("r"))
    chance = left.join(right, ["model", "label"]).groupBy("model").agg(F.sum(c("l") * c("r")).alias("_lr"))
    sums = sums.join(chance, "model", "left")
    kappa = lambda po, pe: F.when(pe < 1, (po - pe) / (1 - pe))
    tp, fp, fn, tn = c("_tp"), c("_fp"), c("_fn"), c("_tn")
    binary_chance = ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    return sums.select(
        "model", "n_total", "n_valid", "n_failed", "n_compared",
        ratio(c("_same"), n).alias("accuracy"), ratio(tp + tn, n).alias("accuracy_binary"),
        kappa(ratio(c("_same"), n), ratio(F.coalesce("_lr", F.lit(0)), n * n)).alias("kappa"), kappa(ratio(tp + tn, n), binary_chance).alias("kappa_binary"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "n_yes_yes", ratio(c("_mech"), c("n_yes_yes")).alias("mechanism_accuracy"),
    )


def between_judges(verdicts: DataFrame, models: int, failures: Sequence[str]) -> DataFrame:
    """Fleiss' kappa of the judges over items that all judged, on all labels and
    on yes against the rest."""
    valid = verdicts.where(~F.col("verdict").isin(*failures))
    full = fleiss_kappa(valid.select("item", F.col("verdict").alias("label")), models).withColumnRenamed("kappa", "kappa_all")
    yes = valid.select("item", F.when(F.col("verdict") == "yes", "yes").otherwise("not-yes").alias("label"))
    return full.join(F.broadcast(fleiss_kappa(yes, models).select(F.col("kappa").alias("kappa_binary"))))  # one row each


def by_fold(rows: DataFrame) -> DataFrame:
    """Accuracy and macro F1 (over the classes that are actual or predicted) of
    each fold and of all rows (fold null), from (fold, actual, predicted)."""
    both = F.explode(F.array(F.col("fold"), F.lit(None).cast("int"))).alias("fold")
    counts = rows.select(both, "actual", "predicted").groupBy("fold", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("actual") == F.col("predicted")
    # A row counts for its actual class and for its predicted one.
    ends = counts.select("fold", "n", hit.alias("hit"), F.explode(F.array("actual", "predicted")).alias("label"))
    per = ends.groupBy("fold", "label").agg((F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("f1"))
    macro = per.groupBy("fold").agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("classes"))
    whole = counts.groupBy("fold").agg(F.sum("n").alias("n"), (F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return whole.join(macro, whole["fold"].eqNullSafe(macro["fold"])).drop(macro["fold"])


def scores_by_fold(rows: DataFrame, folds: int) -> DataFrame:
    """fold, n, precision, recall, f1 and auc of (fold, actual, predicted, score)
    rows: of each fold, and of all rows (fold null)."""
    out = None
    for k in [*range(folds), None]:
        part = rows if k is None else rows.where(F.col("fold") == k)
        # One row each.
        one = binary_metrics(part).join(F.broadcast(auc(part.select("score", "actual"))))
        one = one.select(F.lit(k).cast("int").alias("fold"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), "precision", "recall", "f1", "auc")
        out = one if out is None else out.unionByName(one)
    return out


def class_report(rows: DataFrame) -> DataFrame:
    """label, support, precision and recall of each class of (actual, predicted)."""
    cells = rows.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    ends = cells.select("actual", "predicted", "n", F.explode(F.array_distinct(F.array("actual", "predicted"))).alias("label"))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    is_actual, is_predicted = F.col("actual") == F.col("label"), F.col("predicted") == F.col("label")
    sums = ends.groupBy("label").agg(count(is_actual).alias("support"), count(is_predicted).alias("_said"), count(is_actual & is_predicted).alias("_hit"))
    ratio = lambda b: F.col("_hit") / F.greatest(F.col(b), F.lit(1))
    return sums.select("label", "support", ratio("_said").alias("precision"), ratio("support").alias("recall"))
