"""Quality rules as a learned decision list, with DataFrame operations only.

Statistics of each text are computed by SQL functions. Sequential covering
learns rules for the rare class: each rule is a conjunction of thresholds that
is grown on one part of the labelled texts, literal by literal, by FOIL gain,
and pruned on the other; the texts that it covers are then set aside. The
ordered rules become one conditional expression.

Rules are learned on a bounded sample, the parameter ``per_class`` of ``learn``:
at most so many labelled texts of each class among those that are judged. Growth
ends where no literal gains, covering at the first rule of too little precision.

Defined cases: null and empty texts have no words and all statistics zero;
texts of any length are read whole, a text's windows within its own row; labels
with null fields are left out; no labels, or one class, give an empty list that
keeps every text; ties between literals go to the first by name and value;
repeated rows are judged alike and stay repeated; an empty table gives no row;
``keep_sound`` keeps columns of any name, ``judge`` the key only, so that none
of its own columns clashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import stored

WINDOW = 5
#: Thresholds tried per statistic (quantiles of the labelled texts).
THRESHOLDS = 12
#: A rule is kept if so large a share of what it covers in the pruning part has the label.
MIN_PRECISION = 0.9
#: Bound of the sample of labelled texts of each class that the rules are learned on.
SAMPLE_PER_CLASS = 10_000
STATISTICS = ("n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "punct_share", "dup_line_share", "repeat_share", "distinct_share", "pipe_share", "short_line_share", "bang_share")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts (n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words) and the STATISTICS beside them."""
    whole = F.coalesce(F.col(text), F.lit(""))
    blanks = "[\\x20\\x09-\\x0D]+"
    rows = docs.withColumn("_text", whole)
    rows = rows.withColumn("_words", F.filter(F.split("_text", blanks), lambda w: w != ""))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda v: v.rlike("[^\\x20\\x09-\\x0D]")))
    size = F.size("_words")
    spots = F.when(size >= WINDOW, F.sequence(F.lit(0), size - WINDOW)).otherwise(F.array().cast("array<int>"))
    # Equal windows have equal hashes: where all hashes differ, so do the windows.
    rows = rows.withColumn("_hashes", F.transform(spots, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])))
    # Sorted by hash, and by the words themselves where hashes are equal.
    exact = F.sort_array(F.transform(spots, lambda i: F.struct(F.get("_hashes", i).alias("h"), F.slice("_words", i + 1, WINDOW).alias("w"), i.alias("i"))))
    twice = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.size("_sorted") - 1),
            lambda k: F.when((F.get("_sorted", k)["w"] == F.get("_sorted", k - 1)["w"]) | (F.get("_sorted", k)["w"] == F.get("_sorted", k + 1)["w"]), F.get("_sorted", k)["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    some = (F.size("_hashes") > 0) & (F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    rows = rows.withColumn("_sorted", F.when(some, exact))
    rows = rows.withColumn("_twice", F.when(F.col("_sorted").isNotNull(), F.sort_array(twice)))
    # Words under the union of the repeated windows: each adds what the one before leaves open.
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("_twice") - 1),
        F.lit(0).cast("long"),
        lambda n, k: n + F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get("_twice", k) - F.get("_twice", k - 1))).cast("long"),
    )
    rows = rows.withColumn("n_repeat_words", F.when(F.size("_twice") > 0, covered).otherwise(F.lit(0).cast("long")))
    found = lambda pattern: F.regexp_count("_text", F.lit(pattern))
    rows = rows.withColumns({"_pipes": F.length("_text") - F.length(F.replace("_text", F.lit("|"), F.lit(""))), "_bangs": F.length("_text") - F.length(F.replace("_text", F.lit("!"), F.lit("")))})
    rows = rows.withColumns(
        {
            "n_words": size.cast("long"),
            "word_chars": (F.length("_text") - found("[\\x20\\x09-\\x0D]")).cast("long"),
            "n_symbols": found("[#*$%&|<>]").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    words, chars, lines = (F.greatest(x.cast("double"), F.lit(1.0)) for x in (F.col("n_words"), F.col("word_chars"), F.size("_lines")))
    rows = rows.withColumns(
        {
            "mean_word": F.col("word_chars") / words,
            "symbol_share": F.col("n_symbols") / words,
            "upper_share": found("\\p{Lu}") / chars,
            "digit_share": found("[0-9]") / chars,
            "punct_share": found("[.,;:?'\"()-]") / chars,
            "dup_line_share": F.col("n_dup_lines") / lines,
            "repeat_share": F.col("n_repeat_words") / words,
            "distinct_share": F.size(F.array_distinct("_words")) / words,
            "pipe_share": F.col("_pipes") / words,
            "short_line_share": F.size(F.filter("_lines", lambda v: F.length(v) < 30)) / lines,
            "bang_share": F.col("_bangs") / words,
        }
    )
    return rows.drop("_text", "_words", "_lines", "_hashes", "_sorted", "_twice", "_pipes", "_bangs")


@dataclass(frozen=True)
class Literal:
    statistic: str
    above: bool  # statistic >= value, else statistic < value
    value: float

    def column(self) -> Column:
        return F.col(self.statistic) >= self.value if self.above else F.col(self.statistic) < self.value


Rule = tuple[Literal, ...]


def covers(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (x.column() for x in rule))


def _counts(rows: DataFrame, tests: list[Column]) -> list[tuple[float, float]]:
    """For each test, the weights of labelled and of other rows that meet it, in one pass."""
    sums = [F.coalesce(F.sum(F.when(t & (F.col("_y") == y), F.col("_w"))), F.lit(0.0)) for t in tests for y in (1, 0)]
    row = rows.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(tests))]


def _bin(statistic: Column, marks: list[float]) -> Column:
    """How many of the marks the statistic reaches."""
    return F.size(F.filter(F.array(*map(F.lit, marks)).cast("array<double>"), lambda v: statistic >= v))


def _literal_counts(rows: DataFrame, marks: list[list[float]]) -> list[tuple[Literal, float, float]]:
    """The weights that every literal covers, from one histogram: a row falls
    into one bin of each statistic, and thresholds are sums over bins."""
    bins = rows.select("_y", "_w", F.posexplode("_bins").alias("s", "bin")).groupBy("s", "bin", "_y").agg(F.sum("_w").alias("w")).collect()
    table: list[list[list[float]]] = [[[0.0] * (len(m) + 1) for _ in (0, 1)] for m in marks]
    for r in bins:
        table[r["s"]][r["_y"]][r["bin"]] += r["w"]
    out = []
    for name, values, (others, labelled) in zip(STATISTICS, marks, table, strict=True):
        for k, value in enumerate(values):
            out.append((Literal(name, True, value), sum(labelled[k + 1 :]), sum(others[k + 1 :])))
            out.append((Literal(name, False, value), sum(labelled[: k + 1]), sum(others[: k + 1])))
    return out


def _grow(rows: DataFrame, marks: list[list[float]]) -> Rule:
    """FOIL: add the literal with most gain until only labelled rows are covered."""
    rule: Rule = ()
    p0, n0 = _counts(rows, [F.lit(True)])[0]
    while n0 > 0 and p0 > 0:
        counted = _literal_counts(rows.where(covers(rule)) if rule else rows, marks)
        gains = [p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p > 0 else 0.0 for _, p, n in counted]
        best = max(range(len(counted)), key=lambda i: (gains[i], -i), default=None)
        if best is None or gains[best] <= 1e-9:
            break
        literal, p0, n0 = counted[best]
        rule += (literal,)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, float]:
    """The prefix of the rule with the best (p - n) / (p + n), the shortest
    among equals, and its precision, smoothed."""
    counted = _counts(rows, [covers(rule[:k]) for k in range(1, len(rule) + 1)])
    worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in counted]
    best = max(range(len(rule)), key=lambda i: (worth[i], -i))
    p, n = counted[best]
    return rule[: best + 1], (p + 0.5) / (p + n + 1)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> list[Rule]:
    """Rules for the label 0, in order. Learned on at most ``per_class`` labelled
    texts of ``docs`` of each class (smallest hash of their key), weighted back
    to the classes' shares."""
    known = labels.select(F.col(key).alias("_k"), (F.col(label) <= 0).cast("int").alias("_y")).dropna().distinct()
    known = stored(known.join(docs.select(F.col(key).alias("_k")).distinct(), "_k", "left_semi"), "rule-labels")
    total = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return []
    parts = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_k", F.lit(3)), "_k").limit(per_class).withColumn("_w", F.lit(total[y] / min(total[y], per_class))) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1])  # 2 * per_class rows at most: it may be broadcast
    chosen = docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(sample), "_k")
    rows = with_statistics(chosen).select("_y", "_w", (F.xxhash64("_k", F.lit(7)) % 3 == 0).alias("_prune"), *STATISTICS)
    rows = stored(rows, "rule-statistics")
    quantiles = [k / THRESHOLDS for k in range(1, THRESHOLDS)] + [0.01, 0.99]
    both = [rows.where(F.col("_y") == y).agg(*[F.percentile(s, quantiles).alias(s) for s in STATISTICS]).first() for y in (0, 1)]
    marks = [sorted({v for b in both for v in (b[s] or [])}) for s in STATISTICS]
    binned = [_bin(F.col(s), m) for s, m in zip(STATISTICS, marks, strict=True)]
    rows = rows.withColumn("_bins", F.array(*binned)).coalesce(8).cache()
    left, rules = rows, []
    while True:
        rule = _grow(left.where(~F.col("_prune")), marks)
        if not rule:
            break
        rule, precision = _prune(left.where("_prune"), rule)
        if precision < MIN_PRECISION:
            break
        rules.append(rule)
        before, left = left, left.where(~covers(rule))
        if before.where(covers(rule)).isEmpty():
            break
    rows.unpersist()
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the number of the first rule that
    covers the text (from 1), 0 if none does."""
    return reduce(lambda rest, k: F.when(covers(rules[k - 1]), F.lit(k)).otherwise(rest), range(len(rules), 0, -1), F.lit(0))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the statistics, base_failed, rule and kept."""
    own = docs.select(*(F.col(k) for k in keep), F.col(text).alias("text"))
    rows = with_statistics(own).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_sound(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever their names."""
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("text"))
    # A filter is not pushed below a column that depends on the partition; pushed
    # down, it would repeat the statistics' nested expressions in each other.
    judged = judge(packed, rules, keep=("_row",)).withColumn("_part", F.spark_partition_id())
    return judged.where("kept and _part >= 0").select("_row.*")
