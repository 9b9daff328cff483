"""URL filters: editorial host and path rules, and rules mined by FP-growth.

Tokens of labelled URLs are mined for frequent combinations; combinations that
imply a verdict with enough confidence and support judge the URLs on which no
editorial rule fits, the surest first. Tokens that the labelled URLs only have
together (as the keys of one query template) are one item in mining: any of them
gives the same support and confidence, so rules that name several say no more,
and FP-growth does not list their subsets. A URL has such an item by any of its
tokens, and its least one is named. Mined rules are matched by a join with an
inverted index, from each rule's rarest item, and their other items checked;
they stay on Spark, however many there are. Combinations of tokens that vary from
URL to URL are still all listed, as FP-growth does, down to the least support.

Defined cases: null URLs and those without ``://`` have an empty host and path
and no tokens; they get the verdict of URLs on which nothing fits, allow; URLs of
any length are read whole; repeated rows give repeated rows; no labelled URL or
no frequent combination gives no mined rule; ties between mined rules go to the
first in order; an empty table gives no row; further columns, whatever their
names, are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import stored

#: Least share of the labelled URLs, and least confidence.
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
SALTS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (``host/path``) that fits: its host or a subdomain of
    it, and a path that starts with the rule's; else null."""

    def fits(rule: str) -> Column:
        own, _, start = rule.partition("/")
        return ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")

    ordered = sorted((r for r, _ in rules), key=lambda r: (len(r), r))
    return reduce(lambda rest, r: F.when(fits(r), F.lit(r)).otherwise(rest), ordered, F.lit(None).cast("string"))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments (digits as #),
    their ending, query keys, and whether there is a fragment."""
    digits = lambda s: F.regexp_replace(s, "[0-9]+", "#")
    labels = F.transform(F.filter(F.split(host, "[.]"), lambda s: s != ""), lambda s: F.concat(F.lit("h:"), digits(s)))
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("p:"), F.regexp_replace(digits(s), "[.][A-Za-z]+$", "")))
    ending = F.regexp_extract(path, "[.][A-Za-z]+$", 0)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "[?]([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), F.regexp_extract(s, "^[^=]*", 0)))
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z]+)://", 1)))
    more = F.filter(F.array(F.when(ending != "", F.concat(F.lit("e:"), ending)), F.when(F.instr(F.coalesce(url, F.lit("")), "#") > 0, F.lit("f:"))), lambda s: s.isNotNull())
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(scheme, labels, parts, keys, more)))


def together(rows: DataFrame) -> DataFrame:
    """token and item, the least of the tokens that are in the same rows (columns
    id and tokens); of tokens of enough support. These are few: their number times
    the support is at most the tokens of a row. Rows are told by the exclusive or
    of two hashes of their ids, 128 bits."""
    least = F.lit(MIN_SUPPORT) * rows.count()
    of = rows.select("id", F.explode("tokens").alias("token"))
    marks = of.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    marks = marks.where(F.col("n") >= least)
    return marks.groupBy("n", "x", "y").agg(F.collect_set("token").alias("tokens")).select(F.explode("tokens").alias("token"), F.array_min("tokens").alias("item"))


def mine(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and rules from rows of ``tokens`` and ``verdict`` (null verdicts are
    left out): the items as ``together`` gives them, and all rules of enough
    support and confidence, with ``needs``, their items, and ``through``, the one
    of these that the index holds them by."""
    spark = labelled.sparkSession
    rows = stored(labelled.where(F.col("verdict").isNotNull() & (F.size("tokens") > 0)).select("tokens", "verdict", F.monotonically_increasing_id().alias("id")), "labelled-urls")
    if rows.isEmpty():
        return spark.createDataFrame([], "token string, item string"), spark.createDataFrame([], "through string, needs array<string>, said string, confidence double, support double")
    items = stored(together(rows), "url-items")
    said = F.concat(F.lit("verdict="), F.col("verdict"))
    held = rows.select("id", said.alias("said"), F.explode("tokens").alias("token")).join(F.broadcast(items), "token")  # few, see ``together``
    held = held.groupBy("id", "said").agg(F.collect_set("item").alias("items"))
    # Rows without a frequent token count too.
    every = rows.select("id", said.alias("verdict")).join(held.select("id", "items"), "id", "left").select(F.array_append(F.coalesce("items", F.array().cast("array<string>")), F.col("verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=MIN_SUPPORT, minConfidence=MIN_CONFIDENCE).fit(every)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith("verdict=")).select(
        F.array_sort("antecedent").alias("needs"), F.regexp_replace(F.element_at("consequent", 1), "^verdict=", "").alias("said"), "confidence", "support"
    )
    # The index holds a rule by its rarest item; frequent single items are few.
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    rarest = rules.select("needs", F.explode("needs").alias("token")).distinct().join(single, "token").groupBy("needs").agg(F.min(F.struct("freq", "token")).alias("least"))
    return items, stored(rules.join(rarest, "needs").select(F.col("least.token").alias("through"), "needs", "said", "confidence", "support"), "url-rules")


def surest(token_sets: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct ``tokens`` that a rule matches, what the best rule said
    and its tokens (``mined``): the surest, then the one of most support, of
    fewest tokens, and first in order."""
    met = token_sets.where(F.size("tokens") > 0).select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(items), "token")
    # What a set has of each item: its least token.
    held = met.groupBy("tokens", "item").agg(F.min("token").alias("token")).groupBy("tokens").agg(F.map_from_entries(F.collect_list(F.struct("item", "token"))).alias("held"))
    asked = held.select("tokens", "held", F.explode(F.map_keys("held")).alias("through"), F.pmod(F.xxhash64("tokens"), F.lit(SALTS)).cast("int").alias("salt"))
    spread = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = asked.join(spread, ["through", "salt"]).where(F.forall("needs", lambda i: F.map_contains_key("held", i)))
    named = F.array_join(F.array_sort(F.transform("needs", lambda i: F.element_at("held", i))), " ")
    order = F.struct((-F.col("confidence")).alias("a"), (-F.col("support")).alias("b"), F.size("needs").alias("c"), named.alias("mined"), "said")
    best = met.groupBy("tokens").agg(F.min(order).alias("best"))
    return best.select("tokens", "best.said", "best.mined")


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """Key, host, path, rule, verdict, and the mined rule that decided, if one did."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    said = reduce(lambda rest, r: F.when(F.col("rule") == r[0], F.lit(r[1])).otherwise(rest), rules, F.lit(None).cast("string"))
    rows = rows.withColumn("verdict", said).drop("url")
    open_sets = rows.where("verdict is null").select("tokens").distinct()
    found = surest(open_sets, *mine(rows.select("tokens", "verdict")))
    # Joined over salts: one set of tokens may be that of a large share of the pages.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "path"), F.lit(SALTS)).cast("int"))
    whole = salted.join(found.select("*", salts), ["tokens", "salt"], "left")
    open_one = F.col("verdict").isNull()
    return whole.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", "said", F.lit("allow")).alias("verdict"), F.when(open_one, F.col("mined")).alias("mined"))


def parse_rules(lines: str) -> list[tuple[str, str]]:
    """Lines such as ``block example.org/es/`` as (rule, verdict)."""
    return [(rule, verdict) for verdict, rule in re.findall(r"(allow|block) (\S+)", lines)]
