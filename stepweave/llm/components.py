"""Connected components of a graph of links, by joins and sums alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import stored

SALTS = 8


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of
    ``edges`` (columns a and b) that is not itself a root.

    Large-star and small-star rounds in turn: each links a node's neighbours to
    the least of them. A round only joins nodes to minima, so a node of many
    links is never gathered in one place.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(pairs, name)
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Over salts: a node may have a large share of all links.
        spread = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = spread.join(least, ["a", "salt"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        wide = lower.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        small = large.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(wide, ["a", "salt"])
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(lower.select("a", F.col("m").alias("b")))
        now = stored(moved.distinct(), name)
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
