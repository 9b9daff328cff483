"""How often steps are dealt over tasks, and what is broadcast."""

from pyspark.sql import functions as F

from stepweave.operators import rollups, sequences
from stepweave.sources.tables import cut, lineitem_steps

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def steps(spark, repo="r"):
    rows = [(repo, "f", s, i, (i * i) % 3, f"t{i}", False) for s, n in (("a", 7), ("b", 23), ("c", 2)) for i in range(n)]
    return spark.createDataFrame(rows, "repo_slug string, file_path string, scenario string, line int, cluster_id int, text string, is_background boolean")


def test_lines_are_dealt_by_part_and_by_order_alone(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = plan(lineitem_steps(spark, DATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in made.splitlines() if "Exchange" in x]
    assert sum("(l_partkey" in x for x in dealt) == 1
    assert sum("(l_orderkey" in x for x in dealt) == 1
    assert sum("(o_orderkey" in x for x in dealt) == 1  # orders; not the lines once more
    assert sum("(o_custkey" in x for x in dealt) == 1


def test_blocks_deal_steps_once(spark):
    made = plan(sequences.blocks(sequences.numbered(cut(sequences.placed(steps(spark)))), size=8, parts=3))
    assert not [x for x in made.splitlines() if "hashpartitioning" in x and "block#" in x]
    assert "rangepartitioning(block#" in made


def test_blocks_of_no_repository(spark):
    """Scenarios of a null repository go on over rows as others do."""
    held = {}
    for repo in ("r", None):
        rows = sequences.blocks(sequences.numbered(cut(sequences.placed(steps(spark, repo)))), l_max=3, size=8, parts=3)
        held[repo] = sorted(map(tuple, rows.select("scenario", "ids", "texts", "n", "at", "start", "scen", "dealt").collect()), key=str)
    assert held["r"] == held[None]
    assert sum(r[0] == "b" for r in held["r"]) == 4
    assert {r[5] for r in held["r"] if r[0] == "b"} == {0, 1, 9, 17}


def test_few_patterns_are_broadcast_to_their_units(spark):
    rows = spark.range(40).select(F.concat_ws(",", F.col("id") % 5, F.col("id") % 2).alias("pattern"), (F.col("id") % 3).alias("unit"))
    ranked = rows.select("pattern").distinct().select("pattern", F.lit(2).alias("max_within_file_recurrence"), F.lit(1).alias("max_within_repo_files"), F.lit(2).alias("n_distinct_orgs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flags = rollups.unit_flags(rows, cut(ranked), "unit")
        assert "BroadcastHashJoin" in plan(flags)
        assert sorted(map(tuple, flags.collect())) == [(u, True, True, False, True) for u in range(3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
