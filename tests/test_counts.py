"""Windows counted within tasks: the same as by slices."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stepweave.operators import patterns, rollups, sequences
from stepweave.plans import catalogue
from stepweave.sources import tables

STEP = "repo_slug string, file_path string, scenario string, line int, cluster_id int, text string, is_background boolean"


def made(spark, size, seed=1):
    rng = random.Random(seed)
    rows = []
    for s, n in enumerate([1, 2, 3, 17, 18, 19, 40, 200, 5, 6, 30, 7]):
        repo, file = f"o{s % 2}_r{s % 3}", f"f{s % 2}"
        rows += [(repo, file, f"s{s}", i, rng.choice([3, 11, -4]), f't{rng.randrange(9)} "a" "b"' if rng.random() < 0.1 else f"t{i}", False) for i in range(n)]
    numbered = tables.cut(sequences.numbered(tables.cut(sequences.placed(spark.createDataFrame(rows, STEP).repartition(3)))))
    return numbered, tables.cut(sequences.blocks(numbered, size=size))


def rows_of(df, *columns):
    return sorted(repr([r[c] for c in columns]) for r in df.select(*columns).collect())


@pytest.mark.parametrize(("size", "support"), [(18, 1), (64, 2), (4096, 2)])
def test_equals_slices(spark, size, support):
    numbered, blocks = made(spark, size)
    slices = sequences.slices(blocks)
    files = tables.cut(sequences.by_file(blocks))
    got, want = tables.cut(sequences.ranked(files, blocks, support)), tables.cut(sequences.ranking(slices, numbered, support))
    assert want.count() > 20 and rows_of(got, *sorted(want.columns)) == rows_of(want, *sorted(want.columns)) and set(got.columns) == set(want.columns)
    assert dict(got.dtypes) == dict(want.dtypes)
    low = (1, 1, 0.9)
    suites = [patterns.spec_suite_files(rows, want, *low) for rows in (files, slices)]
    assert rows_of(suites[0], *suites[1].columns) == rows_of(suites[1], *suites[1].columns)
    some = suites[1].withColumn("is_spec_suite", F.col("file_path") == "f1")
    shares = [patterns.outlier_fraction(rows, want, some) for rows in (files, slices)]
    assert rows_of(shares[0], "pattern", "outlier_fraction") == rows_of(shares[1], "pattern", "outlier_fraction")
    assert shares[0].agg(F.countDistinct("outlier_fraction")).first()[0] > 1
    gate = F.col("support_total") >= 4
    names = blocks.where("at = scen").select("scen", *sequences.KEY)
    flags = names.join(rollups.unit_flags(sequences.by_scenario(blocks), want, "scen", gate=gate), "scen")
    want_flags = rollups.scenario_flags(slices, want, gate)
    assert rows_of(flags, *want_flags.columns) == rows_of(want_flags, *want_flags.columns)
    files_of = rollups.unit_flags(files, want, "repo_slug", "file_path", gate=gate)
    assert files_of.count() == want_flags.select("repo_slug", "file_path").distinct().count()


def test_small_chunks_and_no_rows(spark, monkeypatch):
    _, blocks = made(spark, 64)
    want = rows_of(sequences.totals(sequences.by_file(blocks), 1), "pattern", "support_total", "n_distinct_scenarios", "spot")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        with monkeypatch.context() as m:
            m.setattr(sequences, "_CHUNK", 1)  # every row by itself
            assert rows_of(sequences.totals(sequences.by_file(blocks), 1), "pattern", "support_total", "n_distinct_scenarios", "spot") == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sequences.totals(sequences.by_file(blocks.where("false"))).count() == 0 and sequences.by_scenario(blocks.where("false")).count() == 0


def test_equal_windows_of_a_task_are_one_row(spark):
    """Places of one file leave the task as one row a pattern, not one each."""
    rows = spark.createDataFrame([("o_r", "f", f"s{s}", i, i % 2, "t", False) for s in range(50) for i in range(40)], STEP).coalesce(1)
    blocks = tables.cut(sequences.blocks(tables.cut(sequences.numbered(tables.cut(sequences.placed(rows))))).coalesce(1))
    assert sequences.slices(blocks).count() == 50 * sum(40 - n + 1 for n in range(2, 19))
    assert sequences.by_file(blocks).count() == 2 * 17


def test_left_join_does_not_broadcast(spark):
    left = spark.range(100).select(F.col("id").alias("k"))
    right = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    joined = tables.left_join(left, right, ["k"])
    assert joined.count() == 100 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_targets_are_all_labelled_patterns(spark):
    """Not a pool of a bounded size."""
    found = catalogue.QUERIES["classifier_targets"](spark, "/root/testdata/sf0.01")
    assert found.count() > catalogue.LABELS


def test_targets_have_labels_of_all_documents(spark, tmp_path):
    """All patterns with a scope but ties (a share of 1 in 11), by labels of any id; and
    the SQL's rows where ids are null, repeated or far apart."""
    d = "/root/testdata/sf0.01"
    assert catalogue.QUERIES["classifier_targets"](spark, d).count() > 0.8 * catalogue._features(spark, d).count()
    labels = [(None, 1, 0), (None, 0, 0), (7, 1, 0), (7, 1, 0), (7, 0, None), (600, 0, 1), (10**12, 1, 0), (10**12 + 1, None, 0), (-5, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    for t in ("labels", "events"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(duck.execute(f"SELECT pattern, verdict, mechanism, label FROM ({catalogue.ORACLE['classifier_targets']})").fetchall())
    got = catalogue.QUERIES["classifier_targets"](spark, str(tmp_path)).select("pattern", "verdict", "mechanism", "label")
    assert sorted(map(tuple, got.collect())) == want and len({v for _, v, _, _ in want}) >= 3


def test_folds_are_of_all_labelled_patterns(spark):
    found = catalogue.QUERIES["stratified_folds"](spark, "/root/testdata/sf0.01")
    assert found.count() > catalogue.LABELS and found.select("fold").distinct().count() == 5
