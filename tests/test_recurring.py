"""Long windows counted in ranges of the steps that follow: the same as by tasks."""

import pytest
from pyspark.sql import functions as F

from stepweave.operators import sequences
from stepweave.plans import catalogue
from stepweave.sources import tables

STEP = "repo_slug string, file_path string, scenario string, line int, cluster_id int, text string, is_background boolean"
COLUMNS = ["pattern", "L", "repo_slug", "file_path", "n", "scenarios", "spot"]


def blocks_of(spark, rows, size):
    numbered = tables.cut(sequences.numbered(tables.cut(sequences.placed(spark.createDataFrame(rows, STEP).repartition(3)))))
    return tables.cut(sequences.blocks(numbered, size=size))


def made(spark, size=64):
    """Random steps, one scenario of equal steps, a null repository, long and short ones."""
    rows = []
    for s, n in enumerate([1, 2, 3, 17, 18, 19, 40, 200, 5, 6, 30, 7, 90, 90]):
        repo, file = (f"o{s % 2}_r{s % 3}" if s % 5 else None), f"f{s % 2}"
        rows += [(repo, file, f"s{s}", i, 7 if s >= 12 else [3, 11, -4][(i * i * (s + 3) // 5) % 3], f"t{i}", False) for i in range(n)]
    return blocks_of(spark, rows, size)


def rows_of(df):
    return sorted(repr([r[c] for c in COLUMNS]) for r in df.select(*COLUMNS).collect())


def by_file_of(df):
    """One row a pattern and file: a file may come several times."""
    return df.groupBy("pattern", "L", "repo_slug", "file_path").agg(F.sum("n").alias("n"), F.sum("scenarios").alias("scenarios"), F.min("spot").alias("spot"))


@pytest.mark.parametrize(("short", "size", "l_max"), [(2, 40, 18), (2, 25, 18), (5, 1000, 18), (1, 9, 4)])
def test_ranges_tell_what_tasks_tell(spark, short, size, l_max):
    blocks = made(spark)
    want = by_file_of(sequences.by_file(blocks, l_max).where(F.col("L") > short))
    again = want.groupBy("pattern").agg(F.sum("n").alias("_n")).where("_n >= 2").select("pattern")
    want = want.join(again, "pattern", "left_semi")
    found = tables.cut(sequences.recurring(blocks, short, l_max, size=size))
    assert (found.where("scen is not null").count() > 0) and (size < 40 or found.where("scen is null").count() > 0)
    got = sequences.merged(found)
    # Ends of ranges may hand on windows that are alone.
    kept = by_file_of(got).join(again, "pattern", "left_semi")
    assert want.count() > 20 and rows_of(kept) == rows_of(want)
    alone = got.join(again, "pattern", "left_anti")
    assert alone.agg(F.max("n")).first()[0] in (None, 1)
    # As ``totals`` are of all windows.
    short_ones = sequences.by_file(blocks, l_max).where(F.col("L") <= short)
    both = [sequences.totals(rows).orderBy("pattern").collect() for rows in (short_ones.unionByName(got), sequences.by_file(blocks, l_max))]
    assert both[0] == both[1]


def test_no_rows(spark):
    assert sequences.merged(sequences.recurring(made(spark).where("false"), 2)).count() == 0
    assert sequences.merged(sequences.recurring(made(spark), 18)).count() == 0


def test_long_windows_that_do_not_recur_are_not_stored(spark):
    """Each of 3,000 different steps begins windows of all lengths; none recurs."""
    rows = [("o_r", "f", f"s{s}", i, s * 30 + i, "t", False) for s in range(100) for i in range(30)]
    blocks = blocks_of(spark, rows, 4096)
    short = sequences.short_length(blocks)
    assert short == 2
    assert sequences.by_file(blocks).count() == sum(100 * (31 - n) for n in range(2, 19))
    assert sequences.by_file(blocks, short).count() == 2900
    assert sequences.recurring(blocks, short).count() <= 2 * 16


def test_stored_windows_are_short_or_recur(spark):
    files = catalogue._by_file(spark, "/root/testdata/sf0.001", "ev")
    n = files.groupBy("pattern", "L").agg(F.sum("n").alias("n"))
    short = sequences.short_length(catalogue._blocks(spark, "/root/testdata/sf0.001", "ev"))
    assert short == 7
    assert n.where((F.col("L") > short) & (F.col("n") < 2)).count() <= 2 * 18
    assert n.where(F.col("L") > short).count() > 0
