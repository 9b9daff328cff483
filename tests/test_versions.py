"""Versions of stage tables, pinned by their readers."""

import pytest

from pyspark.sql import functions as F

from stepweave.sources.versions import Stages


@pytest.fixture
def stages(spark, tmp_path):
    return Stages(spark, f"file://{tmp_path}/stages")


def test_readers_keep_to_their_version(spark, stages):
    first = stages.write("t", spark.range(10).withColumn("x", F.col("id") * 2))
    held = stages.read("t", "x")
    # Overwritten by what was just read of it.
    second = stages.write("t", first.where("id < 4").withColumn("y", F.lit("new")))
    assert held.columns == ["x"] and held.count() == 10 and first.count() == 10
    assert second.count() == 4 and stages.read("t").columns == ["id", "x", "y"] and stages.read("t", version=1).count() == 10
    assert stages.versions("t") == [1, 2] and not stages.exists("u")
    with pytest.raises(FileNotFoundError):
        stages.read("t", version=9)


def test_buckets_spare_a_shuffle(spark, stages):
    rows = spark.range(500).select(F.concat(F.lit("p"), F.col("id") % 50).alias("pattern"), "id")
    stages.write("a", rows, bucket_by="pattern", buckets=4)
    stages.write("b", rows.select("pattern").distinct(), bucket_by="pattern", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stages.read("a").join(stages.read("b"), "pattern")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unfinished_versions_are_not_seen(spark, stages, tmp_path):
    stages.write("t", spark.range(3))
    (tmp_path / "stages/t/v-half").mkdir()  # a writer that died before it committed
    (tmp_path / "stages/t/_pointers/0000000002").touch()  # and one while it did
    assert stages.versions("t") == [1] and stages.read("t").count() == 3
    stages.write("t", spark.range(5))
    assert stages.versions("t") == [1, 3] and stages.read("t").count() == 5
    assert stages.vacuum("t") == 2 and stages.versions("t") == [3] and stages.read("t").count() == 5
