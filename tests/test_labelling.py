"""Edge cases of pools, raters, judges, vectors, reports and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepweave.operators import agreement, judging, patterns, sampling, sequences, vectors
from stepweave.sources import report, tables
from stepweave.streaming import supports

POOL = "pattern string, L int, stratum string, scope_repo string, support_total long, n_distinct_repos long, max_within_repo_files long, max_within_file_recurrence long"


@pytest.mark.parametrize("target", [1, 7, 40, 1000])
def test_strata_share_and_fill_up(spark, target):
    rows = spark.range(600).select(F.col("id").cast("string").alias("pattern"), F.when(F.col("id") < 500, "big").otherwise(F.concat(F.lit("c"), F.col("id") % 9)).alias("cell"))
    got = sampling.stratified(rows, ["cell"], target).collect()
    assert len({r["pattern"] for r in got}) == len(got) == min(target, 600)
    if target == 40:
        assert len({r["cell"] for r in got}) == 10
        assert {r["pattern"] for r in got} == {r["pattern"] for r in sampling.stratified(rows.repartition(7), ["cell"], target).collect()}
    assert sampling.stratified(rows.where("false"), ["cell"], target).count() == 0


def test_pilot_takes_one_of_each_length(spark):
    rows = [(f"p{i}", 2 + i % 2, "real_signal", "RQ1", 30, 1, 1, 9 - i) for i in range(5)] + [("s", 12, "spec_dominated", "RQ3", 5, 2, 1, 1)]
    got = {(r["quota"], r["pattern"]) for r in sampling.pilot(spark.createDataFrame(rows, POOL)).collect()}
    assert got == {("RQ1-within-file", "p0"), ("RQ1-within-file", "p1"), ("spec-dominated", "s")}


def test_examples_avoid_suites(spark):
    pool = spark.createDataFrame([("1,2",), ("9",)], "pattern string")
    slices = spark.createDataFrame([("1,2", "a", "suite", "s", 0), ("1,2", "b", "plain", "s", 3)], "pattern string, repo_slug string, file_path string, scenario string, position_start int")
    suites = spark.createDataFrame([("a", "suite", True), ("b", "plain", False)], "repo_slug string, file_path string, is_spec_suite boolean")
    got = {r["pattern"]: (r["example_file"], r["example_on_outlier_file"]) for r in sampling.representatives(pool, slices, suites).collect()}
    assert got == {"1,2": ("plain", False), "9": (None, None)}


def test_judges_without_cases(spark):
    verdicts = spark.createDataFrame([("m", 1, "API_FAIL", None), ("n", 1, "yes", "x"), ("n", 2, "yes", "x")], "model string, item long, verdict string, mechanism string")
    human = spark.createDataFrame([(1, "yes", "x"), (2, "tie", "x")], "item long, label string, mechanism string")
    rows = {r["model"]: r for r in agreement.judge_summary(verdicts, human, judging.FAILURES).collect()}
    assert (rows["m"]["n_failed"], rows["m"]["n_compared"], rows["m"]["accuracy"], rows["m"]["f1"]) == (1, 0, 0.0, 0.0)
    assert (rows["n"]["n_compared"], rows["n"]["accuracy"], rows["n"]["kappa"], rows["n"]["mechanism_accuracy"]) == (1, 1.0, None, 1.0)
    assert agreement.erfc_p(5.6889) == pytest.approx(0.01707, abs=1e-4)


def test_one_rater_is_not_a_majority(spark):
    votes = spark.createDataFrame([(1, "A", "y"), (1, "B", "n"), (2, "A", "n"), (2, "B", "n"), (2, "C", "y")], "item long, rater string, label string")
    got = {r["item"]: (r["labels_per_rater"], r["n_raters"], r["label"]) for r in agreement.by_rater(votes, 3).collect()}
    assert got == {1: ({"A": "y", "B": "n"}, 2, "y"), 2: ({"A": "n", "B": "n", "C": "y"}, 3, "n")}


def test_waits_grow_and_refusals_end_it(spark, tmp_path):
    log = str(tmp_path / "log")

    def wait(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds:g} ")

    def client(prompt):
        raise judging.Refused if prompt == "never" else OSError

    df = spark.createDataFrame([("later",), ("never",)], "prompt string").coalesce(1)
    assert [r["content"] for r in judging.ask(df, client, 8, wait).collect()] == [None, None]
    assert open(log).read() == "2 4 8 16 32 60 60 "


def test_unknown_clusters_have_no_weight(spark):
    known = spark.createDataFrame([(1, [1.0, 3.0]), (2, [4.0, 0.0])], "cluster_id int, vector array<float>")
    rows = spark.createDataFrame([("1,1,2",), ("1,9",), ("9,9",)], "pattern string")
    got = {(r["pattern"], r["pos"]): r["value"] for r in vectors.pooled(rows, known).collect()}
    assert got == {("1,1,2", 0): 2.0, ("1,1,2", 1): 2.0, ("1,9", 0): 1.0, ("1,9", 1): 3.0, ("9,9", 0): 0.0, ("9,9", 1): 0.0}


def test_embedding_in_tasks(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "k long, text string")
    got = vectors.embed(df, lambda texts: np.array([[len(t)] for t in texts]), "k").collect()
    assert {r["k"]: r["vector"] for r in got} == {1: [3.0], 2: [0.0]}


def test_only_noise(spark):
    row = vectors.cluster_summary(spark.createDataFrame([(-1,), (-1,)], "cluster_id int")).first()
    assert (row["n_clusters"], row["n_noise"], row["noise_fraction"], row["size_max"]) == (0, 2, 1.0, None)


def test_report_escapes_and_cuts(spark, tmp_path):
    df = spark.createDataFrame([("<b>", 1), (None, 2), ("late", 3)], "name string, n int").orderBy("n")
    report.write_html(spark, {"A & B": df}, str(tmp_path / "page"), most=2)
    page = spark.read.option("wholetext", True).text(str(tmp_path / "page")).first()["value"]
    assert "A &amp; B" in page and "&lt;b&gt;" in page and "late" not in page


def test_report_folds_out_steps_and_places(spark, tmp_path):
    rows = spark.createDataFrame([("1,2", 3, ["a <b>", "c"]), ("2,2", 1, ["c", "c"])], "pattern string, n int, canonical_text_seq array<string>").orderBy(F.desc("n"))
    sites = spark.createDataFrame([("1,2", 2, "r/late", 0, ["a", "c"]), ("1,2", 1, "r/f", 4, ["A", "C"])], "pattern string, site int, place string, start int, texts array<string>")
    report.write_html(spark, {"Best": (rows, sites)}, str(tmp_path / "page"))
    page = spark.read.option("wholetext", True).text(str(tmp_path / "page")).first()["value"]
    first, second = page.split("<tbody>")[1:]
    assert "a &lt;b&gt;" in first and first.index("r/f from step 5</p><ol start='5'><li>A") < first.index("r/late")
    assert "no places" in second and "canonical_text_seq" not in page and page.count("<details>") == 2


def test_site_texts_are_those_of_the_place(spark):
    steps = spark.createDataFrame([("r", "f", "s", i, i % 2, f"t{i}", False) for i in range(5)], "repo_slug string, file_path string, scenario string, line int, cluster_id int, text string, is_background boolean")
    numbered = sequences.numbered(tables.cut(sequences.placed(steps)))
    rows = sequences.slices(sequences.blocks(numbered, 3), 3)
    got = patterns.site_texts(rows, spark.createDataFrame([("0,1",)], "pattern string"), numbered, 2).orderBy("site").collect()
    assert [(r["position_start"], r["texts"]) for r in got] == [(0, ["t0", "t1"]), (2, ["t2", "t3"])]


def test_probe_and_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "k long, `a.b` string")
    assert [tuple(r) for r in tables.probe(df).collect()] == [(0, "k", "bigint", 2, 0), (1, "a.b", "string", 2, 1)]
    assert tables.common_columns(df, df.select("k")) == ["k"]
    tables.write_summary(df.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "s"))
    assert tables.read_document(spark, str(tmp_path / "s")).first()["n"] == 2
    row = tables.read_verdicts(spark, str(tmp_path / "s"), "n long").first()
    assert row["n"] == 2 and row["source_file"].endswith(".json")


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("o_r", "f", "a", [1, 2, 1, 2], ["x", "y", "x", "y"], 4)], "repo_slug string, file_path string, scenario string, ids array<int>, texts array<string>, n int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    supports.supports(stream).writeStream.outputMode("complete").format("memory").queryName("held").trigger(availableNow=True).start().awaitTermination()
    want = sequences.slices(rows).groupBy("pattern").count().collect()
    assert {r["pattern"]: r["support_total"] for r in spark.table("held").collect()} == {r["pattern"]: r["count"] for r in want}
    new = stream.select("scenario", "n")
    for turn in ("1", "2"):
        supports.append_new(new, str(tmp_path / "out"), "scenario", str(tmp_path / turn)).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 1


@pytest.mark.parametrize(
    ("content", "said", "how"),
    [
        ('\n```json\n{"label_a": "yes"}\n```', "yes", "n/a"),
        ('{"extraction_worthy": [], "label_a": "no"}', "no", "n/a"),
        ('{"extraction_worthy": 0.0, "label_a": "no"}', "no", "n/a"),
        ('{"extraction_worthy": "no", "extraction_worthy": "yes"}', "yes", "n/a"),
        ('{"extraction_worthy": "yes", "mechanism": "n/a\\n"}', "yes", "n/a"),
        ('{"extraction_worthy": null, "label_a": false, "mechanism": true}', "PARSE_FAIL", "PARSE_FAIL"),
        ('so {"extraction_worthy": null} it is', "PARSE_FAIL", "n/a"),
        ('{"label_a": "yes"} and more', "PARSE_FAIL", "PARSE_FAIL"),
    ],
)
def test_answers_of_judges(spark, content, said, how):
    df = spark.createDataFrame([(content,)], "c string")
    assert tuple(judging.parsed(df, "c").select("verdict", "mechanism").first()) == (said, how)


def test_models_are_asked_once_a_key(spark, tmp_path):
    """Two models with passing and lasting errors; a run that was ended goes on."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def client(model, system, prompt):
        n = len(list(calls.glob(f"{model}-{prompt}-*")))
        (calls / f"{model}-{prompt}-{n}").touch()
        if prompt == "p1" and n == 0:
            raise judging.Status(429, retry_after=3)
        if prompt == "p2" and n < 2:
            raise judging.Status(503)
        if prompt == "p3" and model == "b":
            raise judging.Status(400, "bad request")
        return '{"extraction_worthy": "yes", "mechanism": "background"}'

    prompts = spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(6)], "pattern string, prompt string")
    ask = lambda rows: judging.ask_models(rows, ["a", "b"], client, str(tmp_path / "log"), wait=lambda s: None, batch=2)
    ask(prompts.where("pattern < 'k3'"))
    rows = ask(prompts).collect()
    assert len(rows) == 12 == len({(r["model"], r["pattern"]) for r in rows})
    bad = {(r["model"], r["pattern"]): r for r in rows if r["verdict"] != "yes"}
    assert set(bad) == {("b", "k3")} and bad["b", "k3"]["verdict"] == "API_FAIL" and bad["b", "k3"]["notes"].startswith("400")
    tries = {m: len(list(calls.glob(f"{m}-*"))) for m in "ab"}
    assert tries == {"a": 6 + 1 + 2, "b": 6 + 1 + 2}
