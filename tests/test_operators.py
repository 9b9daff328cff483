"""Edge cases of the step-sequence operators."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stepweave.functions.columns import LENGTH_BUCKETS, bucket, has_quote_pair, not_blank
from stepweave.operators import agreement, judging, patterns, rollups, sampling, sequences, vectors
from stepweave.sources import tables
from stepweave.sources.versions import Stages

STEP = "repo_slug string, file_path string, scenario string, line int, cluster_id int, text string, is_background boolean"


def steps(spark, *scenarios, repo="o_r", file="f"):
    rows = [(repo, file, name, i, c, f"t{c}", False) for name, ids in scenarios for i, c in enumerate(ids)]
    return spark.createDataFrame(rows, STEP)


def dealt(rows, size=4096):
    """Numbered steps, and all windows."""
    numbered = tables.cut(sequences.numbered(tables.cut(sequences.placed(rows))))
    return numbered, sequences.slices(sequences.blocks(numbered, size=size))


def ranking(rows):
    numbered, windows = dealt(rows)
    return sequences.ranking(windows, numbered)


def test_blank_and_null_scenarios_go_and_unclustered_steps_close_up(spark):
    rows = steps(spark, ("a", [1, None, 2]), (" \t", [1, 2]), (None, [1, 2]), ("b", [5]))
    assert [(r["scenario"], r["ids"]) for r in sequences.scenarios(rows).collect()] == [("a", [1, 2])]


@pytest.mark.parametrize("n", [1, 2, 18, 19, 30])
def test_window_counts(spark, n):
    got = sequences.slices(sequences.scenarios(steps(spark, ("a", list(range(n)))))).count()
    assert got == sum(n - length + 1 for length in range(2, min(18, n) + 1))


def test_support_counts_overlaps_of_one_scenario(spark):
    ranked = ranking(steps(spark, ("a", [7, 7, 7, 7])))
    row = ranked.where("pattern = '7,7'").first()
    assert (row["support_total"], row["n_distinct_scenarios"], row["max_within_file_recurrence"]) == (3, 1, 1)


def test_repositories_of_one_owner_are_one_owner(spark):
    rows = steps(spark, ("a", [1, 2]), repo="o_r1").union(steps(spark, ("a", [1, 2]), repo="o_r2"))
    row = ranking(rows).first()
    assert (row["n_distinct_repos"], row["n_distinct_orgs"]) == (2, 1)


@pytest.mark.parametrize("size", [18, 23, 64, 4096])
def test_long_scenarios_are_dealt_over_rows(spark, size):
    """All windows once, wherever the rows are cut."""
    rng = random.Random(size)
    made = [(f"s{i}", [rng.randrange(3) for _ in range(n)]) for i, n in enumerate([1, 2, 3, 17, 18, 19, 40, 200, 5])]
    rows = steps(spark, *made).repartition(5)
    want = sorted((r["scenario"], r["position_start"], r["L"], r["pattern"], tuple(r["text_seq"])) for r in sequences.slices(sequences.scenarios(rows)).collect())
    numbered, windows = dealt(rows, size)
    assert sorted((r["scenario"], r["position_start"], r["L"], r["pattern"], tuple(r["text_seq"])) for r in windows.collect()) == want
    assert [r["at"] for r in numbered.orderBy("at").collect()] == list(range(sum(len(ids) for _, ids in made)))
    first = {}
    for scenario, position, _, pattern, texts in want:
        first.setdefault(pattern, (scenario, position, texts))
        first[pattern] = min(first[pattern], (scenario, position, texts))
    got = {r["pattern"]: tuple(r["canonical_text_seq"]) for r in sequences.ranking(windows, numbered, 1).collect()}
    assert got == {p: v[2] for p, v in first.items()}


def test_bucket_raises_outside(spark):
    with pytest.raises(Exception, match="outside all buckets"):
        spark.range(1).select(bucket(F.lit(19), LENGTH_BUCKETS)).collect()


def test_unicode_words_and_blanks(spark):
    df = spark.createDataFrame([(['"é" "b"'], "　"), (["x"], "y")], "t array<string>, s string")
    assert [tuple(r) for r in df.select(has_quote_pair(F.col("t")), not_blank(F.col("s"))).collect()] == [(True, False), (False, True)]


def test_closure_needs_equal_support_and_scope(spark):
    rows = [("1,2,3", 3, 5, "RQ3"), ("1,2,3,4", 4, 5, "RQ3"), ("2,3,4", 3, 6, "RQ3"), ("1,2", 2, 5, "RQ2")]
    df = spark.createDataFrame(rows, "pattern string, L int, support_total long, scope_org string")
    assert [r["pattern"] for r in patterns.non_closed(df).distinct().collect()] == ["1,2,3"]


def test_agreement_edges(spark):
    one = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "a")], "item long, label string")
    assert agreement.fleiss_kappa(one, 2).first()["kappa"] == 1.0
    votes = spark.createDataFrame([(1, "y"), (1, "n"), (2, "y"), (3, "y"), (3, "y"), (3, "n")], "item long, label string")
    assert {r["item"]: r["label"] for r in agreement.majority(votes).collect()} == {1: "tie", 2: "y", 3: "y"}
    assert agreement.auc(spark.createDataFrame([(1, 1), (2, 1)], "score long, actual int")).first()["auc"] is None
    assert agreement.binary_metrics(spark.createDataFrame([(0, 0)], "actual int, predicted int")).first()["f1"] == 0.0


def test_sinks_round_trip_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "k long, v string")
    path = str(tmp_path / "out")
    tables.append_missing(df.where("k = 1"), path, "k")
    tables.append_missing(df, path, "k")
    assert sorted(r["k"] for r in tables.read_jsonl(spark, path, "k long, v string").collect()) == [1, 2]
    odd = spark.createDataFrame([(None, "n"), (3, "c"), (3, "d")], "k long, v string")
    for _ in range(2):
        tables.append_missing(odd, path, "k")
    assert sorted(r["k"] or 0 for r in tables.read_jsonl(spark, path, "k long, v string").collect()) == [0, 1, 2, 3]
    with pytest.raises(FileNotFoundError):
        tables.Catalog(spark, (path,)).table("absent")


def test_verdicts(spark):
    more = {6: '{"extraction_worthy": "y"}', 7: '{"extraction_worthy": "unsure"}', 8: '{"extraction_worthy": true}', 9: '{"extraction_worthy": "it is flagged as spec"}', 10: '{"extraction_worthy": "", "label_a": "no"}', 11: 'so {"label_a": "no"}'}
    said = more | {1: '```json\n{"extraction_worthy": "Yes"}\n```', 2: 'I think {"extraction_worthy": "Flagged Spec"} fits {"x": 1}', 3: "", 4: None, 5: '{"label_extraction_worthy": "no"}'}
    df = spark.createDataFrame(list(said.items()), "k long, c string")
    got = {r["k"]: r["v"] for r in judging.parsed(df, "c").withColumnRenamed("verdict", "v").collect()}
    assert got == {1: "yes", 2: "flagged-spec", 3: "PARSE_FAIL", 4: "API_FAIL", 5: "no", 6: "yes", 7: "PARSE_FAIL", 8: "PARSE_FAIL", 9: "flagged-spec", 10: "no", 11: "PARSE_FAIL"}


def test_mismatches_and_null_texts(spark):
    rows = [("1,2", 2, 4, 2, 1, 1, 2, 1, 4, ["a", None], "shared_higher_level_step"), ("1,3", 2, 4, 2, 2, 2, 2, 1, 4, ['x "a" "b"', None], "shared_higher_level_step"), ("1,4", 2, 4, 1, 1, 2, 2, 2, 4, [None, "<p>"], None)]
    df = spark.createDataFrame(rows, "pattern string, L int, support_total long, n_distinct_repos long, n_distinct_orgs long, n_distinct_files long, max_within_repo_files long, max_within_file_recurrence long, n_distinct_scenarios long, canonical_text_seq array<string>, said string")
    got = {r["pattern"]: r for r in patterns.qa_flags(patterns.with_scopes(df), F.col("said")).collect()}
    assert [got[p]["mechanism_mismatch"] for p in ("1,2", "1,3", "1,4")] == [True, False, False]
    assert [got[p]["templated_outline"] for p in ("1,2", "1,3", "1,4")] == [False, False, True]
    assert got["1,3"]["quality_score"] == 4 * 2.0 * 2


def test_asking_retries_and_gives_up(spark):
    def client(prompt):
        if prompt == "bad":
            raise OSError
        return prompt.upper()

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "k long, prompt string")
    assert {r["k"]: r["content"] for r in judging.ask(df, client, wait=lambda s: None).collect()} == {1: "OK", 2: None}


def test_auc_and_folds_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice([-1.0, float("inf"), rng.gauss(0, 3)]), rng.randint(0, 1)) for _ in range(800)]
    pairs = [(a, b) for a, k in rows if k == 1 for b, k in rows if k == 0]
    want = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    assert agreement.auc(spark.createDataFrame(rows, "score double, actual int")).first()["auc"] == pytest.approx(want)
    labels = {i: None if i % 7 == 0 else i % 2 for i in range(1000)}
    made = sampling.folds(spark.createDataFrame([(str(i), k) for i, k in labels.items()], "pattern string, label int"))
    assert made.columns == ["pattern", "label", "fold"]
    got = {int(r["pattern"]): r["fold"] for r in made.collect()}
    for label in (None, 0, 1):
        own = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i, k in labels.items() if k == label)
        assert [got[i] for _, i in own] == [n % 5 for n in range(len(own))]
    assert len(got) == 1000


@pytest.mark.parametrize("ranges", [1, 4, 256])
def test_percentiles_without_a_buffer_of_values(spark, ranges):
    rng = random.Random(ranges)
    rows = [(k, rng.choice([rng.random(), 0.25, 7.0])) for k in ("a", "b", None) for _ in range(rng.randrange(1, 90))] + [("c", 1.5), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    marks = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in rollups.percentiles(df, "k", "v", marks, ranges).collect()}
    want = {r["k"]: r for r in df.where("v is not null").groupBy("k").agg(*[F.percentile("v", q).alias(n) for n, q in marks.items()], F.count("v").alias("n")).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert [got[k][c] for c in (*marks, "n")] == pytest.approx([r[c] for c in (*marks, "n")])


def test_left_join_with_repeated_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "k int, t string")
    right = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "k int, cluster_id int")
    got = sorted((tuple(r) for r in tables.left_join(left, right, ["k"]).collect()), key=repr)
    assert got == sorted([(1, "a", 10), (1, "a", 11), (1, "a", 10), (1, "a", 11), (2, "b", None), (None, "c", None)], key=repr)
    row = tables.key_audit(right, ["k"]).first()
    assert (row["rows"], row["keys"], row["repeated_keys"], row["most"]) == (3, 2, 1, 2)


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, None, 1.5)], "k int, t string, v double")
    tables.write_csv(df, str(tmp_path / "c"))
    tables.write_parquet(df, str(tmp_path / "p"))
    assert sorted(tables.read_csv(spark, str(tmp_path / "c"), "k int, t string, v double").collect()) == sorted(df.collect())
    assert sorted(spark.read.parquet(str(tmp_path / "p")).collect()) == sorted(df.collect())
    last = tables.latest_per_key(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string"), "k", "n")
    assert sorted((r["k"], r["v"]) for r in last.collect()) == [("a", "y"), ("b", "z")]


def test_vectors_are_made_once(spark, tmp_path):
    """The second run asks the model for nothing that the first one had."""
    stages, calls = Stages(spark, f"file://{tmp_path}/cache"), tmp_path / "calls"
    calls.mkdir()

    def model(texts):
        for i, t in enumerate(texts):
            (calls / f"{len(list(calls.iterdir()))}-{i}-{hashlib.md5(t.encode()).hexdigest()}").touch()
        return vectors.hashed_words(texts)

    docs = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, None), (4, "blue")], "k int, text string")
    first = {r["k"]: r["vector"] for r in vectors.cached(docs, model, stages, "k").collect()}
    asked = len(list(calls.iterdir()))
    assert asked == 3 and first[1] == first[2] and set(first) == {1, 2, 3, 4}
    assert {r["k"]: r["vector"] for r in vectors.cached(docs, model, stages, "k").collect()} == first and len(list(calls.iterdir())) == asked
    more = docs.union(spark.createDataFrame([(5, "green tea")], docs.schema))
    assert vectors.cached(more, model, stages, "k").count() == 5 and len(list(calls.iterdir())) == asked + 1
    assert sum(x * x for x in first[1]) == pytest.approx(1, abs=1e-6) and not any(first[3])
