"""Every registered query with an SQL form gives the SQL's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from stepweave.plans import catalogue, oracle

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return float(value) if hasattr(value, "is_finite") else value


ROWS_ONLY = {"density_hierarchy", "neighbour_layout", "neighbour_recall", "bootstrap_ci", "feature_importances", "gbt_intervals", "gbt_metrics", "gbt_predictions", "headline_predicted", "fold_measures", "mechanism_metrics", "mechanism_model_and_rule", "mechanism_predictions", "mechanism_rule_agreement", "pattern_clusters", "population_mechanisms", "population_scores", "qa_predicted", "raters_f1", "repo_prevalence_predicted"}


def test_all_others_have_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE) == ROWS_ONLY


def rows_of(spark, name):
    return catalogue.QUERIES[name](spark, str(DATA)).collect()


def test_bootstrap_holds_the_estimates(spark):
    known = {r["metric"]: r for r in rows_of(spark, "bootstrap_ci")}
    whole = rows_of(spark, "classification_metrics")[0].asDict() | {"auc": rows_of(spark, "auc_midrank")[0]["auc"]}
    for name, r in known.items():
        assert r["resamples"] == 1000 and r["low"] < whole[name] < r["high"]


def test_models_out_of_fold(spark):
    rows = rows_of(spark, "gbt_predictions")
    assert {r["fold"] for r in rows} == set(range(5)) and all(0 <= r["p"] <= 1 and r["pred"] == (r["p"] >= 0.5) for r in rows)
    metrics = {r["fold"]: r for r in rows_of(spark, "gbt_metrics")}
    hit = sum(r["label"] == 1 and r["pred"] == 1 for r in rows)
    assert set(metrics) == {None, *range(5)} and metrics[None]["n"] == len(rows)
    assert metrics[None]["recall"] == pytest.approx(hit / sum(r["label"] for r in rows))
    intervals = {r["metric"]: r for r in rows_of(spark, "gbt_intervals")}
    assert intervals["f1"]["low"] <= metrics[None]["f1"] <= intervals["f1"]["high"]
    found = [r["importance"] for r in rows_of(spark, "feature_importances")]
    assert found == sorted(found, reverse=True) and min(found) > 0 and sum(found) == pytest.approx(1)
    rows = rows_of(spark, "mechanism_predictions")
    every = {r["fold"]: r for r in rows_of(spark, "mechanism_metrics")}[None]
    assert every["accuracy"] == pytest.approx(sum(r["mechanism"] == r["predicted"] for r in rows) / len(rows))
    assert catalogue.QUERIES["pattern_clusters"](spark, str(DATA)).select("cluster_id").distinct().count() == 10


def test_measures_with_intervals(spark):
    rows = rows_of(spark, "fold_measures")
    assert {(r["metric"], r["fold"]) for r in rows} == {(m, k) for m in ("precision", "recall", "f1", "auc") for k in range(5)}
    metrics = {r["fold"]: r for r in rows_of(spark, "gbt_metrics")}
    assert all(r["value"] == metrics[r["fold"]][r["metric"]] and r["low"] <= r["median"] <= r["high"] for r in rows)
    raters = {r["rater"]: r for r in rows_of(spark, "raters_f1")}
    judges = {r["model"]: r["f1"] for r in rows_of(spark, "judge_agreement")}
    assert set(raters) == {"classifier", *judges} and raters["classifier"]["f1"] == metrics[None]["f1"]
    for name, r in raters.items():
        assert r["low"] <= r["f1"] <= r["high"] and r["f1"] == judges.get(name, r["f1"])


def test_predicted_population_equals_sql(spark, duck):
    """What follows from the stored predictions, by SQL over the same predictions."""
    predicted = catalogue.QUERIES["population_mechanisms"](spark, str(DATA)).toPandas()
    scores = {r["pattern"]: r["pred"] for r in rows_of(spark, "population_scores")}
    assert {p for p, v in scores.items() if v} == set(predicted["pattern"]) and len(predicted) > 10
    duck.register("predicted", predicted)
    check(spark, duck, "mechanism_model_and_rule", "SELECT 'model' AS told_by, mechanism, count(*) AS patterns FROM predicted GROUP BY ALL UNION ALL SELECT 'rule', mechanism_rule, count(*) FROM predicted GROUP BY ALL")
    check(spark, duck, "mechanism_rule_agreement", "SELECT count(*) AS patterns, avg(CAST(mechanism = mechanism_rule AS DOUBLE)) AS agreement FROM predicted")
    gate = "pattern IN (SELECT pattern FROM predicted)"
    for name, level in (("headline_predicted", "repo_slug, file_path, scenario"), ("repo_prevalence_predicted", "repo_slug")):
        check(spark, duck, name, oracle.rolled("ev", level, gate))
    sql = oracle.qa("ev", f"SELECT {', '.join(catalogue._QA_COLUMNS)} FROM qa")
    sql = sql.replace("WHERE scope_org <> 'noscope'),", f"WHERE scope_org <> 'noscope' AND {gate}),").replace("CASE scope_repo WHEN 'RQ3' THEN 'shared_higher_level_step' WHEN 'RQ2' THEN 'reusable_scenario' WHEN 'RQ1' THEN 'background' ELSE 'none' END AS mechanism", "(SELECT mechanism FROM predicted p WHERE p.pattern = cand.pattern) AS mechanism")
    sql = sql.replace("scope_repo = 'RQ3' AND n_distinct_orgs < 2", "(SELECT mechanism FROM predicted p WHERE p.pattern = cand.pattern) = 'shared_higher_level_step' AND n_distinct_orgs < 2").replace("CASE WHEN scope_repo = 'RQ3' THEN n_distinct_orgs", "CASE WHEN (SELECT mechanism FROM predicted p WHERE p.pattern = cand.pattern) = 'shared_higher_level_step' THEN greatest(n_distinct_orgs, 1)")
    check(spark, duck, "qa_predicted", sql)


def check(spark, duck, name, sql):
    got = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, duck, name):
    check(spark, duck, name, catalogue.ORACLE[name])
