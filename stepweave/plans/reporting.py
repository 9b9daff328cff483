"""Queries behind reports: corpus shape, prevalence, QA tables, figures' data."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.functions.columns import mechanism_of
from stepweave.operators import agreement, density, hierarchy, neighbours, patterns, rollups, sequences, vectors
from stepweave.plans import oracle
from stepweave.plans.catalogue import _PAIRS, LABELLED, _blocks, _by_scenario, _candidates, _labelled, _outliers, _pairs, _qa, _ranked, _ranking, _slices, _steps, _suites, query
from stepweave.sources import tables


@query(
    oracle.over(
        "li",
        "SELECT (SELECT count(*) FROM steps) AS n_steps, (SELECT count(DISTINCT repo_slug) FROM steps) AS n_repos, count(DISTINCT repo_slug) AS n_repos_with_slices, count(DISTINCT split_part(repo_slug, '_', 1)) AS n_owners, count(DISTINCT (repo_slug, file_path)) AS n_files_with_slices, count(*) AS n_scenarios_with_slices, CAST(sum(n) AS BIGINT) AS n_steps_with_slices FROM scen",
    )
)
def corpus_shape(spark, d):
    steps = _steps(spark, d, "li")
    return rollups.corpus_shape(steps, sequences.lengths(steps))


@query(oracle.rolled("li", "repo_slug, file_path, scenario", "pattern IN (SELECT pattern FROM outliers WHERE outlier_fraction <= 0.5)").replace(",\nheld AS", oracle.suite(50, 100, 0.30) + ",\nheld AS"))
def real_signal_prevalence(spark, d):
    flags = rollups.unit_flags(_by_scenario(spark, d), _outliers(spark, d), "scen", gate=F.col("outlier_fraction") <= 0.5)
    return rollups.prevalence(flags, "scen")


@query(
    oracle.rolled("li", "repo_slug").split("SELECT count(*) AS units")[0]
    + "SELECT owner, repo_slug, file_path, count(*) AS scenarios, "
    + ", ".join(f"count_if({f}) AS n_{f}" for f in rollups.FLAGS)
    + " FROM (SELECT *, split_part(repo_slug, '_', 1) AS owner FROM flags) GROUP BY ROLLUP (owner, repo_slug, file_path)"
)
def prevalence_rollup(spark, d):
    flags = rollups.unit_flags(_by_scenario(spark, d), _ranking(spark, d), "scen")
    names = _blocks(spark, d).where("at = scen").select("scen", *sequences.KEY)
    return rollups.by_level(names.join(flags, "scen"))


@query(oracle.over("li", "SELECT count(*) AS files, count_if(is_spec_suite) AS suites, quantile_cont(n_distinct_rq1_patterns, 0.5) AS median_rq1_patterns FROM suites", oracle.suite(50, 100, 0.30)))
def outlier_summary(spark, d):
    return _suites(spark, d).agg(F.count(F.lit(1)).alias("files"), F.count_if("is_spec_suite").alias("suites"), F.percentile("n_distinct_rq1_patterns", 0.5).alias("median_rq1_patterns"))


def _kept(spark, d, kind="li"):
    return _qa(spark, d, kind).where("rejection_reason = 'kept'")


@query(oracle.qa("ev2", " UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS patterns, 100.0 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS pct FROM qa WHERE rejection_reason = 'kept' GROUP BY {c}" for c in ("mechanism", "scope_org", "L"))))
def qa_distribution(spark, d):
    return patterns.distribution(_kept(spark, d, "ev2"), "mechanism", "scope_org", "L")


@query(oracle.qa("ev", "SELECT L, count(*) AS before, count_if(rejection_reason = 'kept') AS after FROM qa GROUP BY L"))
def length_before_after(spark, d):
    rows = _qa(spark, d, "ev")
    return rows.groupBy("L").agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("rejection_reason") == "kept").alias("after"))


@query(oracle.qa("ev", "SELECT mechanism, count(*) AS patterns, " + ", ".join(f"round(quantile_cont(quality_score, {q}), 6) AS p{int(100 * q)}" for q in (0.25, 0.5, 0.75, 0.95)) + " FROM qa WHERE rejection_reason = 'kept' GROUP BY mechanism"))
def quality_by_mechanism(spark, d):
    marks = {f"p{int(100 * q)}": q for q in (0.25, 0.5, 0.75, 0.95)}
    rows = rollups.percentiles(_kept(spark, d, "ev"), "mechanism", "quality_score", marks)
    return rows.select("mechanism", F.col("n").alias("patterns"), *[F.round(m, 6).alias(m) for m in marks])


@query(oracle.qa("ev", "SELECT pattern, array_to_string(string_split(pattern, ',')[1:6], ',') AS shown, L, quality_score FROM qa WHERE rejection_reason = 'kept' AND scope_org = 'RQ3' ORDER BY quality_score DESC, pattern LIMIT 20"))
def top_rq3_quality(spark, d):
    rows = _kept(spark, d, "ev").where("scope_org = 'RQ3'").orderBy(F.desc("quality_score"), "pattern").limit(20)
    return rows.select("pattern", F.array_join(F.slice(F.split("pattern", ","), 1, 6), ",").alias("shown"), "L", "quality_score")


@query(oracle.over("ev", "SELECT counted, mechanism, count(*) AS patterns FROM (SELECT unnest(['repo', 'org']) AS counted, unnest([scope_repo, scope_org]) AS s FROM ranked) JOIN (VALUES ('RQ3', 'shared_higher_level_step'), ('RQ2', 'reusable_scenario'), ('RQ1', 'background'), ('noscope', 'none')) v(s, mechanism) USING (s) GROUP BY ALL"))
def mechanism_counts(spark, d):
    both = F.array(*[F.struct(F.lit(k).alias("counted"), mechanism_of(F.col(f"scope_{k}")).alias("mechanism")) for k in ("repo", "org")])
    return _ranked(spark, d, "ev").select(F.inline(both)).groupBy("counted", "mechanism").agg(F.count(F.lit(1)).alias("patterns"))


@query(
    oracle.over(
        "li",
        "SELECT pattern, array_to_string(list(repo_slug || '/' || file_path || '/' || scenario || '#' || position_start ORDER BY site), ' ') AS sites, any_value(n_distinct_repos) AS n_site_repos, CAST(count(*) AS INTEGER) AS n_sites FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY repo_slug, file_path, scenario, position_start) AS site FROM slices WHERE pattern IN (SELECT pattern FROM ranked WHERE scope_org <> 'noscope')) JOIN (SELECT pattern, n_distinct_repos FROM ranked) USING (pattern) WHERE site <= 50 GROUP BY pattern",
    )
)
def call_site_lists(spark, d):
    sites = patterns.call_sites(_slices(spark, d), _candidates(spark, d), 50)
    rows = patterns.call_site_lists(sites, _candidates(spark, d))
    return rows.withColumn("sites", F.array_join(F.transform("sites", lambda s: F.concat(s["repo_slug"], F.lit("/"), s["file_path"], F.lit("/"), s["scenario"], F.lit("#"), s["position_start"].cast("string"))), " "))


@query(
    oracle.over(
        "li",
        "SELECT pattern, CAST(pos AS INTEGER) AS pos, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT pattern FROM ids) CROSS JOIN (SELECT DISTINCT pos FROM parts) LEFT JOIN known USING (pattern, pos)",
        """,
ids AS (SELECT pattern, CAST(unnest(string_split(pattern, ',')) AS BIGINT) AS cluster_id FROM ranked),
parts AS (SELECT vec_id AS cluster_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings),
known AS (SELECT pattern, pos, round(avg(v), 6) AS value FROM ids JOIN parts USING (cluster_id) GROUP BY ALL)""",
    )
)
def pattern_vectors(spark, d):
    known = tables.Catalog(spark, (d,)).table("embeddings", ["vec_id", "embedding"])
    rows = vectors.pooled(_ranked(spark, d), known.select(F.col("vec_id").cast("int").alias("cluster_id"), F.col("embedding").alias("vector")))
    return rows.withColumn("value", F.round("value", 6))


@query(
    "SELECT count(*) FILTER (k >= 0) AS n_clusters, CAST(coalesce(sum(n) FILTER (k < 0), 0) AS BIGINT) AS n_noise, coalesce(sum(n) FILTER (k < 0), 0) / CAST(sum(n) AS DOUBLE) AS noise_fraction, min(n) FILTER (k >= 0) AS size_min, quantile_cont(n, 0.5) FILTER (k >= 0) AS size_median, quantile_cont(n, 0.95) FILTER (k >= 0) AS size_p95, max(n) FILTER (k >= 0) AS size_max"
    " FROM (SELECT label - 1 AS k, count(*) AS n FROM embeddings GROUP BY 1)"
)
def cluster_summary(spark, d):
    rows = tables.Catalog(spark, (d,)).table("embeddings", ["label"])
    return vectors.cluster_summary(rows.select((F.col("label") - 1).alias("cluster_id")))


@query(" UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS name, '{t}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls FROM documents" for i, (c, t) in enumerate([("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")])))
def schema_probe(spark, d):
    return tables.probe(tables.Catalog(spark, (d,)).table("documents"))


@query(
    """
    WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    near AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x, e y WHERE list_distance(x.v, y.v) <= 1.18),
    core AS (SELECT a AS node FROM near GROUP BY a HAVING count(*) >= 5),
    linked AS (SELECT a, b FROM near JOIN core x ON x.node = a JOIN core y ON y.node = b),
    reach(node, seen) AS (SELECT node, node FROM core UNION SELECT a, seen FROM reach JOIN linked ON b = node),
    roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY 1)
    SELECT vec_id, bool_or(core.node IS NOT NULL) AS core, coalesce(min(root), -1) AS cluster_id
    FROM e LEFT JOIN near ON a = vec_id LEFT JOIN roots ON roots.node = near.b LEFT JOIN core ON core.node = vec_id GROUP BY vec_id
    """
)
def density_clusters(spark, d):
    rows = tables.Catalog(spark, (d,)).table("embeddings", ["vec_id", "embedding"])
    return density.clusters(rows, 1.18, 5)


def _points(spark, d):
    return tables.cut(neighbours.nodes(tables.Catalog(spark, (d,)).table("embeddings", ["vec_id", "embedding"]), "vec_id", "embedding"))


@query()
def density_hierarchy(spark, d):
    """Clusters of several densities, cut by stability; noise is -1."""
    return hierarchy.clusters(tables.Catalog(spark, (d,)).table("embeddings", ["vec_id", "embedding"]), levels=16)


@query()
def neighbour_recall(spark, d):
    """How much of the 15 nearest neighbours the graph has, over queries by hash."""
    points = _points(spark, d)
    return neighbours.recall(points, tables.cut(neighbours.graph(points, 15)), 15)


@query()
def neighbour_layout(spark, d):
    """Places of the vectors in two dimensions, by the edges of their graph."""
    points = _points(spark, d)
    rows = neighbours.layout(points, tables.cut(neighbours.graph(points, 15)))
    return rows.select(F.col("node").alias("vec_id"), F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


_MEMBERS = "members AS (SELECT p_partkey AS part, p_size % 4 AS cluster_id FROM part WHERE p_size <= 46 UNION ALL SELECT p_partkey, p_size % 4 + 4 FROM part WHERE p_size <= 46 AND p_size % 10 = 0)"


def _members(spark, d):
    """Clusters of parts: none of the largest, two of some."""
    parts = tables.Catalog(spark, (d,)).table("part", ["p_partkey", "p_size"]).where("p_size <= 46")
    ids = F.when(F.col("p_size") % 10 == 0, F.array(F.col("p_size") % 4, F.col("p_size") % 4 + 4)).otherwise(F.array(F.col("p_size") % 4))
    return parts.select(F.col("p_partkey").alias("part"), F.explode(ids).alias("cluster_id"))


@query(f"WITH {_MEMBERS} SELECT l_orderkey, l_linenumber, l_partkey AS part, cluster_id FROM lineitem LEFT JOIN members ON part = l_partkey")
def steps_left_join_members(spark, d):
    """Every step with its clusters: unclustered steps stay, and some fan out."""
    steps = tables.Catalog(spark, (d,)).table("lineitem", ["l_orderkey", "l_linenumber", "l_partkey"]).withColumnRenamed("l_partkey", "part")
    return tables.left_join(steps, _members(spark, d), ["part"])


@query(f"WITH {_MEMBERS} SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, count_if(n > 1) AS repeated_keys, max(n) AS most FROM (SELECT count(*) AS n FROM members GROUP BY part)")
def member_key_audit(spark, d):
    return tables.key_audit(_members(spark, d), ["part"])


@query(oracle.over("li", "SELECT pattern, L, support_total FROM ranked ORDER BY L DESC, support_total, pattern LIMIT 20"))
def longest_rare(spark, d):
    return _ranked(spark, d).orderBy(F.desc("L"), "support_total", "pattern").limit(20).select("pattern", "L", "support_total")


@query(oracle.over("li", "SELECT CAST(trunc(quantile_cont(n, 0.5)) AS BIGINT) AS p50, CAST(trunc(quantile_cont(n, 0.95)) AS BIGINT) AS p95, CAST(ceil(quantile_cont(n, 0.99)) AS BIGINT) AS recommended_p99 FROM scen"))
def truncated_lengths(spark, d):
    rows = sequences.lengths(_steps(spark, d, "li"))
    return rows.agg(*[F.percentile("n", q).cast("long").alias(k) for k, q in (("p50", 0.5), ("p95", 0.95))], F.ceil(F.percentile("n", 0.99)).cast("long").alias("recommended_p99"))


@query(_PAIRS + "SELECT label, count_if(actual = label) AS support, count_if(actual = label AND predicted = label) / CAST(greatest(count_if(predicted = label), 1) AS DOUBLE) AS precision, count_if(actual = label AND predicted = label) / CAST(greatest(count_if(actual = label), 1) AS DOUBLE) AS recall FROM pairs, (VALUES (0), (1)) v(label) GROUP BY label")
def class_report(spark, d):
    return agreement.class_report(_pairs(spark, d))


@query(oracle.over("ev", "SELECT 'outlier_fraction < 0.3' AS rule, count_if(outlier_fraction < 0.3 AND label = 1) AS tp, count_if(outlier_fraction < 0.3 AND label = 0) AS fp, count_if(outlier_fraction >= 0.3 AND label = 1) AS fn FROM labelled", LABELLED))
def rule_of_outliers(spark, d):
    """The rule that few places in spec suites mean yes, over the labelled pool."""
    rows = _labelled(spark, d).select(F.col("label").alias("actual"), (F.col("outlier_fraction") < 0.3).cast("int").alias("predicted"))
    return agreement.binary_metrics(rows).select(F.lit("outlier_fraction < 0.3").alias("rule"), "tp", "fp", "fn")
