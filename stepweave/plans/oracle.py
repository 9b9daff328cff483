"""SQL forms of the registered queries, built from shared subqueries."""

from __future__ import annotations

_LI = """
steps AS (
  SELECT r_name || '_' || n_name AS repo_slug, CAST(c_custkey AS VARCHAR) AS file_path, CAST(o_orderkey AS VARCHAR) AS scenario,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line,
         CASE WHEN p_size <= 46 THEN CAST(p_size % 4 AS INTEGER) END AS cluster_id,
         CASE p_size % 4 WHEN 0 THEN 'set "' || p_type || '" "' || split_part(p_name, ' ', 1) || '"'
                         WHEN 1 THEN 'check <' || p_type || '>' ELSE p_type END AS text,
         (l_returnflag = 'R' AND l_linenumber = 1) AS is_background
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
_EV = """
steps AS (
  SELECT 'org' || (user_id % 4) || '_repo' || (user_id % 8) AS repo_slug, 'f' || (user_id % 40) AS file_path,
         CAST(user_id AS VARCHAR) AS scenario, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line,
         CAST({code} AS INTEGER) AS cluster_id, event_type AS text, false AS is_background FROM events)"""
_CODES = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 ELSE 5 END"
STEPS = {"li": _LI, "ev": _EV.format(code=_CODES), "ev2": _EV.format(code="CASE WHEN event_type = 'error' THEN 0 ELSE 1 END")}

_BASE = """
scen AS (
  SELECT repo_slug, file_path, scenario, list(cluster_id ORDER BY line) AS ids, list(text ORDER BY line) AS texts, CAST(count(*) AS INTEGER) AS n
  FROM steps WHERE NOT is_background AND cluster_id IS NOT NULL AND trim(scenario) <> '' GROUP BY ALL HAVING count(*) >= 2),
lens AS (SELECT *, unnest(range(2, least(18, n) + 1)) AS L FROM scen),
spots AS (SELECT *, unnest(range(0, n - L + 1)) AS s FROM lens),
slices AS (
  SELECT repo_slug, file_path, scenario, CAST(s AS INTEGER) AS position_start, CAST(L AS INTEGER) AS L,
         array_to_string(ids[s + 1 : s + L], ',') AS pattern, texts[s + 1 : s + L] AS text_seq FROM spots),
files AS (SELECT pattern, repo_slug, file_path, count(DISTINCT scenario) AS scen FROM slices GROUP BY ALL),
within AS (SELECT pattern, max(scen) AS m FROM files GROUP BY 1),
repos AS (SELECT pattern, max(k) AS m FROM (SELECT pattern, repo_slug, count(*) AS k FROM files GROUP BY ALL) GROUP BY 1),
pat AS (
  SELECT pattern, L, CAST(count(*) AS BIGINT) AS support_total, count(DISTINCT repo_slug) AS n_distinct_repos,
         count(DISTINCT (repo_slug, file_path)) AS n_distinct_files, count(DISTINCT (repo_slug, file_path, scenario)) AS n_distinct_scenarios,
         any_value(w.m) AS max_within_file_recurrence, any_value(r.m) AS max_within_repo_files,
         count(DISTINCT split_part(repo_slug, '_', 1)) AS n_distinct_orgs,
         arg_min(text_seq, (repo_slug, file_path, scenario, position_start)) AS canonical
  FROM slices JOIN within w USING (pattern) JOIN repos r USING (pattern) GROUP BY pattern, L HAVING count(*) >= 2),
ranked AS (
  SELECT *, len(list_filter(canonical, lambda t: regexp_matches(t, '"\\w+"\\s+"\\w+"'))) > 0 AS has_template_structure,
         CASE WHEN n_distinct_repos >= 2 THEN 'RQ3' WHEN max_within_repo_files >= 2 THEN 'RQ2' WHEN max_within_file_recurrence >= 2 THEN 'RQ1' ELSE 'noscope' END AS scope_repo,
         CASE WHEN n_distinct_orgs >= 2 THEN 'RQ3' WHEN max_within_repo_files >= 2 THEN 'RQ2' WHEN max_within_file_recurrence >= 2 THEN 'RQ1' ELSE 'noscope' END AS scope_org
  FROM pat)"""


def suite(patterns: int, recurrence: int, template: float) -> str:
    return f""",
file_stats AS (
  SELECT repo_slug, file_path, count(*) AS n_distinct_rq1_patterns, max(scen) AS top_pattern_recurrence, avg(CAST(has_template_structure AS DOUBLE)) AS template_fraction
  FROM files JOIN ranked USING (pattern) WHERE max_within_file_recurrence >= 2 GROUP BY ALL),
suites AS (SELECT *, n_distinct_rq1_patterns > {patterns} AND (top_pattern_recurrence > {recurrence} OR template_fraction >= {template}) AS is_spec_suite FROM file_stats),
outliers AS (
  SELECT pattern, CAST(sum(CASE WHEN is_spec_suite THEN 1 ELSE 0 END) AS BIGINT) / CAST(count(*) AS DOUBLE) AS outlier_fraction
  FROM slices LEFT JOIN suites USING (repo_slug, file_path) GROUP BY 1)"""


_QA = """,
cand AS (SELECT * FROM ranked WHERE scope_org <> 'noscope'),
parts AS (
  SELECT scope_org, support_total, L - 1 AS L, array_to_string(p, ',') AS pattern FROM (
    SELECT scope_org, support_total, L, unnest([string_split(pattern, ',')[1 : L - 1], string_split(pattern, ',')[2 : L]]) AS p FROM cand WHERE L >= 3)),
opened AS (SELECT DISTINCT cand.pattern FROM cand JOIN parts USING (scope_org, support_total, L, pattern)),
flagged AS (
  SELECT *, CASE scope_repo WHEN 'RQ3' THEN 'shared_higher_level_step' WHEN 'RQ2' THEN 'reusable_scenario' WHEN 'RQ1' THEN 'background' ELSE 'none' END AS mechanism,
         scope_repo = 'RQ3' AND n_distinct_orgs < 2 AS mechanism_mismatch,
         n_distinct_scenarios / CAST(greatest(support_total, 1) AS DOUBLE) AS scen_ratio,
         len(list_filter(canonical, lambda t: regexp_matches(t, '<\\w+(-\\w+)*>'))) > 0 AS templated_outline,
         len(list_distinct(string_split(pattern, ','))) = 1 AS single_cluster, n_distinct_scenarios <= 1 AS single_scenario,
         pattern IN (SELECT pattern FROM opened) AS non_closed,
         n_distinct_scenarios * sqrt(support_total) * CASE WHEN scope_repo = 'RQ3' THEN n_distinct_orgs ELSE 1 END AS quality_score FROM cand),
qa AS (
  SELECT *, scen_ratio < 0.20 AS overlap_dominated,
         CASE WHEN templated_outline THEN 'templated_outline' WHEN single_cluster THEN 'single_cluster' WHEN single_scenario THEN 'single_scenario'
              WHEN scen_ratio < 0.20 THEN 'overlap_dominated' WHEN mechanism_mismatch THEN 'mechanism_mismatch' WHEN non_closed THEN 'non_closed' ELSE 'kept' END AS rejection_reason FROM flagged)"""

_ROLL = """,
held AS (SELECT DISTINCT pattern, repo_slug, file_path, scenario FROM slices),
flags AS (
  SELECT repo_slug, file_path, scenario, coalesce(bool_or(k.pattern IS NOT NULL), false) AS recurring, coalesce(bool_or(max_within_file_recurrence >= 2), false) AS rq1,
         coalesce(bool_or(max_within_repo_files >= 2), false) AS rq2, coalesce(bool_or(n_distinct_orgs >= 2), false) AS rq3
  FROM held LEFT JOIN (SELECT * FROM ranked WHERE {gate}) k USING (pattern) GROUP BY ALL)"""


def over(steps: str, body: str, more: str = "") -> str:
    return f"WITH {STEPS[steps]}, {_BASE} {more} {body}"


def qa(steps: str, body: str) -> str:
    return over(steps, body, _QA)


def rolled(steps: str, level: str, gate: str = "true") -> str:
    names = ("recurring", "rq1", "rq2", "rq3")
    counts = ", ".join(f"count_if({f}) AS n_{f}" for f in names)
    shares = ", ".join(f"100.0 * count_if({f}) / CAST(greatest(count(*), 1) AS DOUBLE) AS pct_{f}" for f in names)
    unit = f"SELECT {level}, {', '.join(f'bool_or({f}) AS {f}' for f in names)} FROM flags GROUP BY {level}"
    return over(steps, f"SELECT count(*) AS units, {counts}, {shares} FROM ({unit})", _ROLL.format(gate=gate))


RANKED_COLUMNS = "pattern, L, support_total, n_distinct_repos, n_distinct_files, n_distinct_scenarios, max_within_file_recurrence, max_within_repo_files, n_distinct_orgs"

RATERS = """
base AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
ratings AS (
  SELECT doc_id AS item, CAST(quality AS VARCHAR) AS label FROM base
  UNION ALL SELECT doc_id, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS VARCHAR) FROM base
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unsure' WHEN toxic = 1 THEN '0' ELSE CAST(quality AS VARCHAR) END FROM base)"""

#: The columns that a classifier reads, in SQL over ``ranked`` and ``outliers``.
FEATURES = [
    *"L support_total n_distinct_repos n_distinct_orgs n_distinct_files max_within_file_recurrence max_within_repo_files outlier_fraction".split(),
    "CAST(has_template_structure AS INTEGER) AS has_template",
    *(f"CAST(scope_repo = '{s}' AS INTEGER) AS scope_{s}" for s in ("RQ1", "RQ2", "RQ3")),
    "max_within_file_recurrence / CAST(greatest(support_total, 1) AS DOUBLE) AS ratio_within_file",
    "max_within_repo_files / CAST(greatest(support_total, 1) AS DOUBLE) AS ratio_within_repo",
    "n_distinct_orgs / CAST(greatest(n_distinct_repos, 1) AS DOUBLE) AS ratio_orgs",
]
