"""The queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import bloom_lm, compression_quality, conversation_repair, decision_rules, decontamination, disclosure, jaccard_forest, license_scan, periodic_runs, sentencepiece_codec, toxicity, url_rules, warc
from stepweave.llm.common import fold, read, shared_dir


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 1)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write(read(spark, sf_dir, "pages"), out)
    return warc.read(spark, out, manifest).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = compression_quality.fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    scored = compression_quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The editorial rules of the query.
RULES = "allow org/, block example.org/es/, block example.org/en/1, allow com/fr/, block com/de/"


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"), url_rules.parse_rules(RULES.replace(",", "")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rules = decision_rules.learn(docs, labels)
    judged = decision_rules.judge(docs, rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def op9_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = sentencepiece_codec.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_codec.digests(encoded)


def op10_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.similar(read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return conversation_repair.audits(conversation_repair.damaged(turns), turns)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.collapse(periodic_runs.planted(read(spark, sf_dir, "documents"))))


def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digests(disclosure.sanitise(read(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_bloom_lm, op3_warc, op4_compression_quality, op5_url_rules, op6_license_scan, op7_toxicity_grammar, op8_decision_rules, op9_sentencepiece_codec, op10_jaccard_forest, op11_conversation_repair, op12_periodic_runs, op13_disclosure)}
#: The word shingles of a table's texts, in order, as SQL.
_SHINGLES = """
    SELECT id, [array_to_string(w[i : i + least(5, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(5, len(w)) + 2)] AS s, least(5, len(w)) AS width
    FROM (SELECT {key} AS id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+') IF x <> ''] AS w FROM {table})
    WHERE len(w) > 0
"""

ORACLE: dict[str, str] = {
    "op1_decontamination": f"""
        WITH d AS ({_SHINGLES.format(key='doc_id', table='documents')}), b AS ({_SHINGLES.format(key='item_id', table='benchmark')}),
             held AS (SELECT id AS doc_id, len(s) AS n, unnest(s) AS x, generate_subscripts(s, 1) AS pos FROM d),
             own AS (SELECT id AS item_id, len, width, x, count(*) AS c FROM (SELECT id, len(s) AS len, width, unnest(s) AS x FROM b) GROUP BY ALL),
             hit AS (SELECT doc_id, item_id, width, pos, x, c, len AS size, least(n, len) AS m, n - least(n, len) + 1 AS last FROM held JOIN own USING (x)),
             pair AS (SELECT doc_id, item_id, width, size, m, last FROM hit GROUP BY ALL HAVING 9 * count(*) >= 4 * (m + size)),
             part AS (SELECT p.doc_id, p.item_id, p.width, p.size, p.m, h.x, h.c, h.pos, unnest(range(greatest(1, h.pos - p.m + 1), least(h.pos, p.last) + 1)) AS start FROM pair p JOIN hit h USING (doc_id, item_id)),
             mass AS (SELECT doc_id, item_id, width, size, m, start, sum(k) AS o FROM (SELECT doc_id, item_id, width, size, m, start, x, least(c, count(*)) AS k FROM part GROUP BY doc_id, item_id, width, size, m, start, x, c) GROUP BY ALL)
        SELECT doc_id, item_id, max(o) / (any_value(m + size) - max(o)) AS similarity, arg_max(start, (o, -start)) - 1 AS first_word, any_value(m + width) - 1 AS n_words
        FROM mass GROUP BY doc_id, item_id HAVING 9 * max(o) >= 4 * any_value(m + size)
    """,
    "op10_jaccard_forest": f"""
        WITH RECURSIVE d AS ({_SHINGLES.format(key='doc_id', table='documents')}),
             own AS (SELECT DISTINCT id, unnest(s) AS x FROM d), size AS (SELECT id, count(*) AS n FROM own GROUP BY id),
             met AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM own a JOIN own b ON a.x = b.x AND a.id <> b.id GROUP BY ALL),
             link AS (SELECT a, b FROM met JOIN size p ON p.id = a JOIN size q ON q.id = b WHERE 5 * met.n >= 4 * (p.n + q.n - met.n)),
             reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
             low AS (SELECT a, min(b) AS top FROM reach GROUP BY a), links AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT doc_id, least(doc_id, coalesce(top, doc_id)) AS class_id, coalesce(n, 0) AS n_links
        FROM documents LEFT JOIN low ON low.a = doc_id LEFT JOIN links ON links.a = doc_id
    """,
    "op3_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
             g AS (SELECT b, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY b)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.b) AS payload_digest,
               CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN top > page_id THEN top END AS refers_to
        FROM p LEFT JOIN g ON n >= 1000 AND p.b = g.b
    """,
}
