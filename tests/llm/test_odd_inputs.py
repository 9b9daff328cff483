"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece

from pyspark.sql import functions as F

from stepweave.llm import bloom_lm, compression_quality, decision_rules, decontamination, jaccard_forest, license_scan, sentencepiece_codec, toxicity, url_rules, warc
from stepweave.llm.common import fold

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("module, label", [(compression_quality, "quality"), (toxicity, "toxic")])
def test_classifiers(odd, none, labels, module, label):
    for known in (labels, labels.where("false"), labels.where("doc_id = 1")):
        got = module.score(odd, module.fit(odd, known, label)).collect()
        assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert module.score(none, module.fit(none, labels, label)).count() == 0
    named = [t.withColumn("doc_id", t["doc_id"].cast("string")) for t in (odd, labels)]
    assert module.score(named[0], module.fit(*named, label)).count() == 10


def test_filters_keep_columns(odd, none, labels, spark):
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    assert decontamination.clean(odd, items).columns == odd.columns
    assert sorted(r["doc_id"] for r in decontamination.clean(odd, items).collect()) == [3, 4, 5, 6, 8]
    assert decontamination.clean(odd, items.where("false")).count() == 10
    assert decontamination.matches(none, items).count() == 0
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(odd, items).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (7, None)}
    rules = decision_rules.learn(odd, labels)
    assert decision_rules.keep_sound(odd, rules).columns == odd.columns
    model = compression_quality.fit(odd, labels)
    assert compression_quality.keep_good(odd, model).columns == odd.columns


def test_rules(odd, none, labels):
    assert decision_rules.learn(odd, labels.where("false")) == []
    rows = {r["doc_id"]: r for r in decision_rules.judge(odd, []).collect()}
    for key in (3, 4, 5):
        assert (rows[key]["n_words"], rows[key]["word_chars"], rows[key]["n_repeat_words"], rows[key]["kept"]) == (0, 0, 0, False)
    assert decision_rules.judge(none, []).count() == 0


def test_codec(odd, none):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = sentencepiece_codec.encode(odd, MODEL)
    texts = [(r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()]
    want = sorted((k or 0, len(own.encode(t)), hashlib.sha256(",".join(map(str, own.encode(t))).encode()).hexdigest(), hashlib.sha256(own.decode(own.encode(t)).encode()).hexdigest(), len(t.encode())) for k, t in texts)
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["n_bytes"]) for r in sentencepiece_codec.digests(encoded).collect())
    assert got == want
    assert sentencepiece_codec.encode(none, MODEL).count() == 0


def test_licenses(odd, none):
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(odd).collect()}
    assert (got[3]["n_words"], got[3]["labels"], got[3]["score"], got[3]["first_word"]) == (0, "", 0.0, None)
    assert license_scan.scan_licenses(none).count() == 0


def test_language_model(odd, none):
    held = fold(odd["doc_id"], 5) == 1
    got = bloom_lm.score(odd, held).collect()
    assert len(got) == 10 and all(r["score"] <= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert len({(r["base_score"], r["score"]) for r in got if r["doc_id"] == 2}) == 1
    assert bloom_lm.score(none, fold(none["doc_id"], 5) == 1).count() == 0
    named = odd.withColumn("doc_id", odd["doc_id"].cast("string"))
    assert {(r["doc_id"], r["score"]) for r in bloom_lm.score(named, fold(named["doc_id"], 5) == 1).collect()} == {(r["doc_id"] and str(r["doc_id"]), r["score"]) for r in got}
    nothing = bloom_lm.score(odd, odd["doc_id"].isNull() | odd["doc_id"].isNotNull()).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in nothing} == {(0, 0, 0.0)}


def test_join(odd, none):
    got = sorted((r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in jaccard_forest.similar(odd).collect())
    assert got == [(0, None, 0), (1, 1, 2), (2, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0)]
    assert jaccard_forest.similar(none).count() == 0
    kept = jaccard_forest.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    twice = jaccard_forest.first_of_each(odd.where("doc_id = 2")).collect()
    assert len(twice) == 1


def test_archives(odd, none, spark, tmp_path):
    pages = odd.selectExpr("doc_id as page_id", "cast(null as string) as url", "text as html", "key", "node as refers_to")
    for name, table, n in (("a", pages, 10), ("b", none.selectExpr("doc_id as page_id", "text as url", "text as html"), 0)):
        out = f"file://{tmp_path}/{name}"
        manifest = warc.write(table, out, dedup_bytes=1, shard_bytes=100, roll_bytes=200)
        assert warc.read(spark, out, manifest).count() == n
    got = {(r["key"], r["record_type"], r["refers_to"]) for r in warc.read(spark, f"file://{tmp_path}/a").collect()}
    assert {(1, "revisit", 2), (2, "response", None), (None, "revisit", 2), (3, "response", None)} <= got


def test_urls(spark):
    rows = [(1, "http://A.Org/x"), (2, None), (3, "no scheme"), (4, "https://b.com/de/1?x=1#f"), (4, "https://b.com/de/1?x=1#f"), (5, "http://x.net/de/1"), (6, "ftp://"), (7, "http://www.example.org/es/1")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as rule")
    rules = url_rules.parse_rules("allow org/ block com/de/ block example.org/es/")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(df, rules).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4] == ("b.com", "/de/1", "com/de/", "block") and got[7] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert url_rules.judge(df.where("false"), rules).count() == 0


def test_hot_keys_of_archives_are_split(spark, tmp_path):
    page = "concat(id % 50, repeat('x', 100))"
    rows = spark.range(600).selectExpr("case when id < 200 then null when id < 400 then 7 else 9007199254740993 + id end as page_id", "'u' as url", f"{page} as html")
    out = f"file://{tmp_path}/hot"
    manifest = warc.write(rows, out, dedup_bytes=1, shard_bytes=2000)
    assert manifest.agg(F.max("records")).first()[0] < 60
    got = warc.read(spark, out, manifest).toPandas()
    assert len(got) == 600 and got["key"].isna().sum() == 200 and (got["key"] == 7).sum() == 200
    assert (got["record_type"] == "response").sum() == 50 and set(got.loc[got["record_type"] == "response", "refers_to"].dropna()) == set()
    keys = {r["key"] for r in warc.read(spark, out, manifest).select("key").collect()}
    assert keys == {None, 7, *(9007199254740993 + i for i in range(400, 600))}
