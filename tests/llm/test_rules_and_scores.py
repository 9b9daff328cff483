"""The learned list of op8, the score of op6 and the choice of op7 against plain versions; odd inputs of the pipeline's stages."""

import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepweave.llm import decision_rules, license_scan, sentencepiece_codec, toxicity

DATA = "/root/testdata/sf0.001"


def plain_value(tokens):
    """(permitted, first token not read) of an expression, by descent; ValueError if malformed."""

    def operand(i):
        if i >= len(tokens) or tokens[i] in (")", "and", "or", "with"):
            raise ValueError
        if tokens[i] == "(":
            value, i = level(i + 1, 0)
            if i >= len(tokens) or tokens[i] != ")":
                raise ValueError
            return value, i + 1
        name = tokens[i]
        return (name.removesuffix("+") in license_scan.PERMITTED, name), i + 1

    def level(i, k):
        if k == 2:
            value, i = operand(i)
            while i < len(tokens) and tokens[i] == "with":
                (_, other), i = operand(i + 1)
                value = (value[0] or other in license_scan.EXCEPTIONS, value[1])
            return value, i
        value, i = level(i, k + 1)
        while i < len(tokens) and tokens[i] == ("or", "and")[k]:
            other, i = level(i + 1, k + 1)
            value = (value[0] or other[0] if k == 0 else value[0] and other[0], value[1])
        return value, i

    return level(0, 0)[0][0]


def plain_scan(text):
    """labels, score and permitted."""
    words = re.findall(r"[0-9a-z]+", text.lower())
    found = []
    for phrase in {*license_scan.BASE, *license_scan.NOTICES, license_scan.TAG}:
        p = phrase.split()
        found += [(i, i + len(p), phrase) for i in range(len(words)) if words[i : i + len(p)] == p]
    base = {license_scan.BASE[p] for _, _, p in found if p in license_scan.BASE}
    labels, doubt = set(base), 0.01 if base else 1.0
    for a, b, phrase in found:
        inside = any((x, y) != (a, b) and x <= a and b <= y for x, y, _ in found)
        if phrase in license_scan.NOTICES and not inside:
            labels.add(license_scan.NOTICES[phrase][0])
            doubt *= 1 - license_scan.NOTICES[phrase][1]
    verdicts = [v not in license_scan.RESTRICTED for v in labels]
    for line in re.split("[\r\n]", text):
        for m in re.finditer("spdx-license-identifier:", line, re.ASCII | re.IGNORECASE):
            tokens = [t.lower() for t in re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*", line[m.end() :])]
            try:
                verdicts.append(plain_value(tokens))
                depth, names, before = 0, [], None
                for t in tokens:  # up to where two operands meet, or a bracket closes nothing
                    if before is not None and before not in ("(", "and", "or", "with") and t not in (")", "and", "or", "with"):
                        break
                    depth += (t == "(") - (t == ")")
                    if depth < 0:
                        break
                    names.append(t)
                    before = t
                labels |= {t for t in names if t not in ("(", ")", "and", "or", "with") and t not in license_scan.EXCEPTIONS}
                doubt *= 0.01
            except ValueError:
                verdicts.append(False)
                labels |= {t for t in [t for t in tokens if t not in "()"][:1] if t not in ("and", "or", "with") and t not in license_scan.EXCEPTIONS}
                doubt *= 0.5
    return ",".join(sorted(labels)), 1 - doubt if labels else 0.0, all(verdicts) if verdicts else None


def test_op6_score():
    rng = random.Random(5)
    names = ["MIT", "GPL-2.0-only", "Apache-2.0", "Zlib", "LLVM-exception", "(", ")", "AND", "or", "WITH"]
    for _ in range(3000):
        parts = []
        for _ in range(rng.randint(0, 6)):
            pick = rng.random()
            if pick < 0.5:
                parts.append(rng.choice([*license_scan.BASE, *license_scan.NOTICES]))
            elif pick < 0.8:
                parts.append("\n// " + rng.choice(["SPDX-License-Identifier:", "spdx-license-identifier: \t"]) + " " + " ".join(rng.choices(names, k=rng.randint(0, 5))) + rng.choice(["\n", "\r\n", ""]))
            else:
                parts.append(rng.choice(["plain", "the", "license", "version 2", "sa"]))
        text = " ".join(parts)
        row = license_scan.scan(text)
        labels, score, permitted = plain_scan(text)
        assert (row[5], row[8]) == (labels, permitted), text
        assert row[6] == pytest.approx(score), text


def plain_rules(rows):
    """Sequential covering over rows of statistics, one literal and one rule at a time."""
    names = decision_rules.STATISTICS
    x = np.array([[float(r[s]) for s in names] for r in rows])
    y, w, prune = (np.array([r[c] for r in rows]) for c in ("_y", "_w", "_prune"))
    marks = [sorted({float(v) for k in (0, 1) for v in np.quantile(x[y == k, i], [k / decision_rules.THRESHOLDS for k in range(1, decision_rules.THRESHOLDS)] + [0.01, 0.99])}) for i in range(len(names))]
    meets = lambda rule: np.logical_and.reduce([(x[:, names.index(n)] >= v) == up for n, up, v in rule], initial=True)
    left, out = np.ones(len(y), bool), []
    while True:
        rule, now = [], left & ~prune
        while (w[now & (y == 0)].sum() > 0) and (w[now & (y == 1)].sum() > 0):
            p0, n0 = w[now & (y == 1)].sum(), w[now & (y == 0)].sum()
            best = (1e-9, None, None)
            for i, n in enumerate(names):
                for v in marks[i]:
                    for up in (True, False):
                        hit = now & ((x[:, i] >= v) == up)
                        p, q = w[hit & (y == 1)].sum(), w[hit & (y == 0)].sum()
                        gain = p * (math.log2(p / (p + q)) - math.log2(p0 / (p0 + n0))) if p > 0 else 0.0
                        if gain > best[0] * (1 + 1e-12):
                            best = (gain, (n, up, v), hit)
            if best[1] is None:
                break
            rule.append(best[1])
            now = best[2]
        if not rule:
            return out
        worth = []
        for k in range(1, len(rule) + 1):
            hit = left & prune & meets(rule[:k])
            p, q = w[hit & (y == 1)].sum(), w[hit & (y == 0)].sum()
            worth.append(((p - q) / (p + q) if p + q else -1.0, -k, (p + 0.5) / (p + q + 1)))
        top = max(worth)
        if top[2] < decision_rules.MIN_PRECISION:
            return out
        rule = rule[: -top[1]]
        out.append(rule)
        hit = left & meets(rule)
        if not hit.any():
            return out
        left &= ~hit


def test_op8_learned_list(spark):
    rng = random.Random(9)
    texts = []
    for i in range(1500):
        words = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(12, 60))]
        bad = i % 4 == 0
        if bad and i % 8 == 0:
            words = [w + rng.choice(["|", "#", "!"]) for w in words]
        elif bad:
            words = words[:3] * 8
        texts.append((i, " ".join(words), int(not bad) if i % 101 else 1))
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in texts], "doc_id long, quality int")
    got = decision_rules.learn(docs, labels)
    rows = decision_rules.with_statistics(docs).join(labels, "doc_id").select((F.col("quality") <= 0).cast("int").alias("_y"), F.lit(1.0).alias("_w"), (F.xxhash64("doc_id", F.lit(7)) % 3 == 0).alias("_prune"), *decision_rules.STATISTICS).collect()
    assert len(got) >= 2
    assert [[(x.statistic, x.above, pytest.approx(x.value)) for x in rule] for rule in got] == plain_rules(rows)
    judged = {r["doc_id"]: r for r in decision_rules.judge(docs, got).collect()}
    assert sum(judged[i]["kept"] == (q == 1) for i, _, q in texts) > 0.95 * len(texts)


def test_op7_bar_is_the_one_of_least_loss():
    rng = np.random.default_rng(3)
    y = (rng.random(600) < 0.3).astype(float)
    good, noise = np.c_[y * 2 + rng.random(600)], rng.random((600, 1))
    w = np.ones(600)
    assert toxicity._loss(good, y, w) < toxicity._loss(noise, y, w)
    assert toxicity._loss(noise[:0], y[:0], w[:0]) == 0


@pytest.fixture
def rows(spark, odd):
    """Odd texts beside the documents, so that classifiers learn as ever."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    strange = odd.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n_chars"), F.lit("more").alias("row"), F.lit(1).alias("_k"))
    return docs.withColumns({"row": F.lit("more"), "_k": F.lit(1)}).unionByName(strange)


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows(spark, rows, number):
    """Every stage stands nulls, empty, long and repeated texts and further columns,
    and an empty table; all but the last keep the columns, and rows as they are."""
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, rows, DATA)
    got = out.collect()
    assert stage(spark, rows.where("false"), DATA).count() == 0
    strange = [r for r in got if r["doc_id"] is None or r["doc_id"] > 1_000_000]
    if number == 4:
        assert len(got) == rows.count()
        empty = sentencepiece_codec.encode(rows.where("text is null"), public_tokenizers.path("piece_bpe_32k.model"))
        assert {r["n_tokens"] for r in strange if r["doc_id"] in (1_000_003, 1_000_004)} == {0} == {r["n_tokens"] for r in sentencepiece_codec.digests(empty).collect()}
        return
    assert out.columns == rows.columns
    before = {repr(r) for r in rows.collect()}
    assert all(repr(r) in before for r in got)
    ids = sorted(r["doc_id"] for r in strange if r["doc_id"] is not None)
    if name == "quality rules":  # fewer than ten words
        assert set(ids) <= {1_000_006}
    if name == "n-gram Jaccard join":  # copies of one text leave their least id; a null id stays
        assert ids == [1_000_001, 1_000_003, 1_000_004, 1_000_005, 1_000_006, 1_000_007, 1_000_008] and sum(r["doc_id"] is None for r in strange) == 1
    if name == "benchmark decontamination":
        assert len(strange) == 10
