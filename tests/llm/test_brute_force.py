"""Operators against plain versions on the smallest tables and made ones."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepweave.llm import bloom_lm, decontamination, jaccard_forest, license_scan, queries, toxicity, url_rules
from stepweave.llm.common import read
from stepweave.llm.sentencepiece_codec import CharacterMap

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in read(spark, DATA, "documents").collect()}


def linked(texts):
    sets = {i: frozenset(shingles(t)) for i, t in texts.items()}
    root, links = {i: i for i in texts}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-12:
                links[i] += 1
                links[j] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (find(i), links[i]) for i in texts}


def test_op10(spark, texts):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.op10_jaccard_forest(spark, DATA).collect()}
    assert got == linked(texts)


def test_op10_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_forest, "FINE_TEXTS", 5)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    made = {}
    for i in range(40):
        w = list(base)
        for at in rng.sample(range(60), rng.randint(0, 3)):
            w[at] = f"x{rng.randint(0, 9)}"
        made[i] = " ".join(w)
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_forest.similar(df).collect()} == linked(made)


@pytest.mark.parametrize(("shared", "links"), [(800_000, [1, 1]), (799_999, [])])
@pytest.mark.parametrize("dense", [0.0, 2.0])
def test_long_texts_at_the_threshold(monkeypatch, shared, links, dense):
    monkeypatch.setattr(jaccard_forest, "DENSE", dense)
    every = np.arange(1_000_000, dtype=np.uint64)
    sets = [every[:900_000], every[900_000 - shared :]]
    rows = [{"node": n, "block": 0, "copies": 1, "shingles": s.tobytes(), "label": bytes(320)} for n, s in zip((b"a", b"b"), sets, strict=True)]
    assert jaccard_forest._verified(rows, 0, 0, 0.8, 4)["links"] == links


def test_prefixes_are_shortened_to_the_target():
    assert jaccard_forest.depth_for({20: 1000}) == 8
    assert 1 < jaccard_forest.depth_for({20: 1000, 3: 500}) < 8
    assert jaccard_forest.depth_for({2: 10}, target=1 - 1e-12) == 1
    assert jaccard_forest.depth_for({}) == 8


def test_recall_where_the_first_depth_is_too_long(spark, monkeypatch):
    """Pairs near the threshold: the measure after verification shortens on."""
    monkeypatch.setattr(jaccard_forest, "depth_for", lambda *_: 8)
    rng = random.Random(4)
    made = {}
    for i in range(60):
        w = [f"a{i}_{k}" for k in range(100)]
        made[2 * i] = " ".join(w)
        w[rng.randint(20, 30)] = "x"
        w[rng.randint(60, 70)] = "y"
        made[2 * i + 1] = " ".join(w)
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_forest.similar(df).collect()} == linked(made)


def test_op1(spark, texts):
    want = {}
    for r in read(spark, DATA, "benchmark").collect():
        own = Counter(shingles(r["text"]))
        size = sum(own.values())
        for i, t in texts.items():
            s = shingles(t)
            if own.keys() & set(s):
                m = min(size, len(s))
                best = max(sum((Counter(s[a : a + m]) & own).values()) for a in range(len(s) - m + 1))
                if best / (m + size - best) >= 0.8 - 1e-12:
                    want[i, r["item_id"]] = best / (m + size - best)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in queries.op1_decontamination(spark, DATA).collect()}
    assert want and got == pytest.approx(want)


def test_op1_in_many_blocks(spark, monkeypatch):
    docs, items = read(spark, DATA, "documents"), read(spark, DATA, "benchmark")
    want = sorted(map(tuple, decontamination.matches(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 7)
    assert items.count() > 7 and sorted(map(tuple, decontamination.matches(docs, items).collect())) == want
    assert {r["doc_id"] for r in decontamination.clean(docs, items).collect()}.isdisjoint(r[0] for r in want)


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    items = decontamination.Items([(i, " ".join(f"w{i}_{k}" for k in range(20))) for i in range(30)])
    prints = items.prints[rng.integers(0, 30, 500)].copy()
    for n in range(500):
        for bit in rng.choice(64, rng.integers(0, 30), replace=False):
            prints[n] ^= np.uint64(1) << np.uint64(bit)
    got = {tuple(x) for x in items.within_radius(prints, np.arange(30)).tolist()}
    want = {(n, i) for n in range(500) for i in range(30) if bin(int(prints[n] ^ items.prints[i])).count("1") <= decontamination.RADIUS}
    assert got == want


def test_op2(spark, texts):
    count, held = Counter(), {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    for i, t in tokens.items():
        if not held[i]:
            count.update(t)
    n = sum(count.values())
    unit = math.log10(n + 0.5 * (len(count) + 1))
    for r in queries.op2_bloom_lm(spark, DATA).collect():
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(count[t] > 0 for t in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(count[t] + 0.5) - unit for t in own), rel=1e-9)


def test_filter_never_underestimates():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 62, 4000, dtype=np.uint64))
    levels = bloom_lm.level(rng.integers(1, 500, len(keys)))
    own = bloom_lm.Filter(keys, levels)
    assert (own.levels(keys) >= levels).all() and (own.levels(keys) > levels).mean() < 0.03
    assert (own.levels(rng.integers(0, 1 << 62, 4000, dtype=np.uint64)) > 0).mean() < 0.03


def test_levels_are_exact_for_small_counts():
    counts = np.arange(1, 5000)
    q = bloom_lm.level(counts)
    assert (bloom_lm.least(q) <= counts).all() and (counts <= bloom_lm.most(q)).all()
    assert (bloom_lm.least(q)[:4] == counts[:4]).all() and (bloom_lm.most(q)[:3] == counts[:3]).all()


def test_op3(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{DATA}/pages.parquet')")
    want = sorted(map(repr, con.execute(queries.ORACLE["op3_warc"]).fetchall()))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(repr(tuple(r[c] for c in columns)) for r in queries.op3_warc(spark, DATA).collect()) == want


@pytest.mark.parametrize("name, label, folds, out", [("op4_compression_quality", "quality", 3, 1), ("op7_toxicity_grammar", "toxic", 5, 0)])
def test_held_out_accuracy(spark, name, label, folds, out):
    data = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r[label] for r in read(spark, data, "labels").collect()}
    rows = queries.QUERIES[name](spark, data).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out) for r in rows)
    right = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(right) / len(right) > 0.95


def test_toxic_texts_held_out_are_found(spark):
    data = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in read(spark, data, "labels").collect()}
    rows = [r for r in queries.op7_toxicity_grammar(spark, data).collect() if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = ([r["predicted"] for r in rows if truth[r["doc_id"]] == y] for y in (1, 0))
    assert sum(toxic) > 0.9 * len(toxic) and sum(clean) < 0.01 * len(clean)


def test_op5_columns(spark):
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    urls = {r["page_id"]: r["url"] for r in read(spark, DATA, "pages").collect()}
    for r in queries.op5_url_rules(spark, DATA).collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r["page_id"]] or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [x for x in rules if (host == (h := x.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + x.partition("/")[2])]
        best = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best)
        assert r["verdict"] == rules[best] if best else r["verdict"] in ("allow", "block")


def test_op6_base(spark, texts):
    base = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for r in queries.op6_license_scan(spark, DATA).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r["doc_id"]] or "").translate(LOWER))
        places = [(i, v) for p, v in base.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({v for _, v in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_license_expressions():
    text = "x\nSPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\n"
    assert license_scan.postfix("(MIT OR GPL-2.0-only) AND Apache-2.0") == ["mit", "gpl-2.0-only", "or", "apache-2.0", "and"]
    row = license_scan.scan(text)
    assert row[5] == "apache-2.0,gpl-2.0-only,mit" and row[8] is True
    assert license_scan.permitted(license_scan.postfix("GPL-2.0-only WITH Classpath-exception-2.0"))
    assert not license_scan.permitted(license_scan.postfix("MIT AND GPL-3.0-only"))
    assert license_scan.postfix("MIT OR") is None and license_scan.postfix("(MIT") is None and license_scan.postfix("") is None


def test_grammar_rewrites_by_clause():
    def run(symbols):
        machine, out = toxicity.grammar(), []
        state = machine.start
        for s in symbols:
            o, state = machine.step(state, s)
            out.append(o)
        return "".join(out)

    assert run("toi") == "toI" and run("noi") == "noj" and run("roi") == "roq"
    assert run("tbi") == "tbi" and run("rbi") == "rbi" and run("toooooi") == "toooooi"
    assert run("h") == "h" and run("mh") == "my" and run("tmh") == "tmH" and run("ntmh") == "ntmk" and run("mbh") == "mbh"
    assert run("ai") == "ax" and run("tai") == "taI" and run("nai") == "naj" and run("rtai") == "rtaq" and run("abi") == "abi"


def test_clauses_score_by_their_grammar():
    """Against a plain reading of each clause."""
    own = toxicity._Matcher({"zork": 2.0})
    texts = ["you are such an idiot. nice day", "he is not an idiot", "she said you are a zork", "we will kill you", "i will not hurt you, zork!", "plain words", ""]
    got = np.expm1(own.features(pa.array(texts)))
    want = np.zeros((7, 6))
    want[0, 1] = want[0, 5] = 1.5 * toxicity.SEED_WEIGHT  # aimed at you
    want[1, 2] = want[1, 5] = 0.3 * toxicity.SEED_WEIGHT  # negated
    want[2, 3] = want[2, 5] = 0.3 * 2.0  # reported
    want[3, 4] = want[3, 5] = 0.5 * toxicity.SEED_WEIGHT  # a threat without a target before it
    want[4, 4] = want[4, 5] = 0.2 * toxicity.SEED_WEIGHT  # negated, in its own clause
    want[4, 0] = 2.0
    want[4, 5] = max(want[4, 5], 2.0)
    assert got == pytest.approx(want)


def test_op5_mined_verdicts(spark):
    """All combinations of tokens of a small table, judged in plain loops."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        host = rng.choice(["a.org", "b.com", "c.net"])
        rows.append((i, f"http://{host}/{rng.choice(['de', 'fr', 'xx'])}/{rng.choice(['p', 'q'])}{'?k=1' if rng.random() < 0.3 else ''}"))
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = url_rules.parse_rules("allow org/ block com/de/ allow com/fr/")
    got = {r["page_id"]: r for r in url_rules.judge(df, rules).collect()}
    host, path = url_rules.host_and_path(F.col("url"))
    kinds = {r["page_id"]: frozenset(r["t"]) for r in df.select("page_id", url_rules.url_tokens(F.col("url"), host, path).alias("t")).collect()}
    known = {i: r["verdict"] for i, r in got.items() if r["rule"]}
    count, said = Counter(), Counter()
    for i, v in known.items():
        for n in range(1, len(kinds[i]) + 1):
            for c in combinations(sorted(kinds[i]), n):
                count[c] += 1
                said[c, v] += 1
    mined = {(c, v): (k / count[c], k / len(known)) for (c, v), k in said.items() if k / len(known) >= url_rules.MIN_SUPPORT and k / count[c] >= url_rules.MIN_CONFIDENCE}
    decided = 0
    for i, r in got.items():
        if not r["rule"]:
            fit = [(-a, -b, len(c), " ".join(c), v) for (c, v), (a, b) in mined.items() if set(c) <= kinds[i]]
            assert (r["verdict"], r["mined"]) == ((min(fit)[4], min(fit)[3]) if fit else ("allow", None))
            decided += bool(fit)
    assert decided


def test_op5_ends_on_shared_tokens(spark):
    """Thirty query keys that come together, of which others have a part."""
    query = "&".join(f"k{i:02d}=1" for i in range(30))
    rows = [(i, f"http://a.org/x?{query}") for i in range(100)] + [(100 + i, f"http://b.com/de/{i}") for i in range(50)]
    rows += [(200, "http://c.net/z?k07=5&k03=1"), (201, "http://c.net/de/4")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    began = time.time()
    got = {r["page_id"]: r for r in url_rules.judge(df, url_rules.parse_rules("allow org/ block com/de/")).collect()}
    assert time.time() - began < 20
    assert (got[200]["verdict"], got[200]["mined"]) == ("allow", "q:k03") and (got[201]["verdict"], got[201]["mined"]) == ("block", "p:#")


def test_op6_many_matches_and_labels():
    plain = " under the mit license cc by nc sa gnu gpl " * 3000
    row = license_scan.scan(plain)
    assert row[:4] == (30_000, 6000, 0, 29_994)
    assert row[5] == "cc-by-nc,cc-by-nc-sa,gpl,mit" and 0.99 < row[6] <= 1
    # A longer phrase takes the place of those inside it; base labels stay.
    assert license_scan.scan("gnu general public license version 3")[5] == "gpl-3"
    assert license_scan.scan("the mit license and cc by")[4:6] == ("", "cc-by,mit")


def test_op9_spans_are_the_librarys():
    import public_tokenizers

    from stepweave.llm.sentencepiece_codec import codec

    own = codec(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [r[0] or "" for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()] + ["", " ", "  a  b ", "漢字 \U0001f600 \x00 z", "<s> <0x41> ▁x"]
    ids, bounds = own.encode(texts)
    assert ids == own.model.encode(texts)
    for proto, i, b, text in zip(own.model.encode(texts, return_type="proto"), ids, bounds, texts, strict=True):
        assert b[-1:].tolist() == [len(text.encode())] or not text
        assert all(p.begin == x for p, k, x in zip(proto.pieces, i, b, strict=False) if not own.is_byte[k])


def test_op8_base(spark, texts):
    for r in queries.op8_decision_rules(spark, DATA).collect():
        text = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = defaultdict(list)
        for i in range(len(w) - 4):
            seen[tuple(w[i : i + 5])].append(i)
        covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (failed and r["kept"])


def test_character_map_takes_the_longest_key():
    # A double array for a -> "x" and ab -> "yz": units at 0 (root), a, its leaf, b and its leaf.
    label = {"a": ord("a"), "b": ord("b")}
    units = [0] * 512
    units[0] = 1 << 10  # offset 1
    at_a = 0 ^ 1 ^ label["a"]
    units[at_a] = (256 << 10) | (1 << 8) | label["a"]
    leaf_a = at_a ^ 256
    units[leaf_a] = 0 | 1 << 31
    at_b = leaf_a ^ label["b"]
    units[at_b] = (128 << 10) | (1 << 8) | label["b"]
    units[at_b ^ 128] = 2 | 1 << 31
    blob = np.array(units, "<u4").tobytes()
    own = CharacterMap(np.array([len(blob)], "<u4").tobytes() + blob + b"x\0yz\0")
    assert own.longest(b"abc", 0) == (2, b"yz") and own.longest(b"ac", 0) == (1, b"x") and own.longest(b"c", 0) is None


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline

    docs = read(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), "test")
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after and after <= set(before) and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "n-gram Jaccard join":
            assert after == {c for c, _ in linked(before).values()}
        if name == "benchmark decontamination":
            assert set(before) - after == {r["doc_id"] for r in decontamination.matches(spark.createDataFrame(list(before.items()), "doc_id long, text string"), read(spark, DATA, "benchmark")).collect()}
    assert corpus_pipeline.run(spark, DATA).count() == len(after)
    assert Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"


@pytest.mark.parametrize("name", ["op1_decontamination", "op10_jaccard_forest"])
def test_sql_of_pairs(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    held = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in held.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(held.fetchall())
