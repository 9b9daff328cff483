"""Personal data and disclosing terms against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from stepweave.llm import disclosure
from stepweave.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def plain_row(key, text):
    spans = plain_spans(text)
    counts = Counter(s[0] for s in spans)
    return (key, *(counts[k] for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())


def base(frame):
    return sorted((tuple(r)[:6] for r in frame.collect()), key=repr)


PARTS = ["a", "b.c", "@", "@x.y", ".", "-", "_", "%", " ", "\n", "1", "12", "255", "256", "0007", "1.2.3.4", "10.0.0.999", ".5.6", "+1", "+", "(523) 555-1055", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "é", "漢", "\U0001f600", "x@y", "q@r.s", "a@b.c_d@e.f", " 4", "-4"]


def test_spans_of_random_texts(spark, odd, none):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["1.2.3.4 " * 700, "9" * 9_000, "a" * 9_000 + "@", "1-" * 30_000, "a@b" + ".c" * 20_000, "+1" * 20_000, "+1" + "(" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    want = sorted((plain_row(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert base(disclosure.digests(disclosure.sanitise(docs))) == want
    assert len({w[5] for w in want}) > 300 and disclosure.sanitise(none).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_disclosure"](spark, DATA)
    assert base(got) == sorted((plain_row(*r) for r in docs), key=repr)
    clean = {r["doc_id"] for r in docs if not plain_spans(r["text"])}
    assert {r["spans"] for r in got.collect() if r["doc_id"] in clean} == {""}


def term(word):
    return re.sub(r"^[\W_]+|[\W_]+$", "", word).lower()


def plain_disclosing(texts, window, threshold, contexts):
    """(entity, term) to share and form, by counting words around each mention."""
    every, near, where, total = Counter(), Counter(), {}, 0
    for text in texts:
        every.update(t for w in text.split() if (t := term(w)))
        words, at = [], 0
        for k, a, b in sorted((s for s in plain_spans(text)), key=lambda s: s[1]):
            words += [(None, w) for w in text[at:a].split()] + [(k, text[a:b])]
            at = b
        words += [(None, w) for w in text[at:].split()]
        for i, (k, w) in enumerate(words):
            if k:
                entity = f"{k}:{re.sub('[^0-9]', '', w) if k in ('card', 'phone') else w.lower()}"
                around = tuple(t for kind, v in words[max(0, i - window) : i] + words[i + 1 : i + 1 + window] if kind is None and (t := term(v)))
                near.update((entity, t) for t in around)
                for t in around:
                    where.setdefault((entity, t), set()).add(around)
    total = every.total()
    of = Counter()
    for (e, _), n in near.items():
        of[e] += n

    def share(n, e, places):
        return math.log2(min(n, places) * total / (of[e] * places)) / math.log2(total / of[e])

    forms = lambda t: (re.sub("[0-9]", "0", t), re.sub("[0-9]", "0", t)[:3] + "*")
    out = {}
    for (e, t), n in near.items():
        if len(where[e, t]) >= contexts and share(n, e, every[t]) >= threshold:
            form = ""
            for level in (0, 1):
                g = forms(t)[level]
                places = sum(c for u, c in every.items() if forms(u)[level] == g)
                if share(sum(c for (f, u), c in near.items() if f == e and forms(u)[level] == g), e, places) < threshold:
                    form = g
                    break
            out[e, t] = (round(share(n, e, every[t]), 9), form)
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    common = [f"{a}{b}" for a in ("ba", "de", "ki", "lo", "mu") for b in ("ra", "se", "ti", "vo", "na", "pe")]
    talk = lambda n: [rng.choice(common) for _ in range(n)]
    texts = [" ".join(talk(120)) for _ in range(80)]
    for i in range(12):  # 'Zyx-Quill' and 'unit 7731' tell the address; 'common' words don't
        texts.append(" ".join([*talk(40), "Zyx-Quill,", *talk(3), "Ann.Lee@mail.example.com", *talk(3), f"unit773{i % 2}", *talk(30), "Zyx-Quill"]))
        texts.append(" ".join([*talk(30), *(f"unit{rng.randrange(1000, 9999)}" for _ in range(4)), *talk(30)]))
    texts += [" ".join(["onlyhere", *talk(5), "8.8.4.4", *talk(20)])] * 9  # copies of one text
    texts += [" ".join([*talk(9), "+1 (523) 555-1055", *talk(9), "4111 1111 1111 1111"]) for _ in range(5)]
    return texts


def test_disclosing_terms(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").repartition(5)
    found = disclosure.with_spans(docs.withColumn("row", F.col("doc_id")), "text").where("size(spans) > 0")
    got = disclosure.disclosing(disclosure.mentions(found), disclosure.vocabulary(docs, "text"))
    got = {(r["entity"], r["term"]): (round(r["share"], 9), r["form"]) for r in got.collect()}
    want = plain_disclosing(corpus, disclosure.WINDOW, disclosure.THRESHOLD, disclosure.CONTEXTS)
    assert got == want
    ann = {t: f for (e, t), (_, f) in want.items() if e == "email:ann.lee@mail.example.com"}
    assert ann["zyx-quill"] == "" and ann["unit7731"] == "unit0000" and not any(t == "onlyhere" for _, t in want)


def test_sanitised_texts(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    terms = {t: f for (_, t), (_, f) in plain_disclosing(corpus, disclosure.WINDOW, disclosure.THRESHOLD, disclosure.CONTEXTS).items()}
    for r in disclosure.sanitise(docs).collect():
        text = corpus[r["doc_id"]]
        spans = [(a, b, f"[{k.upper()}]") for k, a, b in plain_spans(text)]
        want = [(k, a, b, f"[{k.upper()}]") for k, a, b in plain_spans(text)]
        if "Ann.Lee" in text:
            words = [(m.start(), m.end(), terms[term(m[0])]) for m in re.finditer(r"\S+", text) if term(m[0]) in terms and "@" not in m[0]]
            spans, want = spans + words, want + [("term", *w) for w in words]
        assert [tuple(s) for s in r["spans"]] == want
        made, at = "", 0
        for a, b, form in sorted(spans):
            made, at = made + text[at:a] + form, b
        assert r["sanitised"] == (made + text[at:] if spans else None)
