"""Periodic runs against every stretch of every lag."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from stepweave.llm import periodic_runs
from stepweave.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            s = at
            while at + q < n and words[at] == words[at + q]:
                at += 1
            length = at + q - s
            # A stretch four times as long as q has smaller periods that divide q only.
            smaller = any(q % p == 0 and all(words[k] == words[k + p] for k in range(s, s + length - p)) for p in range(1, q)) if length >= max(6, 4 * q) else True
            if not smaller:
                found.append((s, length, q))
            at = max(at, s + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(key, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (
        key, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def made(n, seed=3):
    rng = random.Random(seed)
    for _ in range(n):
        kinds = rng.choice([1, 2, 3, 9])
        words = [rng.randrange(kinds) for _ in range(rng.randint(0, 70))]
        if len(words) > 10 and rng.random() < 0.7:
            turn = [rng.randrange(kinds) for _ in range(rng.randint(1, 7))]
            at = rng.randrange(len(words))
            words[at:at] = (turn * 20)[: rng.randint(6, 45)]
        yield words


@pytest.mark.parametrize("heavy", [periodic_runs.HEAVY, 0.0, 0.3, 1e9])
def test_runs_whichever_way_lags_are_counted(heavy):
    texts = list(made(300))
    codes, offsets = np.array([w for t in texts for w in t]), np.r_[0, np.cumsum([len(t) for t in texts])]
    got = [[tuple(map(int, r)) for r in g] for g in periodic_runs.runs(codes, offsets, heavy)]
    assert got == [plain_runs(t) for t in texts] and sum(map(len, got)) > 150


def test_counts_are_exact():
    words = np.array([random.Random(2).choice([0, 0, 0, *range(40)]) for _ in range(900)])
    for heavy in (0.0, 1e9):
        counts, base = periodic_runs.lag_counts(words, np.array([0, 900]), heavy)
        assert base.tolist() == [0, 226] and counts[1:].tolist() == [int((words[:-q] == words[q:]).sum()) for q in range(1, 226)]


def test_odd_texts(spark, odd, none):
    loops = spark.createDataFrame([(100 + i, " \n".join(f"w{w}" for w in t)) for i, t in enumerate(made(150, 8))], "doc_id long, text string")
    given = odd.select("doc_id", "text").unionByName(loops)
    got = rows(periodic_runs.digests(periodic_runs.collapse(periodic_runs.planted(given))))
    want = {repr(plain_row(r["doc_id"], r["text"])) for r in given.where("doc_id <> 6 or doc_id is null").collect()}
    assert {repr(r) for r in got if r[0] != 6} == want
    assert periodic_runs.collapse(none).count() == 0 and periodic_runs.collapse(odd).count() == 10


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert rows(QUERIES["op12_periodic_runs"](spark, DATA)) == sorted((plain_row(*r) for r in docs), key=repr)
