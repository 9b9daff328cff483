"""Bounds on what is sent to the tasks take nothing from the results."""

import math
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from stepweave.llm import bloom_lm, decontamination
from stepweave.llm.common import fold, read

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("range_bytes", [1 << 30, 40_000])
def test_scores_follow_the_plain_model(spark, range_bytes):
    """In one hash range or many, with a filter that hardly errs."""
    docs = read(spark, DATA, "documents").repartition(3)
    held = fold(docs["doc_id"], 5) == 1
    plain = plain_scores({r["doc_id"]: r["text"] for r in docs.collect()})
    got = {r["doc_id"]: r["score"] for r in bloom_lm.score(docs, held, bits_per_entry=400, range_bytes=range_bytes).collect()}
    assert got == pytest.approx(plain, rel=1e-9)


def test_scores_do_not_depend_on_partitions(spark):
    docs = read(spark, DATA, "documents")
    held, before = fold(docs["doc_id"], 5) == 1, spark.conf.get("spark.sql.shuffle.partitions")
    runs = []
    for n in (4, 7, 31):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        runs.append({r["doc_id"]: r["score"] for r in bloom_lm.score(docs.repartition(n), held, range_bytes=100_000).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert runs[0] == pytest.approx(runs[1], rel=1e-9) and runs[0] == pytest.approx(runs[2], rel=1e-9)


def plain_scores(texts):
    split = {i: [w.decode() for w in (t or "").encode().lower().split()] for i, t in texts.items()}
    one, two, three = Counter(), Counter(), Counter()
    for i, t in split.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            t = [0, *t, None]
            one.update(t)
            two.update(zip(t, t[1:]))
            three.update(zip(t, t[1:], t[2:]))
    n, v = sum(one.values()) - one[0], len(one) - 1

    def ends(count):
        """The least and the greatest count of the level that holds ``count``."""
        marks = [m for k in range(60) if (m := math.ceil(2 ** (k / 2) - 1e-9)) <= 10 * count + 10]
        return (0, 0) if not count else (max(m for m in marks if m <= count), min(m for m in marks if m > count) - 1)

    def terms(t):
        for k in range(1, len(t)):
            seen = one[t[k - 1]]
            weight = bloom_lm.PAIR_WEIGHT * max(seen, 1) ** bloom_lm.PAIR_POWER
            p = (min(ends(two[t[k - 1], t[k]])[0], seen) + weight * (one[t[k]] + 0.5) / (n + 0.5 * (v + 1))) / (seen + weight)
            if k > 1:
                context = ends(two[t[k - 2], t[k - 1]])[1]
                p = (min(ends(three[t[k - 2], t[k - 1], t[k]])[0], context) + bloom_lm.TRIPLE_WEIGHT * p) / (context + bloom_lm.TRIPLE_WEIGHT)
            yield math.log10(p)

    return {i: sum(terms([0, *t, None])) for i, t in split.items()}


@pytest.mark.parametrize("size", [45, 100, 200])
def test_cut_items_before_a_repeated_word(size):
    """Items without their last tenth, in front of one word many times."""
    texts = [[f"w{i}_{k}" for k in range(size + 4)] for i in range(40)]
    items = decontamination.Items([(i, " ".join(t)) for i, t in enumerate(texts)])
    cut = [" ".join([*t[: size + 4 - size // 10], *["same"] * 500]) for t in texts]
    found = {(r, m[0]): m[1] for r, m in items.search(pa.array(cut, pa.string()))}
    kept = size - size // 10
    assert found == pytest.approx({(i, i): kept / (2 * size - kept) for i in range(40)})


def test_repeating_items_are_found():
    """Items of few distinct shingles, and windows counted one from another."""
    items = ["a b c d e f g " * 12, "x " * 60, " ".join(f"v{k}" for k in range(30)) + " y" * 30]
    texts = [f"head {t} {' '.join(f'z{k}' for k in range(n))}" for t in items for n in (0, 9)] + [t.rsplit(" ", 4)[0] + " tail" * 50 for t in items]
    found = {(r, m[0]): m[1] for r, m in decontamination.Items(list(enumerate(items))).search(pa.array(texts, pa.string()))}
    want = {}
    for r, t in enumerate(texts):
        for i, item in enumerate(items):
            a, b = t.split(), item.split()
            s, own = [tuple(a[k : k + 5]) for k in range(len(a) - 4)], Counter(tuple(b[k : k + 5]) for k in range(len(b) - 4))
            m, size = min(len(s), own.total()), own.total()
            shared = max((Counter(s[k : k + m]) & own).total() for k in range(len(s) - m + 1))
            if shared / (m + size - shared) >= 0.8:
                want[r, i] = shared / (m + size - shared)
    assert len(want) >= 6 and found == pytest.approx(want)
