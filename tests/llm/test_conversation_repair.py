"""Conversation repair against a plain search, in one place and dealt over parts."""

import hashlib
import heapq
import random
import zlib
from itertools import groupby

import pytest

from stepweave.llm import conversation_repair as repair

BLANKS = " \t\n\v\f\r"


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = {1: "", 2: text.translate({ord(c): None for c in ".!?"})}.get(k, text)
        yield from [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)


def plain_faults(pairs):
    seen, out = set(), []
    for role, text in pairs:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "fine")
        seen.add((role, text))
    return out


def accepts(state, role):
    """The next state of (s?(ua)+)?, as the string of initials so far; None if none."""
    initial = role[:1]
    if initial == "s":
        return "s" if state == "" else None
    if initial == "u":
        return "u" if state in ("", "s", "a") else None
    return "a" if initial == "a" and state == "u" else None


def plain_repair(pairs):
    """The cheapest edits, the least string of letters among them, by best-first search."""
    kinds = plain_faults(pairs)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, at, state, out = heapq.heappop(heap)
        if at == len(pairs) and state in ("", "a"):
            return cost, letters, out
        if (at, state) in done:
            continue
        done.add((at, state))
        for role in ("user", "assistant"):
            to = accepts(state, role)
            if to:
                heapq.heappush(heap, (cost + 3, letters + "I", at, to, (*out, (role, ""))))
                if at < len(pairs) and kinds[at] in ("fine", "truncated"):
                    heapq.heappush(heap, (cost + 3 + 3 * (kinds[at] == "truncated"), letters + "R", at + 1, to, (*out, (role, pairs[at][1]))))
        if at < len(pairs):
            heapq.heappush(heap, (cost + 4, letters + "D", at + 1, state, out))
            to = accepts(state, pairs[at][0])
            if to and kinds[at] in ("fine", "truncated"):
                heapq.heappush(heap, (cost + 3 * (kinds[at] == "truncated"), letters + "K", at + 1, to, (*out, pairs[at])))


def plain(rows, ids):
    order = lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest())
    out = {i: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for i in ids}
    for key, group in groupby(sorted(rows, key=order), lambda r: r[0]):
        turns = list(group)
        pairs = [t[2:] for t in turns]
        kinds = plain_faults(pairs)
        known = [t[1] for t in turns if t[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, letters, left = plain_repair(pairs)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[key] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, letters, digest)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "sys", "USER"]
    texts = ["Yes.", "No!", "so then", "What?  \n", " \t", "", None, "é…", "漢字。", "x" * 3000]
    made = []
    for conv in [*range(150), None, 9007199254740993]:
        for turn in range(rng.choice([1, 2, 4, 7, 12])):
            number = rng.choice([turn, turn, turn, turn + 3, None, 2])
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            made.append((conv, number, role, rng.choice(texts) if rng.random() < 0.6 else f"text {conv} {turn}."))
    made += [(700, t, ("user", "assistant")[t % 2], f"turn {t}." if t % 11 else "again") for t in range(900)]
    return made


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, place int")


def read(frame):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[c] for c in names) for r in frame.collect()}


@pytest.mark.parametrize("bounds", [(20_000, 16 << 20), (5, 16 << 20), (0, 0)])
def test_audits_equal_the_plain_search(spark, rows, bounds):
    given = table(spark, rows).repartition(7)
    want = plain(list(plain_damage(rows)), {r[0] for r in rows})
    got = read(repair.audits(repair.damaged(given), given, *bounds))
    assert got == want and len({v[6] for v in want.values()}) > 40 and want[700][5] > 0


@pytest.mark.parametrize("large_rows", [20_000, 3])
def test_repaired_turns_have_the_digest(spark, rows, large_rows):
    given = table(spark, rows[:300])
    turns = repair.repaired(given, large_rows).collect()
    held = {}
    for r in sorted(turns, key=lambda r: r["place"]):
        held.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for key, row in read(repair.audits(given)).items():
        assert hashlib.sha256("\n".join(held.get(key, [])).encode()).hexdigest() == row[7]


def test_long_conversations_are_solved_in_blocks(monkeypatch):
    rng = random.Random(1)
    codes = ["".join(rng.choice(repair._CODES) for _ in range(n)) for n in (0, 1, 63, 64, 65, 300)]
    want = [repair._solve(c) for c in codes]
    monkeypatch.setattr(repair, "_BLOCK", 7)
    assert [repair._solve(c) for c in codes] == want


def test_empty_table(spark, rows):
    given = table(spark, rows[:5]).where("false")
    assert repair.audits(repair.damaged(given), given).count() == 0 and repair.repaired(given).count() == 0
