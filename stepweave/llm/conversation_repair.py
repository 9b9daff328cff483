"""Repair of the structure of conversations by cheapest edits.

The turns of a conversation should have the role initials ``(s?(ua)+)?``. Faulty
turns (blank, duplicate, truncated) are told first; then every turn is kept (K,
0), given the role that fits (R, 3) or deleted (D, 4), and turns without text
are inserted (I, 3). Blank and duplicate turns must go; a truncated one that
stays costs 3 more. Turns and states of the pattern are a graph without cycles
of cost 0: minimum costs from its start and to its end tell which edits are
tight, that is, lie on some cheapest path. A walk over the set of states that it
can be in takes the least tight edit letter at each step, so that the audit is
the least of all cheapest ones.

A conversation of up to ``large_rows`` turns and ``large_bytes`` of text is
repaired in one place, as one of the many that share a task. A larger one is
dealt over range partitions by turn: duplicates by a grouping, faults as one
character a turn, which are joined to one string a conversation, as its audit
is one, and edits go back to the turns by a join on their places. Its texts meet
only to be hashed, in order, as a stream, since SHA-256 has no other way. Both
ways give the same rows.

Defined cases: a null role or text is one space; null turns come first; turns of
equal number are ordered by role and the text's MD5, so equal rows lie side by
side; null and repeated conversation ids are keys like others; very long texts
are held one at a time beside their own conversation; an empty table gives no
row; other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import bounded, stored

#: Costs of the edits and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Conversations beyond either bound are dealt over tasks.
LARGE_ROWS, LARGE_BYTES = 20_000, 16 << 20
#: Rows of text that are gathered before they are given on.
_LINES = 4096
BLANKS = " \t\n\v\f\r"
#: A turn as one character: its initial (s, u, a or another) and its fault.
INITIALS = "suax"
FINE, CUT, BLANK, DUPLICATE = "suax", "SUAX", "1234", "5678"
_CODES = FINE + CUT + BLANK + DUPLICATE
#: States: nothing kept yet, after a system, user, assistant turn; the one that a
#: user or assistant turn leads to; the role that fits; whether a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
FITTING = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (0, None, None, 0)
_FAR = 1 << 60
#: Turns whose costs to the end are held at once.
_BLOCK = 1 << 16


@lru_cache(maxsize=None)
def _edits(code: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of the edits of one turn in a state."""
    more = TRUNCATED if code in CUT else 0
    out = [("D", DELETE, state)]
    if code in FINE or code in CUT:
        kind = code.lower()
        if kind == "s" and state == START:
            out.append(("K", KEEP + more, SYSTEM))
        if (kind == "u" and FITTING[state] == USER) or (kind == "a" and FITTING[state] == ASSISTANT):
            out.append(("K", KEEP + more, FITTING[state]))
        out.append(("R", REROLE + more, FITTING[state]))
    return tuple(out)


def _inserted(costs: list[int], ahead: bool) -> tuple[int, ...]:
    """Costs of the states once insertions are allowed: to the end, or ahead
    from the start. Two are enough; more come back to a state."""
    for _ in range(2):
        if ahead:
            costs = [min([costs[s], *(costs[p] + INSERT for p in range(4) if FITTING[p] == s)]) for s in range(4)]
        else:
            costs = [min(costs[s], costs[FITTING[s]] + INSERT) for s in range(4)]
    return tuple(costs)


_END = _inserted([_FAR if e is None else e for e in ENDS], ahead=False)


@lru_cache(maxsize=1 << 16)
def _before(code: str, apart: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a turn, from those behind it. A vector's parts
    differ by a few edits at most, so few vectors occur once their least part is
    taken off."""
    return _inserted([min(c + apart[t] for _, c, t in _edits(code, s)) for s in range(4)], ahead=False)


def _backward(codes: str, costs: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs to the end at each place, the last one's given."""
    out = [costs]
    for code in reversed(codes):
        low = min(costs)
        costs = tuple(low + v for v in _before(code, tuple(v - low for v in costs)))
        out.append(costs)
    return out[::-1]


def _forward(code: str, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from the start behind a turn, from those before it."""
    after = [_FAR] * 4
    for s in range(4):
        for _, c, t in _edits(code, s):
            after[t] = min(after[t], costs[s] + c)
    return _inserted(after, ahead=True)


def _solve(codes: str) -> tuple[int, str]:
    blocks = [codes[i : i + _BLOCK] for i in range(0, len(codes), _BLOCK)]
    ends = [_END]
    for block in reversed(blocks):
        ends.append(_backward(block, ends[-1])[0])
    best = ends[-1][START]
    front = _inserted([0, _FAR, _FAR, _FAR], ahead=True)
    states, letters = {START}, []

    def moves(behind: tuple[int, ...], edits: Iterable[tuple[int, str, int, int]]) -> dict[str, set[int]]:
        """The tight edits of the states by letter, and where they lead."""
        out: dict[str, set[int]] = {}
        for s, letter, cost, to in edits:
            if front[s] + cost + behind[to] == best:
                out.setdefault(letter, set()).add(to)
        return out

    insertions = lambda: [(s, "I", INSERT, FITTING[s]) for s in states]
    for k, block in enumerate(blocks):
        back = _backward(block, ends[-2 - k])
        for i, code in enumerate(block):
            while True:
                found = moves(back[i + 1], [(s, *e) for s in states for e in _edits(code, s)]) | moves(back[i], insertions())
                letter = min(found)
                letters.append(letter)
                states = found[letter]
                if letter != "I":
                    break
            front = _forward(code, front)
    while not any(ENDS[s] == 0 and front[s] == best for s in states):
        letters.append("I")
        states = moves(_END, insertions())["I"]
    return best, "".join(letters)


_cached = lru_cache(maxsize=1 << 15)(_solve)


def repairs(codes: str) -> tuple[int, str]:
    """The least cost of a conversation's edits, and the audit."""
    return _cached(codes) if len(codes) <= 64 else _solve(codes)


def faults(codes: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated turns, and adjacent initials that don't fit."""
    blank, duplicate, cut = (sum(map(codes.count, kind)) for kind in (BLANK, DUPLICATE, CUT))
    kinds = codes.translate({ord(c): INITIALS[i % 4] for i, c in enumerate(_CODES)})
    starts = "".join("." if a + b in ("su", "ua", "au") else "x" for a, b in zip(kinds, kinds[1:]))
    return blank, duplicate, cut, starts.count("x")


def _code(role: str, text: str, seen: set[tuple[str, str]]) -> str:
    at = max(0, INITIALS.find(role[0])) if role and role[0] in "sua" else 3
    bare = text.rstrip(BLANKS)
    if not bare:
        return BLANK[at]
    if (role, text) in seen:
        return DUPLICATE[at]
    seen.add((role, text))
    return FINE[at] if bare[-1] in ".!?" else CUT[at]


def _turns(codes: str, audit: str, pairs: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that remain."""
    state, at = START, 0
    for letter in audit:
        if letter == "I":
            state = FITTING[state]
            yield letter, ROLE[state], ""
            continue
        role, text = pairs[at]
        if letter == "K":
            state = SYSTEM if codes[at] in "sS" else FITTING[state]
            yield letter, role, text
        elif letter == "R":
            state = FITTING[state]
            yield letter, ROLE[state], text
        at += 1


def _rows(conversations: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", space("role"), space("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row,
    1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it the user's."""
    rows = _rows(conversations)
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("_k", F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")) % 20).where("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("_copy", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def _order() -> list[Column]:
    return [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("_md5")]


_RECORD = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _split(conversations: DataFrame, large_rows: int, large_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of common conversations, and those of large ones, if any."""
    rows = _rows(conversations)
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = stored(sizes.where((F.col("n") > large_rows) | (F.col("bytes") > large_bytes)).select(F.col("conv_id").alias("_large")), "large-conversations")
    if large.isEmpty():
        return rows, None
    named = F.col("conv_id").eqNullSafe(F.col("_large"))
    return rows.join(large, named, "left_anti"), rows.join(large, named, "left_semi")


def _small(rows: DataFrame, turns: bool) -> DataFrame:
    """Common conversations, each whole in one place: their records, or the turns
    that remain of them."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    record = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _RECORD) + ", audit string, repaired_sha256 string"
    remaining = f"conv_id {kind}, place long, edit string, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in (remaining if turns else record).split(", ")]
        out: list[list] = [[] for _ in names]
        types: list[pa.DataType | None] = [None] * len(names)

        def close(key: object, numbers: list[int | None], pairs: list[tuple[str, str]]) -> None:
            seen: set[tuple[str, str]] = set()
            codes = "".join(_code(r, t, seen) for r, t in pairs)
            cost, audit = repairs(codes)
            made = _turns(codes, audit, pairs)
            if turns:
                rows = [(key, i, *t) for i, t in enumerate(made)]
            else:
                known = {n for n in numbers if n is not None}
                gaps = max(known) - min(known) + 1 - len(known) if known else 0
                digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in made).encode()).hexdigest()
                rows = [(key, gaps, *faults(codes), cost, audit, digest)]
            for row in rows:
                for held, value in zip(out, row, strict=True):
                    held.append(value)

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(held, types[i] or (pa.int64() if c in {*_RECORD, "place"} else pa.string())) for i, (held, c) in enumerate(zip(out, names, strict=True))]
            for held in out:
                held.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        now, numbers, pairs = None, [], []
        for batch in batches:
            types[0] = batch.schema.field("conv_id").type
            for key, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if pairs and key != now:
                    close(now, numbers, pairs)
                    numbers, pairs = [], []
                    if len(out[0]) >= _LINES:
                        yield flush()
                now = key
                numbers.append(turn)
                pairs.append((role, text))
        if pairs:
            close(now, numbers, pairs)
        if types[0] is not None:
            yield flush()

    dealt = bounded(rows).withColumn("_md5", F.md5(F.col("text").cast("binary"))).repartition("conv_id").sortWithinPartitions(*_order()).drop("_md5")
    return dealt.mapInArrow(run, remaining if turns else record)


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of large conversations in order, over range partitions, with part and
    place (without gaps within a part), and each turn's code."""
    marked = rows.withColumn("_md5", F.md5(F.col("text").cast("binary"))).withColumn("_id", F.monotonically_increasing_id())
    order = [*_order(), F.col("_id")]  # the last deals even equal rows
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}).drop("_id"), "placed-turns")
    first = placed.groupBy("conv_id", "role", "_md5").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("_first"))
    bare = F.rtrim("text", F.lit(BLANKS))
    kind = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate("sua")], F.lit(3))
    fault = F.when(bare == "", 2).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    lean = placed.select("conv_id", "part", "place", "turn", kind.alias("_kind"), fault.alias("_fault")).join(first, "place", "left")
    state = F.when((F.col("_fault") != 2) & F.col("_first").isNull(), 3).otherwise(F.col("_fault"))
    return placed, lean.select("conv_id", "part", "place", "turn", F.substring(F.lit(_CODES), 4 * state + F.col("_kind") + 1, F.lit(1)).alias("code"))


def _beside(left: DataFrame, right: DataFrame, key: str = "conv_id") -> DataFrame:
    """Left join on a key that may be null."""
    return left.join(right.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations as strings of codes: faults, cost and audit."""
    for batch in batches:
        for at in range(batch.num_rows):
            one = batch.slice(at, 1)
            codes = "".join(p["codes"] for p in one.column("pieces")[0].as_py())
            cost, audit = repairs(codes)
            arrays = [one.column("conv_id"), *(pa.array([v], pa.int64()) for v in (*faults(codes), cost)), pa.array([audit], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", *_RECORD[1:], "audit"])


_ACTION = pa.schema([("place", pa.int64()), ("head", pa.list_(pa.string())), ("edit", pa.string()), ("role", pa.string()), ("tail", pa.list_(pa.string()))])


def _actions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What becomes of each turn: the roles of those inserted before it, its own
    edit, its new role, and the roles of those inserted behind the last one."""
    for batch in batches:
        for row in range(batch.num_rows):
            pieces = batch.column("pieces")[row].as_py()
            codes = "".join(p["codes"] for p in pieces)
            places = (p["at"] + k for p in pieces for k in range(len(p["codes"])))
            state, head, done, out = START, [], 0, []
            for letter in repairs(codes)[1]:
                if letter == "I":
                    state = FITTING[state]
                    (head if done < len(codes) else out[-1]["tail"]).append(ROLE[state])
                    continue
                if letter == "K":
                    state = SYSTEM if codes[done] in "sS" else FITTING[state]
                elif letter == "R":
                    state = FITTING[state]
                done += 1
                if len(out) >= _LINES:
                    yield pa.RecordBatch.from_pylist(out, _ACTION)
                    out = []
                out.append({"place": next(places), "head": head, "edit": letter, "role": ROLE[state] if letter == "R" else None, "tail": []})
                head = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _ACTION)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation from its turns in order, as they come."""
    names, kind, now, digest = ["conv_id", "repaired_sha256"], None, None, None
    give = lambda: pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()])], names)
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if digest is not None and key == now:
                digest.update(b"\n")
            else:
                if digest is not None:
                    yield give()
                now, digest = key, hashlib.sha256()
            digest.update(f"{role}:{text}".encode())
    if digest is not None:
        yield give()


def _large(rows: DataFrame, turns: bool) -> DataFrame:
    """Large conversations, over range partitions: their records, or the turns
    that remain of them."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    placed, codes = _placed(rows)
    codes = stored(codes, "turn-codes")
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda c: c["code"]), "")
    pieces = codes.groupBy("conv_id", "part").agg(F.min("place").alias("at"), spelled.alias("codes"))
    whole = stored(pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "at", "codes"))).alias("pieces")), "conversation-codes")
    actions = whole.select("pieces").mapInArrow(_actions, "place long, head array<string>, edit string, role string, tail array<string>")
    inserted = lambda c: F.transform(c, lambda r: F.struct(F.lit("I").alias("edit"), r.alias("role"), F.lit("").alias("text")))
    own = F.array(F.struct(F.col("edit").alias("edit"), F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))
    every = F.concat(inserted("head"), F.when(F.col("edit") != "D", own).otherwise(F.array()), inserted("tail"))
    joined = placed.join(actions.withColumnRenamed("role", "new_role"), "place").select("conv_id", "place", F.posexplode(every).alias("pos", "turn"))
    remaining = joined.select("conv_id", (8 * F.col("place") + F.col("pos")).alias("place"), "turn.edit", "turn.role", "turn.text")
    if turns:
        return remaining
    known = codes.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    digests = bounded(remaining).repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_hashed, f"conv_id {kind}, repaired_sha256 string")
    planned = whole.mapInArrow(_planned, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _RECORD[1:]) + ", audit string")
    rows = _beside(_beside(planned, known), digests)
    return rows.select("conv_id", *_RECORD, "audit", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repaired(conversations: DataFrame, large_rows: int = LARGE_ROWS, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """conv_id, place (ascending), edit, role and text of the turns that remain,
    inserted ones included."""
    common, large = _split(conversations, large_rows, large_bytes)
    made = _small(common, turns=True)
    return made if large is None else made.unionByName(_large(large, turns=True))


def audits(conversations: DataFrame, ids: DataFrame | None = None, large_rows: int = LARGE_ROWS, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """One row per conversation: gaps in its turn numbers, blank, duplicate and
    truncated turns, illegal neighbours, cost and audit of the cheapest edits, and
    the SHA-256 of the repaired turns. Of ``ids`` (column conv_id) without turns:
    zeros, an empty audit, and the hash of nothing."""
    common, large = _split(conversations, large_rows, large_bytes)
    made = _small(common, turns=False)
    made = made if large is None else made.unionByName(_large(large, turns=False))
    if ids is None:
        return made
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _RECORD]
    rows = _beside(ids.select("conv_id").distinct(), made)
    return rows.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
