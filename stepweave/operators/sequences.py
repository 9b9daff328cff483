"""Scenarios, their windows, and the ranking of recurring patterns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from stepweave.functions.columns import has_quote_pair, not_blank, owner

KEY = ("repo_slug", "file_path", "scenario")
L_MIN, L_MAX = 2, 18
#: Steps of a row of a dealt scenario.
BLOCK = 4096
#: A window's spot is the number of its first step times SPOT, and its place in the
#: row of ``blocks``: the least spot is the first window, and tells its row.
SPOT = 1 << 13
#: Steps whose windows a task counts together.
_CHUNK = 1 << 20
#: Patterns of a length, at most, whose windows are counted where they lie; those of
#: longer windows hardly repeat within a task.
_HELD = 100_000
#: Rows of a range of ``recurring``.
_RANGE = 250_000


def clean_steps(steps: DataFrame) -> DataFrame:
    """Steps of named scenarios that are no background and have a cluster."""
    return steps.where(~F.col("is_background") & not_blank(F.col("scenario")) & F.col("cluster_id").isNotNull())


def lengths(steps: DataFrame, min_length: int = 2) -> DataFrame:
    """The scenarios and n, their number of steps."""
    return clean_steps(steps).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_length).withColumn("n", F.col("n").cast("int"))


def scenarios(steps: DataFrame, min_length: int = 2) -> DataFrame:
    """One row per scenario: its cluster ids and texts in order of line. For
    scenarios that fit a row; ``blocks`` deals longer ones over rows."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "cluster_id", "text")))
    rows = clean_steps(steps).groupBy(*KEY).agg(ordered.alias("steps"))
    return rows.select(*KEY, F.col("steps.cluster_id").alias("ids"), F.col("steps.text").alias("texts"), F.size("steps").alias("n")).where(F.col("n") >= min_length)


def placed(steps: DataFrame) -> DataFrame:
    """The steps of scenarios in order of key and line over range partitions,
    with ``part`` and ``row``, their place in it. To be stored once, as
    ``numbered`` reads it twice."""
    order = [*KEY, "line", "cluster_id", "text"]
    rows = clean_steps(steps).select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("row"))


def numbered(placed_steps: DataFrame) -> DataFrame:
    """Steps with ``at``, their number in the order of all steps, without gaps:
    the number of a window's first step tells windows by key and position."""
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a partition
    ahead = placed_steps.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"))
    return placed_steps.join(F.broadcast(ahead), "part").withColumn("at", F.col("row") + F.col("ahead")).drop("part", "row", "ahead")


def blocks(numbered_steps: DataFrame, l_max: int = L_MAX, size: int = BLOCK, parts: int | None = None) -> DataFrame:
    """Scenarios as rows of at most ``size`` steps and the l_max - 1 that follow
    them: ids, texts, n (the steps at which windows start), start (the position of
    the first), at (its number), scen (the number of the scenario's first step) and
    whether the scenario is dealt over several rows. A scenario of any share of all
    steps is dealt over as many rows as it needs. Rows lie in ``parts`` ranges of
    their numbers: steps are dealt once, by these."""
    if size > SPOT:
        raise ValueError(f"a row has at most {SPOT} steps")
    home = F.floor(F.col("at") / size)
    copies = F.when((F.col("at") % size < l_max - 1) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    dealt = numbered_steps.withColumn("block", F.explode(copies))
    dealt = dealt.repartitionByRange(parts, "block") if parts else dealt.repartitionByRange("block")
    grouped = dealt.groupBy(*KEY, "block").agg(F.array_sort(F.collect_list(F.struct("at", "cluster_id", "text"))).alias("steps"))
    rows = grouped.select(*KEY, "block", F.col("steps.at")[0].alias("at"), F.col("steps.cluster_id").alias("ids"), F.col("steps.text").alias("texts"))
    rows = rows.withColumn("n", F.least(F.size("ids").cast("long"), (F.col("block") + 1) * size - F.col("at")).cast("int")).where("n > 0")
    # At most one scenario goes on into a block: where it began. Such a one has the
    # last step of a block and the first of the next; there are no more than blocks.
    edges = numbered_steps.where((F.col("at") % size == 0) | (F.col("at") % size == size - 1)).groupBy(*KEY).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    across = edges.where(F.floor(F.col("first") / size) < F.floor(F.col("last") / size)).select(*[F.col(c).alias(f"_{c}") for c in KEY])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
    ends = numbered_steps.join(F.broadcast(across), same, "left_semi").groupBy(*KEY).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    began = ends.select("first", F.explode(F.sequence(F.floor(F.col("first") / size) + 1, F.floor(F.col("last") / size))).alias("block"))
    rows = rows.join(F.broadcast(began), "block", "left").withColumn("start", F.when(F.col("at") == F.col("block") * size, F.col("at") - F.col("first")))
    start = F.coalesce("start", F.lit(0))
    # Only where a scenario goes on do steps of the next block follow.
    return rows.select(*KEY, "ids", "texts", "n", "at", start.cast("int").alias("start"), (F.col("at") - start).alias("scen"), ((start > 0) | (F.size("ids") > F.col("n"))).alias("dealt"))


def slices(scenario_rows: DataFrame, l_max: int = L_MAX) -> DataFrame:
    """Every window of L_MIN to l_max consecutive steps, at every start: of whole
    scenarios, or of ``blocks``, whose windows have the number of their first
    step, ``at``, beside their position."""
    most = F.least(F.lit(l_max), F.size("ids"))
    lengths = scenario_rows.where(most >= L_MIN).withColumn("L", F.explode(F.sequence(F.lit(L_MIN), most)))
    last = F.least(F.size("ids") - F.col("L"), F.col("n") - 1)
    starts = lengths.where(last >= 0).withColumn("_from", F.explode(F.sequence(F.lit(0), last)))
    window = F.slice("ids", F.col("_from") + 1, F.col("L"))
    dealt = "start" in scenario_rows.columns
    position = (F.col("_from") + F.col("start") if dealt else F.col("_from")).alias("position_start")
    own = [(F.col("at") + F.col("_from")).alias("at")] if dealt else []
    return starts.select(*KEY, position, "L", F.array_join(window.cast("array<string>"), ",").alias("pattern"), F.slice("texts", F.col("_from") + 1, F.col("L")).alias("text_seq"), *own)


def _windows(ids: np.ndarray, starts: np.ndarray, left: np.ndarray, l_max: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the places of windows, a number for each that equal windows
    share, and the numbers of the single steps. ``left`` counts the steps of a row
    from each on."""
    _, one = np.unique(ids, return_inverse=True)
    code, kinds = one.astype(np.int64), int(one.max()) + 1
    spots = np.flatnonzero(starts)
    for length in range(L_MIN, l_max + 1):
        spots = spots[left[spots] >= length]
        if not len(spots):
            return
        # The window's first length - 1 steps, and its last one.
        _, found = np.unique(code[spots] * kinds + one[spots + length - 1], return_inverse=True)
        code[spots] = found
        yield length, spots, found, one


def _grouped(block_rows: DataFrame, by: tuple[str, ...], l_max: int) -> DataFrame:
    """pattern, L, ``by``, n (windows), scenarios (rows of ``block_rows`` that hold
    one) and spot (the least) of the windows of each chunk of rows, so that equal
    windows of a task are one row; ``by`` may come several times."""
    rows = block_rows.select(*by, "ids", "n", "at")
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema if f.name in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch.column("ids").flatten())
            if size >= _CHUNK:
                yield from counted(pa.Table.from_batches(waiting).combine_chunks())
                waiting, size = [], 0
        if size:
            yield from counted(pa.Table.from_batches(waiting).combine_chunks())

    def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = rows.column("ids").combine_chunks()
        ids, held = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
        row = np.repeat(np.arange(len(held)), held)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(held) - held, held)
        at = rows.column("at").to_numpy()[row] + place
        names = pa.array(np.unique(ids)).cast(pa.string())
        # A number for each group.
        group = np.zeros(len(held), np.int64)
        for c in by:
            codes = rows.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            group = np.unique(group * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
        groups = int(group.max()) + 1
        for length, spots, code, one in _windows(ids, place < rows.column("n").to_numpy()[row], held[row] - place, l_max):
            key = code * groups + group[row[spots]]
            order = np.argsort(key, kind="stable")
            key, spots = key[order], spots[order]
            edge = np.r_[True, key[1:] != key[:-1]]
            first = np.flatnonzero(edge)
            other = edge | np.r_[True, row[spots][1:] != row[spots][:-1]]
            steps = one[spots[first][:, None] + np.arange(length)].ravel()
            texts = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * length), names.take(pa.array(steps)))
            of = pa.array(row[spots[first]])
            yield pa.RecordBatch.from_arrays(
                [
                    pc.binary_join(texts, ","),
                    pa.array(np.full(len(first), length, np.int32)),
                    *(rows.column(c).combine_chunks().take(of) for c, _ in kinds),
                    pa.array(np.diff(np.r_[first, len(spots)])),
                    pa.array(np.add.reduceat(other.astype(np.int64), first)),
                    pa.array(np.minimum.reduceat(at[spots] * SPOT + place[spots], first)),
                ],
                ["pattern", "L", *(c for c, _ in kinds), "n", "scenarios", "spot"],
            )

    fields = ", ".join(f"{c} {t}" for c, t in kinds)
    return rows.mapInArrow(run, f"pattern string, L int, {fields}, n long, scenarios long, spot long")


def by_file(block_rows: DataFrame, l_max: int = L_MAX) -> DataFrame:
    """pattern, L, repo_slug, file_path, n (windows), scenarios that hold one, and
    spot: the windows of ``blocks``, counted within tasks before any shuffle. A file
    that several tasks have comes several times, with other scenarios each."""
    whole = _grouped(block_rows.where("not dealt"), ("repo_slug", "file_path"), l_max)
    # Few: a scenario of several rows counts once.
    parts = _grouped(block_rows.where("dealt"), ("repo_slug", "file_path", "scen"), l_max)
    parts = parts.groupBy("pattern", "L", "repo_slug", "file_path", "scen").agg(F.sum("n").alias("n"), F.lit(1).cast("long").alias("scenarios"), F.min("spot").alias("spot"))
    return whole.unionByName(parts.drop("scen"))


def short_length(block_rows: DataFrame, l_max: int = L_MAX) -> int:
    """The greatest length of which the kinds of steps make no more than ``_HELD``
    patterns: up to it windows are for ``by_file``, beyond it for ``recurring``."""
    kinds = block_rows.select(F.explode(F.array_distinct("ids")).alias("id")).distinct().count()
    return max([n for n in range(L_MIN, l_max + 1) if kinds**n <= _HELD], default=L_MIN)


def _end(steps: np.ndarray, least: bool) -> int:
    """The first or last row in order of ``steps``, which has a row for each place."""
    rows = np.arange(steps.shape[1])
    for place in steps:
        on = place[rows]
        rows = rows[on == (on.min() if least else on.max())]
    return int(rows[0])


def recurring(block_rows: DataFrame, short: int, l_max: int = L_MAX, min_support: int = 2, size: int = _RANGE) -> DataFrame:
    """What ``by_file`` tells of the windows of more than ``short`` steps whose pattern
    has ``min_support`` of them at least, as rows for ``merged``.

    A row of the l_max steps that follow is dealt for each step, over ranges of these
    rows, so equal windows of any length lie side by side: a range has all windows of
    its patterns, but for those of its first and its last row. Windows of these come by
    scenario, with ``scen``, as other ranges may have more of them; a pattern of any
    share of the windows lies in as many ranges as it needs."""
    starts = F.least(F.col("n"), F.size("ids") - short)
    rows = block_rows.where((starts > 0) & F.lit(short < l_max)).select("repo_slug", "file_path", "scen", "ids", "at", starts.alias("_starts"))
    dealt = rows.agg(F.sum("_starts")).first()[0] or 0
    rows = rows.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_starts") - 1)))
    rows = rows.select("repo_slug", "file_path", "scen", F.slice("ids", F.col("_from") + 1, l_max).alias("ids"), ((F.col("at") + F.col("_from")) * SPOT + F.col("_from")).alias("spot"))
    rows = rows.repartitionByRange(max(1, -(-dealt // size)), "ids", "scen", "spot")
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema if f.name in ("repo_slug", "file_path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from counted(pa.Table.from_batches(held).combine_chunks())

    def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = rows.column("ids").combine_chunks()
        known, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        names, left = pa.array(known).cast(pa.string()), pc.list_value_length(lists).to_numpy()
        # Steps by their place; none counts as less than any, as it does in the ranges.
        steps = np.full((l_max, len(left)), -1, np.int64)
        steps[np.arange(len(codes)) - np.repeat(np.cumsum(left) - left, left), np.repeat(np.arange(len(left)), left)] = codes
        ends = [_end(steps, True), _end(steps, False)]
        file = np.zeros(len(left), np.int64)
        for c, _ in kinds:
            codes = rows.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            file = np.unique(file * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
        scen, spot = rows.column("scen").to_numpy(), rows.column("spot").to_numpy()
        _, unit = np.unique(scen, return_inverse=True)
        _, unit = np.unique(file * (int(unit.max()) + 1) + unit, return_inverse=True)  # those of a file together
        units = int(unit.max()) + 1
        spots, code, open_ones = np.arange(len(left)), np.zeros(len(left), np.int64), np.ones((2, len(left)), bool)
        for length in range(1, l_max + 1):
            on = left[spots] >= length
            spots, code, open_ones = spots[on], code[on], open_ones[:, on]
            if not len(spots):
                return
            last = steps[length - 1]
            _, code, n = np.unique(code * len(known) + last[spots], return_inverse=True, return_counts=True)
            open_ones = open_ones & np.stack([last[spots] == last[e] for e in ends])
            if length <= short:
                continue
            # The longer windows of a window without its like have none either.
            on = (n[code] >= min_support) | open_ones.any(axis=0)
            spots, code, open_ones = spots[on], code[on], open_ones[:, on]
            for is_open in (False, True):
                of = open_ones.any(axis=0) == is_open
                if not of.any():
                    continue
                key = code[of] * units + unit[spots[of]]
                order = np.argsort(key, kind="stable")
                key, mine = key[order], spots[of][order]
                other = np.r_[True, key[1:] != key[:-1]]
                same, of_file = key // units, file[mine]
                first = np.flatnonzero(other if is_open else np.r_[True, (same[1:] != same[:-1]) | (of_file[1:] != of_file[:-1])])
                texts = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * length), names.take(pa.array(steps[:length, mine[first]].T.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [
                        pc.binary_join(texts, ","),
                        pa.array(np.full(len(first), length, np.int32)),
                        *(rows.column(c).combine_chunks().take(pa.array(mine[first])) for c, _ in kinds),
                        pa.array(np.diff(np.r_[first, len(mine)])),
                        pa.array(np.add.reduceat(other.astype(np.int64), first)),
                        pa.array(np.minimum.reduceat(spot[mine], first)),
                        pa.array(scen[mine[first]]) if is_open else pa.nulls(len(first), pa.int64()),
                    ],
                    ["pattern", "L", *(c for c, _ in kinds), "n", "scenarios", "spot", "scen"],
                )

    fields = ", ".join(f"{c} {t}" for c, t in kinds)
    return rows.mapInArrow(run, f"pattern string, L int, {fields}, n long, scenarios long, spot long, scen long")


def merged(range_rows: DataFrame) -> DataFrame:
    """The rows of ``by_file``, of those of ``recurring``, to be stored first: what
    several ranges have of a scenario is one."""
    parts = range_rows.where("scen is not null").groupBy("pattern", "L", "repo_slug", "file_path", "scen").agg(F.sum("n").alias("n"), F.min("spot").alias("spot"))
    parts = parts.groupBy("pattern", "L", "repo_slug", "file_path").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("scenarios"), F.min("spot").alias("spot"))
    return range_rows.where("scen is null").drop("scen").unionByName(parts)


def by_scenario(block_rows: DataFrame, l_max: int = L_MAX) -> DataFrame:
    """scen and pattern of the windows of ``blocks``; a pair comes once for each row
    of a dealt scenario that holds it."""
    return _grouped(block_rows, ("scen",), l_max).select("scen", "pattern")


def totals(file_rows: DataFrame, min_support: int = 2) -> DataFrame:
    """What ``counts`` tells, of the rows of ``by_file``: one shuffle of these, by
    pattern and repository, and one of a row for each pattern and repository. The
    place is the least spot."""
    n, low = F.count(F.lit(1)), F.min("spot").alias("spot")
    total = lambda c: F.sum(c).alias(c)
    most = lambda c: F.max(c).alias(c)
    rows = file_rows.select("pattern", "repo_slug", "file_path", F.col("n").alias("support_total"), F.col("scenarios").alias("n_distinct_scenarios"), "spot").repartition("pattern", "repo_slug")
    rows = rows.groupBy("pattern", "repo_slug", "file_path").agg(total("support_total"), total("n_distinct_scenarios"), low)
    within = F.max("n_distinct_scenarios").alias("max_within_file_recurrence")
    rows = rows.groupBy("pattern", "repo_slug").agg(total("support_total"), total("n_distinct_scenarios"), within, n.alias("n_distinct_files"), low).repartition("pattern")
    rows = rows.groupBy("pattern", owner(F.col("repo_slug")).alias("owner")).agg(
        total("support_total"), total("n_distinct_scenarios"), most("max_within_file_recurrence"), total("n_distinct_files"), F.max("n_distinct_files").alias("max_within_repo_files"), n.alias("n_distinct_repos"), low
    )
    rows = rows.groupBy("pattern").agg(total("support_total"), total("n_distinct_scenarios"), most("max_within_file_recurrence"), total("n_distinct_files"), most("max_within_repo_files"), total("n_distinct_repos"), n.alias("n_distinct_orgs"), low)
    return rows.where(F.col("support_total") >= min_support).withColumn("L", F.size(F.split("pattern", ",")))


def ranked(file_rows: DataFrame, block_rows: DataFrame, min_support: int = 2) -> DataFrame:
    """What ``ranking`` tells, of the rows of ``by_file``: the texts are a part of
    the row of ``blocks`` that the first window lies in, so each pattern is joined
    with one row."""
    rows = totals(file_rows, min_support).withColumns({"_place": F.col("spot") % SPOT, "_row": F.floor(F.col("spot") / SPOT) - F.col("spot") % SPOT})
    texts = block_rows.select(F.col("at").alias("_row"), "texts").hint("merge")
    rows = rows.join(texts, "_row").withColumn("canonical_text_seq", F.slice("texts", (F.col("_place") + 1).cast("int"), F.col("L"))).drop("_row", "_place", "spot", "texts")
    return rows.withColumn("has_template_structure", has_quote_pair(F.col("canonical_text_seq")))


def counts(slice_rows: DataFrame, min_support: int = 2) -> DataFrame:
    """Patterns with their support and spread, and ``at``, the number of their
    first window's first step, from one hierarchy of sums: scenario, file,
    repository, owner, pattern. Each level is aggregated before its shuffle, so a
    frequent pattern reaches a task as one row per owner, and all measures are
    numbers, so that all levels aggregate by hash."""
    n, low = F.count(F.lit(1)), F.min("at").alias("at")
    total = lambda c: F.sum(c).alias(c)
    rows = slice_rows.groupBy("pattern", "L", *KEY).agg(n.alias("support_total"), low)
    rows = rows.groupBy("pattern", "L", "repo_slug", "file_path").agg(total("support_total"), n.alias("n_distinct_scenarios"), low)
    within = F.max("n_distinct_scenarios").alias("max_within_file_recurrence")
    rows = rows.groupBy("pattern", "L", "repo_slug").agg(total("support_total"), total("n_distinct_scenarios"), within, n.alias("n_distinct_files"), low)
    # Owner and pattern: the spread over repositories as a maximum and a sum.
    rows = rows.groupBy("pattern", "L", owner(F.col("repo_slug")).alias("owner")).agg(
        total("support_total"), total("n_distinct_scenarios"), F.max("max_within_file_recurrence").alias("max_within_file_recurrence"), total("n_distinct_files"), F.max("n_distinct_files").alias("max_within_repo_files"), n.alias("n_distinct_repos"), low
    )
    rows = rows.groupBy("pattern", "L").agg(
        total("support_total"), total("n_distinct_scenarios"), F.max("max_within_file_recurrence").alias("max_within_file_recurrence"), total("n_distinct_files"), F.max("max_within_repo_files").alias("max_within_repo_files"), total("n_distinct_repos"), n.alias("n_distinct_orgs"), low
    )
    return rows.where(F.col("support_total") >= min_support)


def ranking(slice_rows: DataFrame, numbered_steps: DataFrame, min_support: int = 2) -> DataFrame:
    """``counts`` with the texts of each pattern's first window in order of key
    and position, fetched for recurring patterns alone."""
    rows = counts(slice_rows, min_support)
    spots = rows.select("pattern", F.posexplode(F.sequence(F.col("at"), F.col("at") + F.col("L") - 1)).alias("i", "at"))
    texts = spots.join(numbered_steps.select("at", "text"), "at").groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("t"))
    rows = rows.drop("at").join(texts.select("pattern", F.col("t.text").alias("canonical_text_seq")), "pattern")
    return rows.withColumn("has_template_structure", has_quote_pair(F.col("canonical_text_seq")))


def length_profile(lengths: DataFrame) -> DataFrame:
    """Exact statistics of a column ``n``."""
    marks = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    return lengths.agg(
        F.count(F.lit(1)).alias("scenarios"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("mean_n"), *[F.percentile("n", v).alias(k) for k, v in marks.items()], F.ceil(F.percentile("n", 0.95)).cast("long").alias("recommended_l_max")
    )


def identity_audit(steps: DataFrame) -> DataFrame:
    """Scenario counts and lengths under keys from naive to the one in use."""
    named = steps.where(not_blank(F.col("scenario")))
    front = named.where(~F.col("is_background"))
    clustered = front.where(F.col("cluster_id").isNotNull())
    forms = {
        "A name": steps.groupBy("scenario"),
        "B file and name": steps.groupBy("file_path", "scenario"),
        "C full key, named": named.groupBy(*KEY),
        "D without background": front.groupBy(*KEY),
        "E clustered, two or more": clustered.groupBy(*KEY),
    }
    out = None
    for label, grouped in forms.items():
        rows = grouped.agg(F.count(F.lit(1)).alias("n"))
        rows = rows.where("n >= 2") if label.startswith("E") else rows
        rows = rows.agg(F.lit(label).alias("identity"), F.count(F.lit(1)).alias("scenarios"), F.sum("n").alias("steps"), F.max("n").alias("max_n"), F.percentile("n", 0.95).alias("p95"))
        out = rows if out is None else out.unionByName(rows)
    return out
