"""Periodic runs of words: stretches that repeat with a period of q words.

A run is a maximal stretch of consecutive words with smallest period q and at
least max(MIN_LENGTH, MIN_TURNS * q) words. A lag q is worth a scan only if
enough word pairs q apart are equal, so the equal pairs of all lags are counted
first, exactly: a word that is frequent in its text (heavy) by the
autocorrelation of its places, by FFT; the others (light) by the differences of
their places, for all texts of a batch at once. Only the lags whose count
reaches what one run needs are scanned for islands of equal pairs. An island
whose stretch lies in a run of a divisor of q has a smaller period and is left
out: a stretch of two periods p < q, four times as long as q, has their
greatest common divisor as a period too.

Each text is worked on in its own row: nothing is shuffled, whatever a key's
share of the rows. Work and memory follow the length of the text.

Defined cases: null and empty texts have no words, no runs and an empty
collapsed text; texts of any length are read whole; repeated rows stay repeated
and are treated alike; null keys are kept; an empty table gives no row; the
result has its own columns only, so other names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import bounded, slices, tokens

MIN_LENGTH, MIN_TURNS = 6, 4
#: A word of k places among n is heavy if k * k exceeds this times n * log2(n).
HEAVY = 4.0
#: Differences of places that are held before they are counted.
_HELD = 1 << 21


def _needed(lag: np.ndarray) -> np.ndarray:
    """Equal pairs in a row that a run of this period has at least."""
    return np.maximum(MIN_LENGTH, MIN_TURNS * lag) - lag


def lag_counts(codes: np.ndarray, offsets: np.ndarray, heavy: float = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal words at each lag up to n / MIN_TURNS of each text, and
    where each text's lags (from 0) begin."""
    sizes = np.diff(offsets)
    reach = sizes // MIN_TURNS
    base = np.r_[0, np.cumsum(reach + 1)]
    counts = np.zeros(base[-1], np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((codes, text))  # stable: places of a word stay in order
    same = (codes[order][1:] == codes[order][:-1]) & (text[order][1:] == text[order][:-1])
    first = np.flatnonzero(np.r_[True, ~same])[: len(order)]
    times = np.diff(np.r_[first, len(order)])
    n = sizes[text[order[first]]].astype(float)
    is_heavy = times.astype(float) ** 2 > heavy * n * np.log2(n + 1)
    for at, k in zip(first[is_heavy], times[is_heavy], strict=True):
        d = text[order[at]]
        width = 1 << int(sizes[d] + reach[d]).bit_length()
        places = np.zeros(width)
        places[order[at : at + k] - offsets[d]] = 1.0
        spectrum = np.fft.rfft(places)
        counts[base[d] : base[d + 1]] += np.rint(np.fft.irfft(spectrum * spectrum.conj(), width)[: reach[d] + 1]).astype(np.int64)
    left = np.flatnonzero(np.repeat(~is_heavy, times))
    end = np.repeat(first + times, times)
    step, held, size = 0, [], 0
    while len(left):
        step += 1
        left = left[left + step < end[left]]
        apart = order[left + step] - order[left]
        near = apart <= reach[text[order[left]]]  # later places are farther still
        left, apart = left[near], apart[near]
        held.append(base[text[order[left]]] + apart)
        size += len(left)
        if size > _HELD or not len(left):
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, size = [], 0
    return counts, base


def islands(words: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words with period ``lag`` that are
    long enough and that no neighbouring word extends."""
    equal = np.zeros(len(words) - lag + 2, np.int8)
    equal[1:-1] = words[:-lag] == words[lag:]
    edges = np.flatnonzero(equal[1:] != equal[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= _needed(np.int64(lag))
    return starts[long], ends[long] + lag


def runs(codes: np.ndarray, offsets: np.ndarray, heavy: float = HEAVY) -> list[np.ndarray]:
    """Per text the rows (start, length, period) of its runs, by start and period."""
    counts, base = lag_counts(codes, offsets, heavy)
    lag = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
    worth = np.flatnonzero((lag > 0) & (counts >= _needed(lag)))
    of = np.searchsorted(base, worth, side="right") - 1
    out = [np.zeros((0, 3), np.int64)] * (len(offsets) - 1)
    at = 0
    while at < len(worth):
        d = of[at]
        stop = at + np.searchsorted(of[at:], d, side="right")
        words, known, rows = codes[offsets[d] : offsets[d + 1]], {}, []
        for q in lag[worth[at:stop]].tolist():  # ascending
            starts, ends = islands(words, q)
            for p, (s, e) in known.items():
                if q % p == 0 and len(starts):
                    # Runs of one period in order of start are in order of end.
                    before = np.searchsorted(s, starts, side="right") - 1
                    own = (before < 0) | (e[before] < ends)
                    starts, ends = starts[own], ends[own]
            if len(starts):
                known[q] = starts, ends
                rows.append(np.c_[starts, ends - starts, np.full(len(starts), q)])
        if rows:
            found = np.concatenate(rows)
            out[d] = found[np.lexsort((found[:, 2], found[:, 0]))]
        at = stop
    return out


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: not those after a run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: float = HEAVY) -> DataFrame:
    """Key, n_words, runs (start, length and period, by start and period) and
    collapsed, the words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                codes, offsets, words = tokens(batch.column("text"), lower=False)
                found = runs(codes, offsets, heavy)
                texts = []
                for d, rows in enumerate(found):
                    own = codes[offsets[d] : offsets[d + 1]]
                    texts.append(" ".join(words[own[kept(len(own), rows)] if len(rows) else own].tolist()))
                flat = np.concatenate(found)
                members = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in found])].astype(np.int32)), members)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(offsets)), lists, pa.array(texts, pa.string())], ["key", "n_words", "runs", "collapsed"])

    rows = bounded(docs).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(run, f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return made.withColumnRenamed("key", key)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text, with a periodic tail where h = crc32 of the decimal key is
    a multiple of 10: with g = h / 10, word i >= a = g % n becomes word
    a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8). A null key has no crc."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    rows = docs.select(F.col(key), F.col(text).alias("_text"), h.alias("_h"))
    tail = F.col("_h") % 10 == 0
    rows = rows.withColumn("_words", F.when(tail, F.filter(F.split("_text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")))
    rows = rows.withColumns({"_n": F.size("_words").cast("long"), "_g": F.floor(F.col("_h") / 10)})
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    changed = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get("_words", place(i).cast("int")))
    return rows.select(F.col(key), F.when(F.col("_n") > 0, F.array_join(changed, " ")).otherwise(F.col("_text")).alias(text))


def digests(collapsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, n_runs, the greatest run (ties: the first by start, then period) and
    the digests of all runs and of the collapsed text."""
    # The greatest by length, then the least start and period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = collapsed.withColumn("_best", best)
    length, period = F.col("_best.length"), -F.col("_best.period")
    return rows.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
