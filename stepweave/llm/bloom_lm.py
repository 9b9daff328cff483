"""Language-model scoring with a log-frequency Bloom filter.

Counts of word pairs and triples of the training texts are quantised on a
logarithmic scale; an n-gram of level q enters the filter q times, as level 1 to
q, and a look-up probes levels until one is missing. Probabilities are smoothed
twice: a triple's by the pair's, a pair's by the word's own.

The filter holds every n-gram of the corpus, so it grows with it (about 2 bytes
for each distinct n-gram) and has no bound below which it could be broadcast. It
is cut into hash ranges, as many as the bytes of text call for; a range's part is
built and probed in one task, and the n-grams that a slice of texts asks for
travel to it: each once a slice, with its count in the slice's training texts,
so that counting and asking take one shuffle. Counts of words are exact and
answered alike. Nothing depends on the number of partitions, and no size brings
a rule of its own.

A quantised count is the least of its level, and a context counts as the most of
its level, so the probabilities of a context sum to at most 1 (but for the
filter's false hits, about one n-gram in a hundred). Counts up to 4 are exact.

Defined cases: a null or empty text has the end token only; texts of any length
are scored whole; repeated rows give repeated rows, with equal scores in whatever
task; tied counts are one level; an empty table gives no row; with no training
text all counts are 0 and each token's probability is 1; further columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import bounded, hash_words, mix, stored, tokens

#: Bytes of text in a slice, and of text whose n-grams one hash range holds.
SLICE_BYTES, RANGE_BYTES = 4 << 20, 8 << 20
PROBES, BITS_PER_ENTRY = 6, 10
#: Weight of the lower order, in counts: a word's own probability weighs
#: PAIR_WEIGHT times this power of the context's count, a pair's TRIPLE_WEIGHT.
PAIR_WEIGHT, PAIR_POWER, TRIPLE_WEIGHT = 16.0, 0.8, 10.0
#: The least count of each level: powers of the square root of 2, rounded up.
LEVELS = np.unique(np.ceil(2.0 ** (np.arange(126) / 2) - 1e-9).astype(np.int64))
_END = np.uint64(0x1F83D9ABFB41BD6B)
_START = np.uint64(0x5BE0CD19137E2179)
WORDS, PAIRS, TRIPLES = 1, 2, 3


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of an array, compressed: sorted hashes and counts shrink well."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def _sorted_pack(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _sorted_unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def level(counts: np.ndarray) -> np.ndarray:
    """The level of each count; 0 for none."""
    return np.searchsorted(LEVELS, counts, "right")


def least(levels: np.ndarray) -> np.ndarray:
    """The least count of each level; 0 for level 0."""
    return np.r_[0, LEVELS][levels].astype(np.float64)


def most(levels: np.ndarray) -> np.ndarray:
    """The greatest count of each level."""
    return np.r_[0, LEVELS[1:] - 1, LEVELS[-1]][levels].astype(np.float64)


class Filter:
    """One hash range of the log-frequency Bloom filter."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY):
        """Of distinct keys and their levels, 1 at least."""
        self.size = max(64, int(levels.sum()) * bits_per_entry)
        self.bits = np.zeros(self.size, bool)
        for q in range(1, int(levels.max(initial=0)) + 1):
            own = keys[levels >= q]
            for at in self._spots(own, q):
                self.bits[at] = True

    def _spots(self, keys: np.ndarray, q: int) -> Iterator[np.ndarray]:
        """The bits of each key at a level."""
        with np.errstate(over="ignore"):
            h = mix(keys + np.uint64(q) * np.uint64(0xD1B54A32D192ED03))
            step = mix(h) | np.uint64(1)
            for _ in range(PROBES):
                yield h % np.uint64(self.size)
                h = h + step

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels by repeated membership probes, from level 1 until one is missing."""
        found = np.zeros(len(keys), np.int64)
        left, q = np.arange(len(keys)), 1
        while len(left):
            hit = np.ones(len(left), bool)
            for at in self._spots(keys[left], q):
                hit &= self.bits[at]
            left = left[hit]
            found[left] = q
            q += 1
        return found


def _shifted(codes: np.ndarray, offsets: np.ndarray, start: int) -> np.ndarray:
    """The code before each token; ``start`` before a text's first."""
    before = np.r_[start, codes[:-1]]
    before[offsets[:-1]] = start
    return before


def _ngrams(hashes: np.ndarray, codes: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the hash of its pair, and of its triple (a text's first
    token has no triple: its hash is that of another pair's kind, never asked)."""
    known = np.r_[hashes, _START]
    one = _shifted(codes, offsets, len(hashes))
    two = _shifted(one, offsets, len(hashes))
    with np.errstate(over="ignore"):
        pair = mix(known[one] * np.uint64(0x9E3779B97F4A7C15) + known[codes])
        triple = mix(known[two] * np.uint64(0xC2B2AE3D27D4EB4F) + pair)
    return pair >> np.uint64(64 - bits), triple >> np.uint64(64 - bits)


def _distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (below 2 ** 63) and how often each is in training."""
    both = np.sort((keys << np.uint64(1)) | train.astype(np.uint64))
    keys, flags = both >> np.uint64(1), (both & np.uint64(1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(flags, first)


def sliced(rows: DataFrame, key_type: str) -> DataFrame:
    """Slices of the rows ``key``, ``text``, ``held_out``: their keys, and their
    tokens as codes of sorted word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def slice_of(batch: pa.Table) -> pa.RecordBatch:
            nonlocal number
            codes, offsets, words = tokens(batch.column("text").combine_chunks())
            hashes = np.r_[hash_words(words), _END]
            codes, offsets = np.insert(codes, offsets[1:], len(words)), offsets + np.arange(len(offsets))
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            number += 1
            columns = {
                "slice": pa.array([number - 1], pa.int64()),
                "keys": pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("key").combine_chunks()),
                "held": pa.array([batch.column("held_out").to_pylist()], pa.list_(pa.bool_())),
                "sizes": pa.array([_pack(np.diff(offsets).astype(np.int32))], pa.binary()),
                "hashes": pa.array([_sorted_pack(hashes[order])], pa.binary()),
                "codes": pa.array([_pack(rank[codes].astype(np.int32))], pa.binary()),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for batch in batches:
            step = 1024
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                held.append(part)
                size += part.column("text").nbytes
                if size >= SLICE_BYTES:
                    yield slice_of(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield slice_of(pa.Table.from_batches(held))
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, f"slice long, keys array<{key_type}>, held array<boolean>, sizes binary, hashes binary, codes binary")


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted word hashes, codes, offsets, and whether each token is in training."""
    sizes = _unpack(row["sizes"], np.int32).astype(np.int64)
    held = np.array(row["held"], bool)
    return _sorted_unpack(row["hashes"]), _unpack(row["codes"], np.int32).astype(np.int64), np.r_[0, np.cumsum(sizes)], np.repeat(~held, sizes)


def asked(slices: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """What each slice asks for: per kind and hash range the sorted distinct
    keys, and their counts in the slice's training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["slice", "held", "sizes", "hashes", "codes"]).to_pylist():
                hashes, codes, offsets, train = _opened(row)
                pair, triple = _ngrams(hashes, codes, offsets, bits)
                inner = np.ones(len(codes), bool)
                inner[offsets[:-1]] = False
                kinds = {WORDS: (hashes, np.bincount(codes, train, len(hashes)).astype(np.int64), 64), PAIRS: (*_distinct(pair, train), bits), TRIPLES: (*_distinct(triple[inner], train[inner]), bits) if inner.any() else (triple[:0], codes[:0], bits)}
                out = []
                for kind, (keys, counts, width) in kinds.items():
                    where = (keys >> np.uint64(width - range_bits)).astype(np.int64) if range_bits else np.zeros(len(keys), np.int64)
                    cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else np.zeros(0, np.int64)
                    for i, j in zip(cuts, np.r_[cuts[1:], len(keys)], strict=False):  # no keys, no cuts
                        out.append((row["slice"], kind, int(where[i]), _sorted_pack(keys[i:j]), _pack(counts[i:j].astype(np.int32 if counts[i:j].max() < 1 << 31 else np.int64))))
                for at in range(0, len(out), 4096):
                    part = list(zip(*out[at : at + 4096], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["slice", "kind", "range", "keys", "counts"])

    return slices.mapInArrow(run, "slice long, kind int, range long, keys binary, counts binary")


def answered(asks: DataFrame, bits_per_entry: int) -> DataFrame:
    """Per slice, kind and range the answers in the order of its keys: exact
    counts of words, levels of pairs and triples by probes of the range's part of
    the filter. A row without a slice holds a range's training tokens and
    distinct words."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        slices, keys, counts = [], [], []
        for s, k, c in zip(*(table.column(x).to_pylist() for x in ("slice", "keys", "counts")), strict=True):
            own = _sorted_unpack(k)
            packed = _unpack(c, np.uint8)
            width = len(packed) // max(1, len(own))
            slices.append(s)
            keys.append(own)
            counts.append(_unpack(c, np.int32 if width == 4 else np.int64).astype(np.int64))
        every = np.concatenate(keys)
        found, place = np.unique(every, return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)
        tokens_in, distinct = (int(total.sum()), int((total > 0).sum())) if kind == WORDS else (0, 0)
        if kind == WORDS:
            answers = total
        else:
            seen = total > 0
            answers = Filter(found[seen], level(total[seen]), bits_per_entry).levels(found).astype(np.uint8)
        ends = np.cumsum([len(k) for k in keys])
        told = [_pack(answers[place[j - len(k) : j]]) for k, j in zip(keys, ends, strict=True)]
        n = len(slices)
        return pa.table({
            "slice": pa.array([*slices, None], pa.int64()), "kind": pa.array([kind] * (n + 1), pa.int32()), "range": pa.array([key[1].as_py()] * (n + 1), pa.int64()),
            "answers": pa.array([*told, None], pa.binary()), "tokens": pa.array([None] * n + [tokens_in], pa.int64()), "distinct": pa.array([None] * n + [distinct], pa.int64()),
        })

    return asks.groupBy("kind", "range").applyInArrow(run, "slice long, kind int, range long, answers binary, tokens long, distinct long")


def probabilities(words: np.ndarray, seen: np.ndarray, pairs: np.ndarray, triples: np.ndarray, first: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 of each token's probability, from the exact counts of the words and
    of the words before them, and the levels of pairs and triples."""
    prior = (words + 0.5) / (n + 0.5 * (v + 1))
    weight = PAIR_WEIGHT * np.maximum(seen, 1.0) ** PAIR_POWER
    by_pair = (np.minimum(least(pairs), seen) + weight * prior) / (seen + weight)
    context = np.where(first, 0.0, most(np.r_[0, pairs[:-1]]))
    by_triple = (np.minimum(np.where(first, 0.0, least(triples)), context) + TRIPLE_WEIGHT * by_pair) / (context + TRIPLE_WEIGHT)
    return np.log10(np.where(first, by_pair, by_triple))


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", bits_per_entry: int = BITS_PER_ENTRY, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Key, held_out, n_tokens, n_known, train_tokens, base_score and score of
    every row; rows that are held out do not train."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    rows = bounded(docs).select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    range_bits = max(0, math.ceil(math.log2(max(1, size) / range_bytes)))
    # Two n-grams of a corpus have equal hashes in less than one case of 2 ** 18.
    bits = min(62, 18 + max(8, size.bit_length()))
    slices = stored(sliced(rows, kind.simpleString()), "lm-slices")
    answers = stored(answered(asked(slices, bits, range_bits), bits_per_entry), "lm-answers")
    n, v = answers.where("slice is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    key_type = to_arrow_type(kind)

    def finished(_: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        got: dict[int, list[np.ndarray]] = {WORDS: [np.zeros(0, np.int64)], PAIRS: [np.zeros(0, np.uint8)], TRIPLES: [np.zeros(0, np.uint8)]}
        for r in sorted(told.select(["kind", "range", "answers"]).to_pylist(), key=lambda r: (r["kind"], r["range"])):
            got[r["kind"]].append(_unpack(r["answers"], np.int64 if r["kind"] == WORDS else np.uint8))
        row = own.select(["held", "sizes", "hashes", "codes"]).to_pylist()[0]
        hashes, codes, offsets, _train = _opened(row)
        first = np.zeros(len(codes), bool)
        first[offsets[:-1]] = True
        counts = np.concatenate(got[WORDS])
        pair, triple = _ngrams(hashes, codes, offsets, bits)
        pairs = np.concatenate(got[PAIRS]).astype(np.int64)[np.unique(pair, return_inverse=True)[1]]
        triples = np.zeros(len(codes), np.int64)
        if len(codes) > len(offsets) - 1:
            triples[~first] = np.concatenate(got[TRIPLES]).astype(np.int64)[np.unique(triple[~first], return_inverse=True)[1]]
        ends = int(counts[np.searchsorted(hashes, _END)])  # as many starts as ends
        before = np.r_[counts, ends][_shifted(codes, offsets, len(hashes))].astype(np.float64)
        model = probabilities(counts[codes], before, pairs, triples, first, n, v)
        base = (np.log10(counts + 0.5) - math.log10(n + 0.5 * (v + 1)))[codes]
        of = offsets[:-1]
        keys = own.column("keys").combine_chunks()
        keys = (keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys).flatten()
        return pa.table({
            "key": keys.cast(key_type), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(np.diff(offsets)), "n_known": pa.array(np.add.reduceat((counts > 0)[codes].astype(np.int64), of)),
            "base_score": pa.array(np.add.reduceat(base, of)), "score": pa.array(np.add.reduceat(model, of)),
        })

    told = answers.where("slice is not null").select("slice", "kind", "range", "answers")
    out = slices.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(finished, f"key {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
