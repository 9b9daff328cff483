"""Benchmark decontamination by SimHash windows.

Every window of a text that has an item's size gets a 64-bit SimHash of its
shingles. A multi-index finds all items within RADIUS bits: by the pigeonhole
principle one of the four 16-bit blocks differs in at most RADIUS // 4 bits, and
for every block value the items that near are tabled. Each candidate is then
verified by the exact similarity of shingles, weighted by how often they occur:
sum of the lesser over sum of the greater counts. A repeated shingle may outweigh
all others of a fingerprint, so RADIUS holds only for distinct shingles: a window
or item that repeats one is compared exactly wherever the window holds enough of
the item's shingles.

A window without a shingle of an item has the similarity 0 to it, so only
windows that hold one are fingerprinted. Items are taken in blocks of about
BLOCK_SHINGLES or BLOCK_ITEMS, whichever comes first, each sent to the tasks;
more items are more passes.

Defined cases: null and empty texts and items match nothing; an item or text of
fewer words than a shingle is one shingle; a text shorter than an item is one
window; texts of any length are searched whole; items with equal texts match
alike; of windows that tie for an item the first counts; repeated rows give
repeated rows; an empty table of texts or items gives no match; other columns
pass through, and none but key and text is read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import bounded, hash_words, mix, shingle_hashes, slices, tokens

SHINGLE = 5
SIMILARITY = 0.8
#: Texts of distinct shingles and similarity 0.8 differ in 10 bits on average, with a deviation of 3.
#: Beyond RADIUS lie fewer than one in 10,000 of such pairs.
RADIUS = 23
BLOCK_SHINGLES = 200_000
#: The multi-index takes 32 KB an item.
BLOCK_ITEMS = 2000
#: Windows that are fingerprinted and compared at once.
WINDOWS = 16_384
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def simhash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` shingles."""
    bits = np.unpackbits(mix(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    sums = np.cumsum(2 * bits - 1, axis=0)
    sums = np.concatenate([np.zeros((1, 64), np.int32), sums])
    signs = (sums[size:] - sums[:-size]) > 0
    return np.packbits(signs, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def repeats(hashes: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of ``size`` shingles holds one twice."""
    order = np.argsort(hashes, kind="stable")
    again = np.full(len(hashes), len(hashes))
    same = hashes[order[1:]] == hashes[order[:-1]]
    again[order[:-1][same]] = order[1:][same]
    soonest = np.minimum.accumulate(again[::-1])[::-1]  # end of a first repetition from here on
    starts = np.arange(len(hashes) - size + 1)
    return soonest[starts] < np.minimum(starts + size, len(hashes))


def shared_counts(hashes: np.ndarray, size: int, starts: np.ndarray, own: Counter) -> Iterator[tuple[int, int]]:
    """(start, sum of the lesser counts) of the windows at sorted ``starts``,
    each from the one before by the shingles that leave and enter."""
    held: Counter = Counter()
    shared = low = high = 0
    for start in starts.tolist():
        if start >= high:
            held, shared, low, high = Counter(), 0, start, start
        for h in hashes[low:start].tolist():
            held[h] -= 1
            shared -= held[h] < own.get(h, 0)
        for h in hashes[high : start + size].tolist():
            shared += held[h] < own.get(h, 0)
            held[h] += 1
        low, high = start, start + size
        yield start, shared


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _POPCOUNT[(a ^ b).view(np.uint16).reshape(*np.shape(a ^ b), 4)].sum(axis=-1)


class Items:
    """A block of benchmark items, with the multi-index of their fingerprints."""

    def __init__(self, items: Sequence[tuple[int, str]]):
        self.ids, self.shingles, self.counts, self.size, self.width = [], [], [], [], []
        for item, text in items:
            codes, _, words = tokens(pa.array([text], pa.string()))
            if len(codes):
                hashes = shingle_hashes(hash_words(words)[codes], SHINGLE)
                self.ids.append(item)
                self.shingles.append(hashes)
                self.counts.append(Counter(hashes.tolist()))
                self.size.append(len(hashes))
                self.width.append(min(SHINGLE, len(codes)))
        n = len(self.ids)
        self.repeats = np.array([len(c) < m for c, m in zip(self.counts, self.size, strict=True)], bool)
        self.prints = np.array([simhash(h, len(h))[0] for h in self.shingles], np.uint64)
        blocks = self.prints.view(np.uint16).reshape(n, 4)
        every = np.arange(1 << 16, dtype=np.uint16)
        # Per block value a bit for each item, set where the item's block is near.
        self.near = [np.zeros((1 << 16, -(-n // 8)), np.uint8) for _ in range(4)]
        for b, table in enumerate(self.near):
            for i in range(n):
                table[:, i >> 3] |= (_POPCOUNT[every ^ blocks[i, b]] <= RADIUS // 4).astype(np.uint8) << np.uint8(i & 7)
        # Each width's shingles, sorted, with the items that hold them.
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in sorted(set(self.width)):
            own = [i for i in range(n) if self.width[i] == w]
            keys = np.concatenate([np.unique(self.shingles[i]) for i in own])
            whose = np.concatenate([np.full(len(np.unique(self.shingles[i])), i) for i in own])
            order = np.argsort(keys, kind="stable")
            self.by_width[w] = keys[order], whose[order]

    def within_radius(self, prints: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Rows (window, item) of all pairs of the given prints and items within RADIUS."""
        blocks = prints.view(np.uint16).reshape(len(prints), 4)
        near = self.near[0][blocks[:, 0]]
        for b in range(1, 4):
            near = near | self.near[b][blocks[:, b]]
        found = np.unpackbits(near, axis=1, bitorder="little")[:, item].astype(bool)
        window, place = np.nonzero(found)
        close = distance(prints[window], self.prints[item[place]]) <= RADIUS
        return np.c_[window[close], item[place[close]]]

    def matches(self, hashes: np.ndarray, width: int, hits: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window per item of
        one text, given its shingles' hashes and those that items hold."""
        keys, whose = self.by_width[width]
        places: dict[int, list[int]] = {}
        for p in hits.tolist():
            for i in whose[np.searchsorted(keys, hashes[p], "left") : np.searchsorted(keys, hashes[p], "right")].tolist():
                places.setdefault(i, []).append(p)
        by_size: dict[int, list[int]] = {}
        for i in places:
            by_size.setdefault(self.size[i], []).append(i)
        best: dict[int, tuple[float, int, int]] = {}
        for m, items in by_size.items():
            size = min(m, len(hashes))
            last = len(hashes) - size
            starts = np.unique(np.concatenate([np.arange(max(0, p - size + 1), min(last, p) + 1) for i in items for p in places[i]]))
            again = repeats(hashes, size)

            def keep(i: int, start: int, shared: int, size: int = size) -> None:
                similarity = shared / (size + self.size[i] - shared)
                if similarity >= SIMILARITY - 1e-12 and (similarity, -start) > best.get(i, (0.0, 0))[:2]:
                    best[i] = similarity, -start, size + width - 1

            # The least shared count of the similarity; none has more than the item's shingles in the window.
            least = (SIMILARITY - 1e-9) / (1 + SIMILARITY) * (size + m)
            for i in items:
                at = np.array(places[i])
                own = starts if self.repeats[i] else starts[again[starts]]
                own = own[(np.searchsorted(at, own + size) - np.searchsorted(at, own)) >= least]
                for start, shared in shared_counts(hashes, size, own, self.counts[i]):
                    keep(i, start, shared)
            plain = np.array([i for i in items if not self.repeats[i]], int)
            cuts = np.flatnonzero((np.diff(starts) > 1) | (np.arange(1, len(starts)) % WINDOWS == 0)) + 1
            for run in np.split(starts, cuts) if len(plain) else ():
                prints = simhash(hashes[run[0] : run[-1] + size], size)
                fresh = np.flatnonzero(~again[run])
                for window, i in self.within_radius(prints[fresh], plain).tolist():
                    start = int(run[fresh[window]])
                    keep(i, start, sum((Counter(hashes[start : start + size].tolist()) & self.counts[i]).values()))
        return [(self.ids[i], v, -start, n) for i, (v, start, n) in sorted(best.items())]

    def search(self, texts: pa.Array) -> Iterator[tuple[int, tuple[int, float, int, int]]]:
        """(row, match) of all texts of a batch."""
        codes, offsets, words = tokens(texts)
        hashed = hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)
        for width, (keys, _) in self.by_width.items():
            if len(hashed) < width:
                continue
            all_shingles = shingle_hashes(hashed, width)
            at = np.minimum(np.searchsorted(keys, all_shingles), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == all_shingles)
            row = np.searchsorted(offsets, hit, "right") - 1
            inside = hit + width <= offsets[row + 1]
            hit, row = hit[inside], row[inside]
            for r in np.unique(row).tolist():
                a, b = offsets[r], offsets[r + 1]
                for match in self.matches(all_shingles[a : b - width + 1], width, hit[row == r] - a):
                    yield r, match


@lru_cache(maxsize=1)
def _items(block: tuple[tuple[int, str], ...]) -> Items:
    """One per Python worker, while its tasks work on the same block."""
    return Items(block)


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[tuple[int, str], ...]]:
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text is not null")
    size, items = rows.agg(F.coalesce(F.sum(F.size(F.split("text", "\\s+"))), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, math.ceil(size / BLOCK_SHINGLES), math.ceil(items / BLOCK_ITEMS))
    cut = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for b in range(blocks):
        yield tuple((r["item"], r["text"]) for r in rows.where(cut == b).orderBy("item", "text").collect())


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Key, item, similarity, first_word and n_words of the best window of each
    text and item that are similar."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    rows = bounded(docs).select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = None
    for block in _blocks(benchmark, item, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = _items(block)
            for whole in batches:
                for batch in slices(whole):
                    got = list(items.search(batch.column("text")))
                    ids = batch.column("key").take(pa.array([r for r, _ in got], pa.int64()))
                    columns = list(zip(*(m for _, m in got), strict=True)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([ids, pa.array(columns[0], item_type), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.float64(), pa.int64(), pa.int64()), strict=True))], ["key", "item", "similarity", "first_word", "n_words"])

        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(benchmark.schema[item].dataType)
        part = rows.mapInArrow(run, f"key {kind}, item {item_kind}, similarity double, first_word long, n_words long")
        found = part if found is None else found.unionByName(part)
    return found.withColumnsRenamed({"key": key, "item": item})


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text matches no item, all columns kept."""
    for block in _blocks(benchmark, item, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = _items(block)
            for whole in batches:
                for batch in slices(whole, text):
                    dirty = {r for r, _ in items.search(batch.column(text))}
                    yield batch.filter(pa.array([r not in dirty for r in range(batch.num_rows)], pa.bool_()))

        docs = bounded(docs).mapInArrow(run, docs.schema)
    return docs
