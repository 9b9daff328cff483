"""N-gram Jaccard join by a MinHash LSH forest.

Texts with equal sets of word shingles are one node. Each of TREES prefix tries
holds the nodes by a label of MAX_DEPTH MinHash values, as bytes that sort and
whose first values are the label's prefixes. Nodes that share a prefix meet. The
matched prefix starts at the whole label and is shortened until the recall
reaches its target: from how many trees each pair meets in at full depth follows
its similarity, and so the chance that it meets at a lesser depth; after the
exact verification the recall is measured again on the verified similarities,
and the prefixes are shortened further where it is short of the target.

Nodes that share a prefix are linked to the least of them, which gives candidate
components. One that is too large for a task is cut into blocks, and two blocks
come together in a task only if a prefix is in both. There the pairs that met are
verified by exact intersections; where most pairs of two blocks met, one product
of their incidence matrices counts all intersections at once, and pairs that no
tree proposed come with it. No list of pairs is made, and copies are one node.

Defined cases: null keys and null or empty texts have no shingles: they are a
class of their own (null for a null key) without links; a text of fewer than
five words is one shingle; texts of any length are taken whole; a similarity that
ties with the threshold is a link; repeated rows are copies and stay repeated; an
empty table gives no row; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import bounded, hash_words, mix, shingle_hashes, slices, stored, tokens
from stepweave.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, TARGET_RECALL = 20, 8, 0.9999
#: Bytes of a label's value: chance equals are rare, and harmless before verification.
VALUE_BYTES = 2
#: Pairs that meet in fewer trees at full depth are hardly at the threshold.
LEAST_TREES = 2
#: A block of a candidate component has about so many texts and shingles at
#: most, and FINE_TEXTS where that makes no more than FINE_BLOCKS blocks: every
#: block may meet every other one, so more blocks mean more even tasks, but more copies.
BLOCK_TEXTS, BLOCK_SHINGLES = 1000, 500_000
FINE_TEXTS, FINE_BLOCKS = 200, 32
#: Blocks are multiplied where so large a share of their pairs met.
DENSE = 0.05
SALTS = 8


def meeting(similarity: float, depth: int) -> float:
    """The chance that a pair shares a prefix of the depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def depth_for(trees_met: dict[int, int], target: float = TARGET_RECALL) -> int:
    """The longest prefix with the target recall, given how many pairs meet in
    how many trees at full depth. Pairs that met stand for those that did not."""
    pairs = [((k / TREES) ** (1 / MAX_DEPTH), n) for k, n in trees_met.items() if k >= LEAST_TREES]
    total = sum(n / meeting(s, MAX_DEPTH) for s, n in pairs)
    for depth in range(MAX_DEPTH, 1, -1):
        if sum(n * meeting(s, depth) / meeting(s, MAX_DEPTH) for s, n in pairs) >= target * total:
            return depth
    return 1


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    codes, offsets, words = tokens(texts)
    hashed = hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    return [np.unique(shingle_hashes(hashed[a:b], SHINGLE)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _node(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def labels(sets: list[np.ndarray]) -> np.ndarray:
    """Each set's label in each tree, as rows of bytes."""
    rng = np.random.default_rng(20)
    factors = rng.integers(1, 1 << 63, TREES * MAX_DEPTH, dtype=np.uint64) | np.uint64(1)
    out = np.zeros((len(sets), TREES * MAX_DEPTH), ">u2")
    if len(sets):
        flat, starts = np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])[:-1]].astype(np.int64)
        with np.errstate(over="ignore"):
            for i, factor in enumerate(factors):
                out[:, i] = mix(np.minimum.reduceat(flat * factor, starts)) >> np.uint64(48)
    return out.view(np.uint8).reshape(len(sets), TREES * MAX_DEPTH * VALUE_BYTES)


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per text with shingles: key, node, number of shingles, and its labels."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = _sets(batch.column("text"))
                rows = [i for i, s in enumerate(sets) if len(s)]
                sets = [sets[i] for i in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(rows, pa.int64())), pa.array([_node(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([x.tobytes() for x in labels(sets)], pa.binary())],
                    ["key", "node", "n", "label"],
                )

    rows = bounded(docs).where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, node binary, n long, label binary")


def prefixes(depth: int) -> Column:
    """The label's prefix of the depth in each tree."""
    width = MAX_DEPTH * VALUE_BYTES
    return F.array(*[F.substring("label", t * width + 1, depth * VALUE_BYTES) for t in range(TREES)])


def met(nodes: DataFrame, depth: int) -> DataFrame:
    """Pairs (a, b) of a node and the least one with which it shares a prefix of
    the depth in a tree, and in how many trees (``trees``)."""
    leaves = nodes.select("node", F.posexplode(prefixes(depth)).alias("tree", "prefix"))
    heads = leaves.groupBy("tree", "prefix").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    salted = leaves.withColumn("salt", _salt("node"))
    pairs = salted.join(heads.select("*", _salts()), ["tree", "prefix", "salt"]).where("node <> head")
    return pairs.groupBy(F.col("node").alias("a"), F.col("head").alias("b")).agg(F.count(F.lit(1)).alias("trees"))


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def _blocks(texts: Column, shingles: Column) -> Column:
    """Into how many blocks a component of so many texts and shingles is cut."""
    fine = F.least(F.ceil(texts / FINE_TEXTS), F.lit(FINE_BLOCKS))
    return F.greatest(F.ceil(texts / BLOCK_TEXTS), F.ceil(shingles / BLOCK_SHINGLES), fine)


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The shingles that each pair of left and right has in common; of the pairs
    that did not meet (``pairs``) only where all are counted at once."""
    common = np.zeros((len(left), len(right)))
    if pairs.mean() < DENSE:
        for i, j in zip(*np.nonzero(pairs), strict=True):
            a, b = sorted((sets[left[i]], sets[right[j]]), key=len)
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            common[i, j] = (b[at] == a).sum()
        return common
    words, place = np.unique(np.concatenate(sets), return_inverse=True)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    times = np.bincount(place, minlength=len(words))
    shared = np.flatnonzero(times > 1)  # others are in no intersection
    column = np.full(len(words), -1)
    column[shared] = np.arange(len(shared))
    at = column[place]
    who, at = who[at >= 0], at[at >= 0]
    turn = np.argsort(at, kind="stable")
    who, at = who[turn], at[turn]
    step = max(64, min(1 << 23, (8 << 20) // max(1, len(sets))))  # a product's counts stay exact in 24 bits
    for low in range(0, len(shared), step):
        a, b = np.searchsorted(at, [low, low + step])
        held_in = np.zeros((len(sets), min(step, len(shared) - low)), np.float32)
        held_in[who[a:b], at[a:b] - low] = 1
        common += held_in[left] @ held_in[right].T
    return common


def _verified(rows: list[dict], first: int, second: int, threshold: float, depth: int) -> dict[str, list]:
    """Links between the texts of one block, or of two different blocks."""
    rows = sorted(rows, key=lambda r: r["node"])
    nodes, block = [r["node"] for r in rows], np.array([r["block"] for r in rows])
    copies = np.array([r["copies"] for r in rows])
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    label = np.frombuffer(b"".join(r["label"] for r in rows), ">u2").reshape(len(rows), TREES, MAX_DEPTH)[:, :, :depth]
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    sizes = np.array([len(s) for s in sets], np.int64)
    pairs = np.zeros((len(left), len(right)), bool)
    for t in range(TREES):
        _, prefix = np.unique(label[:, t], axis=0, return_inverse=True)
        prefix = prefix.reshape(-1)
        pairs |= prefix[left][:, None] == prefix[right][None, :]
    if first == second:
        np.fill_diagonal(pairs, False)
    common = _common(sets, left, right, pairs)
    joined = sizes[left][:, None] + sizes[right][None, :] - common
    linked = common >= (threshold - 1e-12) * joined  # within a rounding error
    if first == second:
        np.fill_diagonal(linked, False)
    # What the trees proposed, and what that stands for: the recall's measure.
    found = np.minimum((common / np.maximum(joined, 1))[linked & pairs], 1.0)
    stands_for = (1 / np.maximum(1 - (1 - found**depth) ** TREES, 1e-9)).sum() / (2 if first == second else 1)
    links = np.zeros(len(sets), np.int64)
    links[left] += (linked * copies[right][None, :]).sum(axis=1)
    if first != second:
        links[right] += (linked * copies[left][:, None]).sum(axis=0)
    # The least text that each can reach by links of this block.
    root = np.arange(len(sets))
    while True:
        new = root.copy()
        np.minimum.at(new, left, np.where(linked, root[right][None, :], len(sets)).min(axis=1, initial=len(sets)))
        np.minimum.at(new, right, np.where(linked, root[left][:, None], len(sets)).min(axis=0, initial=len(sets)))
        if (new == root).all():
            break
        root = new
    out = np.flatnonzero(links)
    n = len(found) / (2 if first == second else 1)
    return {"node": [nodes[i] for i in out], "links": links[out].tolist(), "root": [nodes[root[i]] for i in out], "found": [n if i == 0 else 0.0 for i in range(len(out))], "stands_for": [float(stands_for) if i == 0 else 0.0 for i in range(len(out))]}


_VERIFIED = "node binary, links long, root binary, found double, stands_for double"


def _verify(threshold: float, depth: int):
    """Over partitions sorted by root, i and j, whose rows of equal ones are one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            got = _verified(held, held[0]["i"], held[0]["j"], threshold, depth)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got.values(), (pa.binary(), pa.int64(), pa.binary(), pa.float64(), pa.float64()), strict=True)], list(got))

        for batch in batches:
            for row in batch.to_pylist():
                if held and any(held[0][c] != row[c] for c in ("root", "i", "j")):
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    return run


def _links(docs: DataFrame, nodes: DataFrame, depth: int, key: str, text: str, threshold: float) -> DataFrame:
    """Per node with links in a pair of blocks: their number, the least node it
    reaches there, and the pairs that the trees proposed and what they stand for."""
    near = stored(met(nodes, depth).select("a", "b"), "forest-met")
    linked = components(near, "forest-candidates")
    members = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    members = members.join(nodes, "node")
    total = members.groupBy("root").agg(_blocks(F.count(F.lit(1)), F.sum("n")).cast("int").alias("blocks"))
    # Joined over salts: a component may hold a large share of all nodes.
    cut = total.where("blocks > 1").select("*", _salts())
    placed = members.withColumn("salt", _salt("node")).join(cut, ["root", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = stored(placed.select("node", "root", "rep", "copies", "blocks", "block", "label"), "forest-members")
    # Blocks of a component that some prefix is in both of; all are with themselves.
    shares = placed.where("blocks > 1").select("root", "block", F.posexplode(prefixes(depth)).alias("tree", "prefix"))
    shares = shares.groupBy("root", "tree", "prefix").agg(F.collect_set("block").alias("held")).where(F.size("held") > 1)
    # As many numbers as a component has blocks at most, not texts.
    other = shares.select("root", F.explode("held").alias("block"), "held").select("root", "block", F.explode("held").alias("other")).distinct()
    own = placed.select("root", "block", F.col("block").alias("other")).distinct()
    pairs = own.unionByName(other).distinct().groupBy("root", "block").agg(F.collect_list("other").alias("others"))
    placed = placed.withColumn("salt", _salt("node")).join(pairs.select("*", _salts()), ["root", "block", "salt"]).drop("salt")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = _sets(batch.column("text"))
                same = [i for i, (s, n) in enumerate(zip(sets, batch.column("node").to_pylist(), strict=True)) if _node(s) == n]
                own = batch.take(pa.array(same, pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column("node"), pa.array([sets[i].tobytes() for i in same], pa.binary())], ["node", "shingles"])

    # Over salts: a key may be that of a large share of all rows.
    wanted = placed.select("rep", "node", _salts())
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("text")).withColumn("salt", _salt("text")).join(wanted.hint("shuffle_hash"), ["rep", "salt"])
    sets = texts.select("node", "text").mapInArrow(spelled, "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    whole = sets.join(placed, "node").withColumn("other", F.explode("others"))
    whole = whole.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "blocks", "copies", "label", "shingles")
    # Groups of a component go to the partitions in turn, which evens them out.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = whole.withColumn("part", F.pmod(F.xxhash64("root") + F.shiftright(F.col("j").cast("long") * (F.col("j") + 1), 1) + F.col("i"), F.lit(parts)).cast("int"))
    dealt = whole.drop("blocks").repartitionById(parts, "part").sortWithinPartitions("root", "i", "j")
    return stored(dealt.mapInArrow(_verify(threshold, depth), _VERIFIED), "forest-verified")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """Key, class_id (the least key of its class) and n_links (other rows of at
    least the threshold's similarity, copies included) of every row."""
    bounded(docs)
    signed = stored(signatures(docs, key, text), "forest-signatures")
    nodes = signed.groupBy("node").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("label").alias("label"))
    nodes = stored(nodes, "forest-nodes")
    # One row for each number of trees.
    depth = depth_for({r["trees"]: r["count"] for r in met(nodes, MAX_DEPTH).groupBy("trees").count().collect()}, target)
    while True:
        verified = _links(docs, nodes, depth, key, text, threshold)
        found, stands_for = verified.agg(F.coalesce(F.sum("found"), F.lit(0.0)), F.coalesce(F.sum("stands_for"), F.lit(0.0))).first()
        if depth == 1 or found >= target * stands_for:
            break
        depth -= 1
    classes = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")), "forest-classes")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    # Only copies and linked nodes differ from their own class without links.
    some = nodes.select("node", "rep", "copies").join(links, "node", "left").where("copies > 1 or links is not null").join(classes, "node", "left")
    some = some.select("node", "rep", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    least = some.groupBy("root").agg(F.min("rep").alias("class_id"))
    some = some.withColumn("salt", _salt("node")).join(least.select("*", _salts()), ["root", "salt"])
    some = stored(some.select("node", "class_id", "n_links"), "forest-classed")
    rows = signed.select("key", "node").withColumn("salt", _salt("key"))
    whole = rows.join(some.select("*", _salts()), ["node", "salt"], "left")
    out = whole.select("key", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    bare = docs.where(F.col(key).isNull() | ~F.coalesce(F.col(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))
    bare = bare.select(F.col(key).alias("key"), F.col(key).alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(bare).withColumnRenamed("key", key)


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of the least key, all columns kept; rows with
    a null key are kept."""
    found = stored(similar(docs, key, text, threshold).where(F.col(key).isNotNull()), "forest-found")
    gone = found.where(F.col(key) != F.col("class_id")).select(F.col(key).alias("_gone"))
    kept = docs.join(gone.hint("shuffle_hash"), docs[key] == F.col("_gone"), "left_anti")
    twice = found.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_twice"))
    if twice.isEmpty():
        return kept
    marked = kept.join(twice, kept[key] == F.col("_twice"), "left")
    once = marked.where("_twice is null").drop("_twice")
    return once.unionByName(marked.where("_twice is not null").drop("_twice").dropDuplicates([key]))
