"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are processed in slices of about this many bytes, and Arrow batches
#: between the JVM and Python hold about as many at most.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """``df`` itself, once its session's Arrow batches are bounded by
    SLICE_BYTES: the default, 64 MB for each task and direction, is too much
    beside a small heap. Only the size of batches changes, no result."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(name, None)
    if held is None or not held.rstrip("bB").isdigit() or not 0 < int(held.rstrip("bB")) <= SLICE_BYTES:
        conf.set(name, str(SLICE_BYTES))
    return df


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's decimal text, modulo ``folds``."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(folds)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the
    session names none, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage
    and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch of about SLICE_BYTES of ``column`` each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // SLICE_BYTES
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))
    pa.default_memory_pool().release_unused()


def tokens(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (null: none), A-Z lower-cased.

    Returns the words' codes, the offsets of each text's words in them, and the
    distinct words (object array) that the codes index.
    """
    # Copied first: the string kernels misread arrays that start at an offset.
    texts = pa.array(texts.to_pylist(), pa.large_string())
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = np.array(coded.dictionary.to_pylist(), dtype=object)
    offsets = np.r_[0, np.cumsum(lengths)]
    blank = np.flatnonzero(words == "")
    if len(blank):
        keep = codes != blank[0]
        offsets = np.r_[0, np.cumsum(keep)][offsets]
        codes = codes[keep]
        codes = codes - (codes > blank[0])
        words = np.delete(words, blank[0])
    return codes, offsets, words


def hash_words(words: np.ndarray) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    from pandas.util import hash_array

    return hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor, shift and multiply)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def shingle_hashes(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words; a shorter, non-empty text is one window."""
    if not len(hashed):
        return np.zeros(0, np.uint64)
    size = min(size, len(hashed))
    count = len(hashed) - size + 1
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + count])
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, rising: bool = False) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method with step halving;
    the last coefficient is the intercept. ``rising`` keeps the others from
    being negative. One class only: the smoothed prior."""
    total, ones = w.sum(), (w * y).sum()
    beta = np.zeros(x.shape[1] + 1)
    beta[-1] = np.log((ones + 0.5) / (total - ones + 0.5))
    if not len(y) or ones <= 0 or ones >= total:
        return beta
    use = np.ones(x.shape[1], bool)
    while True:
        z = np.c_[x[:, use], np.ones(len(x))]
        penalty = np.r_[np.full(use.sum(), ridge), 0.0]

        def loss(b: np.ndarray, z: np.ndarray = z, penalty: np.ndarray = penalty) -> float:
            v = z @ b
            return (w * (np.logaddexp(0, v) - y * v)).sum() + 0.5 * (penalty * b * b).sum()

        part = np.r_[np.zeros(use.sum()), beta[-1]]
        now = loss(part)
        for _ in range(100):
            p = sigmoid(z @ part)
            grad = z.T @ (w * (p - y)) + penalty * part
            hess = (z * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(penalty + 1e-6)
            step = np.linalg.solve(hess, grad)
            size = 1.0
            while size > 1e-6 and loss(part - size * step) > now:
                size /= 2
            part = part - size * step
            before, now = now, loss(part)
            if before - now < 1e-9 * (1 + abs(now)):
                break
        if not rising or (part[:-1] >= 0).all():
            break
        use[np.flatnonzero(use)[part[:-1] < 0]] = False
    beta[:-1][use] = part[:-1]
    beta[-1] = part[-1]
    return beta


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))
