"""Vectors of patterns from those of their clusters, and summaries of clusters."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.sources.tables import cut
from stepweave.sources.versions import Stages


def embed(texts: DataFrame, model: Callable[[list[str]], np.ndarray], key: str, text: str = "text") -> DataFrame:
    """Each row's vector from an embedding model that is called in the tasks, a
    batch at a time; a null text is embedded as an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            vectors = model(rows["text"].fillna("").tolist())
            yield pd.DataFrame({"key": rows["key"], "vector": [np.asarray(v, np.float32) for v in vectors]})

    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, vector array<float>").withColumnRenamed("key", key)


def hashed_words(texts: list[str], size: int = 64) -> np.ndarray:
    """The default model: counts of words by their CRC, which also gives the sign,
    of length 1; a text without words is the zero vector."""
    out = np.zeros((len(texts), size), np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            code = zlib.crc32(word.encode())
            row[code % size] += 1 if code >> 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def cached(texts: DataFrame, model: Callable[[list[str]], np.ndarray], stages: Stages, key: str, text: str = "text", name: str = "vectors") -> DataFrame:
    """Key and vector of each row. Vectors are kept by the SHA-256 of their text in
    a stage table; only texts that it lacks go to the model, one row of each, and
    what comes is a new version of it."""
    rows = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("content", F.sha2("text", 256))
    missing = rows.select("content", "text").dropDuplicates(["content"])
    if stages.exists(name):
        missing = missing.join(stages.read(name), "content", "left_anti")
    made = cut(embed(missing, model, "content"))
    if not stages.exists(name):
        held = stages.write(name, made)
    else:
        held = stages.read(name) if made.isEmpty() else stages.write(name, stages.read(name).unionByName(made))
    return rows.join(held, "content").select(F.col("key").alias(key), "vector")


def pooled(patterns: DataFrame, vectors: DataFrame, salts: int = 8) -> DataFrame:
    """(pattern, pos, value): the mean of the vectors (cluster_id, vector) of a
    pattern's ids. Repeated ids weigh as often as they occur, ids without a
    vector are left out, and a pattern without any is the zero vector. Vectors
    stay arrays until they are summed; a cluster that many patterns have is met
    over salts."""
    ids = patterns.select("pattern", F.explode(F.split("pattern", ",").cast("array<int>")).alias("cluster_id"))
    weights = ids.groupBy("pattern", "cluster_id").agg(F.count(F.lit(1)).alias("w")).withColumn("salt", F.pmod(F.xxhash64("pattern"), F.lit(salts)).cast("int"))
    size = (vectors.agg(F.max(F.size("vector"))).first()[0]) or 0
    spread = vectors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sums = [F.sum(F.col("w") * F.get("vector", F.lit(i)).cast("double")).alias(f"v{i}") for i in range(size)]
    met = weights.join(spread, ["cluster_id", "salt"]).groupBy("pattern").agg(F.sum("w").alias("w"), *sums)
    known = patterns.select("pattern").distinct().join(met, "pattern", "left")
    means = F.array(*[F.coalesce(F.col(f"v{i}") / F.col("w"), F.lit(0.0)) for i in range(size)]).cast("array<double>")
    return known.select("pattern", F.posexplode(means).alias("pos", "value"))


def cluster_summary(rows: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Clusters, noise (cluster -1) and the sizes of the clusters."""
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    real = F.when(F.col(cluster) >= 0, F.col("n"))
    noise = F.coalesce(F.sum(F.when(F.col(cluster) < 0, F.col("n"))), F.lit(0))
    return sizes.agg(
        F.count(real).alias("n_clusters"), noise.alias("n_noise"), (noise / F.greatest(F.sum("n"), F.lit(1))).alias("noise_fraction"),
        F.min(real).alias("size_min"), F.percentile(real, 0.5).alias("size_median"), F.percentile(real, 0.95).alias("size_p95"), F.max(real).alias("size_max"),
    )
