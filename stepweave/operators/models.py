"""Classifiers of patterns on histogram boosting, and reduced clusters."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.operators import boosting, sampling

#: What the classifiers read of a pattern, and the classes in order.
FEATURES = "L support_total n_distinct_repos n_distinct_orgs n_distinct_files max_within_file_recurrence max_within_repo_files outlier_fraction has_template scope_RQ1 scope_RQ2 scope_RQ3 ratio_within_file ratio_within_repo ratio_orgs".split()
MECHANISMS = ["background", "reusable_scenario", "shared_higher_level_step"]
ROUNDS, DEPTH, FOLDS = boosting.ROUNDS, boosting.DEPTH, 5


def extraction(labelled: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, folds: int = FOLDS, key: str = "pattern", label: str = "label", seed: int = 42) -> tuple[DataFrame, boosting.Model]:
    """The labelled rows with their fold and p, the probability of label 1 out of
    fold, and the models: one without each fold, one of all rows."""
    cut_rows = sampling.folds(labelled, label, key, folds, seed)
    model = boosting.fit(cut_rows, FEATURES, label, folds=folds, rounds=rounds, depth=depth)
    return boosting.scored(cut_rows, model, "fold").withColumn("pred", (F.col("p") >= 0.5).cast("int")), model


def mechanisms(labelled: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, folds: int = FOLDS, key: str = "pattern", label: str = "mechanism", seed: int = 42) -> tuple[DataFrame, boosting.Model]:
    """Rows labelled with one of MECHANISMS (others are left out) with their fold
    and ``predicted`` out of fold, and the models."""
    index = F.array_position(F.array(*map(F.lit, MECHANISMS)), F.col(label)) - 1
    rows = sampling.folds(labelled.where(F.col(label).isin(MECHANISMS)), label, key, folds, seed).withColumn("_label", index.cast("int"))
    model = boosting.fit(rows, FEATURES, "_label", folds=folds, classes=len(MECHANISMS), rounds=rounds, depth=depth)
    return named(boosting.scored(rows.drop("_label"), model, "fold")), model


def named(scored: DataFrame) -> DataFrame:
    """``predicted``, the mechanism of the greatest probability, the first of equals."""
    return scored.withColumn("predicted", F.element_at(F.array(*map(F.lit, MECHANISMS)), F.array_position("p", F.array_max("p")).cast("int")))


def importances(spark_rows: DataFrame, model: boosting.Model) -> DataFrame:
    """Features of importance above 0, the greatest first."""
    found = sorted(((f, v) for f, v in model.importances().items() if v > 0), key=lambda x: (-x[1], x[0]))
    return spark_rows.sparkSession.createDataFrame(found, "feature string, importance double")


def reduced_clusters(vectors: DataFrame, components: int = 50, clusters: int = 10, key: str = "vec_id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """Principal components and k-means, beside the layout by ``neighbours`` and
    the clusters of ``hierarchy``."""
    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    pca = PCA(k=components, inputCol="raw", outputCol="features")
    model = Pipeline(stages=[pca, KMeans(k=clusters, seed=seed, featuresCol="features", predictionCol="cluster_id")]).fit(rows)
    return model.transform(rows).select(key, "cluster_id")
