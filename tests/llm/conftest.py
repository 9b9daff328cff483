"""Texts that every operator must stand."""

import pytest

LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(60_000))


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "x"), (None, "a b c d e f g"), (8, "é ß 漢字 \U0001f600 \x00 z")]
    return spark.createDataFrame([(k, t, 1, 1.0, "r", 7, 8) for k, t in rows], "doc_id long, text string, n_words int, score double, row string, key int, node int")


@pytest.fixture
def none(odd):
    return odd.where("false")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
