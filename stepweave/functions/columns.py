"""Column functions of the step-sequence operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds (inclusive) and names of the buckets.
LENGTH_BUCKETS = [(2, 3, "2-3"), (4, 5, "4-5"), (6, 8, "6-8"), (9, 12, "9-12"), (13, 18, "13-18")]
SUPPORT_BUCKETS = [(2, 5, "2-5"), (6, 20, "6-20"), (21, 100, "21-100"), (101, None, ">100")]
#: The mechanism that each scope stands for.
MECHANISMS = {"RQ3": "shared_higher_level_step", "RQ2": "reusable_scenario", "RQ1": "background"}
_CUE = r'(?U)"\w+"\s+"\w+"'
_PLACEHOLDER = r"(?U)<\w+(-\w+)*>"


def not_blank(text: Column) -> Column:
    """Not null, and more than white space (Unicode)."""
    return text.isNotNull() & F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def owner(repo: Column) -> Column:
    return F.substring_index(repo, "_", 1)


def bucket(value: Column, bounds: list[tuple[int, int | None, str]]) -> Column:
    """The bucket's name; an error for a value outside all buckets."""
    out = F.raise_error(F.concat(F.lit("outside all buckets: "), value.cast("string"))).cast("string")
    for low, high, name in reversed(bounds):
        out = F.when((value >= low) & (value <= high) if high else value >= low, F.lit(name)).otherwise(out)
    return out


def scope(cross: Column, repo_files: Column, within_file: Column) -> Column:
    """RQ3 before RQ2 before RQ1; ``cross`` counts repositories or owners."""
    return F.when(cross >= 2, "RQ3").when(repo_files >= 2, "RQ2").when(within_file >= 2, "RQ1").otherwise("noscope")


def has_quote_pair(texts: Column) -> Column:
    return F.coalesce(F.exists(texts, lambda t: t.rlike(_CUE)), F.lit(False))


def has_placeholder(texts: Column) -> Column:
    return F.coalesce(F.exists(texts, lambda t: t.rlike(_PLACEHOLDER)), F.lit(False))


def guarded_ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def mechanism_of(scope_column: Column) -> Column:
    out = F.lit("none")
    for name, value in MECHANISMS.items():
        out = F.when(scope_column == name, value).otherwise(out)
    return out
