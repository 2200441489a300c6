"""Checks on frames and on records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.labels import valid_probabilities
from .columns import find_column, quoted


def other_languages(df: DataFrame, language: str = "en") -> DataFrame:
    """(language, n): rows in any other language, lower-cased."""
    name = find_column(df.columns, K.LANGUAGE_COLUMNS)
    found = F.lower(quoted(name).cast("string"))
    return df.where(found != language).groupBy(found.alias("language")).agg(F.count(F.lit(1)).alias("n"))


def require_language(df: DataFrame, language: str = "en") -> None:
    """Raise when a row in another language is left; the languages are named."""
    if find_column(df.columns, K.LANGUAGE_COLUMNS) is None:
        return
    rows = other_languages(df, language).orderBy("language").collect()
    if rows:
        raise ValueError(f"rows in other languages remain: {[r['language'] for r in rows]}")


def require_labels(columns: Sequence[str]) -> None:
    """Raise when a source has neither a category nor a priority column."""
    if not find_column(columns, K.SOURCE_CATEGORY_COLUMNS) and not find_column(columns, K.SOURCE_PRIORITY_COLUMNS):
        raise ValueError("neither a category nor a priority can be made from the source columns")


def prediction_errors(df: DataFrame, labels: Sequence[str] = K.QUEUES, decisions: Sequence[str] = K.DECISIONS) -> Column:
    """Array of what is wrong with a routing record; empty when it keeps the contract.

    Checks the columns the frame has: queue, decision, confidence and threshold in [0, 1],
    probabilities over exactly the labels, latency not negative, subject and body not empty.
    """
    none = F.lit(None).cast("string")
    checks: list[Column] = []

    def fail(name: str, ok: Column) -> None:
        if name in df.columns:
            checks.append(F.when(F.coalesce(ok, F.lit(False)), none).otherwise(F.lit(name)))

    fail("predicted_queue", F.col("predicted_queue").isin(*labels))
    fail("decision", F.col("decision").isin(*decisions))
    for name in ("confidence", "threshold"):
        fail(name, (F.col(name) >= 0.0) & (F.col(name) <= 1.0))
    fail("probabilities", valid_probabilities(F.col("probabilities"), labels))
    fail("latency_ms", F.col("latency_ms") >= 0)
    for name in ("subject", "body"):
        fail(name, F.length(name) >= 1)
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def check_predictions(df: DataFrame, **options) -> DataFrame:
    """Add `errors`; valid rows have an empty array."""
    return df.withColumn("errors", prediction_errors(df, **options))


def split_valid(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the contract, and the others with their errors."""
    checked = check_predictions(df, **options)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
