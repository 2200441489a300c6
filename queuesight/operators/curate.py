"""Filters of the curation job."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from .columns import find_column, quoted


def language_filter(df: DataFrame, language: str = "en") -> DataFrame:
    """Rows in the language; a frame without a language column is kept whole."""
    name = find_column(df.columns, K.LANGUAGE_COLUMNS)
    return df if name is None else df.where(_is_language(quoted(name).cast("string"), language))


def _is_language(column: Column, language: str) -> Column:
    """Equality without regard to case, as a list of spellings where that is short.

    A list of values reaches the Parquet reader; a function of the column does not. (The
    letter k has a second capital outside ASCII.)
    """
    code = language.lower()
    if code.isascii() and code.isalpha() and len(code) <= 3 and "k" not in code:
        return column.isin(*["".join(s) for s in product(*zip(code, code.upper()))])
    return F.lower(column) == code


def require_rows(df: DataFrame, message: str) -> None:
    if df.isEmpty():
        raise ValueError(message)


def non_empty_text(df: DataFrame, columns: Sequence[str] = ("body", "customer_message", "model_text")) -> DataFrame:
    """Rows where every named text has a non-blank value."""
    keep = F.lit(True)
    for name in columns:
        keep = keep & (F.length(tx.clean_text(quoted(name))) > 0)
    return df.where(keep)


def constant_columns() -> list[Column]:
    """Fixed columns of the curated table."""
    return [F.lit("new").alias("status"), F.lit("dataset").alias("channel")]


def split_leak_check(df: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Per key column, how many of its values occur in more than one split (should be 0).

    Counting works on (value hash, split) pairs, which each task first makes unique, so a
    value that fills much of the table costs no more than any other.
    """
    digests = [F.struct(F.lit(k).alias("key"), F.sha2(quoted(k).cast("string"), 256).alias("digest")) for k in keys]
    # The split as a number keeps the grouping a hash aggregation.
    side = F.xxhash64(split).alias("side")
    pairs = df.select(side, F.explode(F.array(*digests)).alias("d")).select("d.key", "d.digest", "side")
    per_value = (
        pairs.where(F.col("digest").isNotNull())
        .groupBy("key", "digest")
        .agg((F.min("side") != F.max("side")).alias("leaks"))
    )
    return per_value.groupBy("key").agg(
        F.count(F.lit(1)).alias("values"), F.count_if("leaks").alias("leaking_values")
    )
