"""Approximate figures from mergeable sketches: stored per day, merged without reading the rows again.

For those who ask for them; the exact operators (`ranks`, `profile`) stay the default. Bounds:
a quantile's rank is off by at most `rank_error(k)` of the rows, a distinct count by at most
three times 1.04 / sqrt(2**lg) of itself, each with a chance of about 99 % or more.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

K_RANKS, LG_DISTINCT = 800, 12


def rank_error(k: int = K_RANKS) -> float:
    """The share of rows by which the rank of a quantile from a sketch of size k may be off."""
    return 2.446 / k**0.9433


def distinct_error(lg: int = LG_DISTINCT) -> float:
    return 3 * 1.04 / 2 ** (lg / 2)


def day_sketches(df: DataFrame, at: str | Column, value: str | Column, who: str | Column, k: int = K_RANKS, lg: int = LG_DISTINCT) -> DataFrame:
    """(day, n, ranks, who): the rows of each day, a quantile sketch of `value` and a distinct sketch of `who`.

    Null values and null keys enter no sketch. Sketches are built on the map side and merged,
    so a day of any size sends a few KB a task.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(F.to_date(column(at)).alias("day"), column(value).cast("double").alias("v"), column(who).cast("string").alias("w"))
    return rows.groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", F.lit(k)).alias("ranks"), F.hll_sketch_agg("w", F.lit(lg)).alias("who")
    )


def merged_sketches(sketches: DataFrame, quantiles: Mapping[str, float], period: Column | None = None) -> DataFrame:
    """(period, n, distinct, one column a quantile) of stored day sketches; all days are one period by default."""
    period = F.lit("all") if period is None else period
    merged = sketches.groupBy(period.alias("period")).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("ranks").alias("ranks"), F.hll_union_agg("who").alias("who"))
    found = [F.kll_sketch_get_quantile_double("ranks", F.lit(q)).alias(name) for name, q in quantiles.items()]
    return merged.select("period", "n", F.hll_sketch_estimate("who").alias("distinct"), *found)


def rank_checked(df: DataFrame, at: str | Column, value: str | Column, who: str | Column, merged: DataFrame, quantiles: Mapping[str, float], period: Column) -> DataFrame:
    """(period, n, one boolean a quantile, distinct_close): whether stored sketches keep their bounds on the rows themselves.

    `period` is an expression of the day. A quantile keeps its bound if the share of rows below
    it and the share up to it lie around the wanted rank, `rank_error` aside.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(F.to_date(column(at)).alias("day"), column(value).cast("double").alias("v"), column(who).cast("string").alias("w"))
    rows = rows.select(period.alias("period"), "v", "w").join(F.broadcast(settle(merged)), "period")  # one row a period
    bound = rank_error()
    sums = [F.sum(F.when(test, 1).otherwise(0)).alias(f"{side}_{name}") for name in quantiles for side, test in (("below", F.col("v") < F.col(name)), ("upto", F.col("v") <= F.col(name)))]
    counted = rows.groupBy("period").agg(F.first("n").alias("n"), F.count("v").alias("values"), F.first("distinct").alias("distinct"), F.count_distinct("w").alias("exact"), *sums)
    keeps = [((F.col(f"below_{name}") / F.col("values") <= q + bound) & (F.col(f"upto_{name}") / F.col("values") >= q - bound)).alias(name) for name, q in quantiles.items()]
    close = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * distinct_error())
    return counted.select("period", "n", *keeps, close.alias("distinct_close"))
