"""Ranks over whole tables: a range-partitioned sort, written once, with each part's offset added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

IN_PART = 33  # monotonically_increasing_id: the part above, the row's place in it below


def numbered(df: DataFrame, order: list[Column], name: str = "rank", within: list[str] | None = None) -> DataFrame:
    """`df` with 1, 2, 3... in `order`, of all rows or `within` each value of some leading columns.

    The order has to be total, but for wholly equal rows: no key, however common, then has to
    be in one task. No window runs over the rows; only the sizes of the sorted parts, one row
    a part (and value of `within`), are summed up. An empty frame stays empty.
    """
    within = within or []
    sorted_rows = df.orderBy(*within, *order).select("*", F.monotonically_increasing_id().alias("_at"))
    rows = stored(sorted_rows, "ordered").withColumn("_part", F.shiftright("_at", IN_PART))
    parts = rows.groupBy(*within, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in within], F.col("_part").alias("_of"), "_first", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_of")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = rows.join(small(stored(parts, "sorted-parts")), same)
    return out.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))
