"""Exact order statistics and exact-size cuts without a global sort.

A global `row_number` would send every row through one task. These operators count
first and sort only what lies next to the wanted rank:

* `order_statistics`: values are counted, the counts are summed by doublings of the value,
  the doubling that holds the wanted rank is summed into value ranges, and only the distinct
  values inside the range that holds it are put in order.
* `hash_thresholds`: rows get a fixed pseudo-random order by md5; the n-th hash is found
  from a histogram of hash prefixes and the rows of a single prefix. A cut is then the
  row-local test `hash <= threshold`, so no wide row is ever shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_checked, settle
from .ordinals import with_ordinal

# Ranges per doubling of |value|: about 1e-5 relative width. A running sum sees the some
# thousand doublings that doubles have, then the ranges of one of them.
_OCTAVE_BITS = 16
_RANGES_PER_OCTAVE = 1 << _OCTAVE_BITS


def _value_range(value: Column) -> Column:
    """A non-decreasing function of the value with boundedly many results.

    Never null, so the join on it adds no null test below the counting and both of its
    uses read the same shuffled counts.
    """
    magnitude = F.floor(F.log2(1 + F.abs(value)) * _RANGES_PER_OCTAVE)
    return F.coalesce(F.when(value < 0, -magnitude).otherwise(magnitude), F.lit(0).cast("long"))


def value_counts_of(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values of a column as double with their row counts (null and NaN left out).

    Only a floating column is tested for NaN: the test sinks into the scan, where a computed
    whole number, such as a token count, would be worked out a second time for it.
    """
    shaped = df.select(*by, F.col(value).alias("value")).where(F.col("value").isNotNull())
    if isinstance(shaped.schema["value"].dataType, (T.DoubleType, T.FloatType)):
        shaped = shaped.where(~F.isnan("value"))
    counted = shaped.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("value", F.col("value").cast("double"))


def order_statistics(
    counts: DataFrame, ranks: Mapping[str, Callable[[Column], Column]], by: Sequence[str] = ()
) -> DataFrame:
    """Values at given 0-based ranks of the ascending order, one column per rank.

    `counts` is the output of `value_counts_of`. Each rank is a function of the number of
    rows. Result: the `by` columns, `n` (rows counted) and per rank name the value, how many
    rows lie under it (`<name>_under`) and how many share it (`<name>_tied`).
    """
    by = list(by)
    ranges = counts.withColumn("range", _value_range(F.col("value")))
    ranges = ranges.withColumn("octave", F.shiftright("range", _OCTAVE_BITS))  # never null, like the range
    totals = ranges.groupBy(*by, "octave").agg(F.sum("n").alias("n"))
    # Bounded input: at most one row per doubling and group.
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    running = whole.orderBy("octave").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), rank(F.col("total")).cast("long").alias("rank")) for name, rank in ranks.items()]
    )
    located = (
        totals.withColumn("total", F.sum("n").over(whole))
        .withColumn("below", F.sum("n").over(running) - F.col("n"))
        .select(*by, "octave", "n", "total", "below", F.explode(wanted).alias("w"))
        .where((F.col("w.rank") >= F.col("below")) & (F.col("w.rank") < F.col("below") + F.col("n")))
        .select(*by, "octave", "total", "below", F.col("w.name").alias("name"), F.col("w.rank").alias("rank"))
    )
    if not by:
        located = F.broadcast(located)  # one row per wanted rank
    place = [*by, "name"]
    near = ranges.join(located, [*by, "octave"]).groupBy(*place, "range").agg(
        F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("total", "below", "rank")]
    )
    # Bounded input: the ranges of one doubling, for each group and wanted rank.
    upto = F.col("below") + F.sum("n").over(
        Window.partitionBy(*place).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    located = (
        near.withColumn("upto", upto)
        .where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        .select(*by, "range", "total", (F.col("upto") - F.col("n")).alias("below"), "name", "rank")
    )
    if not by:
        located = F.broadcast(located)
    inside = Window.partitionBy(*by, "name").orderBy("value")
    found = (
        ranges.join(located, [*by, "range"])
        .withColumn("upto", F.col("below") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    )
    under = F.col("upto") - F.col("n")
    picks = [
        F.max(F.when(F.col("name") == name, c)).alias(name + suffix)
        for name in ranks
        for suffix, c in (("", F.col("value")), ("_under", under), ("_tied", F.col("n")))
    ]
    return found.groupBy(*by).agg(F.max("total").alias("n"), *picks)


def percentiles_of(counts: DataFrame, probabilities: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation from a table of value counts."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probabilities.items():
        ranks[f"{name}_low"] = lambda total, p=p: F.floor((total - 1) * F.lit(float(p)))
        ranks[f"{name}_high"] = lambda total, p=p: F.ceil((total - 1) * F.lit(float(p)))
    found = order_statistics(counts, ranks, by)

    def between(name: str, p: float) -> Column:
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        place = (F.col("n") - 1) * F.lit(float(p))
        part = place - F.floor(place)
        near_low = low + (high - low) * part
        near_high = high - (high - low) * (1 - part)
        return F.when(part < 0.5, near_low).otherwise(near_high).alias(name)

    return found.select(*by, "n", *[between(name, p) for name, p in probabilities.items()])


def exact_percentiles(
    df: DataFrame, value: str, probabilities: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Percentiles of a column; nulls and NaN are left out."""
    return percentiles_of(value_counts_of(df, value, by), probabilities, by)


# --- cuts by hash order -----------------------------------------------------------

_PREFIX = 4  # hex digits: 65,536 prefixes


def order_hash(id_column: Column, seed: int) -> Column:
    """Fixed pseudo-random position of a row; rows with the same id share it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))))


def with_order_hash(df: DataFrame, id_column: str, seed: int, name: str = "_hash") -> DataFrame:
    """Add the row's position. A row with a blank id takes its message instead, if there is
    one: rows without ids would otherwise all share one place."""
    key = F.col(id_column).cast("string")
    if "customer_message" in df.columns and id_column != "customer_message":
        key = F.coalesce(F.nullif(key, F.lit("")), F.col("customer_message"))
    return df.withColumn(name, order_hash(key, seed))


def with_position_hash(df: DataFrame, seed: int, name: str = "_hash") -> DataFrame:
    """Add a position of its own for every row, from its place in source order."""
    placed = with_ordinal(df, "_place")
    return placed.withColumn(name, order_hash(F.col("_place"), seed)).drop("_place")


def hash_histogram(df: DataFrame, hash_column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per group and hash prefix, computed once."""
    counted = df.groupBy(*by, F.substring(hash_column, 1, _PREFIX).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return settle(counted)


def hash_thresholds(
    df: DataFrame, hash_column: str, histogram: DataFrame, quotas: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """For each group and cut, the hash of the `quota`-th row in hash order.

    `quotas` holds the `by` columns, `cut` (a name) and `quota`; a quota of 0 gives no row.
    `exact` tells whether the rows up to that hash are `quota` in number: rows that share
    the hash may reach beyond.
    """
    by = list(by)
    # Bounded input: at most one row per prefix and group.
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    running = whole.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = histogram.withColumn("below", F.sum("n").over(running) - F.col("n"))
    if by:
        placed = summed.join(quotas, by)
    else:
        # No group: the quotas are a handful of rows, carried as one array.
        listed = quotas.agg(F.collect_list(F.struct("cut", "quota")).alias("q")).scalar()
        placed = summed.select("*", F.explode(listed).alias("w")).select(
            "prefix", "n", "below", F.col("w.cut").alias("cut"), F.col("w.quota").alias("quota")
        )
    placed = placed.where((F.col("quota") > F.col("below")) & (F.col("quota") <= F.col("below") + F.col("n")))
    placed = settle(placed.select(*by, "prefix", "cut", (F.col("quota") - F.col("below")).alias("place")))
    # Rows that share a hash are counted first, so an id that repeats a lot is one row here.
    near = (
        df.select(*by, F.col(hash_column).alias("hash"), F.substring(hash_column, 1, _PREFIX).alias("prefix"))
        .join(broadcast_checked(placed, placed.count()), [*by, "prefix"])
        .groupBy(*by, "cut", "place", "hash")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    inside = Window.partitionBy(*by, "cut").orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        near.withColumn("upto", F.sum("n").over(inside))
        .where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place")))
        .select(*by, "cut", F.col("hash").alias("threshold"), (F.col("upto") == F.col("place")).alias("exact"))
    )


def largest_remainder(counts: DataFrame, label: str, total: Column, size: Column) -> DataFrame:
    """Share out `total` places among the classes in proportion to their counts `n`.

    `size` is the sum of the counts. Whole shares first, then the largest remainders, ties
    by label; the places given add up to `total` exactly.
    """
    # Bounded input: one row per class.
    classes = Window.partitionBy(F.lit(0))
    parts = size.cast("decimal(20,0)")
    shared = (
        counts.withColumn("product", F.col("n").cast("decimal(18,0)") * total.cast("decimal(18,0)"))
        .withColumn("remainder", F.col("product") % parts)
        .withColumn("quota", F.expr("cast((product - remainder) as decimal(38,0))"))
        .withColumn("quota", F.round(F.col("quota") / parts).cast("long"))
    )
    order = classes.orderBy(F.desc("remainder"), F.col(label))
    return (
        shared.withColumn("left", total - F.sum("quota").over(classes))
        .withColumn("quota", F.col("quota") + (F.row_number().over(order) <= F.col("left")).cast("long"))
        .select(label, "n", "quota")
    )
