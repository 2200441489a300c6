"""A stored table that opens deep pages without counting or sorting its rows.

Each write sorts its own rows, and a small index keeps the least and greatest key and the
number of rows of every file. How many rows come before a file, at least and at most, follows
from the index alone; only files that may cross the page are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path, settle
from .writers import read_or_none

RANGES = "_ranges"


def _key(order: str):
    return F.col(f"`{order}`")


def append_paged(rows: DataFrame, path: str, order: str = "id") -> None:
    """Add rows, sorted by `order` into files of successive ranges, and enter the files' ranges in the index.

    The rows lie in a folder of their own until the index names it, so a write that fails
    half-way adds nothing. Appends may overlap in range; pages stay right and open more files.
    """
    spark = rows.sparkSession
    folder = f"{path.rstrip('/')}/part-{fresh_path(spark, 'x').rsplit('-', 1)[1]}"
    rows.orderBy(_key(order).asc_nulls_first()).write.parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder)
    # Rows without a key are a range of their own, before all others.
    ranges = written.groupBy(F.col("_metadata.file_path").alias("file"), _key(order).isNotNull().alias("keyed"))
    ranges = ranges.agg(F.min(_key(order)).alias("low"), F.max(_key(order)).alias("high"), F.count(F.lit(1)).alias("n"))
    ranges.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{RANGES}")  # one row a file


def _ranges(spark: SparkSession, path: str) -> DataFrame | None:
    return read_or_none(spark, f"{path.rstrip('/')}/{RANGES}")


def page_files(spark: SparkSession, path: str, skip: int, limit: int) -> tuple[list[tuple[str, bool]], int]:
    """((file, keyed), ...) of the ranges that may cross the page, and how many rows of the table all lie before those.

    Before a range lie at least the rows of ranges that end below its start, and at most those
    of ranges that start no later than its end, its own last row aside. One row a range.
    """
    ranges = _ranges(spark, path)
    if ranges is None or limit <= 0:
        return [], 0
    whole = Window.partitionBy(F.lit(0))
    ends = ranges.select("file", "keyed", "n", F.struct("keyed", F.col("low").alias("k")).alias("at"), F.lit(0).alias("end"), F.struct("keyed", F.col("high").alias("k")).alias("other"))
    ends = ends.unionByName(ranges.select("file", "keyed", "n", F.struct("keyed", F.col("high").alias("k")).alias("at"), F.lit(1).alias("end"), F.struct("keyed", F.col("low").alias("k")).alias("other")))
    # Sorted by place: rows of ranges that ended strictly before a start, of ranges that started up to an end.
    below = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.sum(F.when(F.col("end") == 1, F.col("n")).otherwise(0)).over(below)
    same = F.sum(F.when(F.col("end") == 1, F.col("n")).otherwise(0)).over(Window.partitionBy("at"))
    begun = F.sum(F.when(F.col("end") == 0, F.col("n")).otherwise(0)).over(below)
    placed = ends.select("file", "keyed", "n", "end", (ended - same).alias("least"), begun.alias("most"))
    both = placed.groupBy("file", "keyed").agg(F.max("n").alias("n"), F.max(F.when(F.col("end") == 0, F.col("least"))).alias("least"), F.max(F.when(F.col("end") == 1, F.col("most"))).alias("most"))
    both = settle(both)
    crossing = (F.col("most") > skip) & (F.col("least") < skip + limit)
    before = both.where(~crossing & (F.col("most") <= skip)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = sorted((r["file"], r["keyed"]) for r in both.where(crossing).select("file", "keyed").collect())
    return found, before


def read_page(spark: SparkSession, path: str, skip: int = 0, limit: int = 100, order: str = "id") -> DataFrame:
    """A page of the stored rows by `order`, nulls first; rows with one key by a hash of the row.

    Only the files that may cross the page are opened; beyond the last row it is empty.
    """
    found, before = page_files(spark, path, skip, limit)
    ranges = _ranges(spark, path)
    if ranges is None:
        raise FileNotFoundError(path)
    if not found:
        one = ranges.select("file").first()[0]
        return spark.read.parquet(one).limit(0)
    rows = spark.read.parquet(*sorted({f for f, _ in found}))
    kinds, keyed = {k for _, k in found}, [f for f, k in found if k]
    if kinds != {True, False}:
        rows = rows.where(_key(order).isNotNull() if True in kinds else _key(order).isNull())
    else:  # ranges without keys all cross or none does; of some files only they do
        rows = rows.where(_key(order).isNull() | F.col("_metadata.file_path").isin(keyed))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.orderBy(_key(order).asc_nulls_first(), tie).offset(skip - before).limit(limit)
