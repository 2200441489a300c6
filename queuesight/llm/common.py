"""Shared pieces: reading, staging in the shared folder, row keys and seeded splits."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator works on, under names of its own.

    Whatever else the frame carries cannot clash with an operator's columns.
    """
    return df.select(*[F.col(f"`{source}`").alias(target) for target, source in columns.items()])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True for rows with an id that are not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def text_key(text: Column) -> Column:
    """With the id, tells rows apart that repeat an id with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, or longer ones where `df` has a column of that name in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def matching(documents: DataFrame, keys: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, Column]:
    """(`keys` with its doc_id and th under names that `documents` has not, the condition that joins the two).

    Only those two columns are kept, so nothing that `documents` carries can clash with them.
    """
    own_id, own_th = unused(documents, "own_id", "own_th")
    renamed = keys.select(F.col("doc_id").alias(own_id), F.col("th").alias(own_th))
    return renamed, F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id)) & (text_key(F.col(f"`{text}`")) == F.col(own_th))


def small(df: DataFrame) -> DataFrame:
    """Mark a stored frame for broadcast when its counted rows are few (see BROADCAST_ROWS)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
