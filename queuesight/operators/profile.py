"""Profiles of a dataset: one scan each, results as small frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from .columns import distinct_names, find_column, quoted
from .ranks import percentiles_of, value_counts_of


def _digest(name: str):
    return F.sha2(F.coalesce(quoted(name).cast("string"), F.lit("")), 256)


def profile_dataset(df: DataFrame, key_fields: Sequence[str] = K.KEY_FIELDS, path: str | None = None) -> DataFrame:
    """One row: size, columns, nulls per key field, duplicate texts, usable for training.

    `missing_<field>` is null for a field the table does not have. Duplicates are rows minus
    distinct texts; texts are compared by SHA-256 so only digests are shuffled.
    """
    df = distinct_names(df)
    names = {c.lower(): c for c in df.columns}
    text = find_column(df.columns, K.TEXT_COLUMNS)
    category = find_column(df.columns, K.CATEGORY_COLUMNS)
    measures = [F.count(F.lit(1)).alias("row_count")]
    for field in key_fields:
        missing = F.count_if(quoted(names[field]).isNull()) if field in names else F.lit(None).cast("long")
        measures.append(missing.alias(f"missing_{field}"))
    distinct = F.count_distinct(_digest(text)) if text else F.lit(None).cast("long")
    measures.append(distinct.alias("distinct_texts"))
    return df.agg(*measures).select(
        F.lit(path).cast("string").alias("file_path"),
        "row_count",
        F.lit(", ".join(df.columns)).alias("columns"),
        *[f"missing_{f}" for f in key_fields],
        (F.col("row_count") - F.col("distinct_texts")).alias("duplicate_customer_message_count"),
        F.lit(bool(text and category)).alias("has_required_training_columns"),
    )


def duplicate_count(df: DataFrame, text: str) -> DataFrame:
    """One row: rows, distinct texts and the rows a deduplication would remove."""
    counted = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(_digest(text)).alias("distinct_texts"))
    return counted.withColumn("duplicates", F.col("row_count") - F.col("distinct_texts"))


def distributions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(field, value, n) for the columns, or for the category, priority and language roles.

    Missing values count as `<missing>`. All fields come from one scan and one grouping.
    """
    df = distinct_names(df)
    if columns is None:
        roles = [K.CATEGORY_COLUMNS, K.PRIORITY_COLUMNS, K.LANGUAGE_COLUMNS]
        labels = ["category", "priority", "language"]
        found = [(label, find_column(df.columns, names)) for label, names in zip(labels, roles)]
        fields = [(label, name) for label, name in found if name]
    else:
        fields = [(c, c) for c in columns]
    pairs = F.array(
        *[
            F.struct(
                F.lit(label).alias("field"),
                F.coalesce(quoted(name).cast("string"), F.lit("<missing>")).alias("value"),
            )
            for label, name in fields
        ]
    )
    return df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def missing_report(df: DataFrame) -> DataFrame:
    """(column_name, missing_count, missing_rate), most missing first."""
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(quoted(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    listed = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("missing_count")) for i, c in enumerate(df.columns)]
    )
    return (
        counted.select("_rows", F.explode(listed).alias("m"))
        .select("m.*", F.try_divide(F.col("m.missing_count").cast("double"), F.col("_rows").cast("double")).alias("missing_rate"))
        .orderBy(F.desc("missing_count"), "column_name")
    )


def value_counts(df: DataFrame, column: str, top: int | None = 30) -> DataFrame:
    """(value, n) including null, most frequent first; ties by value."""
    counted = df.groupBy(quoted(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return ordered if top is None else ordered.limit(top)


def value_counts_multi(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of value combinations; rows with a null in any of the columns are left out."""
    return df.na.drop(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), *columns
    )


def text_lengths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add `<column>_len`: characters of each text, 0 for null."""
    return df.select("*", *[F.length(F.coalesce(quoted(c), F.lit(""))).alias(f"{c}_len") for c in columns])


def describe_lengths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per numeric column.

    Everything is computed from the counts of distinct lengths, so the texts are read once
    and never leave the map side.
    """
    listed = F.array(
        *[F.struct(F.lit(c).alias("field"), quoted(c).alias("value")) for c in columns]
    )
    long = df.select(F.explode(listed).alias("p")).select("p.field", "p.value")
    counts = value_counts_of(long, "value", ["field"])
    quartiles = percentiles_of(counts, {"p25": 0.25, "p50": 0.50, "p75": 0.75}, ["field"]).drop("n")
    means = counts.groupBy("field").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"))
    # One row per field; deviations from the mean do not cancel as sums of squares do.
    about = counts.join(F.broadcast(means), "field")
    n, squares = F.sum("n"), F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), 2))
    moments = about.groupBy("field").agg(
        n.alias("n"),
        F.first("mean").alias("mean"),
        F.when(n > 1, F.sqrt(squares / (n - 1))).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return moments.join(quartiles, "field").select("field", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def token_length_stats(df: DataFrame, text: str) -> DataFrame:
    """Mean, maximum and exact 95th percentile of whitespace tokens per text."""
    counts = value_counts_of(df.select(tx.token_count(quoted(text)).alias("tokens")), "tokens")
    tail = percentiles_of(counts, {"p95_whitespace_tokens": 0.95})
    whole = counts.agg(
        (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean_whitespace_tokens"),
        F.max("value").cast("long").alias("max_whitespace_tokens"),
    )
    head = whole.agg(F.first(F.struct("*"))).scalar()
    return tail.select(
        head["mean_whitespace_tokens"].alias("mean_whitespace_tokens"),
        head["max_whitespace_tokens"].alias("max_whitespace_tokens"),
        "p95_whitespace_tokens",
    )


def select_largest(audit: DataFrame) -> DataFrame:
    """The readable, complete, real dataset with the most rows; ties by path."""
    real = audit.where(
        F.col("has_required_training_columns")
        & ~F.coalesce(F.col("is_smoke_or_generated_output"), F.lit(False))
        & F.col("read_error").isNull()
    )
    return real.orderBy(F.desc("row_count"), "file_path").limit(1)
