"""Splitting a curated table, training the classifiers and describing them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.columns import canonicalize_tickets, require_columns
from ..operators.models import TextClassifier, train_classifier
from ..operators.splits import fixed_splits, split_report
from ..sources.writers import write_table


def write_splits(df: DataFrame, path: str, source: str = "", seed: int = K.SEED, **options) -> DataFrame:
    """Canonicalise, split and write a table partitioned by `split`; returns its report.

    The report (rows, category and priority distribution per split, with the strategy and
    the seed) is computed from the written table.
    """
    parted, strategy = fixed_splits(canonicalize_tickets(df), seed=seed, **options)
    write_table(parted, path, partition_by=["split"])
    written = df.sparkSession.read.parquet(path)
    return split_report(written).select(
        "*",
        F.lit(strategy).alias("split_strategy"),
        F.lit(seed).alias("random_state"),
        F.lit(source).alias("source_dataset"),
    )


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One part of a table written by `write_splits`; only its files are read."""
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def train_models(
    train: DataFrame, targets: Sequence[str] = ("category", "priority"), text: str = "customer_message", **options
) -> dict[str, TextClassifier]:
    """A classifier per target; a target with fewer than two values gets none."""
    require_columns(train, [text])
    models: dict[str, TextClassifier] = {}
    for target in targets:
        if target not in train.columns:
            continue
        values = train.where(F.col(target).isNotNull()).select(target).distinct().limit(2).count()
        if values > 1:
            models[target] = train_classifier(train, text, target, **options)
    if not models:
        raise ValueError("no target has two values")
    return models


def model_table(spark: SparkSession, models: Mapping[str, TextClassifier]) -> DataFrame:
    """A row per model: target, type, training rows, labels and settings."""
    rows = [
        (
            target,
            m.metadata.get("model_type"),
            m.metadata.get("text"),
            m.metadata.get("rows"),
            m.labels,
            m.metadata.get("vocabulary"),
            m.metadata.get("max_iterations"),
            m.metadata.get("class_weight"),
        )
        for target, m in models.items()
    ]
    schema = (
        "target string, model_type string, text string, train_rows long, labels array<string>, vocabulary int, "
        "max_iterations int, class_weight string"
    )
    return spark.createDataFrame(rows, schema)
