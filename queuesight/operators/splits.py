"""Deterministic splits and samples of exact size.

Rows are ordered inside each class by md5(seed:id) and cut at exact places (see `ranks`).
The same id always lands on the same side, for any number of partitions, as long as no cut
falls among rows that share an id. Where one does, sizes come first: the rows are ordered by
their place in source order instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..session import broadcast_checked, settle
from .columns import canonicalize_tickets
from .ranks import hash_histogram, hash_thresholds, largest_remainder, with_order_hash, with_position_hash


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def stratifiable(smallest: int | None, share: float) -> bool:
    """Every class needs two rows and an expected part of at least one row."""
    return bool(smallest) and smallest >= 2 and smallest * share >= 1


def can_stratify(df: DataFrame, label: str, share: float) -> bool:
    return stratifiable(class_counts(df.where(F.col(label).isNotNull()), label).agg(F.min("n")).first()[0], share)


def _quotas(shares: DataFrame, label: str, cut: str) -> DataFrame:
    return shares.select(label, F.lit(cut).alias("cut"), F.col("quota").cast("long").alias("quota"))


class _TiedCut(Exception):
    """A cut falls among rows that share a hash."""


def _exactly(cut: Callable, df: DataFrame, seed: int, id_column: str):
    try:
        return cut(with_order_hash(df, id_column, seed))
    except _TiedCut:
        return cut(with_position_hash(df, seed))


def _class_cuts(df: DataFrame, histogram: DataFrame, quotas: DataFrame, label: str, classes: int) -> DataFrame:
    """Per class the hash thresholds of the cuts `rest` and `test`."""
    found = hash_thresholds(df, "_hash", histogram, quotas, [label])
    wide = settle(
        found.groupBy(label).agg(
            *[F.max(F.when(F.col("cut") == cut, F.col("threshold"))).alias(f"_{cut}") for cut in ("rest", "test")],
            F.min("exact").alias("_exact"),
        )
    )
    if not wide.where(~F.col("_exact")).isEmpty():
        raise _TiedCut
    return broadcast_checked(wide.drop("_exact"), classes)


def _plain_cuts(df: DataFrame, histogram: DataFrame, sizes: dict[str, int]) -> dict[str, str]:
    """The thresholds of cuts over all rows: a few strings."""
    rows = [(cut, size) for cut, size in sizes.items() if size > 0]
    if not rows:
        return {}
    quotas = df.sparkSession.createDataFrame(rows, "cut string, quota long")
    found = hash_thresholds(df, "_hash", histogram, quotas).collect()
    if not all(r["exact"] for r in found):
        raise _TiedCut
    return {r["cut"]: r["threshold"] for r in found}


def _below(threshold: Column) -> Column:
    return F.col("_hash") <= F.coalesce(threshold, F.lit(""))


def fixed_splits(
    df: DataFrame,
    train_size: float = 0.7,
    val_size: float = 0.15,
    test_size: float = 0.15,
    seed: int = K.SEED,
    id_column: str = "ticket_id",
    label: str = "category",
) -> tuple[DataFrame, str]:
    """Add `split` (train, val, test) and name the strategy used.

    The rest (val and test) has ceil(share * n) rows, the test part ceil of its share of
    the rest. Both cuts keep the class proportions when every class is large enough.
    """
    if round(train_size + val_size + test_size, 6) != 1.0:
        raise ValueError("train_size, val_size and test_size must add up to 1")
    return _exactly(lambda hashed: _fixed(hashed, df.columns, val_size, test_size, label), df, seed, id_column)


def _fixed(hashed: DataFrame, outputs: list[str], val_size: float, test_size: float, label: str) -> tuple[DataFrame, str]:
    histogram = hash_histogram(hashed, "_hash", [label])
    counts = histogram.groupBy(label).agg(F.sum("n").alias("n"))
    size = counts.agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).first()
    if not size["n"]:
        raise ValueError("cannot split an empty table")

    rest_share = val_size + test_size
    rest_rows = math.ceil(rest_share * size["n"])
    test_share = test_size / rest_share
    test_rows = math.ceil(test_share * rest_rows)

    if not stratifiable(size["least"], rest_share):
        overall = settle(histogram.groupBy("prefix").agg(F.sum("n").alias("n")))
        cuts = _plain_cuts(hashed, overall, {"rest": rest_rows, "test": test_rows})
        parted = hashed.withColumn("_rest", F.lit(cuts.get("rest"))).withColumn("_test", F.lit(cuts.get("test")))
        strategy = "random_no_stratification"
    else:
        rest = largest_remainder(counts, label, F.lit(rest_rows), F.lit(size["n"]))
        least = rest.where(F.col("quota") > 0).agg(F.min("quota")).first()[0]
        if stratifiable(least, test_share):
            part = rest.where(F.col("quota") > 0).select(label, F.col("quota").alias("n"))
            test = largest_remainder(part, label, F.lit(test_rows), F.lit(rest_rows))
            quotas = _quotas(rest, label, "rest").unionByName(_quotas(test, label, "test"))
            cuts = _class_cuts(hashed, histogram, quotas, label, size["k"])
            parted = hashed.join(cuts, label, "left")
            strategy = "category_stratified"
        else:
            cuts = _class_cuts(hashed, histogram, _quotas(rest, label, "rest"), label, size["k"]).drop("_test")
            joined = hashed.join(cuts, label, "left")
            kept = joined.where(_below(F.col("_rest"))).select("_hash")
            second = _plain_cuts(kept, hash_histogram(kept, "_hash"), {"test": test_rows})
            parted = joined.withColumn("_test", F.lit(second.get("test")))
            strategy = "category_stratified_train_temp_random_val_test"

    split = F.when(~_below(F.col("_rest")), "train").when(~_below(F.col("_test")), "val").otherwise("test")
    return parted.select(*outputs, split.alias("split")), strategy


def create_fixed_splits(df: DataFrame, **options) -> tuple[DataFrame, str]:
    """Canonicalise a ticket table, then split it."""
    return fixed_splits(canonicalize_tickets(df), **options)


def one_cut(df: DataFrame, test_size: float = 0.25, seed: int = K.SEED, id_column: str = "ticket_id", label: str = "category") -> DataFrame:
    """Train and test parts with class proportions kept; the test part has ceil(share * n) rows."""
    return _exactly(lambda hashed: _one_cut(hashed, df.columns, test_size, label), df, seed, id_column)


def _one_cut(hashed: DataFrame, outputs: list[str], test_size: float, label: str) -> DataFrame:
    histogram = hash_histogram(hashed, "_hash", [label])
    counts = histogram.groupBy(label).agg(F.sum("n").alias("n"))
    size = counts.agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).first()
    test_rows = math.ceil(test_size * (size["n"] or 0))
    if not size["n"] or size["least"] < 2 or min(test_rows, size["n"] - test_rows) < size["k"]:
        raise ValueError("every class needs two rows and a place in both parts")
    quotas = _quotas(largest_remainder(counts, label, F.lit(test_rows), F.lit(size["n"])), label, "test")
    cuts = _class_cuts(hashed, histogram, quotas, label, size["k"])
    split = F.when(_below(F.col("_test")), "test").otherwise("train")
    return hashed.join(cuts, label, "left").select(*outputs, split.alias("split"))


def random_sample(df: DataFrame, n: int, seed: int = K.SEED, id_column: str = "ticket_id") -> DataFrame:
    """n rows in the order of md5(seed:id)."""

    def cut(hashed: DataFrame) -> DataFrame:
        histogram = hash_histogram(hashed, "_hash")
        if (histogram.agg(F.sum("n")).first()[0] or 0) <= n:
            return df
        cuts = _plain_cuts(hashed, histogram, {"sample": n})
        return hashed.where(_below(F.lit(cuts.get("sample")))).select(*df.columns)

    return _exactly(cut, df, seed, id_column)


def stratified_sample(
    df: DataFrame, n: int | None, seed: int = K.SEED, id_column: str = "ticket_id", label: str = "label_text"
) -> DataFrame:
    """n rows with the class proportions of the whole.

    No size, or one that covers the table, returns it whole. Where proportions cannot be
    kept (more classes than rows wanted, a class of one row, too few rows left over) the
    sample is drawn without regard to class.
    """
    if not n or n <= 0:
        return df
    return _exactly(lambda hashed: _stratified(hashed, df, n, label), df, seed, id_column)


def _stratified(hashed: DataFrame, df: DataFrame, n: int, label: str) -> DataFrame:
    histogram = hash_histogram(hashed, "_hash", [label])
    counts = histogram.groupBy(label).agg(F.sum("n").alias("n"))
    size = counts.agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).first()
    if not size["n"] or n >= size["n"]:
        return df
    if size["k"] > n or size["least"] < 2 or size["n"] - n < size["k"]:
        overall = settle(histogram.groupBy("prefix").agg(F.sum("n").alias("n")))
        cuts = _plain_cuts(hashed, overall, {"sample": n})
        return hashed.where(_below(F.lit(cuts.get("sample")))).select(*df.columns)
    quotas = _quotas(largest_remainder(counts, label, F.lit(n), F.lit(size["n"])), label, "test")
    cuts = _class_cuts(hashed, histogram, quotas, label, size["k"])
    return hashed.join(cuts, label, "left").where(_below(F.col("_test"))).select(*df.columns)


def evaluation_sample_size(train_sample: int) -> int:
    """Validation and test sample that goes with a training sample."""
    return max(100, math.ceil(train_sample / 4))


def split_report(df: DataFrame, split: str = "split", label: str = "category", priority: str = "priority") -> DataFrame:
    """(split, field, value, n): rows, category and priority distribution of each split.

    The table is reduced to one row per (split, category, priority) first; the three views
    are groupings of that small frame.
    """
    cells = df.groupBy(split, label, priority).agg(F.count(F.lit(1)).alias("n"))
    views = F.array(
        F.struct(F.lit("rows").alias("field"), F.lit("all").alias("value")),
        F.struct(F.lit("category").alias("field"), F.col(label).alias("value")),
        F.struct(F.lit("priority").alias("field"), F.col(priority).alias("value")),
    )
    return (
        cells.select(F.col(split).alias("split"), "n", F.explode(views).alias("v"))
        .groupBy("split", "v.field", "v.value")
        .agg(F.sum("n").alias("n"))
    )


def class_weights(df: DataFrame, label: str, mode: str = "balanced", labels: DataFrame | None = None) -> DataFrame:
    """(label, n, weight): n/(K*n_c), its square root, or 1 for every class.

    `labels` may name further classes; one without rows weighs 1.
    """
    if mode not in ("balanced", "sqrt_balanced", "none"):
        raise ValueError(f"unknown weighting: {mode}")
    counts = class_counts(df, label).select(F.col(label).alias("label"), "n")
    if labels is not None:
        named = labels.select(F.col(labels.columns[0]).alias("label"), F.lit(0).cast("long").alias("n")).distinct()
        counts = counts.unionByName(named).groupBy("label").agg(F.sum("n").alias("n"))
    total = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))).scalar()
    balanced = F.when(
        F.col("n") > 0, total["rows"].cast("double") / (total["classes"].cast("double") * F.col("n").cast("double"))
    ).otherwise(F.lit(1.0))
    weight = {"balanced": balanced, "sqrt_balanced": F.sqrt(balanced), "none": F.lit(1.0)}[mode]
    return counts.select("label", "n", weight.alias("weight"))


def label_vocabulary(df: DataFrame, label: str) -> DataFrame:
    """(label, label_id): distinct labels in alphabetical order, numbered from 0."""
    distinct = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label")).distinct()
    # Bounded input: one row per class.
    return distinct.withColumn(
        "label_id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1).cast("int")
    )


def unknown_labels(train: DataFrame, other: DataFrame, label: str) -> DataFrame:
    """Labels of `other` that the training part does not have."""
    return other.select(label).distinct().join(train.select(label).distinct(), label, "left_anti")


def encode_labels(train: DataFrame, other: DataFrame, label: str = "label_text", name: str = "split") -> DataFrame:
    """Add `label_id` of the training vocabulary; an unknown label is an error that names it."""
    unknown = [r[0] for r in unknown_labels(train, other, label).orderBy(label).collect()]
    if unknown:
        raise ValueError(f"{name} has labels that are not in the training part: {unknown}")
    ids = settle(label_vocabulary(train, label).select(F.col("label").alias("_known"), "label_id"))
    joined = other.join(broadcast_checked(ids, ids.count()), F.col(label) == F.col("_known"))
    return joined.select(*other.columns, F.col("label_id"))
