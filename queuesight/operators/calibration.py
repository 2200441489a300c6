"""Calibration: reliability bins and expected calibration error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import clip_unit, count_reached, ratio
from .metrics import CONFIDENCE, PREDICTED, TRUE


def confidence_bin(confidence: Column, bins: int = K.CALIBRATION_BINS) -> Column:
    """1-based bin of (i/bins, (i+1)/bins]; the first bin also holds 0. Clipped to [0, 1]."""
    edges = [i / bins for i in range(1, bins)]
    return F.lit(1) + count_reached(clip_unit(confidence), edges, strict=True)


def bin_name(index: Column, bins: int = K.CALIBRATION_BINS) -> Column:
    """Interval text such as `(0.2, 0.3]`; the first bin reaches just below 0."""
    names = [f"({i / bins}, {(i + 1) / bins}]" for i in range(bins)]
    names[0] = f"(-0.001, {1 / bins}]"
    return F.element_at(F.array(*[F.lit(n) for n in names]), index)


def binned(
    df: DataFrame,
    by: Sequence[str] = (),
    bins: int = K.CALIBRATION_BINS,
    true: str = TRUE,
    predicted: str = PREDICTED,
    confidence: str = CONFIDENCE,
) -> DataFrame:
    """(by..., bin, n, n_correct, sum_confidence): what every calibration figure needs."""
    correct = F.col(true).eqNullSafe(F.col(predicted)).cast("long")
    return df.groupBy(*by, confidence_bin(F.col(confidence), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(correct).alias("n_correct"), F.sum(confidence).alias("sum_confidence")
    )


def reliability(df: DataFrame, by: Sequence[str] = (), bins: int = K.CALIBRATION_BINS, **names) -> DataFrame:
    """(by..., bin, interval, n, mean_confidence, accuracy, gap); empty bins are left out."""
    means = binned(df, by, bins, **names).select(
        *by,
        "bin",
        bin_name(F.col("bin"), bins).alias("interval"),
        "n",
        (F.col("sum_confidence") / F.col("n")).alias("mean_confidence"),
        ratio(F.col("n_correct"), F.col("n")).alias("accuracy"),
    )
    return means.withColumn("gap", F.col("accuracy") - F.col("mean_confidence"))


def _error() -> Column:
    """Sum over bins of n/N * |accuracy - mean confidence|."""
    return F.sum(F.abs(F.col("n_correct") - F.col("sum_confidence"))) / F.sum("n")


def calibration_error(df: DataFrame, by: Sequence[str] = (), bins: int = K.CALIBRATION_BINS, **names) -> DataFrame:
    """(by..., n, ece)."""
    return binned(df, by, bins, **names).groupBy(*by).agg(F.sum("n").alias("n"), _error().alias("ece"))


def per_class_calibration(df: DataFrame, by: Sequence[str] = (), bins: int = K.CALIBRATION_BINS, predicted: str = PREDICTED, **names) -> DataFrame:
    """(by..., predicted_label, n, mean_confidence, precision, ece), most predicted first."""
    work = df if predicted == PREDICTED else df.withColumn(PREDICTED, F.col(predicted))
    return (
        binned(work, [*by, PREDICTED], bins, **names)
        .groupBy(*by, PREDICTED)
        .agg(
            F.sum("n").alias("total"),
            (F.sum("sum_confidence") / F.sum("n")).alias("mean_confidence"),
            ratio(F.sum("n_correct"), F.sum("n")).alias("precision"),
            _error().alias("ece"),
        )
        .withColumnRenamed("total", "n")
        .orderBy(*by, F.desc("n"), PREDICTED)
    )
