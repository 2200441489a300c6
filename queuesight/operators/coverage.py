"""Coverage against accuracy: what happens when only confident predictions are routed.

The cutoffs of a grid are nested, so a row is described by how many of them it reaches.
The table is reduced once to (reached, true, predicted) counts; the grid is laid over that
small frame. Nothing is repeated per cutoff on the rows themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import coerce_double, count_reached, ratio
from .metrics import CONFIDENCE, PREDICTED, TRUE, class_scores
from .ranks import hash_histogram, hash_thresholds, order_hash, order_statistics, value_counts_of


def confidence_mask(
    confidence: Column, threshold: float, margin: Column | None = None, margin_threshold: float | None = None
) -> Column:
    keep = confidence >= F.lit(float(threshold))
    if margin_threshold is not None:
        keep = keep & (F.coalesce(margin, F.lit(0.0)) >= F.lit(float(margin_threshold)))
    return keep


def gate_mask(threshold: float, confidence: Column, risk: Column, policy: Column, high_risk: float = K.HIGH_RISK) -> Column:
    """Confident enough, not risky, not policy-sensitive."""
    return (confidence >= F.lit(float(threshold))) & (risk < high_risk) & ~policy


def nested_metrics(
    df: DataFrame,
    level: Column,
    grid: Sequence[float],
    by: Sequence[str] = (),
    true: str = TRUE,
    predicted: str = PREDICTED,
) -> DataFrame:
    """Metrics of nested subsets: a row belongs to the first `level` entries of the grid.

    (by..., threshold, n, n_auto, n_review, n_correct, accuracy, macro_f1), one row per grid
    entry; accuracy and macro_f1 are null where nothing is routed. Macro-F1 is taken over
    the labels present in the routed subset.
    """
    by = list(by)
    cells = df.groupBy(*by, level.alias("level"), F.col(true).alias(TRUE), F.col(predicted).alias(PREDICTED)).agg(
        F.count(F.lit(1)).alias("n")
    )
    steps = F.posexplode(F.array(*[F.lit(float(g)) for g in grid])).alias("step", "threshold")
    zero = F.lit(0).cast("long")
    routed = F.when(F.col("step") < F.col("level"), F.col("n")).otherwise(zero)
    hit = F.when(F.col(TRUE).eqNullSafe(F.col(PREDICTED)), F.col("routed")).otherwise(zero)
    sides = F.array(
        F.struct(
            F.col(TRUE).alias("label"), F.col("n").alias("rows"), F.col("routed").alias("support"),
            zero.alias("predicted"), hit.alias("tp"),
        ),
        F.struct(
            F.col(PREDICTED).alias("label"), zero.alias("rows"), zero.alias("support"),
            F.col("routed").alias("predicted"), zero.alias("tp"),
        ),
    )
    totals = (
        cells.select("*", steps)
        .withColumn("routed", routed)
        .select(*by, "threshold", F.explode(sides).alias("s"))
        .select(*by, "threshold", "s.*")
        .groupBy(*by, "threshold", "label")
        .agg(*[F.sum(c).alias(c) for c in ("rows", "support", "predicted", "tp")])
    )
    present = (F.col("support") > 0) | (F.col("predicted") > 0)
    return (
        class_scores(totals)
        .groupBy(*by, "threshold")
        .agg(
            F.sum("rows").alias("n"),
            F.sum("support").alias("n_auto"),
            F.sum("tp").alias("n_correct"),
            F.avg(F.when(present, F.col("f1_score"))).alias("macro_f1"),
        )
        .select(
            *by,
            "threshold",
            "n",
            "n_auto",
            (F.col("n") - F.col("n_auto")).alias("n_review"),
            "n_correct",
            ratio(F.col("n_correct"), F.col("n_auto")).alias("accuracy"),
            "macro_f1",
        )
    )


def coverage(
    df: DataFrame,
    cutoffs: Sequence[float] = K.COVERAGE_CUTOFFS,
    by: Sequence[str] = (),
    keep: Column | None = None,
    confidence: str = CONFIDENCE,
    **names,
) -> DataFrame:
    """`nested_metrics` over confidence cutoffs; rows that fail `keep` always go to review."""
    grid = sorted(cutoffs)
    level = count_reached(F.col(confidence), grid)
    if keep is not None:
        level = F.when(keep, level).otherwise(0)
    return nested_metrics(df, level, grid, by, **names)


def coverage_by_threshold(df: DataFrame, margin_threshold: float | None = None, **options) -> DataFrame:
    """Coverage, accuracy and macro-F1 on the routed rows, rows routed and sent to review."""
    keep = None
    if margin_threshold is not None:
        if "top1_top2_margin" not in df.columns:
            raise ValueError("a margin threshold needs the column top1_top2_margin")
        keep = coerce_double(df, "top1_top2_margin") >= F.lit(float(margin_threshold))
    curve = coverage(df, keep=keep, **options)
    result = curve.select(
        "threshold",
        ratio(F.col("n_auto"), F.col("n")).alias("coverage"),
        F.col("accuracy").alias("accuracy_on_auto_routed"),
        F.col("macro_f1").alias("macro_f1_on_auto_routed"),
        F.col("n_auto").alias("number_auto_routed"),
        F.col("n_review").alias("number_sent_to_review"),
    )
    return result if margin_threshold is None else result.withColumn("margin_threshold", F.lit(float(margin_threshold)))


def risk_gated_sweep(
    df: DataFrame,
    cutoffs: Sequence[float] = K.GATED_CUTOFFS,
    true: str = "category",
    predicted: str = "predicted_category",
    confidence: str = "category_confidence",
    risk: str = "escalation_risk",
    policy: str = "policy_sensitive",
    high_risk: float = K.HIGH_RISK,
) -> DataFrame:
    """Coverage over cutoffs when risky and policy-sensitive rows are held back."""
    keep = (F.col(risk) < high_risk) & ~F.col(policy)
    curve = coverage(df, cutoffs, keep=keep, confidence=confidence, true=true, predicted=predicted)
    return curve.select(
        "threshold",
        F.col("n_auto").alias("auto_triage_count"),
        F.col("n_review").alias("human_review_count"),
        ratio(F.col("n_auto"), F.col("n")).alias("auto_triage_rate"),
        ratio(F.col("n_review"), F.col("n")).alias("human_review_rate"),
        F.col("accuracy").alias("accuracy_on_auto_triaged"),
        F.col("macro_f1").alias("macro_f1_on_auto_triaged"),
        # The gate itself keeps high risk out, so none can be routed.
        F.lit(0).cast("long").alias("high_risk_auto_triaged_count"),
    )


def coverage_sweep(df: DataFrame, **options) -> DataFrame:
    """Every cutoff, also those that route nothing (rate 0, null accuracy)."""
    return coverage(df, **options).select(
        "threshold",
        ratio(F.col("n_auto"), F.col("n")).alias("auto_route_rate"),
        (1 - ratio(F.col("n_auto"), F.col("n"))).alias("human_review_rate"),
        F.col("accuracy").alias("accuracy_on_auto"),
        F.col("macro_f1").alias("macro_f1_on_auto"),
        "n_auto",
    )


def coverage_curve(df: DataFrame, **options) -> DataFrame:
    """Only cutoffs that route something, with the number of errors among the routed."""
    return coverage(df, **options).where(F.col("n_auto") > 0).select(
        "threshold",
        ratio(F.col("n_auto"), F.col("n")).alias("coverage"),
        F.col("accuracy").alias("accuracy_on_auto"),
        F.col("macro_f1").alias("macro_f1_on_auto"),
        "n_auto",
        (F.col("n_auto") - F.col("n_correct")).alias("n_errors_auto"),
    )


def accuracy_at_budget(
    df: DataFrame,
    budgets: Sequence[float] = K.REVIEW_BUDGETS,
    id_column: str = "ticket_id",
    seed: int = K.SEED,
    confidence: str = CONFIDENCE,
    true: str = TRUE,
    predicted: str = PREDICTED,
) -> DataFrame:
    """Accuracy on the rows kept when people review a fixed share of all rows.

    The most confident round(n*(1-b)) rows are kept; rows tied at the cut are taken in the
    order of md5(seed:id). The cut value comes from `order_statistics` and the place among
    the ties from `hash_thresholds`, so neither the table nor a large tie is ever sorted
    whole. The driver sees one cut value, count and hash per budget.
    """
    spark = df.sparkSession
    names = {f"b{i}": b for i, b in enumerate(sorted(budgets))}
    rows = df.select(
        coerce_double(df, confidence).alias("_conf"), F.col(true).alias(TRUE), F.col(predicted).alias(PREDICTED),
        order_hash(F.col(id_column), seed).alias("_hash"),
    )

    def kept(total: Column, budget: float) -> Column:
        return F.bround(total * F.lit(1 - budget)).cast("long")

    ranks = {name: (lambda total, b=b: total - kept(total, b)) for name, b in names.items()}
    cuts = order_statistics(value_counts_of(rows, "_conf"), ranks).first()
    schema = (
        "human_review_budget double, auto_routed long, accuracy_on_auto double, macro_f1_on_auto double, "
        "min_confidence_kept double"
    )
    size = (cuts["n"] if cuts else None) or 0
    keep = {name: round(size * (1 - b)) for name, b in names.items()}
    names = {name: b for name, b in names.items() if keep[name] > 0}
    if not names:
        return spark.createDataFrame([], schema)
    # Of the rows tied at the cut, those that the rows above it leave room for.
    need = {n: keep[n] - (size - cuts[f"{n}_under"] - cuts[f"{n}_tied"]) for n in names}
    split = [(float(cuts[n]), n, need[n]) for n in names if need[n] < cuts[f"{n}_tied"]]
    last = {n: "g" for n in names}  # above every hash: all ties are kept
    if split:
        tied = rows.where(F.col("_conf").isin(sorted({s[0] for s in split})))
        quotas = spark.createDataFrame(split, "_conf double, cut string, quota long")
        found = hash_thresholds(tied, "_hash", hash_histogram(tied, "_hash", ["_conf"]), quotas, ["_conf"])
        last.update({r["cut"]: r["threshold"] for r in found.collect()})
    level = F.lit(0)
    for n in names:
        inside = (F.col("_conf") > cuts[n]) | ((F.col("_conf") == cuts[n]) & (F.col("_hash") <= last[n]))
        level = level + inside.cast("int")
    curve = nested_metrics(rows, level, list(names.values()))
    lowest = F.create_map(*[x for n, b in names.items() for x in (F.lit(float(b)), F.lit(float(cuts[n])))])
    return curve.select(
        F.col("threshold").alias("human_review_budget"),
        F.col("n_auto").alias("auto_routed"),
        F.col("accuracy").alias("accuracy_on_auto"),
        F.col("macro_f1").alias("macro_f1_on_auto"),
        lowest[F.col("threshold")].alias("min_confidence_kept"),
    )
