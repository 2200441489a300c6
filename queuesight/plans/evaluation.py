"""Whole evaluations: every figure of a run, from one table of predictions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import round_exact
from ..operators import bootstrap, calibration, compare, coverage, metrics, rules
from ..operators.models import FOLDED, TERMS, TextClassifier, with_folded, with_terms


def headline(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, n_correct, accuracy, macro_f1, weighted_f1, ece, majority_label, majority_share).

    One scan: rows are reduced to counts per (true, predicted, confidence bin), and all
    figures are functions of that small frame.
    """
    by = by or []
    cells = df.groupBy(
        *by, metrics.TRUE, metrics.PREDICTED, calibration.confidence_bin(F.col(metrics.CONFIDENCE)).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(metrics.CONFIDENCE).alias("sum_confidence"))
    hit = F.when(F.col(metrics.TRUE).eqNullSafe(F.col(metrics.PREDICTED)), F.col("n")).otherwise(0)
    error = (
        cells.groupBy(*by, "bin")
        .agg(F.sum("n").alias("n"), F.sum(hit).alias("hits"), F.sum("sum_confidence").alias("s"))
        .groupBy(*by)
        .agg((F.sum(F.abs(F.col("hits") - F.col("s"))) / F.sum("n")).alias("ece"))
    )
    scores = metrics.score_summary(cells, by)
    major = metrics.majority_baseline(cells, by).drop("n", "majority_n")
    if by:
        return scores.join(error, by).join(major, by)
    one = lambda frame: frame.agg(F.first(F.struct("*"))).scalar()
    first, second = one(error), one(major)
    return scores.select(
        "*",
        first["ece"].alias("ece"),
        second["majority_label"].alias("majority_label"),
        second["majority_share"].alias("majority_share"),
    )


def final_evaluation(df: DataFrame, name: str = "final", latency: str | None = "latency_ms", resamples: int = K.BOOTSTRAP_RESAMPLES) -> dict[str, DataFrame]:
    """The report of a held-out test: frames `metrics`, `report`, `reliability`, `coverage`
    and `class_calibration`. `metrics` is one row with 95% intervals and the comparison with
    always guessing the largest class."""
    head = headline(df)
    intervals = bootstrap.bootstrap_ci(df, resamples)
    ends = intervals.agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col(end))).alias(f"{m}_{end}")
            for m in compare.METRICS
            for end in ("low", "high")
        ]
    )
    ci = ends.agg(F.first(F.struct("*"))).scalar()
    figures = [
        F.lit(name).alias("name"), "*",
        *[ci[f"{m}_{end}"].alias(f"{m}_ci95_{end}") for m in compare.METRICS for end in ("low", "high")],
        (F.col("accuracy") - F.col("majority_share")).alias("lift_over_majority"),
        (ci["accuracy_low"] > F.col("majority_share")).alias("beats_majority_at_95ci"),
        F.lit(resamples).alias("bootstrap_resamples"),
    ]
    if latency and latency in df.columns:
        spread = compare.latency_percentiles(df, latency).agg(F.first(F.struct("*"))).scalar()
        figures += [spread["p50"].alias("latency_p50_ms"), spread["p95"].alias("latency_p95_ms")]
    return {
        "metrics": head.select(*figures),
        "report": metrics.classification_report(df),
        "reliability": calibration.reliability(df),
        "coverage": coverage.coverage_curve(df),
        "class_calibration": calibration.per_class_calibration(df),
    }


def score_system(
    df: DataFrame,
    remap: Mapping[str, str] | None = None,
    baselines: Mapping[str, Mapping[str, float | None]] = K.PUBLISHED_BASELINES,
    id_column: str = "ticket_id",
) -> dict[str, DataFrame]:
    """A system's predictions against the published baseline of its taxonomy.

    Frames `metrics`, `report`, `reliability`, `coverage` and `budget`. The taxonomy is read
    off the labels that occur, after the optional remapping.
    """
    if remap:
        df = metrics.remap_predictions(df, remap)
    head = headline(df)
    taxonomy = metrics.infer_taxonomy(df).scalar()
    known = F.lit(None).cast("double")
    for kind, figures in baselines.items():
        if figures.get("accuracy") is not None:
            known = F.when(taxonomy == kind, F.lit(float(figures["accuracy"]))).otherwise(known)
    columns: list[Column | str] = [
        taxonomy.alias("taxonomy"), "*",
        (round_exact(F.col("accuracy"), 4) > F.col("majority_share")).alias("beats_majority_baseline"),
        known.alias("baseline_accuracy"),
        (F.col("accuracy") - known).alias("accuracy_delta_vs_baseline"),
    ]
    if "latency_ms" in df.columns:
        spread = compare.latency_percentiles(df).agg(F.first(F.struct("*"))).scalar()
        columns += [spread["p50"].alias("latency_p50_ms"), spread["p95"].alias("latency_p95_ms")]
    if "input_tokens" in df.columns:
        cost = metrics.token_cost(df).agg(F.first(F.struct("*"))).scalar()
        columns += [cost["total_input_tokens"].alias("total_input_tokens"), cost["estimated_cost_usd"].alias("estimated_cost_usd")]
    return {
        "metrics": head.select(*columns),
        "report": metrics.classification_report(df),
        "reliability": calibration.reliability(df),
        "coverage": coverage.coverage_sweep(df),
        "budget": coverage.accuracy_at_budget(df, id_column=id_column),
    }


def compare_systems(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b"), check: bool = True) -> dict[str, DataFrame]:
    """Two systems on the same tickets: `summary`, `test` (McNemar), `budget`, `calibration`."""
    if check:
        compare.require_pairable(a, b)
    paired = compare.pair_systems(a, b)
    columns = [c for c in a.columns if c in set(b.columns)]
    both = a.select(F.lit(names[0]).alias("system"), *columns).unionByName(
        b.select(F.lit(names[1]).alias("system"), *columns)
    )
    latency = "latency_ms" if "latency_ms" in columns else None
    return {
        "summary": compare.summarize_systems(both, latency=latency),
        "test": compare.mcnemar(paired),
        "budget": compare.join_budgets(coverage.accuracy_at_budget(a), coverage.accuracy_at_budget(b)),
        "calibration": calibration.calibration_error(both, ["system"]),
    }


def predict_frame(df: DataFrame, category: TextClassifier, priority: TextClassifier | None, text: str = "customer_message", digits: int | None = None, **options) -> DataFrame:
    """Add category and priority predictions and the risk columns (confidences unrounded)."""
    scored = category.score(with_terms(df, text), text, "category", digits)
    if priority is not None:
        scored = priority.score(scored, text, "priority", digits)
    else:
        options.update(priority=None, priority_confidence=None)
    return rules.score_risk(scored.drop(TERMS), text=text, **options)


def evaluate_models(test: DataFrame, category: TextClassifier | None, priority: TextClassifier | None, text: str = "customer_message") -> dict[str, DataFrame]:
    """Per target `<target>_metrics`, `<target>_report` and `<target>_confusion` on the test
    part, and `errors`: the rows where any target is wrong."""
    scored = with_folded(test, text)
    frames: dict[str, DataFrame] = {}
    for target, model in (("category", category), ("priority", priority)):
        if model is None:
            continue
        scored = model.score(scored, text, target)
    scored = scored.drop(FOLDED)
    for target, model in (("category", category), ("priority", priority)):
        if model is None:
            continue
        names = {"true": target, "predicted": f"predicted_{target}"}
        frames[f"{target}_metrics"] = metrics.score_summary(metrics.confusion_cells(scored, **names))
        frames[f"{target}_report"] = metrics.classification_report(scored, true_labels_only=True, **names)
        frames[f"{target}_confusion"] = metrics.confusion_matrix(scored, **names)
    frames["errors"] = rules.errors_only(scored)
    return frames


def error_analysis(scored: DataFrame, text: str = "customer_message", **options) -> DataFrame:
    """Wrong predictions with the likely reason, under the names of the error table."""
    has = set(scored.columns)
    for target in ("category", "priority"):
        if f"{target}_confidence" not in has:
            options.setdefault(f"{target}_confidence", None)
    reasons = rules.likely_reason(rules.errors_only(scored), text=text, **options)
    return reasons.withColumn("likely_reason", F.col("error_type"))


def triage(df: DataFrame, category: TextClassifier, priority: TextClassifier, text: str = "customer_message", id_column: str = "ticket_id", metadata: Mapping[str, str] | None = None, **options) -> DataFrame:
    """One nested result per ticket: category, priority, risk, routing and model metadata.

    Confidences are rounded to four digits before the rules see them.
    """
    scored = priority.score(category.score(with_terms(df, text), text, "category"), text, "priority")
    return triage_document(rules.route_tickets(scored.drop(TERMS), text=text, **options), text, id_column, metadata)


def triage_document(routed: DataFrame, text: str = "customer_message", id_column: str = "ticket_id", metadata: Mapping[str, str] | None = None) -> DataFrame:
    about = {"model_version": "v1", "model_type": K.MODEL_TYPE, "dataset_source": None}
    about.update(metadata or {})
    return routed.select(
        F.col(id_column).cast("string").alias("ticket_id"),
        F.col(text).alias("customer_message"),
        F.struct(
            F.col("predicted_category").alias("prediction"),
            F.col("category_confidence").alias("confidence"),
            F.col("predicted_category").alias("raw_model_prediction"),
            F.lit(False).alias("fallback_applied"),
            F.col("category_distribution").alias("distribution"),
        ).alias("category"),
        F.struct(
            F.col("predicted_priority").alias("prediction"),
            F.col("priority_confidence").alias("confidence"),
            F.col("priority_distribution").alias("distribution"),
        ).alias("priority"),
        F.struct("escalation_risk", "risk_signals", "policy_sensitive").alias("risk"),
        F.struct(F.col("routing_decision").alias("decision"), "reason").alias("routing"),
        F.struct(*[F.lit(v).cast("string").alias(k) for k, v in about.items()]).alias("model_metadata"),
    )
