"""Word lists and rules: weak risk labels, risk score, routing and error reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from .columns import quoted, require_columns


def contains_terms(df: DataFrame, text: str, terms: Sequence[str], name: str = "matched_terms") -> DataFrame:
    """Add the sorted array of terms that occur as whole words, ignoring case."""
    return _lowered(df, _text=quoted(text)).select(*df.columns, tx.matched_terms(F.col("_text"), terms).alias(name))


def _lowered(df: DataFrame, **texts: Column) -> DataFrame:
    """Lower-case each text once, in a projection of its own that the matches read."""
    return df.select("*", *[F.lower(F.coalesce(c.cast("string"), F.lit(""))).alias(n) for n, c in texts.items()])


def _first_of(df: DataFrame, *names: str) -> Column:
    present = {c.lower(): c for c in df.columns}
    for name in names:
        if name in present:
            return quoted(present[name])
    return F.lit("")


def _literals(values: Sequence[str], prefix: str = "") -> Column:
    return F.array(*[F.lit(prefix + v) for v in values])


def _overlaps(found: Column, values: Sequence[str], prefix: str = "") -> Column:
    return F.arrays_overlap(found, _literals(values, prefix)) if values else F.lit(False)


def add_risk_labels(
    df: DataFrame,
    tag_terms: Sequence[str] = K.TAG_RISK_TERMS,
    text_terms: Sequence[str] = K.TEXT_RISK_TERMS,
    policy_tags: Sequence[str] = K.POLICY_TAG_TERMS,
    policy_texts: Sequence[str] = K.POLICY_TEXT_TERMS,
    urgent_texts: Sequence[str] = K.URGENT_TEXT_TERMS,
) -> DataFrame:
    """Add four 0/1 weak labels and the signals behind them.

    The text match runs over model_text, which ends with type and tags, so a tag can fire
    as text too; `data breach` is a policy signal as a tag only.
    """
    require_columns(df, ["model_text"])
    shaped = _lowered(
        df,
        _tags=_first_of(df, "combined_tags", "tags"),
        _text=quoted("model_text"),
        _priority=_first_of(df, "priority", "true_priority"),
        _type=_first_of(df, "type", "ticket_type"),
    )
    shaped = shaped.select(
        *df.columns,
        (F.col("_priority") == "high").alias("_high"),
        (F.col("_type") == "incident").alias("_incident"),
        tx.matched_terms(F.col("_tags"), tag_terms, "tag:").alias("_tag_hits"),
        tx.matched_terms(F.col("_text"), text_terms, "text:").alias("_text_hits"),
    )
    high, incident = F.col("_high"), F.col("_incident")
    tags, texts = F.col("_tag_hits"), F.col("_text_hits")
    urgency = high | incident | _overlaps(texts, urgent_texts, "text:")
    policy = _overlaps(tags, policy_tags, "tag:") | _overlaps(texts, policy_texts, "text:")
    escalation = (F.size(texts) > 0) | (F.size(tags) > 0)
    # The four parts are sorted and their prefixes follow one another alphabetically.
    signals = F.concat_ws(
        "; ",
        F.when(high, F.lit("priority:high")),
        F.nullif(F.array_join(tags, "; "), F.lit("")),
        F.nullif(F.array_join(texts, "; "), F.lit("")),
        F.when(incident, F.lit("type:incident")),
    )
    return shaped.select(
        *df.columns,
        urgency.cast("int").alias("urgency_signal"),
        policy.cast("int").alias("policy_sensitive_signal"),
        escalation.cast("int").alias("escalation_keyword_signal"),
        (policy | escalation | (high & incident)).cast("int").alias("high_risk_policy_label"),
        signals.alias("risk_signal_terms"),
    )


def risk_audit(labelled: DataFrame, columns: Sequence[str] = K.RISK_AUDIT_COLUMNS) -> DataFrame:
    """The audit columns that the labelled frame has."""
    present = {c.lower() for c in labelled.columns}
    return labelled.select(*[quoted(c) for c in columns if c in present])


RISK_FLAGS = [
    "urgency_signal",
    "policy_sensitive_signal",
    "escalation_keyword_signal",
    "high_risk_policy_label",
]


def risk_label_summary(labelled: DataFrame, split: str = "split") -> DataFrame:
    """(field, value, n): rows, rows per split and the 0/1 counts of each flag."""
    cells = labelled.groupBy(split, *RISK_FLAGS).agg(F.count(F.lit(1)).alias("n"))
    views = [
        F.struct(F.lit("rows").alias("field"), F.lit("all").alias("value")),
        F.struct(F.lit("split").alias("field"), F.col(split).alias("value")),
    ]
    views += [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in RISK_FLAGS]
    return (
        cells.select("n", F.explode(F.array(*views)).alias("v"))
        .groupBy("v.field", "v.value")
        .agg(F.sum("n").alias("n"))
    )


def policy_sensitivity(
    df: DataFrame,
    text: str = "customer_message",
    category: str | None = "predicted_category",
    terms: Sequence[str] = K.POLICY_TERMS,
    sensitive: Sequence[str] = K.SENSITIVE_CATEGORIES,
) -> DataFrame:
    """Add policy_signals (sorted terms, then `sensitive_category:<c>`) and policy_sensitive."""
    shaped = _lowered(df, _text=quoted(text))
    found = tx.matched_terms(F.col("_text"), terms)
    shaped = shaped.select(*df.columns, F.concat(found, _sensitive(category, sensitive)).alias("policy_signals"))
    return shaped.withColumn("policy_sensitive", F.size("policy_signals") > 0)


def _sensitive(category: str | None, sensitive: Sequence[str]) -> Column:
    none = F.array().cast("array<string>")
    if category is None or not sensitive:
        return none
    c = quoted(category)
    return F.when(c.isin(*sensitive), F.array(F.concat(F.lit("sensitive_category:"), c))).otherwise(none)


def escalation_risk(
    df: DataFrame,
    text: str = "customer_message",
    category: str | None = "predicted_category",
    priority: str | None = "predicted_priority",
    category_confidence: str | None = "category_confidence",
    priority_confidence: str | None = "priority_confidence",
    risk_terms: Sequence[str] = K.RISK_TERMS,
    policy_terms: Sequence[str] = K.POLICY_TERMS,
    sensitive: Sequence[str] = K.SENSITIVE_CATEGORIES,
    high_priorities: Sequence[str] = K.HIGH_PRIORITIES,
) -> DataFrame:
    """Add escalation_risk, risk_signals, policy_signals and policy_sensitive.

    The score is summed in whole hundredths, so it is exact. The signals name at most
    eight risk words and five policy signals; policy_signals names them all.
    """
    missing = F.lit(None)
    level = quoted(priority) if priority else missing.cast("string")
    sure = quoted(category_confidence) if category_confidence else missing.cast("double")
    sure_priority = quoted(priority_confidence) if priority_confidence else missing.cast("double")

    shaped = _lowered(df, _text=quoted(text)).select(
        *df.columns,
        tx.matched_terms(F.col("_text"), risk_terms, "risk_keyword:").alias("_risk"),
        tx.matched_terms(F.col("_text"), policy_terms, "policy:").alias("_policy_words"),
        F.concat(tx.matched_terms(F.col("_text"), policy_terms), _sensitive(category, sensitive)).alias("policy_signals"),
    )
    named = F.col("_policy_words")
    if category and sensitive:
        c = quoted(category)
        named = F.when(
            c.isin(*sensitive), F.concat(named, F.array(F.concat(F.lit("policy:sensitive_category:"), c)))
        ).otherwise(named)
    policy = F.size("policy_signals") > 0
    high = F.coalesce(level.isin(*high_priorities), F.lit(False))
    medium = F.coalesce(level == "medium", F.lit(False))
    unsure = F.coalesce(sure < K.LOW_CATEGORY_CONFIDENCE, F.lit(False))
    unsure_priority = F.coalesce(sure_priority < K.LOW_PRIORITY_CONFIDENCE, F.lit(False))
    hundredths = (
        F.lit(10)
        + F.least(F.lit(45), 8 * F.size("_risk"))
        + F.when(policy, 18).otherwise(0)
        + F.when(high, 16).when(medium, 6).otherwise(0)
        + F.when(unsure, 8).otherwise(0)
        + F.when(unsure_priority, 5).otherwise(0)
    )
    flags = tx.present(
        [
            F.when(high, F.concat(F.lit("high_priority:"), level)),
            F.when(unsure, F.lit("low_category_confidence")),
            F.when(unsure_priority, F.lit("low_priority_confidence")),
            F.when(medium & ~high, F.lit("medium_priority")),
        ]
    )
    signals = F.concat(flags, F.slice(named, 1, 5), F.slice("_risk", 1, 8))
    return shaped.select(
        *df.columns,
        (F.least(F.lit(99), hundredths).cast("double") / F.lit(100.0)).alias("escalation_risk"),
        F.array_sort(F.array_distinct(signals)).alias("risk_signals"),
        named.alias("_policy_named"),
        "policy_signals",
        policy.alias("policy_sensitive"),
    )


def score_risk(df: DataFrame, **options) -> DataFrame:
    """`escalation_risk` without its working column."""
    return escalation_risk(df, **options).drop("_policy_named")


def route_tickets(
    df: DataFrame,
    low_confidence: float = K.LOW_CATEGORY_CONFIDENCE,
    high_risk: float = K.HIGH_RISK,
    confidence: str | None = None,
    **options,
) -> DataFrame:
    """Add the risk columns plus routing_decision and reason.

    The rules apply in order: high risk, policy, low category confidence, high priority
    that the priority model is sure of, and otherwise an automatic suggestion. Options are
    those of `escalation_risk`; `confidence` stands in for a null category confidence.
    """
    columns = list(df.columns)
    sure_name = options.get("category_confidence", "category_confidence")
    work = df
    if confidence:
        first = quoted(sure_name) if sure_name else F.lit(None).cast("double")
        work = df.withColumn("_sure", F.coalesce(first, quoted(confidence)))
        options["category_confidence"] = sure_name = "_sure"
    scored = escalation_risk(work, **options)
    sure = quoted(sure_name) if sure_name else F.lit(None).cast("double")
    priority = options.get("priority", "predicted_priority")
    priority_name = options.get("priority_confidence", "priority_confidence")
    level = quoted(priority) if priority else F.lit(None).cast("string")
    sure_priority = quoted(priority_name) if priority_name else F.lit(None).cast("double")
    high = level.isin(*options.get("high_priorities", K.HIGH_PRIORITIES))
    sure_of_priority = sure_priority.isNull() | (sure_priority >= K.LOW_PRIORITY_CONFIDENCE)
    rules = [
        (F.col("escalation_risk") >= high_risk, K.HIGH_RISK_OUTCOME),
        (F.col("policy_sensitive"), K.POLICY_OUTCOME),
        (sure < low_confidence, K.LOW_CONFIDENCE_OUTCOME),
        (high & sure_of_priority, K.HIGH_PRIORITY_OUTCOME),
        (F.lit(True), K.DEFAULT_OUTCOME),
    ]
    outcome = F
    for test, (decision, reason) in rules:
        outcome = outcome.when(test, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason")))
    signals = F.array_sort(F.array_union("risk_signals", "_policy_named"))
    return scored.select(
        *columns,
        "escalation_risk",
        outcome["decision"].alias("routing_decision"),
        outcome["reason"].alias("reason"),
        signals.alias("risk_signals"),
        "policy_sensitive",
    )


def route_threshold(value: str | float | None) -> float:
    """Threshold from configuration: clamped to [0, 1], unreadable or absent -> the default."""
    if value is None:
        return K.ROUTE_THRESHOLD
    try:
        return min(max(float(value), 0.0), 1.0)
    except ValueError:
        return K.ROUTE_THRESHOLD


def gate_decision(confidence: Column, threshold: float = K.ROUTE_THRESHOLD) -> Column:
    return F.when(confidence >= F.lit(float(threshold)), "auto_route").otherwise("human_review")


def likely_reason(
    df: DataFrame,
    text: str = "customer_message",
    category: str = "category",
    category_confidence: str | None = "category_confidence",
    priority_confidence: str | None = "priority_confidence",
    name: str = "error_type",
    ambiguous: Sequence[str] = K.AMBIGUOUS_TERMS,
    intents: Sequence[str] = K.MULTI_INTENT_TERMS,
    metadata: Sequence[str] = K.METADATA_TERMS,
    overlapping: Sequence[str] = K.OVERLAPPING_CATEGORIES,
) -> DataFrame:
    """Add the first reason that fits a wrong prediction. Terms match inside words here."""
    none = F.lit(None).cast("double")
    sure = quoted(category_confidence) if category_confidence else none
    sure_priority = quoted(priority_confidence) if priority_confidence else none
    lowered = F.col("_text")
    words = tx.token_count(lowered)
    reason = (
        F.when(sure < K.LOW_REASON_CONFIDENCE, "low_confidence")
        .when(sure_priority < K.LOW_REASON_CONFIDENCE, "priority_depends_on_metadata")
        .when(tx.substring_count(lowered, intents) >= 3, "multiple_intents")
        .when(tx.any_substring(lowered, ambiguous) & (words < 45), "ambiguous_text")
        .when(quoted(category).isin(*overlapping), "label_overlap")
        .when(tx.any_substring(lowered, metadata), "priority_depends_on_metadata")
        .when(words < 20, "insufficient_examples")
        .otherwise("possible_label_noise")
    )
    return _lowered(df, _text=quoted(text)).select(*df.columns, reason.alias(name))


def error_confidence_type(confidence: Column) -> Column:
    return F.when(confidence < K.LOW_ERROR_CONFIDENCE, "low_confidence").otherwise("high_confidence")


def errors_only(df: DataFrame) -> DataFrame:
    """Rows with a wrong category or a wrong priority, with the flags that say which.

    A target without a predicted column does not count as wrong; neither does a null
    prediction, which stands for a missing model.
    """
    flags, names = [], []
    for target in ("category", "priority"):
        if f"predicted_{target}" in df.columns:
            predicted = quoted(f"predicted_{target}")
            flags.append((predicted.isNull() | quoted(target).eqNullSafe(predicted)).alias(f"{target}_correct"))
            names.append(f"{target}_correct")
    if not names:
        return df.where(F.lit(False))
    wrong = F.lit(False)
    for name in names:
        wrong = wrong | ~F.col(name)
    return df.select("*", *flags).where(wrong)


def wrong_labels(df: DataFrame, true: str = "true_label", predicted: str = "predicted_label", confidence: str = "confidence") -> DataFrame:
    """Misclassified rows of one target, with the confidence kind."""
    wrong = ~quoted(true).eqNullSafe(quoted(predicted))
    return df.where(wrong).withColumn("error_confidence_type", error_confidence_type(quoted(confidence)))


def error_breakdown(errors: DataFrame, kind: str = "error_type") -> DataFrame:
    return errors.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), kind)
