"""Classification metrics from one aggregate: rows per (true label, predicted label).

Every metric here is a function of those cells. The table is read once and reduced on the
map side to at most K*K rows per group; all that follows is work on that small frame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.labels import map_label
from ..functions.numeric import ratio

TRUE, PREDICTED, CONFIDENCE = "true_label", "predicted_label", "confidence"


def confusion_cells(df: DataFrame, by: Sequence[str] = (), true: str = TRUE, predicted: str = PREDICTED) -> DataFrame:
    """(by..., true_label, predicted_label, n)."""
    keys = [F.col(true).alias(TRUE), F.col(predicted).alias(PREDICTED)]
    return df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, labels: Sequence[str] | None = None, **names) -> DataFrame:
    """Square long-form matrix over the label list (default: all labels seen), zeros included."""
    cells = confusion_cells(df, **names)
    if labels is None:
        seen = F.array_sort(F.array_distinct(F.concat(F.collect_set(TRUE), F.collect_set(PREDICTED))))
        frame = cells.agg(seen.alias("labels"))
    else:
        frame = cells.agg(F.array(*[F.lit(x) for x in labels]).alias("labels"))
    grid = frame.select("labels", F.explode("labels").alias(TRUE)).select(
        TRUE, F.explode("labels").alias(PREDICTED), F.lit(0).cast("long").alias("n")
    )
    inside = cells if labels is None else cells.where(F.col(TRUE).isin(*labels) & F.col(PREDICTED).isin(*labels))
    return inside.unionByName(grid).groupBy(TRUE, PREDICTED).agg(F.sum("n").alias("n"))


def top_confusions(df: DataFrame, top: int | None = None, **names) -> DataFrame:
    """Wrong cells, largest first."""
    wrong = confusion_cells(df, **names).where(~F.col(TRUE).eqNullSafe(F.col(PREDICTED)))
    ordered = wrong.orderBy(F.desc("n"), TRUE, PREDICTED)
    return ordered if top is None else ordered.limit(top)


def label_totals(cells: DataFrame, by: Sequence[str] = (), n: str = "n") -> DataFrame:
    """(by..., label, support, predicted, tp): each cell counts for its true and its predicted label."""
    zero = F.lit(0).cast("long")
    count = F.col(n)
    hit = F.when(F.col(TRUE).eqNullSafe(F.col(PREDICTED)), count).otherwise(zero)
    sides = F.array(
        F.struct(F.col(TRUE).alias("label"), count.alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col(PREDICTED).alias("label"), zero.alias("support"), count.alias("predicted"), zero.alias("tp")),
    )
    return (
        cells.select(*by, F.explode(sides).alias("s"))
        .select(*by, "s.*")
        .groupBy(*by, "label")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
        .where((F.col("support") > 0) | (F.col("predicted") > 0))
    )


def class_scores(totals: DataFrame) -> DataFrame:
    """Add precision, recall and f1_score; a zero denominator scores 0."""
    return (
        totals.withColumn("precision", ratio(F.col("tp"), F.col("predicted"), 0.0))
        .withColumn("recall", ratio(F.col("tp"), F.col("support"), 0.0))
        .withColumn("f1_score", ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"), 0.0))
    )


def _weighted(name: str) -> Column:
    return F.sum(F.col(name) * F.col("support")) / F.sum("support")


def score_summary(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, n_correct, accuracy, macro_f1, weighted_f1) over the labels that occur."""
    scored = class_scores(label_totals(cells, by))
    return scored.groupBy(*by).agg(
        F.sum("support").alias("n"),
        F.sum("tp").alias("n_correct"),
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("f1_score").alias("macro_f1"),
        _weighted("f1_score").alias("weighted_f1"),
    )


def accuracy(df: DataFrame, by: Sequence[str] = (), **names) -> DataFrame:
    return score_summary(confusion_cells(df, by, **names), by).select(*by, "n", "n_correct", "accuracy")


def classification_report(
    df: DataFrame, by: Sequence[str] = (), true_labels_only: bool = False, **names
) -> DataFrame:
    """(by..., section, label, precision, recall, f1_score, support).

    Sections: `class` (one row per label), `accuracy`, `macro avg` and `weighted avg`. The
    accuracy row repeats the accuracy in every column. With `true_labels_only` the report is
    confined to labels that occur as truth; if other labels were predicted, a `micro avg` row
    replaces the accuracy row.
    """
    scored = class_scores(label_totals(confusion_cells(df, by, **names), by))
    sections = F.explode(F.array(*[F.lit(s) for s in ("class", "accuracy", "macro avg", "weighted avg")]))
    exploded = scored.select("*", sections.alias("section"))
    label = F.when(F.col("section") == "class", F.col("label"))
    counted = (F.col("support") > 0) if true_labels_only else F.lit(True)
    grouped = exploded.groupBy(*by, "section", label.alias("label")).agg(
        *[F.avg(F.when(counted, F.col(m))).alias(f"mean_{m}") for m in ("precision", "recall", "f1_score")],
        *[_weighted(m).alias(f"weighted_{m}") for m in ("precision", "recall", "f1_score")],
        F.sum("support").alias("support"),
        F.sum("tp").alias("tp"),
        F.sum(F.when(counted, F.col("predicted"))).alias("predicted"),
        F.count_if(~counted).alias("outside"),
    )
    if true_labels_only:
        grouped = grouped.where((F.col("section") != "class") | (F.col("support") > 0))
    section = F.col("section")
    micro = (section == "accuracy") & (F.col("outside") > 0)
    share = {
        "precision": ratio(F.col("tp"), F.col("predicted"), 0.0),
        "recall": ratio(F.col("tp"), F.col("support"), 0.0),
        "f1_score": ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"), 0.0),
    }

    def value(name: str) -> Column:
        return (
            F.when(section == "weighted avg", F.col(f"weighted_{name}"))
            .when(micro, share[name])
            .when(section == "accuracy", share["recall"])
            .otherwise(F.col(f"mean_{name}"))
            .alias(name)
        )

    support = F.when((section == "accuracy") & ~micro, share["recall"]).otherwise(F.col("support").cast("double"))
    return grouped.select(
        *by,
        F.when(micro, F.lit("micro avg")).otherwise(section).alias("section"),
        "label",
        value("precision"),
        value("recall"),
        value("f1_score"),
        support.alias("support"),
    )


def majority_baseline(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., majority_label, majority_n, n, majority_share); ties go to the first label."""
    counts = cells.groupBy(*by, TRUE).agg(F.sum("n").alias("n"))
    best = F.min_by(F.struct(F.col(TRUE).alias("label"), "n"), F.struct(-F.col("n"), F.col(TRUE)))
    return counts.groupBy(*by).agg(best.alias("best"), F.sum("n").alias("n")).select(
        *by,
        F.col("best.label").alias("majority_label"),
        F.col("best.n").alias("majority_n"),
        "n",
        ratio(F.col("best.n"), F.col("n")).alias("majority_share"),
    )


def infer_taxonomy(df: DataFrame, merged: Sequence[str] = K.MERGED_ONLY_LABELS, true: str = TRUE, predicted: str = PREDICTED) -> DataFrame:
    """One row: the merged taxonomy if one of its own labels occurs, else the source one."""
    occurs = F.coalesce(F.col(true).isin(*merged), F.lit(False)) | F.coalesce(F.col(predicted).isin(*merged), F.lit(False))
    return df.agg(
        F.when(F.max(occurs), K.MERGED_TAXONOMY).otherwise(K.SOURCE_TAXONOMY).alias("taxonomy")
    )


def remap_predictions(df: DataFrame, mapping: Mapping[str, str] = K.MERGED_QUEUE_MAP, true: str = TRUE, predicted: str = PREDICTED) -> DataFrame:
    """Both label columns in the target taxonomy."""
    return df.withColumns({true: map_label(F.col(true), mapping), predicted: map_label(F.col(predicted), mapping)})


def token_cost(df: DataFrame, tokens: str = "input_tokens", price: float = K.TOKEN_PRICE_PER_MILLION) -> DataFrame:
    """One row: total input tokens and their price."""
    total = F.sum(F.col(tokens).try_cast("double"))
    return df.agg(
        total.cast("long").alias("total_input_tokens"), (total / 1e6 * F.lit(price)).alias("estimated_cost_usd")
    )
