"""Comparing two systems on the same tickets, and tables of metrics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import correct_flag
from .metrics import PREDICTED, TRUE, confusion_cells, score_summary
from .ranks import exact_percentiles


def pair_systems(a: DataFrame, b: DataFrame, id_column: str = "ticket_id", suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Inner join of two prediction tables on the ticket id, columns suffixed, with correct flags."""

    def side(df: DataFrame, suffix: str) -> DataFrame:
        flagged = df.withColumn("correct", correct_flag(F.col(TRUE), F.col(PREDICTED)))
        return flagged.select(
            F.col(id_column), *[F.col(c).alias(c + suffix) for c in flagged.columns if c != id_column]
        )

    return side(a, suffixes[0]).join(side(b, suffixes[1]), id_column)


def label_agreement(paired: DataFrame, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """One row: pairs and how many of them disagree on the true label."""
    differ = ~F.col(TRUE + suffixes[0]).eqNullSafe(F.col(TRUE + suffixes[1]))
    return paired.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(differ).alias("mismatches"))


def repeated_ids(df: DataFrame, id_column: str = "ticket_id") -> DataFrame:
    """Ids that occur more than once; a pairing would multiply their rows."""
    return df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def require_pairable(a: DataFrame, b: DataFrame, id_column: str = "ticket_id") -> None:
    """Raise when an id repeats in either table or the true labels differ."""
    for name, side in (("first", a), ("second", b)):
        if not repeated_ids(side, id_column).isEmpty():
            raise ValueError(f"{id_column} is not unique in the {name} table")
    mismatches = label_agreement(pair_systems(a, b, id_column)).first()["mismatches"]
    if mismatches:
        raise ValueError(f"the true labels differ on {mismatches} tickets")


def mcnemar_counts(paired: DataFrame, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """One row: pairs, tickets only the first system got right, only the second."""
    first, second = F.col("correct" + suffixes[0]), F.col("correct" + suffixes[1])
    return paired.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if((first == 1) & (second == 0)).alias("only_first"),
        F.count_if((first == 0) & (second == 1)).alias("only_second"),
    )


def exact_binomial_p(wins: Column, losses: Column) -> Column:
    """Two-sided exact binomial p-value at one half, for a column of a few rows; null for 0 and 0."""

    @F.pandas_udf(T.DoubleType())
    def p_value(left, right):
        import math

        import pandas as pd

        def one(b: int, c: int) -> float:
            n, least = b + c, min(b, c)
            if b == c:
                return 1.0
            # Terms fall off at least geometrically below the smaller count; those beyond
            # this distance no longer change the sum of doubles.
            start = max(0, least - int(12 * math.sqrt(n)) - 60)
            top = math.lgamma(n + 1) - math.lgamma(least + 1) - math.lgamma(n - least + 1) - n * math.log(2)
            total, term = 1.0, 1.0
            for k in range(least, start, -1):
                term *= k / (n - k + 1)
                total += term
                if term < total * 1e-18:
                    break
            return min(1.0, 2 * math.exp(top + math.log(total)))

        return pd.Series([one(int(b), int(c)) if b + c else None for b, c in zip(left, right)], dtype="float64")

    return p_value(wins.cast("long"), losses.cast("long"))


def mcnemar(paired: DataFrame, suffixes: tuple[str, str] = ("_a", "_b"), level: float = 0.05) -> DataFrame:
    """`mcnemar_counts` with the exact p-value and the verdict; both null without disagreement."""
    p = exact_binomial_p(F.col("only_first"), F.col("only_second"))
    counted = mcnemar_counts(paired, suffixes).withColumn("p_value", p)
    return counted.withColumn("significant", F.col("p_value") < level)


def summarize_systems(df: DataFrame, system: str = "system", latency: str | None = "latency_ms") -> DataFrame:
    """Accuracy, macro-F1, weighted-F1 and median latency of each system."""
    scored = score_summary(confusion_cells(df, [system]), [system])
    if latency is None:
        return scored
    middle = exact_percentiles(df, latency, {"median_latency_ms": 0.5}, [system]).drop("n")
    return scored.join(middle, system, "left")


def join_budgets(a: DataFrame, b: DataFrame, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Two accuracy-at-budget tables side by side (a row per budget)."""
    keys = ["human_review_budget", "auto_routed"]
    left = a.select(*keys, F.col("accuracy_on_auto").alias("accuracy_on_auto" + suffixes[0]))
    right = b.select(*keys, F.col("accuracy_on_auto").alias("accuracy_on_auto" + suffixes[1]))
    return left.join(right, keys)


def latency_percentiles(df: DataFrame, latency: str = "latency_ms", by: Sequence[str] = ()) -> DataFrame:
    """Exact p50 and p95 with linear interpolation; nulls and unreadable values left out."""
    return exact_percentiles(
        df.withColumn(latency, F.col(latency).try_cast("double")), latency, {"p50": 0.5, "p95": 0.95}, by
    )


METRICS = ["accuracy", "macro_f1", "weighted_f1"]


def metric_row(summary: DataFrame, task: str, model: str, notes: str = "") -> DataFrame:
    """A `score_summary` row labelled for the leaderboard."""
    return summary.select(
        F.lit(task).alias("task"), F.lit(model).alias("model_name"), *METRICS, F.lit(notes).alias("notes")
    )


def leaderboard(tables: Iterable[DataFrame | None]) -> DataFrame:
    """Union of metric rows: by task, then macro-F1 and weighted-F1, best first, nulls last.

    A run without metrics (None) is skipped.
    """
    rows = None
    for table in tables:
        if table is not None:
            rows = table if rows is None else rows.unionByName(table, allowMissingColumns=True)
    if rows is None:
        raise ValueError("no metric tables")
    return rows.orderBy("task", F.desc_nulls_last("macro_f1"), F.desc_nulls_last("weighted_f1"), "model_name")


def metric_delta(metrics: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(task, metric, baseline, candidate, delta) where both models have the metric."""
    long = metrics.select(
        "task", "model_name",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("m"),
    ).select("task", "model_name", "m.*")
    both = long.groupBy("task", "metric").agg(
        F.max(F.when(F.col("model_name") == baseline, F.col("value"))).alias("baseline"),
        F.max(F.when(F.col("model_name") == candidate, F.col("value"))).alias("candidate"),
    )
    return both.where(F.col("baseline").isNotNull() & F.col("candidate").isNotNull()).withColumn(
        "delta", F.col("candidate") - F.col("baseline")
    )


def not_yet_scored(tickets: DataFrame, scored: DataFrame, id_column: str = "ticket_id") -> DataFrame:
    """Tickets without a prediction so far; ids are compared as text."""
    done = scored.select(F.col(id_column).cast("string").alias("_done")).distinct()
    return tickets.join(done, tickets[id_column].cast("string") == done["_done"], "left_anti")


def only_scored(tickets: DataFrame, scored: DataFrame, id_column: str = "ticket_id") -> DataFrame:
    """Tickets the other system has scored."""
    done = scored.select(F.col(id_column).cast("string").alias("_done")).distinct()
    return tickets.join(done, tickets[id_column].cast("string") == done["_done"], "left_semi")


def running_accuracy(df: DataFrame, order: str, every: int = 25, true: str = TRUE, predicted: str = PREDICTED) -> DataFrame:
    """(done, n_correct, accuracy) after each `every` rows and at the end.

    `order` is a dense 0-based position. Rows are reduced to one per step first; the running
    total is taken over the steps, range by range, so no task sees more than a slice of them.
    """
    correct = correct_flag(F.col(true), F.col(predicted)).cast("long")
    steps = df.groupBy(F.floor(F.col(order) / every).cast("long").alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(correct).alias("right")
    ).withColumn("part", F.floor(F.sqrt(F.col("step").cast("double"))).cast("long"))
    # Part k holds the steps k*k .. (k+1)*(k+1)-1: both windows see about sqrt(steps) rows.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = steps.groupBy("part").agg(F.sum("n").alias("n"), F.sum("right").alias("right")).select(
        "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("right").over(before), F.lit(0)).alias("right_before"),
    )
    inside = Window.partitionBy("part").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    running = steps.select(
        "part", "step", F.sum("n").over(inside).alias("n_in"), F.sum("right").over(inside).alias("right_in")
    ).join(parts, "part")
    done, right = F.col("n_before") + F.col("n_in"), F.col("right_before") + F.col("right_in")
    return running.select(
        done.alias("done"), right.alias("n_correct"), (right.cast("double") / done.cast("double")).alias("accuracy")
    )


def throughput(scored: DataFrame, completed: str = "completed_at") -> DataFrame:
    """One row: rows scored, rows per second and accuracy of a finished run.

    The seconds lie between the first and the last completion time; a run without any has
    no rate.
    """
    at = F.unix_micros(F.col(completed).cast("timestamp"))
    seconds = (F.max(at) - F.min(at)) / 1e6
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.try_divide(F.count(F.lit(1)).cast("double"), seconds).alias("rows_per_second"),
        F.avg(correct_flag(F.col(TRUE), F.col(PREDICTED))).alias("accuracy"),
    )
