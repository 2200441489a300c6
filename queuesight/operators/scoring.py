"""Scoring by a model the user supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.labels import best_label, complete_probabilities, ranked_probabilities
from ..functions.numeric import round_exact
from .compare import not_yet_scored
from .rules import gate_decision

Scorer = Callable[[list[str]], list[dict[str, float]]]


def score_external(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    text: str = "input_text",
    batch_size: int = K.SCORING_BATCH,
    partitions: int | None = None,
) -> DataFrame:
    """Add probabilities, latency_ms and error from a scorer of text batches.

    `make_scorer` is called once per task; the scorer it returns maps a list of texts to one
    label -> probability dict each. Texts go in batches of `batch_size`, and the latency of a
    text is its batch's time over the batch size. When a batch fails its texts are tried one
    by one; one that still fails keeps null probabilities and its error, and the run goes on.
    `partitions` sets how many scorers work side by side.
    """
    source = df if partitions is None else df.repartition(partitions)

    @F.pandas_udf("probabilities map<string,double>, latency_ms double, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import time

        scorer = make_scorer()

        def attempt(texts):
            started = time.perf_counter()
            found = [{str(k): float(v) for k, v in p.items()} for p in scorer(texts)]
            if len(found) != len(texts):
                raise ValueError(f"the scorer gave {len(found)} results for {len(texts)} texts")
            return found, (time.perf_counter() - started) * 1000.0 / len(texts)

        for batch in batches:
            results = []
            texts = batch.tolist()
            for start in range(0, len(texts), batch_size):
                part = texts[start : start + batch_size]
                try:
                    found, each = attempt(part)
                    results += [(p, each, None) for p in found]
                except Exception:
                    for one in part:
                        try:
                            found, each = attempt([one])
                            results.append((found[0], each, None))
                        except Exception as problem:
                            results.append((None, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(results, columns=["probabilities", "latency_ms", "error"])

    # Only the text goes through Python. Scored once: a scorer is no function to be run twice.
    scored = source.select("*", run.asNondeterministic()(F.col(text)).alias("_scored"))
    return scored.select(*source.columns, "_scored.probabilities", "_scored.latency_ms", "_scored.error")


def prediction_records(scored: DataFrame, labels: Sequence[str] = K.QUEUES, digits: int = 6) -> DataFrame:
    """Prediction columns from a `probabilities` map over the given labels.

    Adds predicted_label (ties by label), confidence, top_1/top_2 probability and their
    margin, and completes the map to exactly the labels.
    """
    ranked = ranked_probabilities(F.col("probabilities"))
    shaped = scored.withColumn("_ranked", ranked)

    def place(i: int):
        return round_exact(F.coalesce(F.get("_ranked", F.lit(i))["probability"], F.lit(0.0)), digits)

    exact = F.coalesce(F.get("_ranked", F.lit(0))["probability"], F.lit(0.0)) - F.coalesce(
        F.get("_ranked", F.lit(1))["probability"], F.lit(0.0)
    )
    return shaped.select(
        *[c for c in scored.columns if c != "probabilities"],
        F.get("_ranked", F.lit(0))["label"].alias("predicted_label"),
        place(0).alias("confidence"),
        place(0).alias("top_1_probability"),
        place(1).alias("top_2_probability"),
        round_exact(exact, digits).alias("top1_top2_margin"),
        complete_probabilities(F.col("probabilities"), labels, digits).alias("probabilities"),
    )


def resume_scoring(tickets: DataFrame, scored: DataFrame | None, make_scorer: Callable[[], Scorer], id_column: str = "ticket_id", **options) -> DataFrame:
    """Score only the tickets that have no stored prediction yet."""
    todo = tickets if scored is None else not_yet_scored(tickets, scored, id_column)
    return score_external(todo, make_scorer, **options)


def route_scored(scored: DataFrame, model_id: str, threshold: float = K.ROUTE_THRESHOLD, labels: Sequence[str] = K.QUEUES) -> DataFrame:
    """Routing-log records from scored tickets: queue, confidence, decision and metadata.

    A model whose labels are not exactly the queues gives records that validation rejects.
    """
    exact = F.array_sort(F.map_keys("probabilities")) == F.array(*[F.lit(x) for x in sorted(labels)])
    shaped = scored.withColumn("_top", best_label(F.col("probabilities")))
    confidence = round_exact(-F.col("_top.key"), 6)
    rounded = F.when(exact, complete_probabilities(F.col("probabilities"), labels)).otherwise(F.col("probabilities"))
    kept = [c for c in scored.columns if c not in ("probabilities", "latency_ms", "predicted_queue", "confidence")]
    return shaped.select(
        *kept,
        F.col("_top.label").alias("predicted_queue"),
        confidence.alias("confidence"),
        F.lit(float(threshold)).alias("threshold"),
        gate_decision(confidence, threshold).alias("decision"),
        rounded.alias("probabilities"),
        F.lit(model_id).alias("model_id"),
        F.greatest(F.lit(0), F.round(F.coalesce(F.col("latency_ms"), F.lit(0.0))).cast("int")).alias("latency_ms"),
    )
