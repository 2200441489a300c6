"""Bootstrap confidence intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .metrics import PREDICTED, TRUE, confusion_cells


def bootstrap_replicates(df: DataFrame, resamples: int = K.BOOTSTRAP_RESAMPLES, seed: int = K.SEED, **names) -> DataFrame:
    """(replicate, accuracy, macro_f1, weighted_f1) for each resample of the rows.

    Drawing n rows with replacement and counting (true, predicted) pairs is one multinomial
    draw over those pairs. The table is therefore reduced to its K*K cells once; the
    resamples are drawn from the cells in parallel, at the same cost for any table size.
    """
    spark = df.sparkSession
    cells = [(r[TRUE], r[PREDICTED], r["n"]) for r in confusion_cells(df, **names).orderBy(TRUE, PREDICTED).collect()]
    schema = "replicate long, accuracy double, macro_f1 double, weighted_f1 double"
    if not cells:
        return spark.createDataFrame([], schema)
    labels = sorted({c[0] for c in cells} | {c[1] for c in cells}, key=str)
    place = {label: i for i, label in enumerate(labels)}
    true_at = [place[t] for t, _, _ in cells]
    predicted_at = [place[p] for _, p, _ in cells]
    counts = [n for _, _, n in cells]
    size = len(labels)

    def draw(batches):
        import numpy as np
        import pandas as pd

        counted = np.asarray(counts, dtype="float64")
        rows, share = int(sum(counts)), counted / counted.sum()
        to_true = np.eye(size)[true_at]
        to_predicted = np.eye(size)[predicted_at]
        to_hit = to_true * to_predicted
        for batch in batches:
            drawn = np.stack(
                [np.random.default_rng([seed, int(i)]).multinomial(rows, share) for i in batch["id"]]
            ).astype("float64")
            support, predicted, hits = drawn @ to_true, drawn @ to_predicted, drawn @ to_hit
            either = support + predicted
            f1 = np.divide(2 * hits, either, out=np.zeros_like(hits), where=either > 0)
            yield pd.DataFrame(
                {
                    "replicate": batch["id"],
                    "accuracy": hits.sum(axis=1) / rows,
                    "macro_f1": f1.sum(axis=1) / (either > 0).sum(axis=1),
                    "weighted_f1": (f1 * support).sum(axis=1) / rows,
                }
            )

    return spark.range(resamples).mapInPandas(draw, schema)


def bootstrap_ci(df: DataFrame, resamples: int = K.BOOTSTRAP_RESAMPLES, seed: int = K.SEED, **names) -> DataFrame:
    """(metric, low, high): 95% percentile intervals of accuracy, macro-F1 and weighted-F1."""
    metrics = ["accuracy", "macro_f1", "weighted_f1"]
    drawn = bootstrap_replicates(df, resamples, seed, **names)
    ends = drawn.agg(*[F.percentile(m, [0.025, 0.975]).alias(m) for m in metrics])
    listed = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m)[0].alias("low"), F.col(m)[1].alias("high")) for m in metrics]
    )
    return ends.select(F.explode(listed).alias("m")).select("m.*")
