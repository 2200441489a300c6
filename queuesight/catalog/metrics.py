"""Queries on predictions: scores, calibration, coverage, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import bootstrap, calibration, compare, coverage, metrics, splits
from ..plans import evaluation
from ..sources.readers import prepare_predictions
from .views import PRED_A, PRED_B, RAW_PREDICTIONS, View, class_scores_sql, coverage_sql, query, summary_sql


def rounded(df, *names, digits=8):
    """Sums of doubles depend on their order in the last bits; compare them to 8 digits."""
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


_CELLS = "(SELECT true_label, predicted_label, COUNT(*) AS n FROM p GROUP BY ALL)"
_A = f"WITH p AS ({PRED_A.sql})"
_BOTH = (
    f"SELECT 'a' AS system, * FROM ({PRED_A.sql}) UNION ALL SELECT 'b' AS system, * FROM ({PRED_B.sql})"
)


def both_systems(spark, sf):
    return PRED_A.frame(spark, sf).select(F.lit("a").alias("system"), "*").unionByName(
        PRED_B.frame(spark, sf).select(F.lit("b").alias("system"), "*")
    )


@query(
    f"""SELECT ticket_id, true_label, predicted_label,
        CASE WHEN ticket_id::BIGINT % 10 < 5 THEN 0e0 ELSE CAST(confidence AS DOUBLE) END AS confidence,
        top_1_probability, top_2_probability,
        round_even((top_1_probability - COALESCE(top_2_probability, 0e0)) * 1e4, 0) / 1e4 AS top1_top2_margin
        FROM (SELECT * REPLACE (CASE WHEN ticket_id::BIGINT % 10 < 5 THEN NULL ELSE confidence END AS confidence)
              FROM ({RAW_PREDICTIONS.sql}))"""
)
def read_predictions(spark, sf):
    return prepare_predictions(RAW_PREDICTIONS.frame(spark, sf))


@query(
    f"""{_A} SELECT 'class' AS section, label, precision, recall, f1_score, CAST(support AS DOUBLE) AS support
        FROM ({class_scores_sql(_CELLS)})
        UNION ALL SELECT 'macro avg', NULL, round(AVG(precision), 8), round(AVG(recall), 8), round(AVG(f1_score), 8), SUM(support)
        FROM ({class_scores_sql(_CELLS)})
        UNION ALL SELECT 'weighted avg', NULL, round(SUM(precision * support) / SUM(support), 8),
               round(SUM(recall * support) / SUM(support), 8), round(SUM(f1_score * support) / SUM(support), 8), SUM(support)
        FROM ({class_scores_sql(_CELLS)})
        UNION ALL SELECT 'accuracy', NULL, a, a, a, a
        FROM (SELECT AVG(CASE WHEN true_label = predicted_label THEN 1e0 ELSE 0e0 END) AS a FROM p)"""
)
def classification_report(spark, sf):
    report = metrics.classification_report(PRED_A.frame(spark, sf))
    names = ("precision", "recall", "f1_score")
    average = F.col("section").isin("macro avg", "weighted avg")
    return report.select(
        *[F.when(average, F.round(c, 8)).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in report.columns]
    )


# Two true labels folded into a third, so that the system predicts labels no ticket has.
_FOLDED = View(
    PRED_B,
    "ticket_id",
    "CASE WHEN true_label IN ('purchase', 'signup') THEN 'click' ELSE true_label END AS true_label",
    "predicted_label",
)
_TRUE_ONLY = f"(SELECT * FROM ({class_scores_sql('cells')}) WHERE support > 0)"


@query(
    f"""WITH p AS ({_FOLDED.sql}), cells AS (SELECT true_label, predicted_label, COUNT(*) AS n FROM p GROUP BY ALL)
        SELECT 'class' AS section, label, precision, recall, f1_score, CAST(support AS DOUBLE) AS support FROM {_TRUE_ONLY}
        UNION ALL SELECT 'macro avg', NULL, round(AVG(precision), 8), round(AVG(recall), 8), round(AVG(f1_score), 8), SUM(support) FROM {_TRUE_ONLY}
        UNION ALL SELECT 'weighted avg', NULL, round(SUM(precision * support) / SUM(support), 8),
               round(SUM(recall * support) / SUM(support), 8), round(SUM(f1_score * support) / SUM(support), 8), SUM(support) FROM {_TRUE_ONLY}
        UNION ALL SELECT 'micro avg', NULL, round(CAST(SUM(tp) AS DOUBLE) / SUM(predicted), 8), round(CAST(SUM(tp) AS DOUBLE) / SUM(support), 8),
               round(CAST(2 * SUM(tp) AS DOUBLE) / (SUM(support) + SUM(predicted)), 8), SUM(support) FROM {_TRUE_ONLY}"""
)
def classification_report_true_labels(spark, sf):
    """Labels that are only predicted: the report has a micro average in place of accuracy."""
    report = metrics.classification_report(_FOLDED.frame(spark, sf), true_labels_only=True)
    names = ("precision", "recall", "f1_score")
    average = F.col("section") != "class"
    return report.select(
        *[F.when(average, F.round(c, 8)).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in report.columns]
    )


@query(
    f"""WITH p AS ({PRED_A.sql}), labels AS (SELECT true_label AS l FROM p UNION SELECT predicted_label FROM p)
        SELECT a.l AS true_label, b.l AS predicted_label,
               (SELECT COUNT(*) FROM p WHERE true_label = a.l AND predicted_label = b.l) AS n
        FROM labels a CROSS JOIN labels b"""
)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(PRED_A.frame(spark, sf))


@query(
    f"""{_A} SELECT true_label, predicted_label, COUNT(*) AS n FROM p WHERE true_label <> predicted_label
        GROUP BY ALL ORDER BY n DESC, true_label, predicted_label LIMIT 10"""
)
def top_confusions(spark, sf):
    return metrics.top_confusions(PRED_A.frame(spark, sf), 10)


@query(
    f"""{_A} SELECT COUNT(*) AS n, COUNT(*) FILTER (true_label = predicted_label) AS n_correct,
        CAST(COUNT(*) FILTER (true_label = predicted_label) AS DOUBLE) / COUNT(*) AS accuracy FROM p"""
)
def accuracy(spark, sf):
    return metrics.accuracy(PRED_A.frame(spark, sf))


@query(f"{_A} {summary_sql(_CELLS)}")
def score_summary(spark, sf):
    cells = metrics.confusion_cells(PRED_A.frame(spark, sf))
    return rounded(metrics.score_summary(cells), "macro_f1", "weighted_f1")


@query(
    f"""{_A} SELECT true_label AS majority_label, COUNT(*) AS majority_n, (SELECT COUNT(*) FROM p) AS n,
        CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM p) AS majority_share
        FROM p GROUP BY true_label ORDER BY majority_n DESC, majority_label LIMIT 1"""
)
def majority_baseline(spark, sf):
    return metrics.majority_baseline(metrics.confusion_cells(PRED_A.frame(spark, sf)))


@query(
    f"""WITH p AS ({PRED_A.sql}), m AS (SELECT CASE true_label WHEN 'click' THEN 'customer_general' WHEN 'view'
          THEN 'customer_general' ELSE true_label END AS t FROM p)
        SELECT CASE WHEN bool_or(t IN ('technical_product_support', 'customer_general')) THEN 'clean_v1'
               ELSE 'original_10' END AS taxonomy FROM m"""
)
def infer_taxonomy(spark, sf):
    mapping = {"click": "customer_general", "view": "customer_general"}
    return metrics.infer_taxonomy(metrics.remap_predictions(PRED_A.frame(spark, sf), mapping))


_BIN = "CASE WHEN least(greatest(confidence, 0e0), 1e0) <= 0.1e0 THEN 1 " + " ".join(
    f"WHEN confidence <= {i / 10!r}::DOUBLE THEN {i}" for i in range(2, 10)
) + " ELSE 10 END"
_BINNED = f"SELECT *, {_BIN} AS bin, CASE WHEN true_label = predicted_label THEN 1e0 ELSE 0e0 END AS ok FROM p"
_INTERVAL = "CASE bin WHEN 1 THEN '(-0.001, 0.1]' " + " ".join(
    f"WHEN {i + 1} THEN '({i / 10}, {(i + 1) / 10}]'" for i in range(1, 10)
) + " END"


@query(
    f"""{_A} SELECT CAST(bin AS INTEGER) AS bin, {_INTERVAL} AS interval, COUNT(*) AS n,
        round(AVG(confidence), 8) AS mean_confidence, SUM(ok) / COUNT(*) AS accuracy,
        round(SUM(ok) / COUNT(*) - AVG(confidence), 8) AS gap FROM ({_BINNED}) GROUP BY bin"""
)
def reliability(spark, sf):
    return rounded(calibration.reliability(PRED_A.frame(spark, sf)), "mean_confidence", "gap")


@query(
    f"""WITH p AS ({_BOTH}), b AS (SELECT system, bin, COUNT(*) AS n, AVG(ok) AS acc, AVG(confidence) AS conf
          FROM ({_BINNED}) GROUP BY system, bin), t AS (SELECT system, COUNT(*) AS total FROM p GROUP BY system)
        SELECT system, CAST(SUM(n) AS BIGINT) AS n, round(SUM(CAST(n AS DOUBLE) / total * abs(acc - conf)), 8) AS ece
        FROM b JOIN t USING (system) GROUP BY system"""
)
def calibration_error(spark, sf):
    return rounded(calibration.calibration_error(both_systems(spark, sf), ["system"]), "ece")


@query(
    f"""{_A}, b AS (SELECT predicted_label, bin, COUNT(*) AS n, AVG(ok) AS acc, AVG(confidence) AS conf
          FROM ({_BINNED}) GROUP BY ALL),
        t AS (SELECT predicted_label, COUNT(*) AS total, AVG(confidence) AS conf,
              AVG(CASE WHEN true_label = predicted_label THEN 1e0 ELSE 0e0 END) AS precision FROM p GROUP BY ALL)
        SELECT predicted_label, total AS n, round(any_value(t.conf), 8) AS mean_confidence,
               any_value(precision) AS precision,
               round(SUM(CAST(n AS DOUBLE) / total * abs(acc - b.conf)), 8) AS ece
        FROM b JOIN t USING (predicted_label) GROUP BY predicted_label, total"""
)
def per_class_calibration(spark, sf):
    return rounded(calibration.per_class_calibration(PRED_A.frame(spark, sf)), "mean_confidence", "ece")


@query(
    coverage_sql(PRED_A.sql, K.COVERAGE_CUTOFFS)
    + """ SELECT threshold, CAST(n_auto AS DOUBLE) / n AS coverage, CAST(n_correct AS DOUBLE) / NULLIF(n_auto, 0) AS accuracy_on_auto_routed,
          macro_f1 AS macro_f1_on_auto_routed, n_auto AS number_auto_routed, n - n_auto AS number_sent_to_review FROM curve"""
)
def coverage_by_threshold(spark, sf):
    return rounded(coverage.coverage_by_threshold(PRED_A.frame(spark, sf)), "macro_f1_on_auto_routed")


_MARGIN = "(SELECT *, CAST((ticket_id * 53) % 100 AS DOUBLE) / 100e0 AS top1_top2_margin FROM ({}))".format(PRED_A.sql)


@query(
    coverage_sql(f"SELECT * FROM {_MARGIN}", K.COVERAGE_CUTOFFS, "top1_top2_margin >= 0.3e0")
    + """ SELECT threshold, CAST(n_auto AS DOUBLE) / n AS coverage, CAST(n_correct AS DOUBLE) / NULLIF(n_auto, 0) AS accuracy_on_auto_routed,
          macro_f1 AS macro_f1_on_auto_routed, n_auto AS number_auto_routed, n - n_auto AS number_sent_to_review,
          0.3e0 AS margin_threshold FROM curve"""
)
def coverage_by_threshold_margin(spark, sf):
    df = PRED_A.frame(spark, sf).selectExpr("*", "CAST((ticket_id * 53) % 100 AS DOUBLE) / 100e0 AS top1_top2_margin")
    return rounded(coverage.coverage_by_threshold(df, 0.3), "macro_f1_on_auto_routed")


@query(
    coverage_sql(PRED_B.sql, K.COVERAGE_CUTOFFS)
    + """ SELECT threshold, CAST(n_auto AS DOUBLE) / n AS auto_route_rate, 1 - CAST(n_auto AS DOUBLE) / n AS human_review_rate,
          CAST(n_correct AS DOUBLE) / NULLIF(n_auto, 0) AS accuracy_on_auto, macro_f1 AS macro_f1_on_auto, n_auto FROM curve"""
)
def coverage_sweep(spark, sf):
    return rounded(coverage.coverage_sweep(PRED_B.frame(spark, sf)), "macro_f1_on_auto")


_HALF = f"SELECT * REPLACE (confidence / 2e0 AS confidence) FROM ({PRED_A.sql})"


@query(
    coverage_sql(_HALF, K.COVERAGE_CUTOFFS)
    + """ SELECT threshold, CAST(n_auto AS DOUBLE) / n AS coverage, CAST(n_correct AS DOUBLE) / n_auto AS accuracy_on_auto,
          macro_f1 AS macro_f1_on_auto, n_auto, n_auto - n_correct AS n_errors_auto FROM curve WHERE n_auto > 0"""
)
def coverage_curve(spark, sf):
    """Confidences up to 0.5 only, so that the upper cutoffs are empty and left out."""
    df = PRED_A.frame(spark, sf).withColumn("confidence", F.col("confidence") / 2)
    return rounded(coverage.coverage_curve(df), "macro_f1_on_auto")


def _budget_sql(source: str) -> str:
    return f"""
      WITH p AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, md5('42:' || CAST(ticket_id AS VARCHAR))) AS place FROM ({source})),
      budgets(b) AS (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)),
      kept AS (SELECT b, CAST(round_even((SELECT COUNT(*) FROM p) * (1 - b), 0) AS BIGINT) AS k FROM budgets),
      cells AS (SELECT b, true_label, predicted_label, COUNT(*) AS n, MIN(confidence) AS low FROM p JOIN kept ON place <= k GROUP BY ALL),
      f AS (SELECT b, round(AVG(f1_score), 8) AS macro_f1 FROM ({class_scores_sql('cells', ['b'])}) GROUP BY b),
      s AS (SELECT b, CAST(SUM(n) AS BIGINT) AS n, SUM(CASE WHEN true_label = predicted_label THEN n ELSE 0 END) AS ok, MIN(low) AS low FROM cells GROUP BY b)
      SELECT b AS human_review_budget, n AS auto_routed, CAST(ok AS DOUBLE) / n AS accuracy_on_auto, macro_f1 AS macro_f1_on_auto,
             low AS min_confidence_kept FROM s JOIN f USING (b)"""


@query(_budget_sql(PRED_B.sql))
def accuracy_at_budget(spark, sf):
    return rounded(coverage.accuracy_at_budget(PRED_B.frame(spark, sf)), "macro_f1_on_auto")


@query(
    f"""WITH a AS ({_budget_sql(PRED_A.sql)}), b AS ({_budget_sql(PRED_B.sql)})
        SELECT a.human_review_budget, a.auto_routed, a.accuracy_on_auto AS accuracy_on_auto_a, b.accuracy_on_auto AS accuracy_on_auto_b
        FROM a JOIN b ON a.human_review_budget = b.human_review_budget AND a.auto_routed = b.auto_routed"""
)
def join_budgets(spark, sf):
    return compare.join_budgets(
        coverage.accuracy_at_budget(PRED_A.frame(spark, sf)), coverage.accuracy_at_budget(PRED_B.frame(spark, sf))
    )


@query(
    f"""SELECT quantile_cont(CAST(latency_ms AS DOUBLE), 0.5) AS p50, round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.95), 8) AS p95,
        COUNT(*) AS n FROM ({PRED_A.sql})"""
)
def latency_percentiles(spark, sf):
    return rounded(compare.latency_percentiles(PRED_A.frame(spark, sf)), "p95")


@query(
    f"""SELECT CAST(SUM(input_tokens) AS BIGINT) AS total_input_tokens,
        round(CAST(SUM(input_tokens) AS DOUBLE) / 1e6 * 0.042e0, 8) AS estimated_cost_usd FROM ({PRED_A.sql})"""
)
def token_cost(spark, sf):
    return rounded(metrics.token_cost(PRED_A.frame(spark, sf)), "estimated_cost_usd")


_PAIRED = f"({PRED_A.sql}) a JOIN ({PRED_B.sql}) b USING (ticket_id)"


@query(
    f"""SELECT ticket_id, a.true_label AS true_label_a, a.predicted_label AS predicted_label_a, a.confidence AS confidence_a,
        a.latency_ms AS latency_ms_a, a.input_tokens AS input_tokens_a,
        CAST(a.true_label = a.predicted_label AS INTEGER) AS correct_a,
        b.true_label AS true_label_b, b.predicted_label AS predicted_label_b, b.confidence AS confidence_b,
        b.latency_ms AS latency_ms_b, b.input_tokens AS input_tokens_b,
        CAST(b.true_label = b.predicted_label AS INTEGER) AS correct_b FROM {_PAIRED}"""
)
def pair_systems(spark, sf):
    return compare.pair_systems(PRED_A.frame(spark, sf), PRED_B.frame(spark, sf))


@query(
    f"""SELECT COUNT(*) AS pairs, COUNT(*) FILTER (a.true_label IS DISTINCT FROM b.true_label) AS mismatches FROM {_PAIRED}"""
)
def label_agreement(spark, sf):
    return compare.label_agreement(compare.pair_systems(PRED_A.frame(spark, sf), PRED_B.frame(spark, sf)))


@query(
    f"""WITH c AS (SELECT COUNT(*) AS pairs,
          COUNT(*) FILTER (a.true_label = a.predicted_label AND b.true_label <> b.predicted_label) AS only_first,
          COUNT(*) FILTER (a.true_label <> a.predicted_label AND b.true_label = b.predicted_label) AS only_second FROM {_PAIRED}),
        m AS (SELECT *, least(only_first, only_second) AS k, only_first + only_second AS n FROM c),
        t AS (SELECT SUM(exp(lgamma(n + 1e0) - lgamma(i + 1e0) - lgamma(n - i + 1e0) - n * ln(2e0))) AS tail
              FROM m, range(0, (SELECT k + 1 FROM m)) r(i))
        SELECT pairs, only_first, only_second, round(least(1e0, 2 * tail), 8) AS p_value, least(1e0, 2 * tail) < 0.05 AS significant FROM m, t"""
)
def mcnemar(spark, sf):
    paired = compare.pair_systems(PRED_A.frame(spark, sf), PRED_B.frame(spark, sf))
    return rounded(compare.mcnemar(paired), "p_value")


@query(
    f"""WITH p AS ({_BOTH}), cells AS (SELECT system, true_label, predicted_label, COUNT(*) AS n FROM p GROUP BY ALL),
        s AS ({summary_sql('cells', ['system'])}),
        l AS (SELECT system, quantile_cont(CAST(latency_ms AS DOUBLE), 0.5) AS median_latency_ms FROM p GROUP BY system)
        SELECT s.*, l.median_latency_ms FROM s JOIN l USING (system)"""
)
def summarize_systems(spark, sf):
    return rounded(compare.summarize_systems(both_systems(spark, sf)), "macro_f1", "weighted_f1")


@query(
    f"""WITH p AS ({_BOTH}), cells AS (SELECT system, true_label, predicted_label, COUNT(*) AS n FROM p GROUP BY ALL),
        s AS ({summary_sql('cells', ['system'])}),
        b AS (SELECT system, bin, COUNT(*) AS k, AVG(ok) AS acc, AVG(confidence) AS conf FROM ({_BINNED}) GROUP BY system, bin),
        e AS (SELECT b.system, round(SUM(CAST(k AS DOUBLE) / s.n * abs(acc - conf)), 8) AS ece FROM b JOIN s USING (system) GROUP BY b.system)
        SELECT system, s.accuracy, s.macro_f1, e.ece FROM s JOIN e USING (system)"""
)
def compare_systems(spark, sf):
    """Summary and calibration of the full comparison, after its check of ids and labels."""
    frames = evaluation.compare_systems(PRED_A.frame(spark, sf), PRED_B.frame(spark, sf))
    joined = frames["summary"].select("system", "accuracy", "macro_f1").join(frames["calibration"].drop("n"), "system")
    return rounded(joined, "macro_f1", "ece")


_BOARD = f"""
  SELECT 'queue' AS task, 'system_a' AS model_name, accuracy, macro_f1, weighted_f1, 'first' AS notes
  FROM ({summary_sql(f"(SELECT true_label, predicted_label, COUNT(*) AS n FROM ({PRED_A.sql}) GROUP BY ALL)")})
  UNION ALL SELECT 'queue', 'system_b', accuracy, macro_f1, weighted_f1, 'second'
  FROM ({summary_sql(f"(SELECT true_label, predicted_label, COUNT(*) AS n FROM ({PRED_B.sql}) GROUP BY ALL)")})"""


def _board(spark, sf):
    rows = []
    for name, view, notes in (("system_a", PRED_A, "first"), ("system_b", PRED_B, "second")):
        summary = metrics.score_summary(metrics.confusion_cells(view.frame(spark, sf)))
        rows.append(compare.metric_row(summary, "queue", name, notes))
    return rows


@query(_BOARD)
def leaderboard(spark, sf):
    return rounded(compare.leaderboard([*_board(spark, sf), None]), "macro_f1", "weighted_f1")


@query(
    f"""WITH l AS (UNPIVOT ({_BOARD}) ON accuracy, macro_f1, weighted_f1 INTO NAME metric VALUE v)
        SELECT a.task, a.metric, a.v AS baseline, b.v AS candidate, round(b.v - a.v, 6) AS delta
        FROM l a JOIN l b ON a.metric = b.metric AND a.task = b.task WHERE a.model_name = 'system_b' AND b.model_name = 'system_a'"""
)
def metric_delta(spark, sf):
    delta = compare.metric_delta(compare.leaderboard(_board(spark, sf)), "system_b", "system_a")
    return rounded(rounded(delta, "baseline", "candidate"), "delta", digits=6)


@query(
    f"""WITH p AS ({PRED_A.sql}) SELECT done, n_correct, CAST(n_correct AS DOUBLE) / done AS accuracy FROM (
          SELECT row_number() OVER (ORDER BY ticket_id) AS done,
                 CAST(SUM(CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END) OVER (ORDER BY ticket_id) AS BIGINT) AS n_correct,
                 COUNT(*) OVER () AS n FROM p) WHERE done % 25 = 0 OR done = n"""
)
def running_accuracy(spark, sf):
    return compare.running_accuracy(PRED_A.frame(spark, sf), "ticket_id")


_OK = f"SELECT AVG(CASE WHEN true_label = predicted_label THEN 1e0 ELSE 0e0 END) AS p, COUNT(*) AS n FROM ({PRED_A.sql})"
# Half the width of the normal approximation; bootstrap ends may differ by a fifth of it.
_HALF = "1.959964e0 * sqrt(p * (1 - p) / n)"


def _near(ends, low="low", high="high"):
    """Whether both ends lie near those of the normal approximation, whose centre and half width are `p` and `half`."""
    off = F.greatest(F.abs(F.col(low) - (F.col("p") - F.col("half"))), F.abs(F.col(high) - (F.col("p") + F.col("half"))))
    return ends.withColumn("near_normal", off <= 0.2 * F.col("half"))


@query(f"SELECT 'accuracy' AS metric, round(p, 8) AS accuracy, round({_HALF}, 8) AS half_width, TRUE AS near_normal, TRUE AS ordered FROM ({_OK})")
def bootstrap_ci(spark, sf):
    """The interval of the accuracy against its normal approximation; low and high ends in order for all metrics."""
    frame = PRED_A.frame(spark, sf)
    ends = bootstrap.bootstrap_ci(frame)
    ordered = ends.agg(F.bool_and(F.col("low") < F.col("high")).alias("ordered"))
    known = frame.agg(F.avg(F.when(F.col("true_label") == F.col("predicted_label"), 1.0).otherwise(0.0)).alias("p"), F.count(F.lit(1)).alias("n"))
    one = known.agg(F.first(F.struct("p", F.expr(_HALF.replace("e0", "D")).alias("half")))).scalar()
    near = _near(ends.where("metric = 'accuracy'").withColumns({"p": one["p"], "half": one["half"], "ordered": ordered.scalar()}))
    return near.select("metric", F.round("p", 8).alias("accuracy"), F.round("half", 8).alias("half_width"), "near_normal", "ordered")


_MAJOR = "SELECT true_label, COUNT(*) AS k FROM p GROUP BY ALL ORDER BY k DESC, true_label LIMIT 1"


@query(
    f"""{_A}, b AS (SELECT bin, COUNT(*) AS k, AVG(ok) AS acc, AVG(confidence) AS conf FROM ({_BINNED}) GROUP BY bin)
        SELECT s.*, (SELECT round(SUM(CAST(k AS DOUBLE) / s.n * abs(acc - conf)), 8) FROM b) AS ece,
               (SELECT true_label FROM ({_MAJOR})) AS majority_label, (SELECT CAST(k AS DOUBLE) FROM ({_MAJOR})) / s.n AS majority_share
        FROM ({summary_sql(_CELLS)}) s"""
)
def headline(spark, sf):
    return rounded(evaluation.headline(PRED_A.frame(spark, sf)), "macro_f1", "weighted_f1", "ece")


@query(
    f"""{_A}, m AS (SELECT (SELECT true_label FROM ({_MAJOR})) AS majority_label, (SELECT CAST(k AS DOUBLE) FROM ({_MAJOR})) / (SELECT COUNT(*) FROM p) AS share)
        SELECT 'system_a' AS name, s.*, m.majority_label, round(s.accuracy - m.share, 8) AS lift_over_majority, TRUE AS near_normal,
               s.accuracy - (SELECT {_HALF} FROM ({_OK})) > m.share AS beats_majority_at_95ci,
               (SELECT quantile_cont(CAST(latency_ms AS DOUBLE), 0.5) FROM p) AS latency_p50_ms,
               (SELECT round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.95), 8) FROM p) AS latency_p95_ms
        FROM ({summary_sql(_CELLS)}) s, m"""
)
def final_evaluation(spark, sf):
    """Metrics row of the locked evaluation; its random interval is compared with the normal approximation."""
    row = evaluation.final_evaluation(PRED_A.frame(spark, sf), "system_a")["metrics"]
    summary = [c for c in row.columns if c in ("n", "n_correct", "accuracy", "macro_f1", "weighted_f1")]
    half = F.lit(1.959964) * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n"))
    near = _near(row.withColumn("p", F.col("accuracy")).withColumn("half", half), "accuracy_ci95_low", "accuracy_ci95_high")
    shown = near.select(
        "name", *summary, "majority_label", F.round("lift_over_majority", 8).alias("lift_over_majority"), "near_normal",
        "beats_majority_at_95ci", "latency_p50_ms", F.round("latency_p95_ms", 8).alias("latency_p95_ms"),
    )
    return rounded(shown, "macro_f1", "weighted_f1")


@query(
    f"""{_A}, b AS (SELECT bin, COUNT(*) AS k, AVG(ok) AS acc, AVG(confidence) AS conf FROM ({_BINNED}) GROUP BY bin)
        SELECT 'original_10' AS taxonomy, s.*, (SELECT round(SUM(CAST(k AS DOUBLE) / s.n * abs(acc - conf)), 8) FROM b) AS ece,
               (SELECT true_label FROM ({_MAJOR})) AS majority_label, (SELECT CAST(k AS DOUBLE) FROM ({_MAJOR})) / s.n AS majority_share,
               round(s.accuracy, 4) > (SELECT CAST(k AS DOUBLE) FROM ({_MAJOR})) / s.n AS beats_majority_baseline,
               0.5229e0 AS baseline_accuracy, round(s.accuracy - 0.5229e0, 8) AS accuracy_delta_vs_baseline,
               (SELECT quantile_cont(CAST(latency_ms AS DOUBLE), 0.5) FROM p) AS latency_p50_ms,
               (SELECT round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.95), 8) FROM p) AS latency_p95_ms,
               (SELECT CAST(SUM(input_tokens) AS BIGINT) FROM p) AS total_input_tokens,
               (SELECT round(CAST(SUM(input_tokens) AS DOUBLE) / 1e6 * 0.042e0, 8) FROM p) AS estimated_cost_usd
        FROM ({summary_sql(_CELLS)}) s"""
)
def score_system(spark, sf):
    return rounded(
        evaluation.score_system(PRED_A.frame(spark, sf))["metrics"],
        "macro_f1", "weighted_f1", "ece", "accuracy_delta_vs_baseline", "latency_p95_ms", "estimated_cost_usd",
    )


@query(
    f"""SELECT true_label AS label, COUNT(*) AS n,
        CAST((SELECT COUNT(*) FROM ({PRED_A.sql})) AS DOUBLE) / (CAST((SELECT COUNT(DISTINCT true_label) FROM ({PRED_A.sql})) AS DOUBLE) * COUNT(*)) AS weight
        FROM ({PRED_A.sql}) GROUP BY true_label"""
)
def class_weights(spark, sf):
    return splits.class_weights(PRED_A.frame(spark, sf), "true_label")


@query(
    f"""SELECT true_label AS label, COUNT(*) AS n,
        round(sqrt(CAST((SELECT COUNT(*) FROM ({PRED_A.sql})) AS DOUBLE) / (CAST((SELECT COUNT(DISTINCT true_label) FROM ({PRED_A.sql})) AS DOUBLE) * COUNT(*))), 8) AS weight
        FROM ({PRED_A.sql}) GROUP BY true_label"""
)
def class_weights_sqrt(spark, sf):
    return rounded(splits.class_weights(PRED_A.frame(spark, sf), "true_label", "sqrt_balanced"), "weight")
