"""Metrics against hand-worked values, brute force and the published figures."""

import random

import pytest
from pyspark.sql import functions as F

from queuesight import constants as K
from queuesight.operators import bootstrap, calibration, compare, coverage, metrics
from queuesight.plans import evaluation
from queuesight.sources.readers import prepare_predictions

SCHEMA = "ticket_id string, true_label string, predicted_label string, confidence double"

# Published per-bin figures of two systems: bin, rows, mean confidence, accuracy.
BINS_TUNED = [
    (3, 5, 0.2757, 0.2), (4, 91, 0.3636, 0.3297), (5, 232, 0.4534, 0.4957), (6, 313, 0.5494, 0.4824),
    (7, 322, 0.6487, 0.6273), (8, 373, 0.7521, 0.6542), (9, 553, 0.8546, 0.7161), (10, 1674, 0.973, 0.8943),
]
BINS_ZERO_SHOT = [
    (3, 13, 0.2746, 0.3846), (4, 92, 0.3663, 0.3261), (5, 262, 0.4548, 0.4122), (6, 280, 0.557, 0.3214),
    (7, 265, 0.6559, 0.4226), (8, 330, 0.7569, 0.4455), (9, 352, 0.8557, 0.4886), (10, 1968, 0.9835, 0.6504),
]
# Published report: label, precision, recall, f1, support.
REPORT = [
    ("billing_and_payments", 0.8407643312101911, 0.7272727272727273, 0.7799113737075333, 363),
    ("customer_general", 0.5808823529411765, 0.403747870528109, 0.4763819095477387, 587),
    ("human_resources", 0.6774193548387096, 0.30434782608695654, 0.42, 69),
    ("returns_and_exchanges", 0.5294117647058824, 0.3068181818181818, 0.38848920863309355, 176),
    ("sales_and_pre_sales", 0.5970149253731343, 0.37037037037037035, 0.45714285714285713, 108),
    ("service_outages_and_maintenance", 0.7850467289719626, 0.5957446808510638, 0.6774193548387096, 141),
    ("technical_product_support", 0.7640094711917916, 0.9136385087305333, 0.8321513002364066, 2119),
]


def rebuilt_predictions():
    """A prediction table with the published label totals: hits, and misses paired off."""
    rows, missed, wrong = [], [], []
    for label, precision, recall, _, support in REPORT:
        tp = round(recall * support)
        rows += [(label, label)] * tp
        missed += [label] * (support - tp)
        wrong += [label] * (round(tp / precision) - tp)
    assert len(missed) == len(wrong) == 927
    # Pair each missed truth with a wrong prediction of another label.
    for shift in range(len(wrong)):
        turned = wrong[shift:] + wrong[:shift]
        if all(a != b for a, b in zip(missed, turned)):
            return rows + list(zip(missed, turned))
    rng = random.Random(1)
    while True:
        pairs = list(zip(missed, wrong))
        for i, (a, b) in enumerate(pairs):
            if a == b:
                j = rng.randrange(len(pairs))
                if wrong[j] != a and wrong[i] != missed[j]:
                    wrong[i], wrong[j] = wrong[j], wrong[i]
        if all(a != b for a, b in zip(missed, wrong)):
            return rows + list(zip(missed, wrong))


@pytest.fixture(scope="module")
def rebuilt(spark):
    rows = [(str(i), t, p, 0.5) for i, (t, p) in enumerate(rebuilt_predictions())]
    return spark.createDataFrame(rows, SCHEMA).persist()


def test_published_report(rebuilt):
    report = {(r["section"], r["label"]): r for r in metrics.classification_report(rebuilt).collect()}
    for label, precision, recall, f1, support in REPORT:
        row = report[("class", label)]
        assert (row["precision"], row["recall"], row["f1_score"], row["support"]) == pytest.approx((precision, recall, f1, support))
    macro, weighted = report[("macro avg", None)], report[("weighted avg", None)]
    assert macro["f1_score"] == pytest.approx(0.5759280005866199)
    assert macro["precision"] == pytest.approx(0.6820784184618355)
    assert weighted["f1_score"] == pytest.approx(0.720829153265342)
    accuracy = report[("accuracy", None)]
    assert accuracy["precision"] == accuracy["support"] == pytest.approx(0.7398259893348302)


def test_published_summary_and_baseline(rebuilt):
    cells = metrics.confusion_cells(rebuilt)
    row = metrics.score_summary(cells).first()
    assert (row["n"], row["n_correct"], round(row["accuracy"], 4)) == (3563, 2636, 0.7398)
    major = metrics.majority_baseline(cells).first()
    assert (major["majority_label"], round(major["majority_share"], 4)) == ("technical_product_support", 0.5947)
    assert round(row["accuracy"] - major["majority_share"], 4) == 0.1451


def test_published_intervals(rebuilt):
    got = {r["metric"]: (r["low"], r["high"]) for r in bootstrap.bootstrap_ci(rebuilt).collect()}
    published = {"accuracy": (0.7258, 0.7544), "macro_f1": (0.5465, 0.6034), "weighted_f1": (0.7053, 0.7374)}
    for name, ends in published.items():
        assert got[name] == pytest.approx(ends, abs=0.004), name


def test_bootstrap_is_reproducible(rebuilt):
    one, two = (bootstrap.bootstrap_replicates(rebuilt.repartition(p), 20).orderBy("replicate").collect() for p in (1, 5))
    assert one == two


def binned_rows(bins):
    rows = []
    for index, n, confidence, accuracy in bins:
        hits = round(accuracy * n)
        rows += [(f"{index}-{i}", "a", "a" if i < hits else "b", confidence) for i in range(n)]
    return rows


@pytest.mark.parametrize("bins,ece", [(BINS_TUNED, 0.0803), (BINS_ZERO_SHOT, 0.2896)])
def test_published_calibration(spark, bins, ece):
    df = spark.createDataFrame(binned_rows(bins), SCHEMA)
    assert calibration.calibration_error(df).first()["ece"] == pytest.approx(ece, abs=6e-5)
    got = {r["bin"]: r for r in calibration.reliability(df).collect()}
    assert [(b, got[b]["n"]) for b in sorted(got)] == [(b[0], b[1]) for b in bins]
    assert got[10]["interval"] == "(0.9, 1.0]" and got[3]["interval"] == "(0.2, 0.3]"
    assert got[10]["gap"] == pytest.approx(bins[-1][3] - bins[-1][2], abs=6e-4)


def test_bin_edges(spark):
    values = [0.0, 0.1, 0.10001, 0.3, 0.30000000000000004, 1.0, 1.2, -0.5, 0.9]
    df = spark.createDataFrame([(v,) for v in values], "c double")
    got = [r[0] for r in df.select(calibration.confidence_bin(F.col("c"))).collect()]
    assert got == [1, 1, 2, 3, 4, 10, 10, 1, 9]
    first = spark.createDataFrame([("1", "a", "a", -0.5), ("2", "a", "b", 0.05)], SCHEMA)
    row = calibration.reliability(first).first()
    assert (row["interval"], row["n"], row["mean_confidence"]) == ("(-0.001, 0.1]", 2, pytest.approx(-0.225))


def brute_f1(pairs):
    labels = {t for t, _ in pairs} | {p for _, p in pairs}
    scores = []
    for label in labels:
        tp = sum(t == p == label for t, p in pairs)
        total = sum(t == label for t, _ in pairs) + sum(p == label for _, p in pairs)
        scores.append(2 * tp / total)
    return sum(scores) / len(scores)


def random_predictions(n=800, levels=40, seed=5):
    rng = random.Random(seed)
    labels = ["a", "b", "c", "never_predicted"]
    rows = []
    for i in range(n):
        true = rng.choice(labels)
        guess = true if rng.random() < 0.5 and true != "never_predicted" else rng.choice(["a", "b", "c", "only_predicted"])
        rows.append((str(i), true, guess, rng.randint(0, levels) / levels))
    return rows


def test_coverage_against_brute_force(spark):
    rows = random_predictions()
    rows = [r if r[3] < 0.93 else (*r[:3], 0.93) for r in rows]  # nothing reaches 0.95
    got = {r["threshold"]: r for r in coverage.coverage(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == K.COVERAGE_CUTOFFS
    for cutoff in K.COVERAGE_CUTOFFS:
        kept = [(t, p) for _, t, p, c in rows if c >= cutoff]
        row = got[cutoff]
        assert (row["n"], row["n_auto"], row["n_review"]) == (len(rows), len(kept), len(rows) - len(kept))
        if kept:
            assert row["accuracy"] == pytest.approx(sum(t == p for t, p in kept) / len(kept))
            assert row["macro_f1"] == pytest.approx(brute_f1(kept))
        else:
            assert row["accuracy"] is None and row["macro_f1"] is None
    df = spark.createDataFrame(rows, SCHEMA)
    assert coverage.coverage_curve(df).count() == 19
    sweep = {r["threshold"]: r for r in coverage.coverage_sweep(df).collect()}
    assert (sweep[0.95]["auto_route_rate"], sweep[0.95]["human_review_rate"], sweep[0.95]["n_auto"]) == (0.0, 1.0, 0)


def test_coverage_never_grows_with_the_cutoff(spark):
    rows = coverage.coverage(spark.createDataFrame(random_predictions(seed=8), SCHEMA)).orderBy("threshold").collect()
    assert all(a["n_auto"] >= b["n_auto"] for a, b in zip(rows, rows[1:]))


def test_margin_needs_its_column(spark):
    df = spark.createDataFrame(random_predictions(20), SCHEMA)
    with pytest.raises(ValueError, match="margin"):
        coverage.coverage_by_threshold(df, 0.2)
    rows = coverage.coverage_by_threshold(df.withColumn("top1_top2_margin", F.lit("0.3")), 0.2).collect()
    assert {r["margin_threshold"] for r in rows} == {0.2} and max(r["number_auto_routed"] for r in rows) == 20


@pytest.mark.parametrize("levels", [1, 3, 40])
def test_budget_against_brute_force(spark, levels):
    """Many ties at every cut; the rows kept among them follow the hash order."""
    import hashlib

    rows = random_predictions(601, levels)
    place = lambda r: (-r[3], hashlib.md5(f"42:{r[0]}".encode()).hexdigest())
    ordered = sorted(rows, key=place)
    got = {r["human_review_budget"]: r for r in coverage.accuracy_at_budget(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert sorted(got) == K.REVIEW_BUDGETS
    for budget in K.REVIEW_BUDGETS:
        kept = ordered[: round(len(rows) * (1 - budget))]
        pairs = [(t, p) for _, t, p, _ in kept]
        row = got[budget]
        assert row["auto_routed"] == len(kept)
        assert row["accuracy_on_auto"] == pytest.approx(sum(t == p for t, p in pairs) / len(kept))
        assert row["macro_f1_on_auto"] == pytest.approx(brute_f1(pairs))
        assert row["min_confidence_kept"] == kept[-1][3]


def test_published_budget_sizes(spark):
    df = spark.range(3562).select(
        F.col("id").cast("string").alias("ticket_id"), F.lit("a").alias("true_label"), F.lit("a").alias("predicted_label"),
        (F.col("id") % 101 / 100).alias("confidence"),
    )
    got = [r["auto_routed"] for r in coverage.accuracy_at_budget(df).orderBy("human_review_budget").collect()]
    assert got == [3206, 2850, 2493, 1781]


def test_budget_of_nothing(spark):
    assert coverage.accuracy_at_budget(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([("1", "a", "a", 0.3)], SCHEMA)
    assert [r["human_review_budget"] for r in coverage.accuracy_at_budget(one).orderBy("human_review_budget").collect()] == [0.1, 0.2, 0.3]


def test_report_over_true_labels(spark):
    rows = [("1", "a", "a", 1.0), ("2", "a", "z", 1.0), ("3", "b", "b", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    report = {(r["section"], r["label"]): r for r in metrics.classification_report(df, true_labels_only=True).collect()}
    assert ("accuracy", None) not in report and ("class", "z") not in report
    micro = report[("micro avg", None)]
    assert (micro["precision"], micro["recall"], micro["support"]) == (1.0, pytest.approx(2 / 3), 3.0)
    assert report[("macro avg", None)]["f1_score"] == pytest.approx((2 / 3 + 1) / 2)
    plain = {r["section"] for r in metrics.classification_report(df.where("predicted_label <> 'z'"), true_labels_only=True).collect()}
    assert "accuracy" in plain and "micro avg" not in plain


def test_confusion_matrix_is_square(spark):
    df = spark.createDataFrame([("1", "a", "b", 1.0), ("2", "a", "b", 1.0), ("3", "c", "c", 1.0)], SCHEMA)
    cells = {(r["true_label"], r["predicted_label"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells[("a", "b")] == 2 and cells[("c", "c")] == 1 and sum(cells.values()) == 3
    listed = metrics.confusion_matrix(df, ["a", "c"]).collect()
    assert sum(r["n"] for r in listed) == 1 and len(listed) == 4


def test_majority_ties_go_to_the_first_label(spark):
    df = spark.createDataFrame([("1", "b", "b", 1.0), ("2", "a", "b", 1.0)], SCHEMA)
    assert metrics.majority_baseline(metrics.confusion_cells(df)).first()["majority_label"] == "a"


@pytest.mark.parametrize("labels,expected", [(("customer_general", "x"), "clean_v1"), (("it_support", "x"), "original_10")])
def test_taxonomy(spark, labels, expected):
    df = spark.createDataFrame([("1", "x", labels[0], 1.0), ("2", labels[1], "x", 1.0)], SCHEMA)
    assert metrics.infer_taxonomy(df).first()[0] == expected


def test_published_paired_test(spark):
    df = spark.createDataFrame([(229, 883), (5, 5), (0, 0), (3, 0), (40000, 41000)], "b long, c long")
    got = [r[0] for r in df.select(compare.exact_binomial_p(F.col("b"), F.col("c"))).collect()]
    assert got[0] == pytest.approx(5.4877e-91, rel=1e-4)
    assert got[1] == 1.0 and got[2] is None and got[3] == pytest.approx(0.25)
    assert got[4] == pytest.approx(0.000446, rel=0.01)


def test_paired_systems(spark):
    a = spark.createDataFrame([("1", "x", "x", 0.9), ("2", "x", "y", 0.8), ("3", "y", "y", 0.7)], SCHEMA)
    b = spark.createDataFrame([("1", "x", "y", 0.9), ("2", "x", "x", 0.8), ("4", "y", "y", 0.7)], SCHEMA)
    paired = compare.pair_systems(a, b)
    assert tuple(compare.mcnemar_counts(paired).first()) == (2, 1, 1)
    row = compare.mcnemar(paired).first()
    assert row["p_value"] == 1.0 and row["significant"] is False
    compare.require_pairable(a, b)
    with pytest.raises(ValueError, match="not unique"):
        compare.require_pairable(a.unionAll(a), b)
    with pytest.raises(ValueError, match="differ"):
        compare.require_pairable(a, b.withColumn("true_label", F.lit("z")))
    same = compare.mcnemar(compare.pair_systems(a, a)).first()
    assert same["p_value"] is None and same["significant"] is None


def test_leaderboard_and_delta(spark):
    schema = "task string, model_name string, accuracy double, macro_f1 double, weighted_f1 double, notes string"
    base = spark.createDataFrame([("queue", "base", 0.4409, 0.4121, 0.443, "")], schema)
    good = spark.createDataFrame([("queue", "good", 0.5229, 0.4725, None, ""), ("priority", "p", 0.5, None, 0.1, "")], schema)
    board = compare.leaderboard([base, None, good])
    assert [r["model_name"] for r in board.collect()] == ["p", "good", "base"]
    delta = {r["metric"]: round(r["delta"], 4) for r in compare.metric_delta(board, "base", "good").collect()}
    assert delta == {"accuracy": 0.082, "macro_f1": 0.0604}


def test_token_cost(spark):
    df = spark.createDataFrame([("3060174",), ("x",), (None,)], "input_tokens string")
    row = metrics.token_cost(df).first()
    assert row["total_input_tokens"] == 3060174 and round(row["estimated_cost_usd"], 6) == 0.128527


def test_predictions_need_their_columns(spark):
    with pytest.raises(ValueError, match="confidence"):
        prepare_predictions(spark.createDataFrame([("a", "b")], "true_label string, predicted_label string"))


def test_running_accuracy(spark):
    rows = [(i, "a", "a" if i % 4 else "b") for i in range(110)]
    df = spark.createDataFrame(rows, "o long, true_label string, predicted_label string")
    got = [(r["done"], r["n_correct"]) for r in compare.running_accuracy(df, "o").orderBy("done").collect()]
    assert got == [(n, sum(1 for i in range(n) if i % 4)) for n in (25, 50, 75, 100, 110)]


def test_final_evaluation(rebuilt):
    frames = evaluation.final_evaluation(rebuilt.withColumn("latency_ms", F.lit(56.71)), "test", resamples=200)
    row = frames["metrics"].first()
    assert row["beats_majority_at_95ci"] and row["latency_p50_ms"] == 56.71
    assert round(row["lift_over_majority"], 4) == 0.1451 and row["n"] == 3563
    assert frames["class_calibration"].count() == 7 and frames["coverage"].count() == 11


def test_score_system(rebuilt):
    frames = evaluation.score_system(rebuilt)
    row = frames["metrics"].first()
    assert (row["taxonomy"], row["baseline_accuracy"], row["beats_majority_baseline"]) == ("clean_v1", 0.73, True)
    assert round(row["accuracy_delta_vs_baseline"], 4) == round(0.7398259893348302 - 0.73, 4)
    assert frames["budget"].count() == 4 and frames["coverage"].count() == 20


def test_compare_systems(rebuilt):
    frames = evaluation.compare_systems(rebuilt, rebuilt.withColumn("predicted_label", F.col("true_label")), ("a", "b"))
    assert frames["summary"].count() == 2 and frames["budget"].count() == 4
    assert frames["test"].first()["only_second"] == 927
    assert {r["system"] for r in frames["calibration"].collect()} == {"a", "b"}
