import pytest
from pyspark.sql import functions as F

from queuesight import constants as K
from queuesight.operators import rules
from queuesight.plans import evaluation

PLAIN = "please explain the setting"
ANGRY = (
    "I was charged twice and support keeps closing my tickets. "
    "If this refund is not handled today I am escalating to legal."
)
SCHEMA = (
    "id int, customer_message string, predicted_category string, category_confidence double, "
    "predicted_priority string, priority_confidence double"
)
CASES = [
    (1, ANGRY, "it_support", 0.2764, "medium", 0.3725, 0.87, "human_review"),
    (2, PLAIN, "technical_support", 0.90, "low", 0.90, 0.10, "auto_triage_suggestion"),
    (3, PLAIN, "billing_and_payments", 0.90, "low", 0.90, 0.28, "supervisor_review"),
    (4, PLAIN, "technical_support", 0.64, "low", 0.90, 0.18, "human_review"),
    (5, PLAIN, "technical_support", 0.90, "high", 0.55, 0.26, "priority_queue"),
    (6, PLAIN, "technical_support", 0.90, "high", 0.54, 0.31, "auto_triage_suggestion"),
    (7, "refunds were cancelled", "technical_support", 0.90, "low", None, 0.10, "auto_triage_suggestion"),
    (8, PLAIN, "technical_support", 0.90, "High", 0.9, 0.10, "auto_triage_suggestion"),
    (9, " ".join(K.RISK_TERMS), "human_resources", 0.1, "urgent", 0.1, 0.99, "human_review"),
    (10, PLAIN, "technical_support", 0.65, "urgent", None, 0.26, "priority_queue"),
]


def routed(spark, **options):
    df = spark.createDataFrame([c[:6] for c in CASES], SCHEMA)
    return {r["id"]: r for r in rules.route_tickets(df, **options).collect()}


def test_route_cases(spark):
    rows = routed(spark)
    for case in CASES:
        assert (rows[case[0]]["escalation_risk"], rows[case[0]]["routing_decision"]) == case[6:], case
    assert rows[1]["risk_signals"] == [
        "low_category_confidence", "low_priority_confidence", "medium_priority", "policy:legal", "risk_keyword:charged twice",
        "risk_keyword:escalating", "risk_keyword:legal", "risk_keyword:refund", "risk_keyword:today",
    ]
    assert rows[3]["risk_signals"] == ["policy:sensitive_category:billing_and_payments"]
    assert rows[3]["policy_sensitive"] and not rows[2]["policy_sensitive"]


def test_signal_limits(spark):
    """The score names at most 8 words and 5 policy signals; routing names all policy signals."""
    text = " ".join(sorted(set(K.RISK_TERMS) | set(K.POLICY_TERMS)))
    df = spark.createDataFrame([(1, text, "human_resources", 0.9, "low", 0.9)], SCHEMA)
    scored = rules.score_risk(df).first()
    assert sum(s.startswith("risk_keyword:") for s in scored["risk_signals"]) == 8
    assert sum(s.startswith("policy:") for s in scored["risk_signals"]) == 5
    assert "policy:sensitive_category:human_resources" not in scored["risk_signals"]
    assert scored["policy_signals"] == [*sorted(K.POLICY_TERMS), "sensitive_category:human_resources"]
    full = rules.route_tickets(df).first()["risk_signals"]
    assert "policy:sensitive_category:human_resources" in full
    assert sum(s.startswith("policy:") for s in full) == len(K.POLICY_TERMS) + 1


def test_general_confidence_stands_in(spark):
    df = spark.createDataFrame([(1, PLAIN, "technical_support", None, "low", None)], SCHEMA).withColumn("confidence", F.lit(0.3))
    assert rules.route_tickets(df).first()["routing_decision"] == "auto_triage_suggestion"
    row = rules.route_tickets(df, confidence="confidence").first()
    assert (row["routing_decision"], row["escalation_risk"]) == ("human_review", 0.18)
    assert "_sure" not in row.asDict()


def test_gate(spark):
    df = spark.createDataFrame([(0.80,), (0.799999,), (1.0,)], "c double")
    assert [r[0] for r in df.select(rules.gate_decision(F.col("c"))).collect()] == ["auto_route", "human_review", "auto_route"]


@pytest.mark.parametrize("value,expected", [(None, 0.8), ("0.5", 0.5), ("x", 0.8), ("7", 1.0), (-1, 0.0)])
def test_threshold(value, expected):
    assert rules.route_threshold(value) == expected


def test_risk_labels(spark):
    rows = [
        (1, "High", "Incident", "none", "Type: Incident"),
        (2, "high ", "request", "Data Breach, x", "hello"),
        (3, "low", None, "outage", "plain"),
        (4, None, "problem", "", "Data breach and urgent refund\nTags: legal"),
        (5, "low", "request", "hot", "nothing"),
    ]
    df = spark.createDataFrame(rows, "id int, priority string, type string, combined_tags string, model_text string")
    got = {r["id"]: tuple(r)[5:] for r in rules.add_risk_labels(df).collect()}
    assert got == {
        1: (1, 0, 0, 1, "priority:high; type:incident"),
        2: (0, 1, 1, 1, "tag:data breach"),
        3: (0, 0, 1, 1, "tag:outage"),
        4: (1, 1, 1, 1, "text:data breach; text:legal; text:refund; text:urgent"),
        5: (0, 0, 0, 0, ""),
    }
    with pytest.raises(ValueError, match="model_text"):
        rules.add_risk_labels(df.drop("model_text"))


def test_risk_audit_and_summary(spark):
    df = spark.createDataFrame([(1, "train", "legal"), (2, "test", "x")], "ticket_id int, split string, model_text string")
    labelled = rules.add_risk_labels(df)
    assert rules.risk_audit(labelled).columns == [
        "split", "ticket_id", "model_text", "urgency_signal", "policy_sensitive_signal", "escalation_keyword_signal",
        "high_risk_policy_label", "risk_signal_terms",
    ]
    summary = {(r["field"], r["value"]): r["n"] for r in rules.risk_label_summary(labelled).collect()}
    assert summary[("rows", "all")] == 2 and summary[("split", "test")] == 1
    assert summary[("high_risk_policy_label", "1")] == 1 and summary[("urgency_signal", "0")] == 2


REASONS = [
    ("x", "a", 0.44, 0.9, "low_confidence"),
    ("x", "a", 0.45, 0.44, "priority_depends_on_metadata"),
    ("brand login billing", "a", 0.9, 0.9, "multiple_intents"),
    ("a problem here", "a", 0.9, 0.9, "ambiguous_text"),
    ("problem " + "w " * 44, "customer_service", None, None, "label_overlap"),
    ("asap please", "a", 0.9, None, "priority_depends_on_metadata"),
    ("too short", "a", 0.9, 0.9, "insufficient_examples"),
    ("w " * 20, "a", 0.9, 0.9, "possible_label_noise"),
]


def test_likely_reason(spark):
    rows = [(i, *r[:4]) for i, r in enumerate(REASONS)]
    df = spark.createDataFrame(rows, "id int, customer_message string, category string, category_confidence double, priority_confidence double")
    got = [r["error_type"] for r in rules.likely_reason(df).orderBy("id").collect()]
    assert got == [r[4] for r in REASONS]


def test_errors(spark):
    df = spark.createDataFrame(
        [(1, "a", "a", "p", "p"), (2, "a", "b", "p", "p"), (3, "a", "a", "p", "q"), (4, "a", None, "p", None)],
        "id int, category string, predicted_category string, priority string, predicted_priority string",
    ).withColumn("customer_message", F.lit("short"))
    assert [r["id"] for r in rules.errors_only(df).orderBy("id").collect()] == [2, 3]
    assert rules.errors_only(df.drop("predicted_category", "predicted_priority")).count() == 0
    analysed = evaluation.error_analysis(df)
    assert {r["likely_reason"] for r in analysed.collect()} == {"insufficient_examples"}
    assert [tuple(r) for r in rules.error_breakdown(analysed).collect()] == [("insufficient_examples", 2)]


def test_error_confidence(spark):
    df = spark.createDataFrame([("a", "b", 0.59), ("a", "b", 0.6), ("a", "a", 0.1)], "true_label string, predicted_label string, confidence double")
    assert sorted(r["error_confidence_type"] for r in rules.wrong_labels(df).collect()) == ["high_confidence", "low_confidence"]
