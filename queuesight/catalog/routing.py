"""Queries on rules, routing, the dashboard and the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels as lb
from ..operators import compare, coverage, dashboard, rules, stores, validation
from ..operators.metrics import confusion_cells, score_summary
from ..plans import curation, evaluation
from ..session import fresh_path, spread
from ..sources import merge_store, paged
from ..sources.writers import append_predictions as append_records
from ..sources.writers import apply_ticket_changes, load_tickets
from .curation import _NORMALIZED_SQL
from .metrics import rounded
from .views import (
    EXPORT,
    POLICY_TAGS,
    POLICY_TEXTS,
    POLICY_WORDS,
    PRED_A,
    QUEUE_WEIGHTS,
    RISK_WORDS,
    ROUTING,
    SCORED,
    TAG_WORDS,
    TEXT_WORDS,
    URGENT_TEXTS,
    coverage_sql,
    query,
    sql_count,
    sql_has,
    sql_round,
    sql_terms,
    summary_sql,
    table,
)

LEXICON = {"risk_terms": RISK_WORDS, "policy_terms": POLICY_WORDS}

# --- word lists and risk labels -------------------------------------------------------


@query(f"SELECT doc_id, {sql_terms('lower(text)', RISK_WORDS)} AS matched FROM documents")
def contains_terms(spark, sf):
    found = rules.contains_terms(spread(table(spark, sf, "documents")), "text", RISK_WORDS)
    return found.select("doc_id", F.array_join("matched_terms", "|").alias("matched"))


_ANY_TAG = " OR ".join(sql_has("lower(combined_tags)", t) for t in TAG_WORDS)
_ANY_TEXT = " OR ".join(sql_has("lower(model_text)", t) for t in TEXT_WORDS)
_POLICY = " OR ".join(
    [sql_has("lower(combined_tags)", t) for t in POLICY_TAGS] + [sql_has("lower(model_text)", t) for t in POLICY_TEXTS]
)
_URGENT = " OR ".join(sql_has("lower(model_text)", t) for t in URGENT_TEXTS)
_RISK_SQL = _NORMALIZED_SQL + f""",
  r AS (SELECT pos, external_id, model_text, queue, priority, type, combined_tags, lower(COALESCE(priority, '')) = 'high' AS high,
          lower(COALESCE(type, '')) = 'incident' AS incident, ({_POLICY}) AS policy, ({_ANY_TAG} OR {_ANY_TEXT}) AS escalation,
          ({_URGENT}) AS urgent, {sql_terms('lower(combined_tags)', TAG_WORDS, 'tag:', '; ')} AS tag_hits,
          {sql_terms('lower(model_text)', TEXT_WORDS, 'text:', '; ')} AS text_hits FROM f),
  labelled AS (SELECT external_id, model_text, priority, type, combined_tags, CASE WHEN pos % 3 = 0 THEN 'test' ELSE 'train' END AS split,
          CAST(high OR incident OR urgent AS INTEGER) AS urgency_signal, CAST(policy AS INTEGER) AS policy_sensitive_signal,
          CAST(escalation AS INTEGER) AS escalation_keyword_signal,
          CAST(policy OR escalation OR (high AND incident) AS INTEGER) AS high_risk_policy_label,
          concat_ws('; ', CASE WHEN high THEN 'priority:high' END, nullif(tag_hits, ''), nullif(text_hits, ''),
                    CASE WHEN incident THEN 'type:incident' END) AS risk_signal_terms FROM r)"""


def _risk_labels(spark, sf):
    tickets = curation.normalize_tickets(EXPORT.frame(spark, sf, spread_rows=True), "documents", drop_empty=True).withColumn(
        "split", F.when(F.col("external_id").cast("long") % 3 == 0, "test").otherwise("train")
    )
    return rules.add_risk_labels(tickets, TAG_WORDS, TEXT_WORDS, POLICY_TAGS, POLICY_TEXTS, URGENT_TEXTS)


@query(
    _RISK_SQL
    + """ SELECT external_id, urgency_signal, policy_sensitive_signal, escalation_keyword_signal, high_risk_policy_label,
          risk_signal_terms FROM labelled"""
)
def risk_labels(spark, sf):
    return _risk_labels(spark, sf).select("external_id", *rules.RISK_FLAGS, "risk_signal_terms")


@query(
    _RISK_SQL
    + """ SELECT split, external_id, customer_message, l.model_text, l.priority, l.type, l.combined_tags, urgency_signal,
          policy_sensitive_signal, escalation_keyword_signal, high_risk_policy_label, risk_signal_terms
          FROM labelled l JOIN f USING (external_id)"""
)
def risk_audit(spark, sf):
    return rules.risk_audit(_risk_labels(spark, sf))


@query(
    _RISK_SQL
    + " SELECT 'rows' AS field, 'all' AS value, COUNT(*) AS n FROM labelled UNION ALL SELECT 'split', split, COUNT(*) FROM labelled GROUP BY ALL "
    + " ".join(
        f"UNION ALL SELECT '{c}', CAST({c} AS VARCHAR), COUNT(*) FROM labelled GROUP BY ALL" for c in rules.RISK_FLAGS
    )
)
def risk_label_summary(spark, sf):
    return rules.risk_label_summary(_risk_labels(spark, sf))


# --- risk score and routing -----------------------------------------------------------

_SENSITIVE = "predicted_category IN ('billing_and_payments', 'returns_and_exchanges', 'human_resources')"
_POLICY_LIST = f"concat_ws('|', nullif({sql_terms('t', POLICY_WORDS)}, ''), CASE WHEN {_SENSITIVE} THEN 'sensitive_category:' || predicted_category END)"
_SCORED_SQL = f"""
  WITH s AS (SELECT *, lower(customer_message) AS t FROM ({SCORED.sql})),
  m AS (SELECT *, {sql_count('t', RISK_WORDS)} AS hits, {_POLICY_LIST} AS policy_list,
          list_filter([{', '.join(f"CASE WHEN {sql_has('t', t)} THEN '{t}' END" for t in sorted(RISK_WORDS))}], lambda x: x IS NOT NULL) AS risk_words,
          list_filter([{', '.join([f"CASE WHEN {sql_has('t', t)} THEN '{t}' END" for t in sorted(POLICY_WORDS)] + [f"CASE WHEN {_SENSITIVE} THEN 'sensitive_category:' || predicted_category END"])}], lambda x: x IS NOT NULL) AS policy_words
        FROM s),
  g AS (SELECT *, policy_list <> '' AS policy, predicted_priority IN ('high', 'urgent', 'critical') AS high,
          COALESCE(category_confidence < 0.65e0, FALSE) AS low_c, COALESCE(priority_confidence < 0.55e0, FALSE) AS low_p FROM m),
  k AS (SELECT *, least(99, 10 + least(45, 8 * hits) + CASE WHEN policy THEN 18 ELSE 0 END
          + CASE WHEN high THEN 16 WHEN predicted_priority = 'medium' THEN 6 ELSE 0 END + CASE WHEN low_c THEN 8 ELSE 0 END
          + CASE WHEN low_p THEN 5 ELSE 0 END) AS h,
          list_concat([x FOR x IN [CASE WHEN high THEN 'high_priority:' || predicted_priority END, CASE WHEN low_c THEN 'low_category_confidence' END,
            CASE WHEN low_p THEN 'low_priority_confidence' END, CASE WHEN predicted_priority = 'medium' THEN 'medium_priority' END] IF x IS NOT NULL],
            ['risk_keyword:' || x FOR x IN risk_words[1:8]]) AS base FROM g),
  risk AS (SELECT *, CAST(h AS DOUBLE) / 100e0 AS escalation_risk,
          array_to_string(list_sort(list_distinct(list_concat(base, ['policy:' || x FOR x IN policy_words[1:5]]))), '|') AS risk_signals,
          array_to_string(list_sort(list_distinct(list_concat(base, ['policy:' || x FOR x IN policy_words]))), '|') AS all_signals FROM k)"""


@query(
    f"""WITH s AS (SELECT *, lower(customer_message) AS t FROM ({SCORED.sql}))
        SELECT ticket_id, {_POLICY_LIST} AS policy_signals, {_POLICY_LIST} <> '' AS policy_sensitive FROM s"""
)
def policy_sensitivity(spark, sf):
    found = rules.policy_sensitivity(SCORED.frame(spark, sf, spread_rows=True), terms=POLICY_WORDS)
    return found.select("ticket_id", F.array_join("policy_signals", "|").alias("policy_signals"), "policy_sensitive")


@query(_SCORED_SQL + " SELECT ticket_id, escalation_risk, risk_signals, policy AS policy_sensitive FROM risk")
def escalation_risk(spark, sf):
    scored = rules.score_risk(SCORED.frame(spark, sf, spread_rows=True), **LEXICON)
    return scored.select(
        "ticket_id", "escalation_risk", F.array_join("risk_signals", "|").alias("risk_signals"), "policy_sensitive"
    )


_ROUTED_SQL = _SCORED_SQL + """,
  routed AS (SELECT *, CASE WHEN h >= 80 THEN 1 WHEN policy THEN 2 WHEN low_c THEN 3
          WHEN high AND (priority_confidence IS NULL OR priority_confidence >= 0.55e0) THEN 4 ELSE 5 END AS rule FROM risk)"""
_DECISION = "CASE rule WHEN 1 THEN 'human_review' WHEN 2 THEN 'supervisor_review' WHEN 3 THEN 'human_review' WHEN 4 THEN 'priority_queue' ELSE 'auto_triage_suggestion' END"
_REASON = """CASE rule WHEN 1 THEN 'High escalation risk requires human review before action'
  WHEN 2 THEN 'Policy-sensitive language or category requires supervisor review'
  WHEN 3 THEN 'Low category confidence requires human validation'
  WHEN 4 THEN 'High-priority prediction should be prioritized for operations review'
  ELSE 'Confidence and risk are acceptable for an auto-triage suggestion' END"""


def _routed(spark, sf):
    return rules.route_tickets(SCORED.frame(spark, sf, spread_rows=True), **LEXICON)


@query(
    _ROUTED_SQL
    + f""" SELECT ticket_id, escalation_risk, {_DECISION} AS routing_decision, {_REASON} AS reason, all_signals AS risk_signals,
           policy AS policy_sensitive FROM routed"""
)
def route_ticket(spark, sf):
    return _routed(spark, sf).select(
        "ticket_id", "escalation_risk", "routing_decision", "reason",
        F.array_join("risk_signals", "|").alias("risk_signals"), "policy_sensitive",
    )


@query(
    _ROUTED_SQL
    + f""" SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, predicted_category AS prediction, category_confidence AS confidence, FALSE AS fallback_applied,
           predicted_priority AS priority, escalation_risk, {_DECISION} AS decision, 'v1' AS model_version FROM routed"""
)
def triage_document(spark, sf):
    """The nested triage result, read back field by field."""
    routed = _routed(spark, sf).withColumns(
        {
            "category_distribution": F.create_map("predicted_category", "category_confidence"),
            "priority_distribution": F.create_map("predicted_priority", "priority_confidence"),
        }
    )
    return evaluation.triage_document(routed).select(
        "ticket_id", "category.prediction", "category.confidence", "category.fallback_applied",
        F.col("priority.prediction").alias("priority"), "risk.escalation_risk", "routing.decision", "model_metadata.model_version",
    )


@query(
    f"SELECT ticket_id, CASE WHEN confidence >= 0.8e0 THEN 'auto_route' ELSE 'human_review' END AS decision FROM ({PRED_A.sql})"
)
def gate_decision(spark, sf):
    return PRED_A.frame(spark, sf).select("ticket_id", rules.gate_decision(F.col("confidence")).alias("decision"))


_GATED = f"""{_SCORED_SQL} SELECT category AS true_label, predicted_category AS predicted_label, category_confidence AS confidence,
  h < 80 AND NOT policy AS open FROM risk"""


@query(
    coverage_sql(_GATED, K.GATED_CUTOFFS, "open")
    + """ SELECT threshold, n_auto AS auto_triage_count, n - n_auto AS human_review_count, CAST(n_auto AS DOUBLE) / n AS auto_triage_rate,
          CAST(n - n_auto AS DOUBLE) / n AS human_review_rate, CAST(n_correct AS DOUBLE) / NULLIF(n_auto, 0) AS accuracy_on_auto_triaged,
          macro_f1 AS macro_f1_on_auto_triaged, 0::BIGINT AS high_risk_auto_triaged_count FROM curve"""
)
def risk_gated_sweep(spark, sf):
    scored = rules.score_risk(SCORED.frame(spark, sf, spread_rows=True), **LEXICON)
    return rounded(coverage.risk_gated_sweep(scored), "macro_f1_on_auto_triaged")


@query(_SCORED_SQL + " SELECT ticket_id, category_confidence, escalation_risk FROM risk WHERE category_confidence >= 0.7e0 AND h < 80 AND NOT policy")
def gate_mask(spark, sf):
    scored = rules.score_risk(SCORED.frame(spark, sf, spread_rows=True), **LEXICON)
    keep = coverage.gate_mask(0.7, F.col("category_confidence"), F.col("escalation_risk"), F.col("policy_sensitive"))
    return scored.where(keep).select("ticket_id", "category_confidence", "escalation_risk")


@query(f"SELECT ticket_id, confidence FROM ({PRED_A.sql}) WHERE confidence >= 0.65e0 AND confidence - 0.5e0 >= 0.2e0")
def confidence_mask(spark, sf):
    keep = coverage.confidence_mask(F.col("confidence"), 0.65, F.col("confidence") - 0.5, 0.2)
    return PRED_A.frame(spark, sf).where(keep).select("ticket_id", "confidence")


# --- errors ---------------------------------------------------------------------------

_AMBIGUOUS = ["tion", "thble", "erin"]
_INTENTS = ["and", "the", "ing", "ous", "les", "que"]
_METADATA = ["anea", "ment", "keit"]
_OVERLAPPING = ["customer_service"]


def _sub(terms):
    return " + ".join(f"CASE WHEN contains(t, '{x}') THEN 1 ELSE 0 END" for x in terms)


_WORDS = r"len(regexp_extract_all(t, '\S+'))"
_ERRORS_SQL = f"""
  WITH s AS (SELECT *, lower(customer_message) AS t, category = predicted_category AS category_correct, priority = predicted_priority AS priority_correct
             FROM ({SCORED.sql})),
  e AS (SELECT *, CASE WHEN category_confidence < 0.45e0 THEN 'low_confidence' WHEN priority_confidence < 0.45e0 THEN 'priority_depends_on_metadata'
          WHEN {_sub(_INTENTS)} >= 3 THEN 'multiple_intents' WHEN {_sub(_AMBIGUOUS)} > 0 AND {_WORDS} < 45 THEN 'ambiguous_text'
          WHEN category IN ('customer_service') THEN 'label_overlap' WHEN {_sub(_METADATA)} > 0 THEN 'priority_depends_on_metadata'
          WHEN {_WORDS} < 20 THEN 'insufficient_examples' ELSE 'possible_label_noise' END AS error_type FROM s)"""
_WORD_OPTIONS = {"ambiguous": _AMBIGUOUS, "intents": _INTENTS, "metadata": _METADATA, "overlapping": _OVERLAPPING}


@query(_ERRORS_SQL + " SELECT ticket_id, error_type FROM e")
def likely_reason(spark, sf):
    return rules.likely_reason(SCORED.frame(spark, sf, spread_rows=True), **_WORD_OPTIONS).select("ticket_id", "error_type")


@query(_ERRORS_SQL + " SELECT ticket_id, category_correct, priority_correct FROM s WHERE NOT category_correct OR NOT priority_correct")
def errors_only(spark, sf):
    return rules.errors_only(SCORED.frame(spark, sf, spread_rows=True)).select("ticket_id", "category_correct", "priority_correct")


@query(
    _ERRORS_SQL
    + """ SELECT ticket_id, customer_message, category_correct, priority_correct, error_type, error_type AS likely_reason FROM e
          WHERE NOT category_correct OR NOT priority_correct"""
)
def error_analysis(spark, sf):
    return evaluation.error_analysis(SCORED.frame(spark, sf, spread_rows=True), **_WORD_OPTIONS).select(
        "ticket_id", "customer_message", "category_correct", "priority_correct", "error_type", "likely_reason"
    )


@query(_ERRORS_SQL + " SELECT error_type, COUNT(*) AS n FROM e WHERE NOT category_correct OR NOT priority_correct GROUP BY ALL")
def error_breakdown(spark, sf):
    return rules.error_breakdown(evaluation.error_analysis(SCORED.frame(spark, sf, spread_rows=True), **_WORD_OPTIONS))


@query(
    f"""SELECT ticket_id, CASE WHEN confidence < 0.6e0 THEN 'low_confidence' ELSE 'high_confidence' END AS error_confidence_type
        FROM ({PRED_A.sql}) WHERE true_label <> predicted_label"""
)
def error_confidence_type(spark, sf):
    return rules.wrong_labels(PRED_A.frame(spark, sf)).select("ticket_id", "error_confidence_type")


# --- joins on stored predictions --------------------------------------------------------


@query("SELECT doc_id AS ticket_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_yet_scored(spark, sf):
    """Documents without a label row; the ids on that side are text."""
    tickets = table(spark, sf, "documents").selectExpr("doc_id AS ticket_id", "lang")
    return compare.not_yet_scored(tickets, table(spark, sf, "labels").selectExpr("CAST(doc_id AS STRING) AS ticket_id"))


@query("SELECT doc_id AS ticket_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def only_scored(spark, sf):
    tickets = table(spark, sf, "documents").selectExpr("doc_id AS ticket_id", "lang")
    return compare.only_scored(tickets, table(spark, sf, "labels").selectExpr("CAST(doc_id AS STRING) AS ticket_id"))


# --- dashboard --------------------------------------------------------------------------

_QUEUES = ["click", "error", "purchase", "refund", "view"]
_ZERO = "(VALUES " + ", ".join(f"('{q}')" for q in _QUEUES) + ") q(label)"


@query(
    f"""WITH r AS ({ROUTING.sql})
        SELECT 'queue' AS section, label, (SELECT COUNT(*) FROM r WHERE predicted_queue = label) AS n, NULL::DOUBLE AS average_confidence FROM {_ZERO}
        UNION ALL SELECT 'decision', label, (SELECT COUNT(*) FROM r WHERE decision = label), NULL FROM (VALUES ('auto_route'), ('human_review')) d(label)
        UNION ALL SELECT 'predictions', NULL, COUNT(*), round(AVG(confidence), 8) FROM r
        UNION ALL SELECT 'tickets', NULL, COUNT(*), NULL FROM documents"""
)
def dashboard_summary(spark, sf):
    """Queue counts are zero-filled over a fixed list: one queue has no rows, one is not listed."""
    summary = dashboard.dashboard_summary(table(spark, sf, "documents"), ROUTING.frame(spark, sf), _QUEUES)
    return rounded(summary, "average_confidence")


@query(
    f"""WITH r AS ({ROUTING.sql}) SELECT (SELECT COUNT(*) FROM documents) AS total_tickets, COUNT(*) AS total_predictions,
        concat_ws(',', {', '.join(f"'{q}=' || CAST(COUNT(*) FILTER (predicted_queue = '{q}') AS VARCHAR)" for q in _QUEUES)}) AS queues,
        COUNT(*) FILTER (decision = 'auto_route') AS auto_route, round(AVG(confidence), 8) AS average_confidence FROM r"""
)
def dashboard_document(spark, sf):
    summary = dashboard.dashboard_summary(table(spark, sf, "documents"), ROUTING.frame(spark, sf), _QUEUES)
    document = dashboard.dashboard_document(summary)
    entries = F.transform(F.map_entries("queue_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return document.select(
        "total_tickets", "total_predictions", F.array_join(entries, ",").alias("queues"),
        F.col("decision_counts")["auto_route"].alias("auto_route"), F.round("average_confidence", 8).alias("average_confidence"),
    )


@query(
    f"SELECT label, (SELECT COUNT(*) FROM events WHERE event_type = label) AS n FROM {_ZERO}"
)
def zero_fill_labels(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return dashboard.zero_fill(counts, _QUEUES)


@query("SELECT user_id AS ticket_id, COUNT(*) AS n FROM events GROUP BY ALL HAVING COUNT(*) > 1")
def repeated_ids(spark, sf):
    return compare.repeated_ids(table(spark, sf, "events").selectExpr("user_id AS ticket_id"))


@query(
    f"""SELECT COUNT(*) AS total, COUNT(*) FILTER (decision = 'auto_route') AS auto_route, COUNT(*) FILTER (decision = 'human_review') AS human_review,
        CAST(COUNT(*) FILTER (decision = 'auto_route') AS DOUBLE) / COUNT(*) AS auto_route_rate,
        CAST(COUNT(*) FILTER (decision = 'human_review') AS DOUBLE) / COUNT(*) AS review_rate FROM ({ROUTING.sql})"""
)
def review_rates(spark, sf):
    return dashboard.review_rates(ROUTING.frame(spark, sf))


_RECENT = f"SELECT * FROM ({ROUTING.sql}) ORDER BY created_at DESC, id DESC LIMIT 20"


@query(f"SELECT id, predicted_queue, confidence, decision, latency_ms FROM ({_RECENT})")
def recent_predictions(spark, sf):
    return dashboard.recent_predictions(ROUTING.frame(spark, sf)).select(
        "id", "predicted_queue", "confidence", "decision", "latency_ms"
    )


@query(
    f"""SELECT CAST(MIN(latency_ms) AS DOUBLE) AS min_latency_ms, round(AVG(latency_ms), 8) AS avg_latency_ms,
        CAST(MAX(latency_ms) AS DOUBLE) AS max_latency_ms FROM ({_RECENT})"""
)
def recent_latency(spark, sf):
    return rounded(dashboard.recent_latency(ROUTING.frame(spark, sf)), "avg_latency_ms")


@query(f"SELECT row_number() OVER (ORDER BY created_at, id) AS prediction, confidence FROM ({_RECENT})")
def recent_confidences(spark, sf):
    return dashboard.recent_confidences(ROUTING.frame(spark, sf))


@query(
    f"""SELECT strftime(created_at, '%Y-%m-%d %H:%M UTC') AS timestamp, upper(predicted_queue[1]) || predicted_queue[2:] AS queue, confidence,
        CASE decision WHEN 'auto_route' THEN 'Auto Route' ELSE 'Human Review' END AS decision, threshold, latency_ms, trim(subject) AS subject FROM ({ROUTING.sql})"""
)
def display_predictions(spark, sf):
    return dashboard.display_predictions(ROUTING.frame(spark, sf))


@query(
    """SELECT doc_id AS id, 'New' AS status, CASE doc_id % 3 WHEN 0 THEN upper(source[1]) || source[2:] WHEN 1 THEN 'Sales And Pre-Sales' ELSE '3Rd Don''T' END AS category, 'Unknown' AS priority,
       source || CASE WHEN doc_id % 2 = 0 THEN ' / mail' ELSE '' END AS source_channel,
       CASE WHEN length(line) <= 110 THEN line ELSE substr(line, 1, 109) || '...' END AS message,
       'N/A' AS created, CASE doc_id % 4 WHEN 0 THEN '2024-05-01 10:' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || ' UTC' WHEN 1 THEN 'soon' ELSE 'N/A' END AS updated
       FROM (SELECT *, translate(trim(text, ' ' || chr(10)), chr(10), ' ') AS line FROM documents)"""
)
def display_tickets(spark, sf):
    tickets = table(spark, sf, "documents").selectExpr(
        "doc_id AS id", "'new' AS status",
        "CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN 'Sales and Pre-Sales' ELSE \"3rd don't\" END AS true_category", "'' AS true_priority", "source",
        "CASE WHEN doc_id % 2 = 0 THEN 'mail' END AS channel", "text AS customer_message",
        "CAST(NULL AS TIMESTAMP) AS created_at",
        "CASE doc_id % 4 WHEN 0 THEN concat('2024-05-01T10:', lpad(CAST(doc_id % 60 AS STRING), 2, '0'), ':30+02:00') WHEN 1 THEN 'soon' WHEN 2 THEN '' END AS updated_at",
    )
    return dashboard.display_tickets(tickets)


@query("SELECT doc_id AS id, lang FROM documents ORDER BY doc_id LIMIT 25 OFFSET 40")
def ticket_page(spark, sf):
    return dashboard.ticket_page(table(spark, sf, "documents").selectExpr("doc_id AS id", "lang"), 40, 25)


@query(
    """WITH d AS (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE printf('%08d', doc_id // 3) END AS id FROM documents),
          p AS (SELECT id FROM d ORDER BY id NULLS FIRST LIMIT 60 OFFSET 130) SELECT id, COUNT(*) AS n FROM p GROUP BY id"""
)
def ticket_page_deep(spark, sf):
    """A page further in over text ids with ties and nulls: how many rows of each id it holds."""
    tickets = table(spark, sf, "documents").selectExpr(
        "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE format_string('%08d', doc_id DIV 3) END AS id", "lang", "doc_id"
    )
    return dashboard.ticket_page(tickets, 130, 60).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'first' AS page, * FROM (SELECT doc_id AS id, lang FROM documents ORDER BY doc_id LIMIT 20)
       UNION ALL SELECT 'deep', * FROM (SELECT doc_id AS id, lang FROM documents ORDER BY doc_id LIMIT 30 OFFSET 145)"""
)
def ticket_page_indexed(spark, sf):
    """Two pages of a store that was written in two parts whose ranges overlap; only files that cross a page are read."""
    path = fresh_path(spark, "paged")
    tickets = table(spark, sf, "documents").selectExpr("doc_id AS id", "lang")
    for part in (0, 1):
        paged.append_paged(tickets.where(f"id % 2 = {part}"), path)
    pages = [paged.read_page(spark, path, skip, limit).select(F.lit(name).alias("page"), "id", "lang") for name, skip, limit in (("first", 0, 20), ("deep", 145, 30))]
    return pages[0].unionByName(pages[1])


# --- probabilities and the record contract ----------------------------------------------

_P = [f"CAST(1 + w{i} AS DOUBLE) / (total + 6)" for i in range(7)]


def _weighted(spark, sf):
    rows = QUEUE_WEIGHTS.frame(spark, sf)
    pairs = [x for q, i in zip(K.QUEUES, range(7)) for x in (F.lit(q), F.expr(_P[i]))]
    return rows.withColumn("probabilities", F.create_map(*pairs))


_LONG = f"""SELECT event_id, total, unnest([{', '.join(f"'{q}'" for q in K.QUEUES)}]) AS queue, unnest([{', '.join(_P)}]) AS p FROM ({QUEUE_WEIGHTS.sql})"""
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p DESC, queue) AS place FROM ({_LONG})"


@query(
    f"""SELECT event_id, CAST(place AS INTEGER) AS place, queue, round(p, 8) AS probability FROM ({_RANKED}) WHERE place <= 3"""
)
def top_k_probabilities(spark, sf):
    best = F.posexplode_outer(lb.top_probabilities(F.col("probabilities"), 3))
    rows = _weighted(spark, sf).select("event_id", best.alias("i", "t"))
    return rows.where(F.col("t").isNotNull()).select(
        "event_id", (F.col("i") + 1).cast("int").alias("place"), F.col("t.label").alias("queue"),
        F.round("t.probability", 8).alias("probability"),
    )


@query(
    f"""SELECT event_id, {sql_round('MAX(CASE WHEN place = 1 THEN p END) - MAX(CASE WHEN place = 2 THEN p END)', 4)} AS margin
        FROM ({_RANKED}) GROUP BY event_id"""
)
def top_margin(spark, sf):
    ranked = lb.ranked_probabilities(F.col("probabilities"))
    return _weighted(spark, sf).select("event_id", lb.top_margin(ranked).alias("margin"))


@query(
    f"""WITH r AS (SELECT event_id, place, queue, {sql_round('p', 4)} AS p FROM ({_RANKED}))
        SELECT event_id, MAX(CASE WHEN place = 1 THEN queue END) AS top_1_label, MAX(CASE WHEN place = 1 THEN p END) AS top_1_probability,
        MAX(CASE WHEN place = 2 THEN queue END) AS top_2_label, MAX(CASE WHEN place = 2 THEN p END) AS top_2_probability,
        MAX(CASE WHEN place = 3 THEN queue END) AS top_3_label, MAX(CASE WHEN place = 3 THEN p END) AS top_3_probability,
        round_even((MAX(CASE WHEN place = 1 THEN p END) - MAX(CASE WHEN place = 2 THEN p END)) * 1e4, 0) / 1e4 AS top1_top2_margin
        FROM r GROUP BY event_id"""
)
def ranked_columns(spark, sf):
    """The flat columns of a prediction file with the three best labels."""
    return _weighted(spark, sf).select("event_id", *lb.ranked_columns(F.col("probabilities")))


@query(
    f"""SELECT event_id, {', '.join(f'{sql_round(p, 6)} AS prob_{q}' for p, q in zip(_P, K.QUEUES))}, 0e0 AS prob_other FROM ({QUEUE_WEIGHTS.sql})"""
)
def probability_columns(spark, sf):
    return _weighted(spark, sf).select(
        "event_id", *lb.probability_columns(F.col("probabilities"), [*K.QUEUES, "other"])
    )


@query(
    f"""SELECT event_id AS id, CAST(place AS INTEGER) AS rank, CASE queue WHEN 'billing_and_payments' THEN 'Billing & Payments' WHEN 'customer_general' THEN 'Customer General'
          WHEN 'human_resources' THEN 'Human Resources' WHEN 'returns_and_exchanges' THEN 'Returns & Exchanges' WHEN 'sales_and_pre_sales' THEN 'Sales & Pre-Sales'
          WHEN 'service_outages_and_maintenance' THEN 'Service Outages & Maintenance' ELSE 'Technical Product Support' END AS queue,
        round(p, 8) AS probability FROM ({_RANKED})"""
)
def probability_breakdown(spark, sf):
    rows = dashboard.probability_breakdown(_weighted(spark, sf).withColumnRenamed("event_id", "id"))
    return rounded(rows, "probability")


_RECORDS_SQL = f"""
  SELECT event_id AS id, event_id % 13 = 0 AS bad_queue, event_id % 17 = 0 AS bad_decision, event_id % 19 = 0 AS bad_confidence,
         event_id % 23 = 0 AS bad_map, event_id % 29 = 0 AS bad_value, event_id % 31 = 0 AS bad_latency, event_id % 37 = 0 AS bad_subject FROM events"""


@query(
    f"""SELECT id, concat_ws(',', CASE WHEN bad_queue THEN 'predicted_queue' END, CASE WHEN bad_decision THEN 'decision' END,
          CASE WHEN bad_confidence THEN 'confidence' END, CASE WHEN bad_map OR bad_value THEN 'probabilities' END,
          CASE WHEN bad_latency THEN 'latency_ms' END, CASE WHEN bad_subject THEN 'subject' END) AS errors FROM ({_RECORDS_SQL})"""
)
def validate_predictions(spark, sf):
    """Routing records, some broken on purpose, with what is wrong with each."""
    rows = _weighted(spark, sf)
    every = lambda n: F.col("event_id") % n == 0
    complete = F.col("probabilities")
    short = F.map_filter(complete, lambda k, v: k != "human_resources")
    high = F.transform_values(complete, lambda k, v: F.when(k == "customer_general", v + 1).otherwise(v))
    records = rows.select(
        F.col("event_id").alias("id"),
        F.when(every(13), "other").otherwise("human_resources").alias("predicted_queue"),
        F.when(every(17), "later").otherwise("auto_route").alias("decision"),
        F.when(every(19), 1.5).otherwise(0.5).alias("confidence"),
        F.when(every(23), short).when(every(29), high).otherwise(complete).alias("probabilities"),
        F.when(every(31), -1).otherwise(5).alias("latency_ms"),
        F.when(every(37), "").otherwise("subject").alias("subject"),
    )
    return validation.check_predictions(records).select("id", F.array_join("errors", ",").alias("errors"))


# --- stored tables ----------------------------------------------------------------------

_INCOMING = """SELECT CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN '' ELSE 'x' || CAST(doc_id // 2 AS VARCHAR) END AS external_id,
  text AS customer_message, source AS true_category, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'open' END AS status, lang AS language, doc_id FROM documents"""
_STORED_IDS = "SELECT 'x' || CAST(doc_id AS VARCHAR) AS external_id FROM labels"
_NEW_SQL = f"""
  WITH i AS ({_INCOMING}), k AS (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY doc_id) AS place FROM i)
  SELECT external_id, customer_message, true_category, NULL::VARCHAR AS true_priority, COALESCE(nullif(status, ''), 'new') AS status,
         NULL::VARCHAR AS channel, NULL::VARCHAR AS source, NULL::VARCHAR AS ticket_type, language, NULL::VARCHAR AS reference_answer,
         NULL::VARCHAR AS tags, doc_id AS load_order
  FROM k WHERE COALESCE(external_id, '') = '' OR (place = 1 AND external_id NOT IN ({_STORED_IDS}))"""


def _incoming(spark, sf):
    key = "CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN '' ELSE concat('x', CAST(doc_id DIV 2 AS STRING)) END"
    return table(spark, sf, "documents").selectExpr(
        f"{key} AS external_id", "text AS customer_message", "source AS true_category",
        "CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'open' END AS status", "lang AS language", "doc_id",
    )


def _stored_ids(spark, sf):
    return table(spark, sf, "labels").selectExpr("concat('x', CAST(doc_id AS STRING)) AS external_id")


@query(_NEW_SQL)
def load_new_tickets(spark, sf):
    """What a load adds: ids repeat in the batch, some are stored, some rows have none."""
    return stores.new_tickets(_incoming(spark, sf).drop("doc_id"), _stored_ids(spark, sf))


@query(
    f"""WITH first AS ({_NEW_SQL.replace(f"AND external_id NOT IN ({_STORED_IDS})", "")})
        SELECT COUNT(*) AS stored_rows, COUNT(nullif(external_id, '')) AS keyed_rows,
               COUNT(*) FILTER (COALESCE(external_id, '') = '') AS added_again FROM first"""
)
def load_twice(spark, sf):
    """Loading a batch twice: the second time only rows without an external id come again."""
    path = fresh_path(spark, "tickets")
    load_tickets(_incoming(spark, sf), path, order="doc_id")
    second = load_tickets(_incoming(spark, sf), path, order="doc_id")
    stored = spark.read.parquet(path)
    return stored.agg(
        (F.count(F.lit(1)) - F.lit(second)).alias("stored_rows"),
        F.count_distinct(F.nullif(F.col("external_id"), F.lit(""))).alias("keyed_rows"),
        F.lit(second).cast("long").alias("added_again"),
    )


_CHANGES = """SELECT doc_id AS id, quality, toxic, CASE WHEN toxic = 1 THEN TRUE ELSE FALSE END AS gone FROM labels"""
_AFTER_SQL = f"""
  WITH s AS (SELECT doc_id AS id, lang AS language, source AS channel, 'new' AS status FROM documents), c AS ({_CHANGES})
  SELECT s.id, CASE WHEN c.id IS NOT NULL THEN NULL ELSE s.language END AS language, CASE WHEN c.quality = 1 THEN 'good' ELSE s.channel END AS channel,
         CASE WHEN c.id IS NOT NULL THEN 'changed' ELSE s.status END AS status, c.id IS NOT NULL AS stamped
  FROM s LEFT JOIN c ON s.id = c.id WHERE NOT COALESCE(gone, FALSE)
  UNION ALL SELECT -1 - doc_id, NULL, 'added', 'new', TRUE FROM labels WHERE toxic = 0
  UNION ALL SELECT doc_id, NULL, 'again', 'new', TRUE FROM labels WHERE toxic = 1 AND doc_id % 2 = 0"""


def _stored(spark, sf):
    return table(spark, sf, "documents").selectExpr(
        "doc_id AS id", "lang AS language", "source AS channel", "'new' AS status",
        "timestamp'2024-01-01 00:00:00' AS created_at", "timestamp'2024-01-01 00:00:00' AS updated_at",
    )


def _changes(spark, sf):
    """Per label row: language set to null, channel set for good ones, toxic ones deleted,
    and for the others a new ticket. Each change of a row comes in two parts."""
    labels = table(spark, sf, "labels")
    changed = labels.selectExpr(
        "doc_id AS id",
        "CASE WHEN quality = 1 THEN array('language', 'channel', 'status') ELSE array('language', 'status') END AS set_fields",
        "CAST(NULL AS STRING) AS language", "'good' AS channel", "'draft' AS status", "false AS delete", "1 AS seq",
    )
    later = labels.selectExpr(
        "doc_id AS id", "array('status') AS set_fields", "'xx' AS language", "'ignored' AS channel", "'changed' AS status",
        "toxic = 1 AS delete", "2 AS seq",
    )
    added = labels.where("toxic = 0").selectExpr(
        "-1 - doc_id AS id", "array('channel') AS set_fields", "CAST(NULL AS STRING) AS language", "'added' AS channel",
        "CAST(NULL AS STRING) AS status", "false AS delete", "1 AS seq",
    )
    again = labels.where("toxic = 1 AND doc_id % 2 = 0").selectExpr(
        "doc_id AS id", "array('channel') AS set_fields", "CAST(NULL AS STRING) AS language", "'again' AS channel",
        "CAST(NULL AS STRING) AS status", "false AS delete", "3 AS seq",
    )
    return changed.unionByName(later).unionByName(added).unionByName(again).withColumn("at", F.expr("timestamp'2024-06-01 00:00:00'"))


@query(_AFTER_SQL)
def ticket_upsert(spark, sf):
    """Inserts, partial updates with explicit nulls, several changes to one row, deletes."""
    after = stores.upsert_tickets(_stored(spark, sf), _changes(spark, sf))
    return after.select("id", "language", "channel", "status", (F.month("updated_at") == 6).alias("stamped"))


@query(
    """SELECT event_id AS id, CASE WHEN user_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN NULL ELSE user_id END AS ticket_id FROM events"""
)
def detach_deleted(spark, sf):
    """Log rows of deleted tickets stay, without their reference."""
    log = table(spark, sf, "events").selectExpr("event_id AS id", "user_id AS ticket_id")
    return stores.detach_deleted(log, _changes(spark, sf))


@query(f"SELECT *, 2::BIGINT AS copies FROM ({_AFTER_SQL})")
def ticket_changes_merged(spark, sf):
    """Changes added to a bucketed store in two batches: the table as read before and after compaction, alike."""
    path, changes = fresh_path(spark, "merged-tickets"), _changes(spark, sf)
    merge_store.create_store(_stored(spark, sf), path)
    for batch in ("seq < 3", "seq = 3"):  # what comes again after a delete comes later
        merge_store.add_changes(changes.where(batch), path)
    before = merge_store.read_store(spark, path)
    merge_store.compact(spark, path, remove=False)
    rows = before.unionByName(merge_store.read_store(spark, path))
    rows = rows.select("id", "language", "channel", "status", (F.month("updated_at") == 6).alias("stamped"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))


@query(
    f"""WITH s AS ({_AFTER_SQL}) SELECT 'tickets' AS store, COUNT(*) AS n, COUNT(language) AS filled FROM s
        UNION ALL SELECT 'log', COUNT(*), COUNT(CASE WHEN user_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN NULL ELSE user_id END) FROM events"""
)
def ticket_changes_applied(spark, sf):
    """The stored tables rewritten in place by a batch of changes."""
    tickets, log = fresh_path(spark, "tickets"), fresh_path(spark, "log")
    _stored(spark, sf).write.parquet(tickets)
    table(spark, sf, "events").selectExpr("event_id AS id", "user_id AS ticket_id").write.parquet(log)
    apply_ticket_changes(_changes(spark, sf), tickets, log)
    return spark.read.parquet(tickets).agg(
        F.lit("tickets").alias("store"), F.count(F.lit(1)).alias("n"), F.count("language").alias("filled")
    ).unionByName(
        spark.read.parquet(log).agg(F.lit("log").alias("store"), F.count(F.lit(1)).alias("n"), F.count("ticket_id").alias("filled"))
    )


@query(
    f"""SELECT CAST(created_at AS DATE)::VARCHAR AS day, decision, COUNT(*) AS n, CAST(SUM(latency_ms) AS BIGINT) AS latency FROM ({ROUTING.sql}) GROUP BY ALL"""
)
def append_predictions(spark, sf):
    """The routing log appended to its table, partitioned by day, and read back."""
    path = fresh_path(spark, "log")
    append_records(ROUTING.frame(spark, sf), path)
    return spark.read.parquet(path).groupBy(F.col("created_date").cast("string").alias("day"), "decision").agg(
        F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("latency")
    )


@query(
    f"""WITH s AS ({SCORED.sql}), a AS (SELECT category AS true_label, predicted_category AS predicted_label, COUNT(*) AS n FROM s GROUP BY ALL),
        b AS (SELECT priority AS true_label, predicted_priority AS predicted_label, COUNT(*) AS n FROM s GROUP BY ALL)
        SELECT 'category' AS target, * FROM ({summary_sql('a')}) UNION ALL SELECT 'priority', * FROM ({summary_sql('b')})"""
)
def evaluate_targets(spark, sf):
    """Scores of both targets of one scored table."""
    scored = SCORED.frame(spark, sf, spread_rows=True)
    rows = None
    for target in ("category", "priority"):
        cells = confusion_cells(scored, true=target, predicted=f"predicted_{target}")
        row = score_summary(cells).select(F.lit(target).alias("target"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return rounded(rows, "macro_f1", "weighted_f1")
