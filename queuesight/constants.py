"""Names, labels, word lists and thresholds that results depend on.

Every operator takes these as parameters; the values here are the defaults.
"""

# --- Fixed values: column roles, in order of preference ------------------------

TEXT_COLUMNS = ["customer_message", "message", "ticket_text", "text", "body", "description", "subject"]
CATEGORY_COLUMNS = ["true_category", "category", "queue", "group", "department", "label", "intent"]
PRIORITY_COLUMNS = ["true_priority", "priority", "urgency", "severity"]
LANGUAGE_COLUMNS = ["language", "lang", "locale"]

SOURCE_ID_COLUMNS = ["id", "ticket_id", "external_id"]
SOURCE_CATEGORY_COLUMNS = ["queue", "category", "group", "department", "true_category"]
SOURCE_PRIORITY_COLUMNS = ["priority", "true_priority", "urgency", "severity"]
SOURCE_TYPE_COLUMNS = ["type", "ticket_type", "request_type", "incident_type"]
SOURCE_ANSWER_COLUMNS = ["answer", "agent_answer", "resolution", "reference_answer", "response"]
SOURCE_SUBJECT_COLUMNS = ["subject", "title"]
SOURCE_MESSAGE_COLUMNS = ["customer_message", "message", "ticket_text", "text"]
SOURCE_BODY_COLUMNS = ["body", "description", "content", "customer_message", "message", "ticket_text", "text"]
TAG_COUNT = 8

KEY_FIELDS = [
    "customer_message",
    "true_category",
    "true_priority",
    "ticket_type",
    "language",
    "reference_answer",
    "tags",
]

STORED_TICKET_COLUMNS = [
    "external_id",
    "customer_message",
    "true_category",
    "true_priority",
    "status",
    "channel",
    "source",
    "ticket_type",
    "language",
    "reference_answer",
    "tags",
]

RISK_AUDIT_COLUMNS = [
    "split",
    "ticket_id",
    "external_id",
    "customer_message",
    "model_text",
    "category",
    "priority",
    "type",
    "combined_tags",
    "urgency_signal",
    "policy_sensitive_signal",
    "escalation_keyword_signal",
    "high_risk_policy_label",
    "risk_signal_terms",
]

# Label columns tried for each prediction task, in order.
TASK_LABEL_COLUMNS = {
    "parent_queue": ["category", "true_category", "parent_queue"],
    "priority": ["priority", "true_priority"],
    "ticket_type": ["ticket_type", "type"],
    "raw_queue": ["queue", "true_category", "category"],
}

# Columns written after a ticket was resolved; never a model input.
LEAKY_COLUMNS = ["answer", "reference_answer"]

# --- Fixed values: files --------------------------------------------------------

DATASET_SUFFIXES = ["csv", "tsv", "json", "jsonl"]
SMOKE_FILENAMES = ["synthetic_tickets.csv"]
GENERATED_DIRNAMES = ["outputs", "__pycache__", "smoke_processed"]
GENERATED_FILENAMES = [
    "data_audit.json",
    "data_audit_summary.csv",
    "seed_load_scripts.csv",
    "split_metadata.json",
    "train.csv",
    "val.csv",
    "test.csv",
]

# Text cells that a CSV reader takes as missing (the pandas defaults).
MISSING_CELLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- Fixed values: labels -------------------------------------------------------

QUEUES = [
    "billing_and_payments",
    "customer_general",
    "human_resources",
    "returns_and_exchanges",
    "sales_and_pre_sales",
    "service_outages_and_maintenance",
    "technical_product_support",
]
DECISIONS = ["auto_route", "human_review"]

# Ten source queues to seven; labels not named here stay as they are.
MERGED_QUEUE_MAP = {
    "technical_support": "technical_product_support",
    "it_support": "technical_product_support",
    "product_support": "technical_product_support",
    "customer_service": "customer_general",
    "general_inquiry": "customer_general",
}
MERGED_ONLY_LABELS = ["technical_product_support", "customer_general"]
MERGED_TAXONOMY = "clean_v1"
SOURCE_TAXONOMY = "original_10"

QUEUE_DISPLAY = {
    "billing_and_payments": "Billing & Payments",
    "customer_general": "Customer General",
    "human_resources": "Human Resources",
    "returns_and_exchanges": "Returns & Exchanges",
    "sales_and_pre_sales": "Sales & Pre-Sales",
    "service_outages_and_maintenance": "Service Outages & Maintenance",
    "technical_product_support": "Technical Product Support",
}

# --- Fixed values: word lists ---------------------------------------------------

RISK_TERMS = [
    "legal", "lawsuit", "chargeback", "fraud", "regulator", "complaint", "angry", "cancel", "refund",
    "charged twice", "duplicate charge", "manager", "escalate", "escalating", "urgent", "today",
    "account locked", "cannot access", "safety", "compliance",
]
POLICY_TERMS = [
    "legal", "lawsuit", "regulator", "compliance", "privacy", "gdpr", "hipaa", "fraud", "chargeback",
    "safety", "contract",
]
SENSITIVE_CATEGORIES = ["billing_and_payments", "returns_and_exchanges", "human_resources"]
HIGH_PRIORITIES = ["high", "urgent", "critical"]

TAG_RISK_TERMS = ["security", "outage", "disruption", "data breach", "fraud", "compliance", "legal"]
TEXT_RISK_TERMS = [
    "legal", "lawsuit", "chargeback", "fraud", "regulator", "complaint", "urgent", "outage",
    "data breach", "account locked", "cannot access", "safety", "compliance", "refund",
    "duplicate charge", "charged twice",
]
POLICY_TAG_TERMS = ["security", "data breach", "fraud", "compliance", "legal"]
POLICY_TEXT_TERMS = ["legal", "lawsuit", "chargeback", "fraud", "regulator", "safety", "compliance"]
URGENT_TEXT_TERMS = ["urgent", "outage"]

AMBIGUOUS_TERMS = ["help", "issue", "problem", "question", "request", "support", "not working"]
MULTI_INTENT_TERMS = ["and", "also", "another", "refund", "login", "billing", "order", "account"]
METADATA_TERMS = ["priority", "urgent", "asap", "today", "deadline", "blocked"]
OVERLAPPING_CATEGORIES = ["customer_service", "product_support", "technical_support"]

# --- Fixed values: outcomes of the routing rules, in the order the rules apply ---

HIGH_RISK_OUTCOME = ("human_review", "High escalation risk requires human review before action")
POLICY_OUTCOME = ("supervisor_review", "Policy-sensitive language or category requires supervisor review")
LOW_CONFIDENCE_OUTCOME = ("human_review", "Low category confidence requires human validation")
HIGH_PRIORITY_OUTCOME = ("priority_queue", "High-priority prediction should be prioritized for operations review")
DEFAULT_OUTCOME = ("auto_triage_suggestion", "Confidence and risk are acceptable for an auto-triage suggestion")

# --- Fixed values: identifiers ---

SOURCE_ID_PREFIX = "source-"
TICKET_ID_PREFIX = "ticket-"
MODEL_TYPE = "tfidf_logistic_regression_baseline"

# --- Fixed values: thresholds ---------------------------------------------------

ROUTE_THRESHOLD = 0.80
LOW_CATEGORY_CONFIDENCE = 0.65
LOW_PRIORITY_CONFIDENCE = 0.55
HIGH_RISK = 0.80
LOW_ERROR_CONFIDENCE = 0.60
LOW_REASON_CONFIDENCE = 0.45
COVERAGE_CUTOFFS = [round(0.05 * i, 2) for i in range(20)]
GATED_CUTOFFS = [round(i / 100, 2) for i in range(50, 100, 5)]
REVIEW_BUDGETS = [0.1, 0.2, 0.3, 0.5]
CALIBRATION_BINS = 10
BOOTSTRAP_RESAMPLES = 2000
TOKEN_PRICE_PER_MILLION = 0.042
SEED = 42

# Published figures that a scored system is set against, by taxonomy.
PUBLISHED_BASELINES = {
    "original_10": {"accuracy": 0.5229, "macro_f1": 0.4725, "weighted_f1": 0.5158},
    "clean_v1": {"accuracy": 0.73, "macro_f1": None, "weighted_f1": None},
    "tfidf_10": {"accuracy": 0.4409, "macro_f1": 0.4121, "weighted_f1": 0.4430},
}

# Text model settings.
VOCABULARY_SIZE = 5000
MAX_ITERATIONS = 1000
SCORING_BATCH = 32
