"""Ticket, prediction and routing views over the given tables.

Every view is a list of column expressions that Spark and DuckDB read alike, so the query
and its SQL counterpart start from the same rows. Views cover their whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL counterpart."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


class View:
    """Named expressions over a table (or over another view)."""

    def __init__(self, base: str | View, *columns: str):
        self.base, self.columns = base, columns

    def frame(self, spark: SparkSession, sf: str, spread_rows: bool = False) -> DataFrame:
        """The view; `spread_rows` for work that is heavy per row (see `session.spread`)."""
        if isinstance(self.base, str):
            source = table(spark, sf, self.base)
            source = spread(source) if spread_rows else source
        else:
            source = self.base.frame(spark, sf, spread_rows)
        return source.selectExpr(*self.columns)

    @property
    def sql(self) -> str:
        source = self.base if isinstance(self.base, str) else f"({self.base.sql})"
        return f"SELECT {', '.join(self.columns)} FROM {source}"


# Predictions of a first system: more often right the more confident it is.
_A = View("events", "*", "(event_id * 7919) % 1001 AS c", "(event_id * 104729) % 1000 AS r")
PRED_A = View(
    _A,
    "event_id AS ticket_id",
    "event_type AS true_label",
    "CASE WHEN r * 10 < 2000 + 6 * c THEN event_type WHEN event_id % 3 = 0 THEN 'click' "
    "WHEN event_id % 3 = 1 THEN 'view' ELSE 'error' END AS predicted_label",
    "CAST(c AS DOUBLE) / 1000e0 AS confidence",
    "(event_id * 31) % 400 AS latency_ms",
    "(event_id * 17) % 900 AS input_tokens",
)
# A second system on the same tickets, with many tied confidences.
PRED_B = View(
    "events",
    "event_id AS ticket_id",
    "event_type AS true_label",
    "CASE WHEN (event_id * 7) % 10 < 5 THEN event_type WHEN event_id % 2 = 0 THEN 'signup' ELSE 'view' END "
    "AS predicted_label",
    "CAST((event_id * 13) % 50 AS DOUBLE) / 50e0 AS confidence",
    "(event_id * 37) % 700 AS latency_ms",
    "(event_id * 19) % 1100 AS input_tokens",
)
# The same predictions as text, the way a file brings them, with unreadable numbers.
RAW_PREDICTIONS = View(
    _A,
    "CAST(event_id AS STRING) AS ticket_id",
    "event_type AS true_label",
    "CASE WHEN event_id % 3 = 0 THEN 'click' ELSE event_type END AS predicted_label",
    "CASE WHEN event_id % 10 = 0 THEN 'n/a' WHEN event_id % 10 = 1 THEN 'nan' WHEN event_id % 10 = 2 THEN NULL "
    "WHEN event_id % 10 = 3 THEN '' WHEN event_id % 10 = 4 THEN '1.2d' "
    "ELSE concat('0.', lpad(CAST(c AS STRING), 4, '0')) END AS confidence",
    "CAST(r AS DOUBLE) / 1000e0 AS top_1_probability",
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(r / 2e0 AS DOUBLE) / 1000e0 END AS top_2_probability",
)
ROUTING = View(
    _A,
    "event_id AS id",
    "user_id AS ticket_id",
    "event_type AS predicted_queue",
    "CAST(c AS DOUBLE) / 1000e0 AS confidence",
    "0.8e0 AS threshold",
    "CASE WHEN c >= 800 THEN 'auto_route' ELSE 'human_review' END AS decision",
    "(event_id * 31) % 400 AS latency_ms",
    "props AS subject",
    "ts AS created_at",
)
# Probabilities over the seven queues; some records break the contract.
_WEIGHTS = View(
    "events",
    "event_id",
    "event_type",
    "ts",
    "props",
    *[f"(event_id * {p} + {i}) % {m} AS w{i}" for i, (p, m) in enumerate([(3, 11), (5, 13), (7, 17), (11, 19), (13, 23), (17, 29), (19, 31)])],
)
QUEUE_WEIGHTS = View(
    _WEIGHTS,
    "event_id", "event_type", "ts", "props",
    *[f"w{i}" for i in range(7)],
    "CAST(1 + w0 + w1 + w2 + w3 + w4 + w5 + w6 AS DOUBLE) AS total",
)

# Documents as a source export: first line as subject, the rest as body.
EXPORT = View(
    "documents",
    "doc_id AS id",
    "CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE NULL END AS subject",
    "CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE text END AS body",
    "source AS answer",
    "CASE WHEN doc_id % 4 = 0 THEN 'Incident' WHEN doc_id % 4 = 1 THEN ' Request ' WHEN doc_id % 4 = 2 THEN '' "
    "ELSE NULL END AS type",
    "CASE WHEN doc_id % 5 = 0 THEN 'Billing and Payments' WHEN doc_id % 5 = 1 THEN 'Technical Support' "
    "WHEN doc_id % 5 = 2 THEN 'Customer Service' WHEN doc_id % 5 = 3 THEN 'Sales and Pre-Sales' "
    "ELSE 'Human Resources' END AS queue",
    "CASE WHEN doc_id % 3 = 0 THEN 'high' WHEN doc_id % 3 = 1 THEN ' Medium' ELSE 'low' END AS priority",
    "CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS language",
    "source AS tag_1",
    "CASE WHEN doc_id % 7 = 0 THEN 'None' WHEN doc_id % 7 = 1 THEN ' Security ' WHEN doc_id % 7 = 2 THEN 'outage' "
    "WHEN doc_id % 7 = 3 THEN 'nan' ELSE NULL END AS tag_2",
    "CASE WHEN doc_id % 9 = 0 THEN 'data breach' ELSE ' ' END AS tag_3",
)
# Tickets with predictions of a category and a priority model.
SCORED = View(
    "documents",
    "doc_id AS ticket_id",
    "text AS customer_message",
    "CASE WHEN doc_id % 3 = 0 THEN 'technical_support' WHEN doc_id % 3 = 1 THEN 'customer_service' "
    "ELSE 'billing_and_payments' END AS category",
    "CASE WHEN (doc_id * 7) % 10 < 6 THEN CASE WHEN doc_id % 3 = 0 THEN 'technical_support' WHEN doc_id % 3 = 1 "
    "THEN 'customer_service' ELSE 'billing_and_payments' END WHEN doc_id % 2 = 0 THEN 'human_resources' "
    "ELSE 'it_support' END AS predicted_category",
    "CAST((doc_id * 7919) % 1001 AS DOUBLE) / 1000e0 AS category_confidence",
    "CASE WHEN doc_id % 4 = 0 THEN 'high' WHEN doc_id % 4 = 1 THEN 'medium' ELSE 'low' END AS priority",
    "CASE WHEN doc_id % 5 = 0 THEN 'high' WHEN doc_id % 5 = 1 THEN 'medium' WHEN doc_id % 5 = 2 THEN 'urgent' "
    "ELSE 'low' END AS predicted_priority",
    "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST((doc_id * 31) % 1001 AS DOUBLE) / 1000e0 END AS priority_confidence",
)
# Tickets with the columns of the canonical frame.
TICKETS = View(
    "documents", "doc_id", "text", "lang", "source AS queue", "lang AS priority_hint"
)

# Words that occur in the given documents, in place of the default lists.
RISK_WORDS = ["license", "released under", "that", "with the", "this", "from", "only", "ones", "then", "les", "que"]
POLICY_WORDS = ["license", "mit", "apache", "rights reserved", "that the", "only", "reserved"]
TEXT_WORDS = ["license", "rights reserved", "with the", "only", "than", "mit"]
TAG_WORDS = ["security", "outage", "data breach", "src3"]
POLICY_TAGS = ["security", "data breach"]
POLICY_TEXTS = ["license", "mit"]
URGENT_TEXTS = ["rights reserved"]

def sql_has(text: str, term: str) -> str:
    """SQL test for a whole word, without look-around."""
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_]){term}($|[^\\p{{L}}\\p{{N}}_])')"


def sql_terms(text: str, terms: Sequence[str], prefix: str = "", separator: str = "|") -> str:
    cases = [f"CASE WHEN {sql_has(text, t)} THEN '{prefix}{t}' END" for t in sorted(terms)]
    return f"concat_ws('{separator}', {', '.join(cases)})"


def sql_count(text: str, terms: Sequence[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {sql_has(text, t)} THEN 1 ELSE 0 END" for t in terms) + ")"


def sql_round(value: str, digits: int) -> str:
    """Half-even on the exact binary value, as formatting a double does it."""
    return f"CAST(format('{{{{:.{digits}f}}}}', {value}) AS DOUBLE)".replace("{{", "{").replace("}}", "}")


def class_scores_sql(cells: str, by: Sequence[str] = ()) -> str:
    """Per-label support, predictions, hits and scores from a relation of (by, true, predicted, n)."""
    keys = "".join(f"{b}, " for b in by)
    return f"""
      SELECT {keys}label, support, predicted, tp,
             CASE WHEN predicted = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / predicted END AS precision,
             CASE WHEN support = 0 THEN 0e0 ELSE CAST(tp AS DOUBLE) / support END AS recall,
             CAST(2 * tp AS DOUBLE) / (support + predicted) AS f1_score
      FROM (SELECT {keys}label, CAST(SUM(s) AS BIGINT) AS support, CAST(SUM(p) AS BIGINT) AS predicted,
                   CAST(SUM(h) AS BIGINT) AS tp
            FROM (SELECT {keys}true_label AS label, n AS s, 0 AS p,
                         CASE WHEN true_label = predicted_label THEN n ELSE 0 END AS h FROM {cells}
                  UNION ALL SELECT {keys}predicted_label, 0, n, 0 FROM {cells})
            GROUP BY {keys}label)
      WHERE support + predicted > 0"""


def summary_sql(cells: str, by: Sequence[str] = ()) -> str:
    keys = "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    return f"""
      SELECT {keys}CAST(SUM(support) AS BIGINT) AS n, CAST(SUM(tp) AS BIGINT) AS n_correct,
             CAST(SUM(tp) AS DOUBLE) / SUM(support) AS accuracy, round(AVG(f1_score), 8) AS macro_f1,
             round(SUM(f1_score * support) / SUM(support), 8) AS weighted_f1
      FROM ({class_scores_sql(cells, by)}){group}"""


def coverage_sql(source: str, cutoffs: Sequence[float], gate: str = "TRUE") -> str:
    """Coverage figures by joining every cutoff with every row of `source`."""
    grid = ", ".join(f"({c!r}::DOUBLE)" for c in cutoffs)
    return f"""
      WITH p AS ({source}), grid(threshold) AS (VALUES {grid}),
      cells AS (SELECT threshold, true_label, predicted_label, COUNT(*) AS n FROM p JOIN grid
                ON confidence >= threshold AND {gate} GROUP BY ALL),
      scores AS (SELECT threshold, AVG(f1_score) AS macro_f1 FROM ({class_scores_sql('cells', ['threshold'])}) GROUP BY threshold),
      sums AS (SELECT threshold, CAST(SUM(n) AS BIGINT) AS n_auto,
                      CAST(SUM(CASE WHEN true_label = predicted_label THEN n ELSE 0 END) AS BIGINT) AS n_correct
               FROM cells GROUP BY threshold),
      curve AS (SELECT g.threshold, (SELECT COUNT(*) FROM p) AS n, COALESCE(n_auto, 0) AS n_auto,
                       COALESCE(n_correct, 0) AS n_correct, round(macro_f1, 8) AS macro_f1
                FROM grid g LEFT JOIN sums s ON s.threshold = g.threshold LEFT JOIN scores f ON f.threshold = g.threshold)"""


def shares_sql(counts: str, label: str, total: str) -> str:
    """Largest-remainder shares of `total` among classes with counts n (relation `counts`)."""
    return f"""
      SELECT {label}, n, q + CASE WHEN row_number() OVER (ORDER BY m DESC, {label}) <= {total} - SUM(q) OVER ()
             THEN 1 ELSE 0 END AS quota
      FROM (SELECT {label}, n, (n * {total}) // (SELECT SUM(n) FROM {counts}) AS q,
                   (n * {total}) % (SELECT SUM(n) FROM {counts}) AS m FROM {counts})"""
