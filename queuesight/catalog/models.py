"""Queries on classifiers, scoring by a supplied model, and streams."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import compare, logistic, models, scoring, sketches, splits
from ..plans import evaluation, training
from ..session import fresh_path, small_batches, spread
from ..streaming import jobs
from .metrics import rounded
from .routing import _P
from .views import PRED_A, QUEUE_WEIGHTS, ROUTING, View, query, sql_round, summary_sql, table

# --- classifiers -----------------------------------------------------------------------


def _labelled(spark, sf):
    """Documents with a quality label as priority and their language as category."""
    documents, labels = spread(table(spark, sf, "documents")), table(spark, sf, "labels")
    return documents.join(labels, "doc_id").selectExpr(
        "doc_id AS ticket_id", "text AS customer_message", "lang AS category",
        "CASE quality WHEN 1 THEN 'high' ELSE 'low' END AS priority",
    )


def _parts(spark, sf):
    parted, _ = splits.fixed_splits(_labelled(spark, sf))
    return parted.where("split = 'train'").drop("split"), parted.where("split = 'test'").drop("split")


def _train(df, label):
    return models.train_classifier(df, "customer_message", label)


_WORDS = """SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2) AS w FROM documents"""


@query(
    f"""WITH d AS ({_WORDS}), t AS (SELECT doc_id, unnest(w) AS term FROM d
          UNION ALL SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM d),
        v AS (SELECT term FROM (SELECT term, COUNT(*) AS n FROM t GROUP BY term) ORDER BY n DESC, term LIMIT 5000),
        c AS (SELECT doc_id, term, COUNT(*) AS tf FROM t SEMI JOIN v USING (term) GROUP BY ALL),
        i AS (SELECT term, ln(((SELECT COUNT(*) FROM documents) + 1e0) / (COUNT(*) + 1)) + 1 AS idf FROM c GROUP BY term),
        x AS (SELECT doc_id, MAX(tf * idf) / sqrt(SUM(tf * idf * tf * idf)) AS top FROM c JOIN i USING (term) GROUP BY doc_id)
        SELECT doc_id, CAST(greatest(2 * len(w) - 1, 0) AS INTEGER) AS n_terms, round(COALESCE(top, 0e0), 6) AS top_weight
        FROM d LEFT JOIN x USING (doc_id)"""
)
def tfidf_features(spark, sf):
    """Terms per document and the largest weight of its TF-IDF vector."""
    texts = spread(table(spark, sf, "documents")).select("doc_id", models.fold_accents(F.col("text")).alias("folded"))
    features = models.fit_features(texts, "folded").transform(texts)
    weights = features.select(
        "doc_id", "n_terms", F.round(F.array_max(vector_to_array("features")), 6).alias("top_weight")
    )
    path = fresh_path(spark, "top-weights")
    with small_batches(spark):
        weights.write.parquet(path)
    return spark.read.schema(weights.schema).parquet(path)


@query(
    """SELECT 'category' AS target, 'tfidf_logistic_regression_baseline' AS model_type, 'customer_message' AS text, COUNT(*) AS train_rows,
       string_agg(DISTINCT lang, ',' ORDER BY lang) AS labels, 5000::INTEGER AS vocabulary, 1000::INTEGER AS max_iterations,
       'balanced' AS class_weight FROM documents JOIN labels USING (doc_id)"""
)
def train_classifier(spark, sf):
    """The model table after training a category model on the labelled documents."""
    models_by_target = training.train_models(_labelled(spark, sf), ["category"])
    return training.model_table(spark, models_by_target).withColumn("labels", F.array_join("labels", ","))


@query()
def trained_features(spark, sf):
    """The strongest terms of a fitted priority model."""
    return models.top_features(_train(_labelled(spark, sf), "priority"), spark)


@query()
def trained_models_evaluated(spark, sf):
    """Category and priority models trained on the train part, scored on the test part."""
    train, test = _parts(spark, sf)
    frames = evaluation.evaluate_models(test, _train(train, "category"), _train(train, "priority"))
    return frames["category_metrics"].select(F.lit("category").alias("target"), "*").unionByName(
        frames["priority_metrics"].select(F.lit("priority").alias("target"), "*")
    )


@query(
    """WITH e AS (SELECT lang, CASE quality WHEN 1 THEN 'high' ELSE 'low' END AS priority FROM documents JOIN labels USING (doc_id)),
        n AS (SELECT 'category' AS target, lang AS class, COUNT(*) AS n FROM e WHERE lang IS NOT NULL GROUP BY ALL
              UNION ALL SELECT 'priority', priority, COUNT(*) FROM e GROUP BY ALL),
        t AS (SELECT target, SUM(n) AS rows, COUNT(*) AS classes FROM n GROUP BY target)
        SELECT target, class, CAST(rows AS BIGINT) AS rows, n AS positives,
          round(CASE WHEN classes = 2 THEN rows ELSE rows / classes + rows - n END * ln(2), 6) AS loss_at_zero,
          TRUE AS fell, TRUE AS gradient_within_bound
        FROM n JOIN t USING (target) WHERE classes > 2 OR class = 'low'"""
)
def trained_optimality(spark, sf):
    """Per fitted problem: its rows, the loss it began with, and that the least loss was reached."""
    labelled = _labelled(spark, sf)
    rows = []
    for target in ("category", "priority"):
        model = _train(labelled, target)
        about = model.metadata
        classes = model.labels if len(model.models) > 1 else model.labels[1:]
        found = zip(classes, about["losses_at_zero"], about["losses"], about["gradient_norms"], about["gradient_bounds"], strict=True)
        rows += [(target, c, about["rows"], round(first, 6), last < first, norm <= bound) for c, first, last, norm, bound in found]
    fitted = spark.createDataFrame(rows, "target string, class string, rows long, loss_at_zero double, fell boolean, gradient_within_bound boolean")
    counted = labelled.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("class")) for t in ("category", "priority")])).alias("x"))
    counted = counted.groupBy("x.target", "x.class").agg(F.count(F.lit(1)).alias("positives"))
    return fitted.join(counted, ["target", "class"])


# Scoring is checked with stated coefficients: term number i of the vocabulary and class number k.
def _stated(spark, sf, label):
    """A classifier of category or priority over the documents' own terms, with stated coefficients."""
    documents = spread(table(spark, sf, "documents"))
    features = models.fit_features(models.with_folded(documents, "text"), models.FOLDED)
    terms = next(s for s in features.stages if hasattr(s, "vocabulary")).vocabulary
    labels = sorted(r[0] for r in _labelled(spark, sf).select(label).distinct().collect())
    weights = [[((i * 37 + k * 101) % 199 - 99) / 50.0 for i in range(len(terms))] for k in range(len(labels) if len(labels) > 2 else 1)]
    fitted = [models.linear_model(spark, f"stated-{label}-{k}", np.array([*w, (k - 1) / 4.0])) for k, w in enumerate(weights)]
    return models.TextClassifier(features, labels, fitted)


_STATED = f"""d AS ({_WORDS}), t AS (SELECT doc_id, unnest(w) AS term FROM d
    UNION ALL SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM d),
  v AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS i FROM (SELECT term, COUNT(*) AS n FROM t GROUP BY term) ORDER BY n DESC, term LIMIT 5000),
  c AS (SELECT doc_id, term, any_value(i) AS i, COUNT(*) AS tf FROM t JOIN v USING (term) GROUP BY doc_id, term),
  idf AS (SELECT term, ln(((SELECT COUNT(*) FROM documents) + 1e0) / (COUNT(*) + 1)) + 1 AS idf FROM c GROUP BY term),
  x AS (SELECT doc_id, i, tf * idf / sqrt(SUM(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS x FROM c JOIN idf USING (term)),
  s AS (SELECT doc_id, k, (k - 1) / 4e0 + COALESCE(SUM(x * (((i * 37 + k * 101) % 199 - 99) / 50e0)), 0e0) AS s
        FROM documents CROSS JOIN range(4) r(k) LEFT JOIN x USING (doc_id) GROUP BY doc_id, k),
  p AS (SELECT doc_id, k, 1 / (1 + exp(-s)) AS p FROM s),
  names AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS k FROM (SELECT DISTINCT lang FROM documents JOIN labels USING (doc_id))),
  category AS (SELECT doc_id, lang AS label, p / SUM(p) OVER (PARTITION BY doc_id) AS p FROM p JOIN names USING (k)),
  priority AS (SELECT doc_id, unnest(['high', 'low']) AS label, unnest([1 - p, p]) AS p FROM p WHERE k = 0),
  best_category AS (SELECT doc_id, label, p FROM category QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label) = 1),
  best_priority AS (SELECT doc_id, label, p FROM priority QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label) = 1)"""


@query(
    f"""WITH {_STATED}, e AS (SELECT doc_id, names.k AS own FROM documents JOIN labels USING (doc_id) JOIN names USING (lang)),
        n AS (SELECT own AS k, COUNT(*) AS n FROM e GROUP BY own),
        r AS (SELECT doc_id, k, s, CASE WHEN own = k THEN 1 ELSE -1 END AS y,
              CASE WHEN own = k THEN (SELECT SUM(n) / COUNT(*) FROM n) / n ELSE 1 END AS weight FROM e JOIN s USING (doc_id) JOIN n USING (k)),
        sums AS (SELECT k, SUM(weight * ln(1 + exp(-y * s))) AS loss, SUM(-weight * y / (1 + exp(y * s))) AS free FROM r GROUP BY k),
        g AS (SELECT k, i, SUM(-weight * y / (1 + exp(y * s)) * x) AS g FROM r JOIN x USING (doc_id) GROUP BY k, i),
        w AS (SELECT k, i, ((i * 37 + k * 101) % 199 - 99) / 50e0 AS w FROM v, names),
        pen AS (SELECT k, SUM(w * w) / 2 AS penalty, SUM((w + COALESCE(g, 0)) * (w + COALESCE(g, 0))) AS squares FROM w LEFT JOIN g USING (k, i) GROUP BY k)
        SELECT lang AS class, n AS positives, round(loss + penalty, 6) AS loss, round(sqrt(squares + free * free), 6) AS gradient_norm
        FROM names JOIN n USING (k) JOIN sums USING (k) JOIN pen USING (k)"""
)
def joint_gradient(spark, sf):
    """Losses and gradients of all classes at stated coefficients, from one distributed evaluation."""
    model = _stated(spark, sf, "category")
    names = F.create_map(*[x for i, c in enumerate(model.labels) for x in (F.lit(c), F.lit(i))])
    labelled = _labelled(spark, sf).where("category IS NOT NULL")
    examples = model.features.transform(models.with_folded(labelled, "customer_message")).select("features", names[F.col("category")].alias("code"))
    counts = {r["category"]: r["count"] for r in labelled.groupBy("category").count().collect()}
    weights = np.stack([np.append(m.coefficients.toArray(), m.intercept) for m in model.models])
    positive = np.array([sum(counts.values()) / (len(counts) * counts[c]) for c in model.labels])
    problems = logistic.Problems(logistic.packed(examples, "features", "code"), np.arange(len(counts)), positive, np.ones(len(counts)), weights.shape[1] - 1)
    losses, gradients = problems.evaluated(problems.codes, weights)
    rows = [(c, counts[c], round(float(loss), 6), round(float(np.linalg.norm(g)), 6)) for c, loss, g in zip(model.labels, losses, gradients, strict=True)]
    return spark.createDataFrame(rows, "class string, positives long, loss double, gradient_norm double")


@query(
    f"""WITH {_STATED}, w AS (SELECT lang AS class, term AS feature, ((i * 37 + k * 101) % 199 - 99) / 50e0 AS weight FROM v CROSS JOIN names)
        SELECT class, CAST(row_number() OVER (PARTITION BY class ORDER BY weight DESC, feature) AS INTEGER) AS rank, feature, weight FROM w
        QUALIFY row_number() OVER (PARTITION BY class ORDER BY weight DESC, feature) <= 25"""
)
def top_features(spark, sf):
    """The strongest terms of a category model."""
    return models.top_features(_stated(spark, sf, "category"), spark)


@query(
    f"""WITH {_STATED} SELECT doc_id AS ticket_id, label AS predicted_category, {sql_round('p', 4)} AS category_confidence,
        (SELECT CAST(COUNT(*) AS INTEGER) FROM names) AS classes FROM best_category"""
)
def score_batch(spark, sf):
    """Every document scored by a category model that went through storage."""
    path = fresh_path(spark, "model")
    _stated(spark, sf, "category").save(path)
    model = models.TextClassifier.load(spark, path)
    tickets = spread(table(spark, sf, "documents")).selectExpr("doc_id AS ticket_id", "text")
    scored = model.score(tickets, "text", "category")
    return scored.select("ticket_id", "predicted_category", "category_confidence", F.size("category_distribution").alias("classes"))


@query(
    f"""WITH {_STATED},
        a AS (SELECT lang AS true_label, label AS predicted_label, COUNT(*) AS n FROM labels JOIN documents USING (doc_id) JOIN best_category USING (doc_id) GROUP BY ALL),
        b AS (SELECT CASE quality WHEN 1 THEN 'high' ELSE 'low' END AS true_label, label AS predicted_label, COUNT(*) AS n FROM labels JOIN best_priority USING (doc_id) GROUP BY ALL)
        SELECT 'category' AS target, * FROM ({summary_sql('a')}) UNION ALL SELECT 'priority', * FROM ({summary_sql('b')})"""
)
def evaluate_models(spark, sf):
    """Category and priority models scored against the labels."""
    frames = evaluation.evaluate_models(_labelled(spark, sf), _stated(spark, sf, "category"), _stated(spark, sf, "priority"))
    rows = frames["category_metrics"].select(F.lit("category").alias("target"), "*").unionByName(
        frames["priority_metrics"].select(F.lit("priority").alias("target"), "*")
    )
    return rounded(rows, "macro_f1", "weighted_f1")


@query(
    f"""WITH {_STATED} SELECT a.doc_id AS ticket_id, a.label AS predicted_category, round(a.p, 8) AS category_confidence,
        b.label AS predicted_priority, round(b.p, 8) AS priority_confidence FROM best_category a JOIN best_priority b USING (doc_id)"""
)
def predict_frame(spark, sf):
    """Both models on every document; the risk columns have queries of their own."""
    tickets = spread(table(spark, sf, "documents")).selectExpr("doc_id AS ticket_id", "text AS customer_message")
    scored = evaluation.predict_frame(tickets, _stated(spark, sf, "category"), _stated(spark, sf, "priority"))
    kept = scored.select("ticket_id", "predicted_category", "category_confidence", "predicted_priority", "priority_confidence")
    return rounded(kept, "category_confidence", "priority_confidence")


# --- a supplied scorer -----------------------------------------------------------------

_LETTERS = "aeiounr"


def _letter_scorer():
    """A scorer that votes by letter counts and refuses some texts."""

    def make():
        letters = "aeiounr"
        queues = [
            "billing_and_payments", "customer_general", "human_resources", "returns_and_exchanges",
            "sales_and_pre_sales", "service_outages_and_maintenance", "technical_product_support",
        ]

        def score(texts):
            results = []
            for text in texts:
                if "License" in text:
                    raise ValueError("refused")
                votes = [1 + text.count(x) for x in letters]
                results.append({q: v / sum(votes) for q, v in zip(queues, votes)})
            return results

        return score

    return make


_VOTES = View(
    "documents",
    "doc_id",
    "contains(text, 'License') AS refused",
    *[f"1 + length(text) - length(replace(text, '{x}', '')) AS v{i}" for i, x in enumerate(_LETTERS)],
)
_LONG_VOTES = f"""SELECT doc_id, refused, unnest([{', '.join(f"'{q}'" for q in K.QUEUES)}]) AS queue,
  unnest([{', '.join(f'CAST(v{i} AS DOUBLE)' for i in range(7))}]) / ({' + '.join(f'v{i}' for i in range(7))}) AS p FROM ({_VOTES.sql})"""
_PLACED = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, queue) AS place FROM ({_LONG_VOTES})"


@query(
    f"""SELECT doc_id AS ticket_id, CASE WHEN any_value(refused) THEN NULL ELSE MAX(CASE WHEN place = 1 THEN queue END) END AS predicted_label,
        CASE WHEN any_value(refused) THEN 0e0 ELSE {sql_round('MAX(CASE WHEN place = 1 THEN p END)', 6)} END AS confidence,
        CASE WHEN any_value(refused) THEN 0e0 ELSE {sql_round('MAX(CASE WHEN place = 2 THEN p END)', 6)} END AS top_2_probability,
        CASE WHEN any_value(refused) THEN 'ValueError: refused' END AS error
        FROM ({_PLACED}) GROUP BY doc_id"""
)
def score_external(spark, sf):
    """A user-supplied scorer over whole texts; a text it refuses is recorded, the rest goes on."""
    tickets = table(spark, sf, "documents").selectExpr("doc_id AS ticket_id", "text AS input_text")
    scored = scoring.score_external(tickets, _letter_scorer())
    return scoring.prediction_records(scored).select(
        "ticket_id", "predicted_label", "confidence", "top_2_probability", "error"
    )


@query(
    f"""SELECT doc_id AS ticket_id, {sql_round('MAX(CASE WHEN place = 1 THEN p END)', 6)} AS confidence FROM ({_PLACED})
        WHERE NOT refused AND doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id"""
)
def resume_scoring(spark, sf):
    """Only documents that have no stored prediction are scored."""
    tickets = table(spark, sf, "documents").selectExpr("doc_id AS ticket_id", "text AS input_text")
    done = table(spark, sf, "labels").selectExpr("CAST(doc_id AS STRING) AS ticket_id")
    scored = scoring.resume_scoring(tickets, done, _letter_scorer())
    return scoring.prediction_records(scored.where("error IS NULL")).select("ticket_id", "confidence")


# --- streams ---------------------------------------------------------------------------

_BEST = f"""SELECT event_id, queue, p FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p DESC, queue) AS place FROM (
  SELECT event_id, unnest([{', '.join(f"'{q}'" for q in K.QUEUES)}]) AS queue, unnest([{', '.join(_P)}]) AS p FROM ({QUEUE_WEIGHTS.sql}))) WHERE place = 1"""


def _stream(spark, sf, name):
    return jobs.read_table_stream(spark, f"{sf}/{name}.parquet", table(spark, sf, name).schema)


@query(
    f"""SELECT event_id, queue AS predicted_queue, {sql_round('p', 6)} AS confidence, CASE WHEN {sql_round('p', 6)} >= 0.25e0 THEN 'auto_route' ELSE 'human_review' END AS decision,
        'stored' AS state FROM ({_BEST}) WHERE event_id % 50 <> 0
        UNION ALL SELECT event_id, queue, {sql_round('p', 6)}, CASE WHEN {sql_round('p', 6)} >= 0.25e0 THEN 'auto_route' ELSE 'human_review' END, 'rejected: probabilities,subject'
        FROM ({_BEST}) WHERE event_id % 50 = 0"""
)
def route_stream(spark, sf):
    """Events as a stream of scored tickets: routed, checked, stored or set aside."""
    path, rejected = fresh_path(spark, "routing"), fresh_path(spark, "rejected")
    jobs.run_available(lambda: jobs.route_stream(_scored_events(spark, sf), path, rejected, threshold=0.25))
    stored = spark.read.parquet(path).select("event_id", "predicted_queue", "confidence", "decision", F.lit("stored").alias("state"))
    aside = spark.read.parquet(rejected).select(
        "event_id", "predicted_queue", "confidence", "decision",
        F.concat(F.lit("rejected: "), F.array_join("errors", ",")).alias("state"),
    )
    return stored.unionByName(aside)


def _scored_events(spark, sf, where="true"):
    source = _stream(spark, sf, "events").where(where)
    inner = source.selectExpr(*QUEUE_WEIGHTS.base.columns).selectExpr(*QUEUE_WEIGHTS.columns)
    pairs = [x for q, p in zip(K.QUEUES, _P) for x in (F.lit(q), F.expr(p))]
    broken = F.col("event_id") % 50 == 0
    extra = F.when(broken, F.create_map(F.lit("unknown"), F.lit(0.0))).otherwise(F.expr("CAST(map() AS MAP<STRING, DOUBLE>)"))
    return inner.select(
        "event_id",
        F.when(broken, "").otherwise(F.col("props")).alias("subject"),
        F.col("event_type").alias("body"),
        F.map_concat(F.create_map(*pairs), extra).alias("probabilities"),
        F.col("ts").alias("created_at"),
    )


@query(
    f"""SELECT event_id, queue AS predicted_queue, 1::BIGINT AS stored FROM ({_BEST}) WHERE event_id % 50 <> 0"""
)
def route_stream_twice(spark, sf):
    """Two jobs of their own, even and odd events, into one store: both parts are there."""
    path = fresh_path(spark, "routing")
    for part in (0, 1):
        scored = _scored_events(spark, sf, f"event_id % 2 = {part}")
        own = fresh_path(spark, "routing-progress") if part else None
        jobs.run_available(lambda: jobs.route_stream(scored, path, threshold=0.25, checkpoint=own))  # noqa: B023
    return spark.read.parquet(path).groupBy("event_id", "predicted_queue").agg(F.count(F.lit(1)).alias("stored"))


@query(
    f"""WITH r AS ({ROUTING.sql})
        SELECT 'queue' AS section, label, (SELECT COUNT(*) FROM r WHERE predicted_queue = label) AS n, NULL::DOUBLE AS average_confidence
        FROM (VALUES {', '.join(f"('{q}')" for q in K.QUEUES)}) q(label)
        UNION ALL SELECT 'decision', label, (SELECT COUNT(*) FROM r WHERE decision = label), NULL FROM (VALUES ('auto_route'), ('human_review')) d(label)
        UNION ALL SELECT 'predictions', NULL, COUNT(*), round(AVG(confidence), 8) FROM r"""
)
def dashboard_stream(spark, sf):
    """Dashboard figures kept by a stream over the routing log."""
    log = _stream(spark, sf, "events").selectExpr(*ROUTING.base.columns).selectExpr(*ROUTING.columns)
    path = fresh_path(spark, "dashboard")
    jobs.run_available(lambda: jobs.dashboard_stream(log, path))
    return rounded(spark.read.parquet(path), "average_confidence")


_KEY = "CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN '' ELSE source || '-' || lang END"


@query(
    f"""SELECT external_id, doc_id, customer_message FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY doc_id) AS place
        FROM (SELECT {_KEY} AS external_id, doc_id, text AS customer_message FROM documents))
        WHERE place = 1 OR COALESCE(external_id, '') = ''"""
)
def ingest_stream(spark, sf):
    """Documents as a stream of tickets whose external ids repeat a lot."""
    incoming = _stream(spark, sf, "documents").selectExpr(f"{_KEY} AS external_id", "doc_id", "text AS customer_message")
    path = fresh_path(spark, "ingest")
    jobs.run_available(lambda: jobs.ingest_stream(incoming, path, "doc_id"))
    return spark.read.parquet(path).select("external_id", "doc_id", "customer_message")


@query(
    f"""SELECT external_id, count(*) AS rows, min(doc_id) AS first FROM (
          SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY part, doc_id) AS place
          FROM (SELECT {_KEY} AS external_id, doc_id, doc_id % 2 AS part FROM documents))
        WHERE place = 1 OR COALESCE(external_id, '') = '' GROUP BY external_id"""
)
def ingest_stream_twice(spark, sf):
    """Two runs with default options, even and then odd documents, from folders of their own: the store holds both."""
    path = fresh_path(spark, "ingest")
    rows = table(spark, sf, "documents").selectExpr(f"{_KEY} AS external_id", "doc_id")
    for part in (0, 1):
        folder = fresh_path(spark, "incoming")
        rows.where(f"doc_id % 2 = {part}").write.parquet(folder)
        incoming = jobs.read_stream(spark, folder, rows.schema)
        jobs.run_available(lambda: jobs.ingest_stream(incoming, path, "doc_id"))  # noqa: B023
    stored = spark.read.parquet(path)
    return stored.groupBy("external_id").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first"))


_USER = "CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN '' ELSE CAST(user_id AS STRING) END"


@query(
    f"""SELECT external_id, COUNT(*) AS rows FROM (SELECT DISTINCT {_USER} AS external_id, CASE WHEN event_id % 10 < 2 THEN event_id END AS own FROM events)
        GROUP BY external_id"""
)
def ingest_event_time(spark, sf):
    """Stream deduplication by key within a watermark longer than the data; rows without a key all stay."""
    incoming = _stream(spark, sf, "events").selectExpr(f"{_USER} AS external_id", "ts")
    path, state = fresh_path(spark, "event-time"), fresh_path(spark, "event-time-state")
    kept = jobs.ingest_event_time(incoming, "ts", "365 days").select("external_id")
    jobs.run_available(
        lambda: kept.writeStream.option("checkpointLocation", state).trigger(availableNow=True).start(path, format="parquet")
    )
    return spark.read.parquet(path).groupBy("external_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    f"""SELECT COUNT(*) AS rows, round(COUNT(*) / ((SELECT epoch_us(max(ts)) - epoch_us(min(ts)) FROM events) / 1e6), 8) AS rows_per_second,
        round(AVG(CASE WHEN true_label = predicted_label THEN 1e0 ELSE 0e0 END), 8) AS accuracy FROM ({PRED_A.sql})"""
)
def throughput(spark, sf):
    """The events as rows scored at their time."""
    at = table(spark, sf, "events").select(F.col("event_id").alias("ticket_id"), F.col("ts").alias("completed_at"))
    scored = PRED_A.frame(spark, sf).join(at, "ticket_id")
    return rounded(compare.throughput(scored), "rows_per_second", "accuracy")


@query(
    f"""SELECT COUNT(*) AS done, CAST(SUM(CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
        round(AVG(CASE WHEN true_label = predicted_label THEN 1e0 ELSE 0e0 END), 8) AS accuracy,
        round(COUNT(*) / ((SELECT epoch_us(max(ts)) - epoch_us(min(ts)) FROM events) / 1e6), 8) AS rows_per_second, TRUE AS several_batches FROM ({PRED_A.sql})"""
)
def observed_throughput(spark, sf):
    """The same figures observed batch by batch while a stream of scored rows is stored: the last row is the whole."""
    at = table(spark, sf, "events").select(F.col("event_id").alias("ticket_id"), F.col("ts").alias("completed_at"))
    scored = PRED_A.frame(spark, sf).select("ticket_id", "true_label", "predicted_label").join(at, "ticket_id")
    source, path = fresh_path(spark, "scored"), fresh_path(spark, "observed")
    scored.repartition(8).write.parquet(source)
    incoming = jobs.read_stream(spark, source, scored.schema, files_per_trigger=2)
    jobs.run_available(lambda: jobs.observed_stream(incoming, path))
    last = jobs.running_figures(spark, path).orderBy(F.desc("batch")).limit(1)
    last = last.select("done", "n_correct", "accuracy", "rows_per_second", (F.col("batch") > 0).alias("several_batches"))
    return rounded(last, "accuracy", "rows_per_second")


_ROUTED = f"SELECT CAST(created_at AS DATE) AS day, * FROM ({ROUTING.sql})"


@query(
    f"""SELECT strftime(day, '%Y-%m') AS period, COUNT(*) AS n, TRUE AS p50, TRUE AS p95, TRUE AS distinct_close FROM ({_ROUTED}) GROUP BY 1
        UNION ALL SELECT 'all', COUNT(*), TRUE, TRUE, TRUE FROM ({_ROUTED})"""
)
def daily_sketches(spark, sf):
    """Latency quantiles and distinct confidences by month and in all, from stored day sketches: each keeps its bound."""
    path, quantiles = fresh_path(spark, "sketches"), {"p50": 0.5, "p95": 0.95}
    log = ROUTING.frame(spark, sf).select("created_at", "latency_ms", "confidence")
    sketches.day_sketches(log, "created_at", "latency_ms", "confidence").write.parquet(path)
    stored = spark.read.parquet(path)
    rows = None
    for period in (F.date_format("day", "yyyy-MM"), F.lit("all")):
        merged = sketches.merged_sketches(stored, quantiles, period)
        checked = sketches.rank_checked(log, "created_at", "latency_ms", "confidence", merged, quantiles, period)
        rows = checked if rows is None else rows.unionByName(checked)
    return rows
