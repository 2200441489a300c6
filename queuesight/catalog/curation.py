"""Queries on tickets: reading, curation, profiles, splits and samples."""

from __future__ import annotations

import ast

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels as lb
from ..functions import numeric as num
from ..functions import text as tx
from ..operators import columns, curate, ordinals, profile, splits, validation
from ..plans import curation, training
from ..session import fresh_path, spread
from ..sources import readers
from ..sources.readers import read_splits, read_tickets
from ..sources.writers import append_jsonl, write_table
from .metrics import rounded
from .views import EXPORT, PRED_A, query, shares_sql, sql_round, table

# The characters that strip() removes, as a SQL text.
_WS = "'" + tx.WHITESPACE + "'"


def _strip(c: str) -> str:
    return f"trim({c}, {_WS})"


# --- reading and writing ------------------------------------------------------------

_AS_TEXT = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents"


def _round_trip(spark, sf, kind, **options):
    folder = fresh_path(spark, f"documents-{kind}")
    texts = table(spark, sf, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS doc_id", "text", "lang", "source", "CAST(n_chars AS STRING) AS n_chars"
    )
    write_table(texts, folder, kind)
    return read_tickets(spark, folder, format=kind, **options).select("doc_id", "text", "lang", "source", "n_chars")


@query(_AS_TEXT)
def read_tickets_csv(spark, sf):
    """Documents written and read back as CSV: quotes and line breaks in cells survive."""
    return _round_trip(spark, sf, "csv")


@query(_AS_TEXT)
def read_csv_blocks(spark, sf):
    """The same files, each read by as many tasks as it has blocks."""
    return _round_trip(spark, sf, "csv", parallel=True)


@query("SELECT COUNT(*) AS rows, CAST(SUM(length(text)) AS BIGINT) AS characters, CAST(bit_xor(CAST('0x' || substr(md5(text), 1, 15) AS BIGINT)) AS BIGINT) AS digest FROM documents")
def read_json_blocks(spark, sf):
    """`.json` files, each one list of rows, read by as many tasks as they have blocks."""
    folder = fresh_path(spark, "lists")
    _write_json_documents(table(spark, sf, "documents").select("doc_id", "text"), folder)
    read = read_tickets(spark, folder, format="json", parallel=True)
    digest = F.bit_xor(F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long"))
    return read.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("characters"), digest.alias("digest"))


@query(_AS_TEXT)
def read_tickets_tsv(spark, sf):
    return _round_trip(spark, sf, "tsv")


@query(_AS_TEXT)
def read_tickets_jsonl(spark, sf):
    return _round_trip(spark, sf, "jsonl")


@query(
    """SELECT split, COUNT(*) AS n, COUNT(lang) AS with_lang, CAST(SUM(length(text)) AS BIGINT) AS characters
       FROM (SELECT text, 'train' AS split, lang FROM documents UNION ALL SELECT text, 'val', NULL FROM documents) GROUP BY split"""
)
def read_splits_union(spark, sf):
    """Two split files, one without the language column, read as one table."""
    documents = table(spark, sf, "documents")
    train = write_table(documents.select("text", "lang"), fresh_path(spark, "train"), "json")
    val = write_table(documents.select("text"), fresh_path(spark, "val"), "json")
    both = read_splits(spark, {"train": train, "val": val}, format="jsonl")
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count("lang").alias("with_lang"), F.sum(F.length("text")).alias("characters")
    )


def _write_json_documents(texts, path, rows=1_000):
    """Write `.json` files of one array over several lines each, about `rows` texts to a file; their number grows with the rows."""
    groups = 1 + texts.count() // rows
    dealt = texts.groupBy(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("part"))
    listed = dealt.agg(F.to_json(F.sort_array(F.collect_list(F.struct("text")))).alias("value"))
    pretty = listed.select("part", F.replace("value", F.lit('},{"text"'), F.lit('},\n{"text"')).alias("value"))
    pretty.write.partitionBy("part").text(path)  # a folder, so a file, for each array


@query(
    """SELECT 'lines' AS file, COUNT(*) AS rows, CAST(SUM(length(text)) AS BIGINT) AS characters FROM documents
       UNION ALL SELECT 'document', COUNT(*), CAST(SUM(length(text)) AS BIGINT) FROM documents
       UNION ALL SELECT 'value', COUNT(*), CAST(SUM(length(text)) AS BIGINT) FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)"""
)
def read_tickets_json(spark, sf):
    """`.json` files of clean lines, of documents over several lines and of one bare value."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    lines = write_table(documents.select("text"), fresh_path(spark, "lines"), "json")
    document, value = fresh_path(spark, "document"), fresh_path(spark, "value")
    _write_json_documents(documents, document)
    first = documents.orderBy("doc_id").limit(1).select(F.to_json(F.struct("text")).alias("j"))
    first.select(F.substring("j", len('{"text":') + 1, 1_000_000_000).alias("j")).select(F.expr("substr(j, 1, length(j) - 1)").alias("value")).coalesce(1).write.text(value)
    rows = None
    for name, path in (("lines", lines), ("document", document), ("value", value)):
        read = read_tickets(spark, path, format="json")
        row = read.agg(F.lit(name).alias("file"), F.count(F.lit(1)).alias("rows"), F.sum(F.length(read.columns[0])).alias("characters"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("SELECT CAST(doc_id AS VARCHAR) AS ticket_id, text AS customer_message, 2::BIGINT AS copies FROM documents")
def append_jsonl_lines(spark, sf):
    """Two appends of the table as JSON lines."""
    rows = table(spark, sf, "documents").selectExpr("CAST(doc_id AS STRING) AS ticket_id", "text AS customer_message")
    path = fresh_path(spark, "jsonl")
    append_jsonl(rows, path)
    append_jsonl(rows, path)
    return spark.read.json(path).groupBy("ticket_id", "customer_message").agg(F.count(F.lit(1)).alias("copies"))


@query(
    """SELECT 'real' AS dataset, COUNT(*) AS row_count, COUNT(*) - COUNT(DISTINCT text) AS duplicate_customer_message_count,
              TRUE AS has_required_training_columns FROM documents
       UNION ALL SELECT 'no_label', COUNT(*), COUNT(*) - COUNT(DISTINCT text), FALSE FROM documents"""
)
def audit_summary(spark, sf):
    """Profile rows of two datasets, one of them without labels."""
    documents = table(spark, sf, "documents")
    real = documents.selectExpr("text AS customer_message", "source AS queue", "lang AS language")
    rows = profile.profile_dataset(real, path="real").unionByName(
        profile.profile_dataset(documents.select("text"), path="no_label")
    )
    return rows.select(
        F.col("file_path").alias("dataset"), "row_count", "duplicate_customer_message_count", "has_required_training_columns"
    )


def _dataset_folder(spark, sf):
    """Datasets made of the documents: usable, without labels, and a generated output."""
    root = fresh_path(spark, "datasets")
    documents = table(spark, sf, "documents")
    labelled = documents.selectExpr("text AS customer_message", "source AS queue", "lang AS language")
    write_table(labelled, f"{root}/real", "csv")
    write_table(documents.select("text"), f"{root}/no_label", "jsonl")
    write_table(labelled, f"{root}/outputs", "csv")
    return root


@query(
    """SELECT 'real' AS dataset, COUNT(*) AS row_count, TRUE AS usable, FALSE AS generated FROM documents
       UNION ALL SELECT 'no_label', COUNT(*), FALSE, FALSE FROM documents UNION ALL SELECT 'outputs', COUNT(*), TRUE, TRUE FROM documents"""
)
def audit_files(spark, sf):
    """Three folders of files written from the documents, listed, read and profiled."""
    audit = readers.audit_files(spark, _dataset_folder(spark, sf))
    folder = F.element_at(F.split("file_path", "/"), -2)
    return audit.groupBy(folder.alias("dataset")).agg(
        F.sum("row_count").alias("row_count"),
        F.bool_and("has_required_training_columns").alias("usable"),
        F.bool_and("is_smoke_or_generated_output").alias("generated"),
    )


@query("SELECT 'real' AS dataset, COUNT(*) AS rows, COUNT(DISTINCT source) AS queues FROM documents")
def resolve_input(spark, sf):
    """With no path given: a file of the largest usable dataset that is no generated output; its dataset is read."""
    path = readers.resolve_input(spark, root=_dataset_folder(spark, sf))
    folder = path.rsplit("/", 1)[0]
    rows = readers.read_tickets(spark, folder, format="csv")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("queue").alias("queues")).select(
        F.lit(folder.rsplit("/", 1)[-1]).alias("dataset"), "rows", "queues"
    )


_TABLES = ["documents", "labels", "events", "customer"]


@query(
    f"""SELECT t AS source, COALESCE(string_agg(name, ',' ORDER BY name), '') AS missing, (SELECT COUNT(*) FROM documents) AS documents
        FROM (VALUES {', '.join(f"('{t}')" for t in _TABLES)}) s(t) CROSS JOIN (VALUES ('doc_id'), ('text'), ('quality')) n(name)
        WHERE name NOT IN (SELECT column_name FROM information_schema.columns WHERE table_name = t) GROUP BY t"""
)
def required_columns(spark, sf):
    """What each table lacks of the columns a job needs, as the check says it."""
    rows = None
    for name in _TABLES:
        try:
            columns.require_columns(table(spark, sf, name), ["doc_id", "text", "quality"])
            missing = ""
        except ValueError as problem:
            missing = ",".join(ast.literal_eval(str(problem).split(": ", 1)[1]))
        row = table(spark, sf, "documents").agg(F.lit(name).alias("source"), F.lit(missing).alias("missing"), F.count(F.lit(1)).alias("documents"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(
    f"""SELECT t AS source, bool_or(column_name IN ({', '.join(f"'{c}'" for c in [*K.SOURCE_CATEGORY_COLUMNS, *K.SOURCE_PRIORITY_COLUMNS])})) AS labelled,
        (SELECT COUNT(*) FROM documents) AS documents FROM (
          SELECT table_name AS t, column_name FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in _TABLES)})
          UNION ALL SELECT 'labels with a category', 'category') GROUP BY t"""
)
def label_availability(spark, sf):
    """Whether a category or priority can be made from each table, as the check says it."""
    rows = None
    for name in [*_TABLES, "labels with a category"]:
        named = table(spark, sf, name.split()[0]).columns + (["category"] if " " in name else [])
        try:
            validation.require_labels(named)
            labelled = True
        except ValueError:
            labelled = False
        row = table(spark, sf, "documents").agg(F.lit(name).alias("source"), F.lit(labelled).alias("labelled"), F.count(F.lit(1)).alias("documents"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(
    "SELECT 'documents' AS file_path, COUNT(*) AS row_count FROM documents"
)
def select_largest(spark, sf):
    """The largest usable dataset among documents, conversations without labels and a smoke copy."""
    documents = table(spark, sf, "documents").selectExpr("text", "source AS queue")
    audits = [
        (documents, "documents", False),
        (table(spark, sf, "conversations").select("text"), "conversations", False),
        (documents.unionAll(documents), "smoke", True),
    ]
    rows = None
    for df, path, smoke in audits:
        row = profile.profile_dataset(df, path=path).select(
            "*", F.lit(smoke).alias("is_smoke_or_generated_output"), F.lit(None).cast("string").alias("read_error")
        )
        rows = row if rows is None else rows.unionByName(row)
    return profile.select_largest(rows).select("file_path", "row_count")


# --- columns and curation -----------------------------------------------------------

_LABEL = "nullif(translate(lower({}), '- ', '__'), '')"


@query(
    f"""SELECT o_orderpriority AS raw, {_LABEL.format(_strip('o_orderpriority'))} AS label, COUNT(*) AS n
        FROM orders GROUP BY ALL"""
)
def normalize_label(spark, sf):
    raw = F.col("o_orderpriority").alias("raw")
    label = tx.normalize_label(F.col("o_orderpriority")).alias("label")
    return table(spark, sf, "orders").groupBy(raw, label).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CASE event_type WHEN 'view' THEN 'browse' WHEN 'click' THEN 'browse' ELSE event_type END AS label,
       COUNT(*) AS n FROM events GROUP BY ALL"""
)
def label_map(spark, sf):
    label = lb.map_label(F.col("event_type"), {"view": "browse", "click": "browse"})
    return table(spark, sf, "events").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


_NORMALIZED_SQL = f"""
  WITH e AS (SELECT * FROM ({EXPORT.sql}) WHERE lower(language) = 'en'),
  c AS (SELECT id AS pos, CAST(id AS VARCHAR) AS external_id, COALESCE({_strip('subject')}, '') AS subject, {_strip('body')} AS body,
          {_strip('answer')} AS answer, nullif({_strip('type')}, '') AS type, nullif({_strip('queue')}, '') AS queue,
          nullif({_strip('priority')}, '') AS priority, nullif({_strip('language')}, '') AS language, '' AS version,
          COALESCE({_strip('tag_1')}, '') AS tag_1, COALESCE({_strip('tag_2')}, '') AS tag_2, COALESCE({_strip('tag_3')}, '') AS tag_3,
          '' AS tag_4, '' AS tag_5, '' AS tag_6, '' AS tag_7, '' AS tag_8,
          concat_ws(', ', {', '.join(f"CASE WHEN lower({_strip(t)}) NOT IN ('', 'none', 'nan') THEN {_strip(t)} END" for t in ('tag_1', 'tag_2', 'tag_3'))}) AS combined_tags,
          concat_ws(chr(10) || chr(10), nullif({_strip('subject')}, ''), nullif({_strip('body')}, '')) AS customer_message FROM e),
  n AS (SELECT *, {_strip("customer_message || chr(10) || chr(10) || 'Type: ' || COALESCE(type, '') || chr(10) || 'Tags: ' || combined_tags")} AS model_text,
          queue AS true_category, priority AS true_priority, 'new' AS status, 'dataset' AS channel, 'documents' AS source,
          type AS ticket_type, answer AS reference_answer, combined_tags AS tags FROM c),
  f AS (SELECT * FROM n WHERE length({_strip('body')}) > 0 AND length({_strip('customer_message')}) > 0)"""


@query(_NORMALIZED_SQL + " SELECT * EXCLUDE (pos) FROM n")
def normalize_tickets(spark, sf):
    return curation.normalize_tickets(EXPORT.frame(spark, sf), "documents").drop("_order")


@query(_NORMALIZED_SQL + " SELECT * EXCLUDE (pos, answer, reference_answer) FROM n")
def drop_leaky_columns(spark, sf):
    """What a model may read: the normalised tickets without the agent's answer."""
    return columns.drop_leaky_columns(curation.normalize_tickets(EXPORT.frame(spark, sf), "documents").drop("_order"))


@query(
    _NORMALIZED_SQL
    + """ SELECT * EXCLUDE (pos, place) FROM (SELECT *, row_number() OVER (PARTITION BY customer_message ORDER BY pos) AS place FROM f)
          WHERE place = 1"""
)
def curate_tickets(spark, sf):
    """English filter, derived columns, empty rows dropped, first of each message kept."""
    return curation.curate_tickets(EXPORT.frame(spark, sf), "documents")


@query(
    _NORMALIZED_SQL
    + """ SELECT (SELECT COUNT(*) FROM n) AS english_rows, (SELECT COUNT(*) FROM n) - COUNT(*) AS dropped_empty,
          COUNT(*) - COUNT(DISTINCT customer_message) AS dropped_duplicates, COUNT(DISTINCT customer_message) AS kept FROM f"""
)
def curation_report(spark, sf):
    return curation.curation_report(EXPORT.frame(spark, sf), source="documents")


@query(
    f"""SELECT printf('row-%06d', row_number() OVER (ORDER BY doc_id)) AS external_id, {_strip('text')} AS customer_message
        FROM documents WHERE lang = 'en'"""
)
def row_ordinal_id(spark, sf):
    """Surrogate ids numbered in source order among the English rows of a table without ids."""
    source = table(spark, sf, "documents").selectExpr("text", "source AS queue", "lang AS language")
    return curation.normalize_tickets(source, "documents", id_prefix="row-").select("external_id", "customer_message")


_CANONICAL_SQL = f"""
  SELECT doc_id AS ticket_id, {_strip('text')} AS customer_message, {_LABEL.format(_strip('source'))} AS category,
         'unknown' AS priority, {_LABEL.format(_strip('source'))} AS true_category, 'unknown' AS true_priority, lang
  FROM documents WHERE length({_strip('text')}) > 0"""


def _canonical(spark, sf):
    source = table(spark, sf, "documents").selectExpr("doc_id AS ticket_id", "text", "source AS queue", "lang")
    return columns.canonicalize_tickets(source).select(
        "ticket_id", "customer_message", "category", "priority", "true_category", "true_priority", "lang"
    )


@query(_CANONICAL_SQL)
def canonicalize_tickets(spark, sf):
    return _canonical(spark, sf)


@query(
    f"""SELECT printf('ticket-%06d', row_number() OVER (ORDER BY doc_id) - 1) AS ticket_id, {_strip('text')} AS customer_message,
        {_LABEL.format(_strip('source'))} AS category, {_LABEL.format(_strip('lang'))} AS priority FROM documents"""
)
def canonicalize_without_ids(spark, sf):
    source = table(spark, sf, "documents").selectExpr("text AS Message", "source AS Category", "lang AS Severity")
    return columns.canonicalize_tickets(source).select("ticket_id", "customer_message", "category", "priority")


_THREADS = """SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS subject,
  string_agg(text, chr(10) ORDER BY turn, text) FILTER (turn > 0) AS body FROM conversations GROUP BY conv_id"""


@query(
    f"""SELECT conv_id, CASE WHEN COALESCE(subject, '') = '' AND COALESCE(body, '') = '' THEN 'none'
        ELSE concat_ws(chr(10) || chr(10), nullif({_strip('subject')}, ''), nullif({_strip('body')}, '')) END AS input_text
        FROM ({_THREADS})"""
)
def subject_body_text(spark, sf):
    """First turn as subject, all later turns in order as body; some threads lack one of them."""
    later = F.sort_array(F.collect_list(F.when((F.col("turn") > 0) & F.col("text").isNotNull(), F.struct("turn", "text"))))
    threads = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("subject"),
        F.array_join(F.transform(later, lambda x: x["text"]), "\n").alias("body"),
    )
    return threads.select("conv_id", tx.subject_body_text(F.col("subject"), F.col("body"), F.lit("none")).alias("input_text"))


@query(
    f"""SELECT doc_id, {_strip('text')} AS input_text, {_LABEL.format(_strip('source'))} AS original_label_text,
        CASE source WHEN 'src1' THEN 'src0' ELSE {_LABEL.format(_strip('source'))} END AS label_text FROM documents WHERE length({_strip('text')}) > 0"""
)
def task_examples(spark, sf):
    """Training examples of a task: the first label column with any value, mapped; usable rows."""
    source = table(spark, sf, "documents").selectExpr(
        "doc_id", "text AS model_text", "'  ' AS queue", "source AS true_category"
    )
    return columns.task_examples(source, "raw_queue", {"src1": "src0"}).select(
        "doc_id", "input_text", "original_label_text", "label_text"
    )


@query("SELECT doc_id, lang FROM documents WHERE lower(lang) = 'en'")
def language_filter(spark, sf):
    return curate.language_filter(table(spark, sf, "documents")).select("doc_id", "lang")


@query("SELECT lower(lang) AS language, COUNT(*) AS n FROM documents WHERE lower(lang) <> 'en' GROUP BY ALL")
def other_languages(spark, sf):
    return validation.other_languages(table(spark, sf, "documents"))


@query(
    f"SELECT id, subject FROM ({EXPORT.sql}) WHERE length({_strip('subject')}) > 0 AND length({_strip('type')}) > 0"
)
def non_empty_text(spark, sf):
    return curate.non_empty_text(EXPORT.frame(spark, sf), ["subject", "type"]).select("id", "subject")


@query(
    """SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place FROM documents)
       WHERE place = 1"""
)
def dedupe_first(spark, sf):
    return ordinals.dedupe_first(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("SELECT COUNT(*) AS row_count, COUNT(DISTINCT text) AS distinct_texts, COUNT(*) - COUNT(DISTINCT text) AS duplicates FROM documents")
def duplicate_count(spark, sf):
    return profile.duplicate_count(table(spark, sf, "documents"), "text")


# --- profiles ------------------------------------------------------------------------


@query(
    f"""SELECT 'export' AS file_path, COUNT(*) AS row_count,
        'customer_message, true_category, true_priority, ticket_type, language, reference_answer, tags' AS columns,
        0::BIGINT AS missing_customer_message, 0::BIGINT AS missing_true_category, 0::BIGINT AS missing_true_priority,
        COUNT(*) FILTER (type IS NULL) AS missing_ticket_type, 0::BIGINT AS missing_language,
        0::BIGINT AS missing_reference_answer, COUNT(*) FILTER (tag_2 IS NULL) AS missing_tags,
        COUNT(*) - COUNT(DISTINCT body) AS duplicate_customer_message_count, TRUE AS has_required_training_columns FROM ({EXPORT.sql})"""
)
def profile_dataset(spark, sf):
    tickets = EXPORT.frame(spark, sf).selectExpr(
        "body AS customer_message", "queue AS true_category", "priority AS true_priority", "type AS ticket_type", "language",
        "answer AS reference_answer", "tag_2 AS tags",
    )
    return profile.profile_dataset(tickets, path="export")


@query(
    f"""WITH e AS ({EXPORT.sql})
        SELECT 'category' AS field, queue AS value, COUNT(*) AS n FROM e GROUP BY ALL
        UNION ALL SELECT 'priority', priority, COUNT(*) FROM e GROUP BY ALL
        UNION ALL SELECT 'language', language, COUNT(*) FROM e GROUP BY ALL"""
)
def distributions(spark, sf):
    return profile.distributions(EXPORT.frame(spark, sf))


_MISSING_COLUMNS = ["id", "subject", "body", "answer", "type", "queue", "priority", "language", "tag_1", "tag_2", "tag_3"]


@query(
    f"WITH e AS ({EXPORT.sql}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS missing_count, CAST(COUNT(*) FILTER ({c} IS NULL) AS DOUBLE) / COUNT(*) AS missing_rate FROM e"
        for c in _MISSING_COLUMNS
    )
)
def missing_report(spark, sf):
    return profile.missing_report(EXPORT.frame(spark, sf))


@query(f"SELECT tag_2 AS value, COUNT(*) AS n FROM ({EXPORT.sql}) GROUP BY ALL ORDER BY n DESC, value NULLS LAST LIMIT 20")
def value_counts(spark, sf):
    return profile.value_counts(EXPORT.frame(spark, sf), "tag_2", 20)


@query(
    f"""SELECT type, queue, priority, language, COUNT(*) AS n FROM ({EXPORT.sql})
        WHERE type IS NOT NULL AND queue IS NOT NULL AND priority IS NOT NULL AND language IS NOT NULL GROUP BY ALL"""
)
def value_counts_multi(spark, sf):
    return profile.value_counts_multi(EXPORT.frame(spark, sf), ["type", "queue", "priority", "language"])


_LENGTHS = f"""SELECT length(COALESCE(subject, '')) AS subject_len, length(COALESCE(body, '')) AS body_len,
  length(COALESCE(answer, '')) AS answer_len FROM ({EXPORT.sql})"""


@query(f"SELECT id, length(COALESCE(subject, '')) AS subject_len, length(body) AS body_len FROM ({EXPORT.sql})")
def text_lengths(spark, sf):
    lengths = profile.text_lengths(EXPORT.frame(spark, sf), ["subject", "body"])
    return lengths.selectExpr("id", "CAST(subject_len AS BIGINT) AS subject_len", "CAST(body_len AS BIGINT) AS body_len")


@query(
    f"WITH l AS ({_LENGTHS}) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS field, COUNT(*) AS n, round(AVG({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(MIN({c}) AS DOUBLE) AS min,
            quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50,
            quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75, CAST(MAX({c}) AS DOUBLE) AS max FROM l"""
        for c in ("subject_len", "body_len", "answer_len")
    )
)
def describe_lengths(spark, sf):
    names = ["subject", "body", "answer"]
    lengths = profile.text_lengths(EXPORT.frame(spark, sf), names)
    return rounded(profile.describe_lengths(lengths, [f"{c}_len" for c in names]), "mean", "std", digits=6)


@query(
    r"""SELECT round(AVG(t), 6) AS mean_whitespace_tokens, MAX(t) AS max_whitespace_tokens,
        round(quantile_cont(CAST(t AS DOUBLE), 0.95), 6) AS p95_whitespace_tokens
        FROM (SELECT len(regexp_extract_all(text, '\S+')) AS t FROM documents)"""
)
def token_length_stats(spark, sf):
    stats = profile.token_length_stats(spread(table(spark, sf, "documents")), "text")
    return rounded(stats, "mean_whitespace_tokens", "p95_whitespace_tokens", digits=6)


# --- splits and samples ----------------------------------------------------------------

_SPLIT_SQL = f"""
  WITH d AS (SELECT doc_id AS ticket_id, lang AS category, source AS priority, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
  c AS (SELECT category, COUNT(*) AS n FROM d GROUP BY ALL),
  total AS (SELECT CAST(ceil(0.3e0 * COUNT(*)) AS BIGINT) AS rest FROM d),
  r AS ({shares_sql('c', 'category', '(SELECT rest FROM total)')}),
  rc AS (SELECT category, quota AS n FROM r WHERE quota > 0),
  t AS ({shares_sql('rc', 'category', '(SELECT CAST(ceil(0.5e0 * rest) AS BIGINT) FROM total)')}),
  ranked AS (SELECT d.*, row_number() OVER (PARTITION BY category ORDER BY h) AS place FROM d),
  s AS (SELECT ranked.ticket_id, ranked.category, ranked.priority,
          CASE WHEN place > r.quota THEN 'train' WHEN place > COALESCE(t.quota, 0) THEN 'val' ELSE 'test' END AS split
        FROM ranked JOIN r USING (category) LEFT JOIN t USING (category))"""


def _tickets(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id AS ticket_id", "lang AS category", "source AS priority", "text")


def _split(spark, sf):
    return splits.fixed_splits(_tickets(spark, sf))[0]


@query(_SPLIT_SQL + " SELECT ticket_id, category, priority, split FROM s")
def fixed_splits(spark, sf):
    """70/15/15 by class, exact sizes."""
    return _split(spark, sf).select("ticket_id", "category", "priority", "split")


@query(
    """WITH d AS (SELECT doc_id AS ticket_id, md5('42:' || CAST(doc_id AS VARCHAR)) AS h, CAST(doc_id AS VARCHAR) AS category FROM documents),
       ranked AS (SELECT *, row_number() OVER (ORDER BY h) AS place FROM d),
       k AS (SELECT CAST(ceil(0.3e0 * COUNT(*)) AS BIGINT) AS rest FROM d)
       SELECT ticket_id, CASE WHEN place > rest THEN 'train' WHEN place > ceil(0.5e0 * rest) THEN 'val' ELSE 'test' END AS split,
              'random_no_stratification' AS strategy FROM ranked, k"""
)
def fixed_splits_unstratified(spark, sf):
    """Classes of a single row cannot be stratified: the cuts run over all rows."""
    source = table(spark, sf, "documents").selectExpr("doc_id AS ticket_id", "CAST(doc_id AS STRING) AS category")
    parted, strategy = splits.fixed_splits(source)
    return parted.select("ticket_id", "split", F.lit(strategy).alias("strategy"))


@query(
    _SPLIT_SQL
    + """ SELECT split, 'rows' AS field, 'all' AS value, COUNT(*) AS n FROM s GROUP BY ALL
          UNION ALL SELECT split, 'category', category, COUNT(*) FROM s GROUP BY ALL
          UNION ALL SELECT split, 'priority', priority, COUNT(*) FROM s GROUP BY ALL"""
)
def split_report(spark, sf):
    return splits.split_report(_split(spark, sf))


@query(
    _SPLIT_SQL
    + """ SELECT split, field, value, n, 'category_stratified' AS split_strategy, CAST(42 AS INTEGER) AS random_state FROM (
          SELECT split, 'rows' AS field, 'all' AS value, COUNT(*) AS n FROM s GROUP BY ALL
          UNION ALL SELECT split, 'category', category, COUNT(*) FROM s GROUP BY ALL
          UNION ALL SELECT split, 'priority', priority, COUNT(*) FROM s GROUP BY ALL)"""
)
def write_splits(spark, sf):
    """Splits written as a table partitioned by split, with the report of what was written."""
    tickets = _tickets(spark, sf).withColumnRenamed("text", "customer_message")
    return training.write_splits(tickets, fresh_path(spark, "splits")).drop("source_dataset")


@query(
    _SPLIT_SQL
    + """, joined AS (SELECT s.split, s.ticket_id, documents.text FROM s JOIN documents ON doc_id = s.ticket_id)
          SELECT 'ticket_id' AS key, COUNT(*) AS values, COUNT(*) FILTER (k > 1) AS leaking_values
          FROM (SELECT ticket_id, COUNT(DISTINCT split) AS k FROM joined GROUP BY ALL)
          UNION ALL SELECT 'text', COUNT(*), COUNT(*) FILTER (k > 1) FROM (SELECT text, COUNT(DISTINCT split) AS k FROM joined GROUP BY ALL)"""
)
def split_leak_check(spark, sf):
    """How many ids and texts occur in two splits of the table that was not deduplicated."""
    return curate.split_leak_check(_split(spark, sf), ["ticket_id", "text"])


@query(
    f"""WITH d AS (SELECT doc_id AS ticket_id, lang AS category, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
        c AS (SELECT category, COUNT(*) AS n FROM d GROUP BY ALL),
        t AS ({shares_sql('c', 'category', '(SELECT CAST(ceil(0.25e0 * COUNT(*)) AS BIGINT) FROM d)')}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY h) AS place FROM d)
        SELECT ticket_id, CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split FROM ranked JOIN t USING (category)"""
)
def smoke_split(spark, sf):
    return splits.one_cut(_tickets(spark, sf)).select("ticket_id", "split")


@query(
    f"""WITH d AS (SELECT doc_id AS ticket_id, lang AS label_text, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
        c AS (SELECT label_text, COUNT(*) AS n FROM d GROUP BY ALL),
        t AS ({shares_sql('c', 'label_text', '150')}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY label_text ORDER BY h) AS place FROM d)
        SELECT ticket_id, label_text FROM ranked JOIN t USING (label_text) WHERE place <= quota"""
)
def stratified_sample(spark, sf):
    source = table(spark, sf, "documents").selectExpr("doc_id AS ticket_id", "lang AS label_text")
    return splits.stratified_sample(source, 150)


@query("SELECT event_id AS ticket_id, event_type FROM events ORDER BY md5('7:' || CAST(event_id AS VARCHAR)) LIMIT 100")
def random_sample(spark, sf):
    source = table(spark, sf, "events").selectExpr("event_id AS ticket_id", "event_type")
    return splits.random_sample(source, 100, seed=7)


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 50")
def head_limit(spark, sf):
    return ordinals.head_limit(table(spark, sf, "events").select("event_id", "event_type"), 50)


@query("SELECT source AS label, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT source FROM documents)")
def label_vocabulary(spark, sf):
    return splits.label_vocabulary(table(spark, sf, "documents"), "source")


@query(
    "SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label_id FROM documents"
)
def encode_labels(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "source")
    return splits.encode_labels(documents, documents, "source")


@query(
    """WITH t AS (SELECT DISTINCT lang || '-' || source AS label FROM documents WHERE lang = 'en'),
            v AS (SELECT DISTINCT lang || '-' || source AS label FROM documents)
       SELECT label FROM v EXCEPT SELECT label FROM t"""
)
def unknown_labels(spark, sf):
    """Labels of the whole table that its English rows, as training part, do not have."""
    documents = table(spark, sf, "documents").selectExpr("lang", "concat(lang, '-', source) AS label")
    return splits.unknown_labels(documents.where("lang = 'en'"), documents, "label")


@query(
    """WITH a AS (SELECT DISTINCT true_label AS label FROM ({a})), b AS (SELECT DISTINCT predicted_label AS label FROM ({a}))
       SELECT label, CAST(bool_or(side = 'a') AS INTEGER) AS in_true, CAST(bool_or(side = 'b') AS INTEGER) AS in_predicted
       FROM (SELECT label, 'a' AS side FROM a UNION ALL SELECT label, 'b' FROM b) GROUP BY label""".format(a=PRED_A.sql)
)
def label_sets(spark, sf):
    """Union of true and predicted labels with the set each belongs to."""
    rows = PRED_A.frame(spark, sf)
    sides = F.array(
        F.struct(F.col("true_label").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")),
        F.struct(F.col("predicted_label").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")),
    )
    return rows.select(F.explode(sides).alias("s")).groupBy("s.label").agg(
        F.max("s.t").alias("in_true"), F.max("s.p").alias("in_predicted")
    )


# --- probability columns ----------------------------------------------------------------

@query(
    """WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
            e AS (SELECT vec_id, exp(v - MAX(v) OVER (PARTITION BY vec_id)) AS w FROM x)
       SELECT vec_id, round(MAX(w) / SUM(w), 8) AS highest, round(MIN(w) / SUM(w), 8) AS lowest, round(SUM(w) / SUM(w), 8) AS total
       FROM e GROUP BY vec_id"""
)
def softmax(spark, sf):
    p = num.softmax(F.col("embedding").cast("array<double>"))
    rows = table(spark, sf, "embeddings").select("vec_id", p.alias("p"))
    return rows.select(
        "vec_id",
        F.round(F.array_max("p"), 8).alias("highest"),
        F.round(F.array_min("p"), 8).alias("lowest"),
        F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 8).alias("total"),
    )


@query(
    f"""SELECT ticket_id, CAST(confidence >= 0.5e0 AS INTEGER) AS prediction, {sql_round('greatest(confidence, 1 - confidence)', 4)} AS confidence
        FROM ({PRED_A.sql})"""
)
def binary_confidence(spark, sf):
    prediction, confidence = num.binary_confidence(F.col("confidence"))
    return PRED_A.frame(spark, sf).select("ticket_id", prediction.alias("prediction"), confidence.alias("confidence"))


@query(
    """WITH n AS (SELECT COUNT(*) AS n FROM events), r AS (SELECT n, CAST(ceil(0.3e0 * n) AS BIGINT) AS rest FROM n),
          s AS (SELECT n, rest, CAST(ceil(0.5e0 * rest) AS BIGINT) AS test FROM r)
        SELECT unnest(['train', 'val', 'test']) AS split, unnest([n - rest, rest - test, test]) AS rows FROM s"""
)
def fixed_splits_repeated_ids(spark, sf):
    """Sizes are exact where most rows share an id or have none."""
    rows = table(spark, sf, "events").selectExpr(
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id % 5 AS STRING) END AS ticket_id", "event_type AS category", "event_id"
    )
    return splits.fixed_splits(rows)[0].groupBy("split").agg(F.count_distinct("event_id").alias("rows"))


@query("SELECT 100::BIGINT AS random_rows, 150::BIGINT AS stratified_rows, COUNT(DISTINCT event_type) AS classes FROM events")
def samples_repeated_ids(spark, sf):
    """Samples have the rows asked for where all rows share one id or have none."""
    rows = table(spark, sf, "events").selectExpr("CAST(NULL AS STRING) AS ticket_id", "event_type AS label_text", "event_id")
    drawn = splits.random_sample(rows, 100).agg(F.count_distinct("event_id").alias("n")).scalar()
    same = rows.withColumn("ticket_id", F.lit("same"))
    kept = splits.stratified_sample(same, 150)
    return kept.agg(F.count_distinct("event_id").alias("stratified_rows"), F.count_distinct("label_text").alias("classes")).select(
        drawn.alias("random_rows"), "stratified_rows", "classes"
    )


@query("SELECT doc_id FROM documents ORDER BY length(text) DESC, doc_id LIMIT 40")
def head_limit_sorted(spark, sf):
    """The first rows of a sorted frame follow its sort, not the files."""
    ordered = table(spark, sf, "documents").orderBy(F.desc(F.length("text")), "doc_id")
    return ordinals.head_limit(ordered, 40).select("doc_id")
