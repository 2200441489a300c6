"""From a source export to the curated ticket table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..operators.columns import distinct_names, find_column, quoted
from ..operators.curate import constant_columns, language_filter, require_rows
from ..operators.ordinals import dedupe_first, surrogate_id, with_ordinal
from ..operators.validation import require_labels, require_language


def source_tickets(
    df: DataFrame, source: str = "dataset", id_prefix: str = K.SOURCE_ID_PREFIX, order: str | None = None
) -> DataFrame:
    """English rows of a source export under fixed names, cleaned, with a position in `_order`.

    Row-wise work only. A source without an id column is numbered from 1 among its English
    rows, in source order.
    """
    df = distinct_names(df)
    english = language_filter(df)
    columns = english.columns
    role = {
        "id": find_column(columns, K.SOURCE_ID_COLUMNS),
        "category": find_column(columns, K.SOURCE_CATEGORY_COLUMNS),
        "priority": find_column(columns, K.SOURCE_PRIORITY_COLUMNS),
        "type": find_column(columns, K.SOURCE_TYPE_COLUMNS),
        "answer": find_column(columns, K.SOURCE_ANSWER_COLUMNS),
        "subject": find_column(columns, K.SOURCE_SUBJECT_COLUMNS),
        "body": find_column(columns, K.SOURCE_BODY_COLUMNS),
        "message": find_column(columns, K.SOURCE_MESSAGE_COLUMNS),
        "language": find_column(columns, K.LANGUAGE_COLUMNS),
        "version": find_column(columns, ["version"]),
    }
    require_labels(columns)
    if not (role["message"] or role["subject"] or role["body"]):
        raise ValueError("no usable text columns; a message, or a subject and body, is needed")

    if role["id"]:
        placed = english.withColumn("_order", F.col(order)) if order else with_ordinal(english, "_order", start=1)
        external_id = tx.clean_text(quoted(role["id"]))
    else:
        placed = with_ordinal(english, "_order", start=1)
        external_id = surrogate_id(F.col("_order"), id_prefix)

    def cleaned(name: str | None):
        return tx.clean_text(quoted(name)) if name else F.lit("")

    def labelled(name: str | None):
        return tx.source_label(quoted(name)) if name else F.lit(None).cast("string")

    tags = [quoted(c) for c in columns if c.lower().startswith("tag")]
    combined = tx.tag_text(tags) if tags else cleaned(find_column(columns, ["labels"]))
    tag_columns = [
        cleaned(find_column(columns, [f"tag_{i}", f"tag{i}"])).alias(f"tag_{i}") for i in range(1, K.TAG_COUNT + 1)
    ]
    # A message column that already serves as the body would double the text.
    separate = role["message"] if role["message"] not in (None, role["body"], role["subject"]) else None
    return placed.select(
        "_order",
        cleaned(separate).alias("_message"),
        external_id.alias("external_id"),
        cleaned(role["subject"]).alias("subject"),
        cleaned(role["body"] or role["subject"]).alias("body"),
        cleaned(role["answer"]).alias("answer"),
        labelled(role["type"]).alias("type"),
        labelled(role["category"]).alias("queue"),
        labelled(role["priority"]).alias("priority"),
        (labelled(role["language"]) if role["language"] else F.lit("en")).alias("language"),
        cleaned(role["version"]).alias("version"),
        *tag_columns,
        combined.alias("combined_tags"),
        F.lit(source).alias("source"),
        F.lit(role["body"] is not None and role["body"] != role["subject"]).alias("_has_body"),
    )


def _message() -> Column:
    """Message, subject and body of a cleaned source row, empty parts left out."""
    blank = F.lit("")
    body = F.when(F.col("_has_body"), F.nullif(F.col("body"), blank))
    return F.concat_ws("\n\n", F.nullif(F.col("_message"), blank), F.nullif(F.col("subject"), blank), body)


def _derived(base: DataFrame) -> DataFrame:
    """The normalised columns that follow from a cleaned source row."""
    kept = [c for c in base.columns if c not in ("_message", "_has_body", "source")]
    return base.select(*kept, "source", _message().alias("customer_message")).select(
        *kept,
        "customer_message",
        tx.model_text(F.col("customer_message"), F.col("type"), F.col("combined_tags")).alias("model_text"),
        F.col("queue").alias("true_category"),
        F.col("priority").alias("true_priority"),
        *constant_columns(),
        "source",
        F.col("type").alias("ticket_type"),
        F.col("answer").alias("reference_answer"),
        F.col("combined_tags").alias("tags"),
    )


def _filled() -> Column:
    """A row with text. The body, or the subject in its place, is always part of the message,
    and the model text holds at least the words Type and Tags: one test covers all three."""
    return F.col("body") != ""


def normalize_tickets(
    df: DataFrame,
    source: str = "dataset",
    id_prefix: str = K.SOURCE_ID_PREFIX,
    order: str | None = None,
    drop_empty: bool = False,
) -> DataFrame:
    """English rows of a source export as normalised tickets, with a position in `_order`."""
    base = source_tickets(df, source, id_prefix, order)
    return _derived(base.where(_filled()) if drop_empty else base)


def curate_tickets(
    df: DataFrame, source: str = "dataset", id_prefix: str = K.SOURCE_ID_PREFIX, order: str | None = None, validate: bool = False
) -> DataFrame:
    """English, non-empty, deduplicated tickets under the normalised schema (28 columns).

    The first row of each message is kept. `validate` adds two checks that read the source:
    some English rows, and no other language left. `order` names a unique column that gives
    the source order; without it the order of the files is used.

    The deduplication groups digests and positions; message, model text and the alias
    columns, which repeat the texts, are made after it.
    """
    base = source_tickets(df, source, id_prefix, order)
    if validate:
        require_rows(base, "no rows are left after the language filter")
        require_language(base)
    return _derived(dedupe_first(base.where(_filled()), _message(), "_order").drop("_order"))


def curation_report(df: DataFrame, **options) -> DataFrame:
    """One row: rows dropped for empty text and copies removed by the curation.

    Counted on digests of the message, next to one another in a single scan.
    """
    return (
        source_tickets(df, **options)
        .select(F.when(_filled(), F.sha2(_message(), 256)).alias("digest"))
        .agg(
            F.count(F.lit(1)).alias("english_rows"),
            F.count("digest").alias("filled"),
            F.count_distinct("digest").alias("kept"),
        )
        .select(
            "english_rows",
            (F.col("english_rows") - F.col("filled")).alias("dropped_empty"),
            (F.col("filled") - F.col("kept")).alias("dropped_duplicates"),
            "kept",
        )
    )
