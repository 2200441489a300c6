"""Column roles, the canonical ticket frame and guards on model inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..functions.labels import map_label
from .ordinals import surrogate_id, with_ordinal


def distinct_names(df: DataFrame) -> DataFrame:
    """Rename earlier columns whose name differs from a later one by case only.

    Spark resolves names without regard to case, so such a pair would be ambiguous; the
    last one keeps the name.
    """
    last = {name.lower(): i for i, name in enumerate(df.columns)}
    if len(last) == len(df.columns):
        return df
    return df.toDF(*[n if last[n.lower()] == i else f"{n}__{i}" for i, n in enumerate(df.columns)])


def find_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate present, ignoring case; of several spellings the last column wins."""
    spelled = {name.lower(): name for name in columns}
    return next((spelled[c.lower()] for c in candidates if c.lower() in spelled), None)


def resolve_columns(columns: Sequence[str], roles: Mapping[str, Sequence[str]] | None = None) -> dict[str, str | None]:
    """Column name per role (text, category, priority, language by default)."""
    roles = roles or {
        "text": K.TEXT_COLUMNS,
        "category": K.CATEGORY_COLUMNS,
        "priority": K.PRIORITY_COLUMNS,
        "language": K.LANGUAGE_COLUMNS,
    }
    return {role: find_column(columns, names) for role, names in roles.items()}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Raise when a column is missing, naming every missing one."""
    present = {c.lower() for c in df.columns}
    missing = sorted(n for n in names if n.lower() not in present)
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def canonicalize_tickets(df: DataFrame) -> DataFrame:
    """Ticket frame under fixed names with normalised labels.

    Rows without a category or without text are dropped; a missing priority is `unknown`.
    Tickets without any id column are numbered in source order after the category filter
    and before the text filter.
    """
    df = distinct_names(df)
    roles = resolve_columns(df.columns)
    if not roles["text"] or not roles["category"]:
        raise ValueError("a customer message column and a category label column are needed")
    names = {c.lower(): c for c in df.columns}

    category = quoted(roles["category"])
    priority = quoted(roles["priority"]) if roles["priority"] else F.lit(None).cast("string")
    true_category = quoted(names["true_category"]) if "true_category" in names else category
    true_priority = quoted(names["true_priority"]) if "true_priority" in names else priority
    known_priority = F.coalesce(tx.normalize_label(priority), F.lit("unknown"))

    derived = {
        "customer_message": tx.strip(quoted(roles["text"]).cast("string")),
        "category": tx.normalize_label(category),
        "priority": known_priority,
        "true_category": tx.normalize_label(true_category),
        "true_priority": F.coalesce(tx.normalize_label(true_priority), known_priority),
    }
    others = [quoted(c) for c in df.columns if c.lower() not in derived]
    shaped = df.select(*others, *[c.alias(n) for n, c in derived.items()])
    shaped = shaped.where(F.col("customer_message").isNotNull() & F.col("category").isNotNull())
    if "ticket_id" not in names:
        if "external_id" in names:
            shaped = shaped.withColumn("ticket_id", quoted(names["external_id"]))
        else:
            shaped = with_ordinal(shaped, "_ordinal").withColumn(
                "ticket_id", surrogate_id(F.col("_ordinal"), K.TICKET_ID_PREFIX)
            ).drop("_ordinal")
    return shaped.where(F.col("customer_message") != "")


def select_label(df: DataFrame, task: str, candidates: Mapping[str, Sequence[str]] = K.TASK_LABEL_COLUMNS) -> str:
    """Name of the task's first label column that holds any non-blank value (one pass)."""
    if task not in candidates:
        raise ValueError(f"unknown task: {task}")
    names = {c.lower(): c for c in df.columns}
    present = [names[c] for c in candidates[task] if c in names]
    if present:
        longest = [F.max(F.length(tx.clean_text(quoted(c)))).alias(f"c{i}") for i, c in enumerate(present)]
        found = df.agg(*longest).first()
        for name, length in zip(present, found):
            if length:
                return name
    raise ValueError(f"no label column for task {task!r}; tried {list(candidates[task])}")


def task_examples(df: DataFrame, task: str, label_map: Mapping[str, str] | None = None) -> DataFrame:
    """Add input_text, original_label_text and label_text for a task; keep usable rows."""
    text, _ = select_input(df)
    original = tx.normalize_label(quoted(select_label(df, task)))
    shaped = df.select(
        "*",
        text.alias("input_text"),
        original.alias("original_label_text"),
        map_label(original, label_map or {}).alias("label_text"),
    )
    return usable_examples(shaped, "input_text", "label_text")


def select_input(df: DataFrame) -> tuple[Column, str]:
    """Training input chosen for the whole frame, and its name (one pass).

    Subject and body, else model_text, else customer_message: the first that is not empty
    everywhere. Rows it leaves empty are dropped by `usable_examples`.
    """
    names = {c.lower(): c for c in df.columns}
    choices = []
    if "subject" in names and "body" in names:
        text = tx.combine_text([quoted(names["subject"]), quoted(names["body"])])
        choices.append(("subject + body", text))
    choices += [(c, tx.clean_text(quoted(names[c]))) for c in ("model_text", "customer_message") if c in names]
    if choices:
        longest = df.agg(*[F.max(F.length(c)).alias(f"c{i}") for i, (_, c) in enumerate(choices)]).first()
        for (name, c), length in zip(choices, longest):
            if length:
                return c, name
    raise ValueError("no input text: subject and body, model_text or customer_message is needed")


def input_text(df: DataFrame) -> Column:
    """Text a predictor reads: subject and body, and customer_message for rows without both."""
    names = {c.lower(): c for c in df.columns}
    none = F.lit(None).cast("string")
    subject, body, message = (quoted(names[c]) if c in names else none for c in ("subject", "body", "customer_message"))
    return tx.subject_body_text(subject, body, message)


def usable_examples(df: DataFrame, text: str, label: str) -> DataFrame:
    """Rows with a non-blank text and label."""
    return df.where((F.length(tx.clean_text(F.col(text))) > 0) & (F.length(tx.clean_text(F.col(label))) > 0))


def drop_leaky_columns(df: DataFrame, leaky: Sequence[str] = K.LEAKY_COLUMNS) -> DataFrame:
    """The frame without the columns written after a ticket was resolved."""
    return df.drop(*[c for c in df.columns if c.lower() in set(leaky)])


def require_no_leak(inputs: Sequence[str], leaky: Sequence[str] = K.LEAKY_COLUMNS) -> None:
    """Raise when a model input column is one of the leaky ones."""
    found = sorted({c.lower() for c in inputs} & set(leaky))
    if found:
        raise ValueError(f"columns must not enter model input: {found}")
