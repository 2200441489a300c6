"""Writing tables, appending to stored tables and rewriting them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.stores import detach_deleted, new_tickets, upsert_tickets
from ..session import replace_table


def write_table(
    df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> str:
    """Write as parquet, csv, tsv, json or jsonl; delimited files quote what needs it."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format in ("csv", "tsv"):
        writer.csv(
            path,
            header=True,
            sep="\t" if format == "tsv" else ",",
            quote='"',
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
    elif format in ("json", "jsonl"):
        writer.json(path)
    elif format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format: {format}")
    return path


def append_jsonl(df: DataFrame, path: str) -> str:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)
    return path


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return None
        raise


def load_tickets(
    incoming: DataFrame, path: str, limit: int | None = None, clear_existing: bool = False, order: str | None = None
) -> int:
    """Add a batch to the stored tickets; returns how many rows were added.

    Repeating a load adds nothing but the rows without an external id. The rows are written
    once, by one job whose commit makes all of them visible, or none when it fails; with
    `clear_existing` the old table stays until the new one is complete. Ids go on from the
    largest stored one in batch order.
    """
    spark = incoming.sparkSession
    stored = read_or_none(spark, path)
    added = new_tickets(incoming, stored, limit, clear_existing, order)
    base = 0
    if stored is not None and not clear_existing:
        base = stored.agg(F.max("id")).first()[0] or 0
    now = F.current_timestamp()
    rows = added.select(
        (F.lit(base) + 1 + F.col("load_order")).cast("long").alias("id"),
        *[c for c in added.columns if c != "load_order"],
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    counter = Observation()
    rows = rows.observe(counter, F.count(F.lit(1)).alias("n"))
    if clear_existing:
        replace_table(rows, path)
    else:
        rows.write.mode("append").parquet(path)
    return counter.get["n"]


def apply_ticket_changes(changes: DataFrame, tickets_path: str, log_path: str | None = None) -> None:
    """Rewrite the ticket table after inserts, partial updates and deletes; references to
    deleted tickets in the routing log become null."""
    spark = changes.sparkSession
    replace_table(upsert_tickets(spark.read.parquet(tickets_path), changes), tickets_path)
    log = read_or_none(spark, log_path) if log_path else None
    if log is not None:
        replace_table(detach_deleted(log, changes), log_path)


def append_predictions(valid: DataFrame, path: str, rejected: DataFrame | None = None, rejected_path: str | None = None) -> None:
    """Append routing records, partitioned by day; records that failed go to a side table."""
    valid.withColumn("created_date", F.to_date("created_at")).write.mode("append").partitionBy("created_date").parquet(path)
    if rejected is not None and rejected_path:
        rejected.write.mode("append").parquet(rejected_path)
