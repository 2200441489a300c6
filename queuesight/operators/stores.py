"""Changes to stored tables, as frames: what to append, what the table becomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import broadcast_checked, settle
from .columns import quoted
from .ordinals import first_by_position, with_ordinal


def new_tickets(
    incoming: DataFrame,
    stored: DataFrame | None,
    limit: int | None = None,
    clear_existing: bool = False,
    order: str | None = None,
    columns: Sequence[str] = K.STORED_TICKET_COLUMNS,
) -> DataFrame:
    """Rows of a batch that a load adds to the stored tickets.

    The batch is cut to its first `limit` rows, then a row is skipped when its external id
    is stored already or came earlier in the batch. Rows without an external id are always
    added. Missing columns are null and a blank status is `new`. The batch position is kept
    as `load_order`; `order` names a dense 0-based position if the batch brings one.

    Later rows of an id are found from ids and positions alone and taken out before the rest
    meets the stored ids.
    """
    positioned = incoming.withColumn("load_order", F.col(order).cast("long")) if order else with_ordinal(incoming, "load_order")
    if limit is not None:
        positioned = positioned.where(F.col("load_order") < limit)
    present = {c.lower() for c in positioned.columns}
    shaped = positioned.select(
        *[(quoted(c) if c in present else F.lit(None)).cast("string").alias(c) for c in columns], "load_order"
    ).withColumn("status", F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("new")))
    keyed = F.coalesce(F.col("external_id"), F.lit("")) != ""
    first = first_by_position(shaped.where(keyed), "external_id", "load_order")
    if stored is not None and not clear_existing:
        known = stored.where(F.col("external_id").isNotNull()).select("external_id").distinct()
        first = first.join(known, "external_id", "left_anti")
    return first.unionByName(shaped.where(~keyed))


def upsert_tickets(stored: DataFrame, changes: DataFrame, key: str = "id", stamp: str = "updated_at") -> DataFrame:
    """The stored table after a batch of changes.

    `changes` has the key, `set_fields` (the fields present in the change), the fields,
    `delete` (boolean) and optionally `seq` (order of several changes to one row) and `at`
    (time of the change). A field named in `set_fields` is set even when its value is null;
    others keep the stored value. Unknown keys are inserted; deleted keys are left out. A
    change after a delete starts from an empty row; a delete with the same `seq` comes last.
    """
    fields = [c for c in stored.columns if c not in (key, stamp) and c in changes.columns]
    if "seq" not in changes.columns:
        changes = changes.withColumn("seq", F.lit(0))
    if "at" not in changes.columns:
        changes = changes.withColumn("at", F.current_timestamp())
    removes = F.coalesce("delete", F.lit(False))
    last_delete, last_change = F.max(F.when(removes, F.col("seq"))), F.max(F.when(~removes, F.col("seq")))
    folded = []
    for field in fields:
        named = F.when(~removes & F.array_contains("set_fields", field), F.col("seq"))
        folded.append(F.max_by(F.struct(F.col(field).alias("value")), named).alias(f"new_{field}"))
        folded.append((F.max(named) > F.coalesce(last_delete, F.max(named) - 1)).alias(f"set_{field}"))
    latest = changes.groupBy(key).agg(
        F.coalesce(last_delete >= F.coalesce(last_change, last_delete), F.lit(False)).alias("_delete"),
        last_delete.isNotNull().alias("_emptied"),
        F.max("at").alias("_at"),
        *folded,
    ).withColumn("_changed", F.lit(True))
    old = stored.withColumn("_stored", F.lit(True))
    joined = old.join(latest, key, "full_outer").where(~F.coalesce("_delete", F.lit(False)))
    # A row deleted and then changed keeps nothing of what was stored.
    emptied = F.coalesce("_emptied", F.lit(False))
    joined = joined.select(
        *[F.when(~emptied, F.col(c)).alias(c) if c in old.columns and c != key else F.col(c) for c in joined.columns]
    )

    def value(name: str):
        if name == key:
            return F.col(key)
        if name in fields:
            kept = F.when(F.coalesce(F.col(f"set_{name}"), F.lit(False)), F.col(f"new_{name}.value")).otherwise(F.col(name))
            if name == "status":
                kept = F.when(F.col("_stored").isNull(), F.coalesce(kept, F.lit("new"))).otherwise(kept)
            return kept.alias(name)
        if name == stamp:
            return F.when(F.coalesce("_changed", F.lit(False)), F.col("_at")).otherwise(F.col(stamp)).alias(stamp)
        if name == "created_at":
            return F.coalesce(F.col(name), F.col("_at")).alias(name)
        return F.col(name)

    return joined.select(*[value(c) for c in stored.columns])


def detach_deleted(log: DataFrame, changes: DataFrame, key: str = "id", reference: str = "ticket_id") -> DataFrame:
    """The routing log with references to deleted tickets set to null.

    Rows without a reference stay out of the join: their null keys would all meet in one
    task. The deleted ids are broadcast when there are few.
    """
    gone = settle(changes.where(F.coalesce("delete", F.lit(False))).select(F.col(key).alias("_gone")).distinct())
    referring = log.where(F.col(reference).isNotNull())
    joined = referring.join(broadcast_checked(gone, gone.count()), F.col(reference) == F.col("_gone"), "left")
    kept = joined.select(
        *[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == reference else F.col(c) for c in log.columns]
    )
    return kept.unionByName(log.where(F.col(reference).isNull()))
