"""Figures of the operations dashboard, computed from the routing log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import text as tx
from ..functions.labels import ranked_probabilities
from ..functions.numeric import ratio
from ..session import settle


def zero_fill(counts: DataFrame, labels: Sequence[str], key: str = "label", n: str = "n") -> DataFrame:
    """Counts over exactly the given labels; absent ones are 0, others are left out."""
    fixed = F.array(*[F.lit(x) for x in labels])
    grid = counts.sparkSession.range(1).select(F.explode(fixed).alias(key), F.lit(0).cast("long").alias(n))
    inside = counts.where(F.col(key).isin(*labels)).select(key, F.col(n).cast("long").alias(n))
    return inside.unionByName(grid).groupBy(key).agg(F.sum(n).alias(n))


def log_cells(log: DataFrame) -> DataFrame:
    """(predicted_queue, decision, n, sum_confidence): all dashboard counts follow from these."""
    return log.groupBy("predicted_queue", "decision").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("sum_confidence")
    )


def summarize_cells(cells: DataFrame, queues: Sequence[str] = K.QUEUES, decisions: Sequence[str] = K.DECISIONS) -> DataFrame:
    """(section, label, n, average_confidence) from `log_cells`.

    Sections: `queue` and `decision` (zero-filled over the fixed labels) and `predictions`
    (the total, with the average confidence or null when the log is empty).
    """
    none = F.lit(None).cast("string")
    views = F.array(
        F.struct(F.lit("queue").alias("section"), F.col("predicted_queue").alias("label")),
        F.struct(F.lit("decision").alias("section"), F.col("decision").alias("label")),
        F.struct(F.lit("predictions").alias("section"), none.alias("label")),
    )
    fixed = [("queue", q) for q in queues] + [("decision", d) for d in decisions] + [("predictions", None)]
    grid = cells.sparkSession.range(1).select(
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("section"), F.lit(x).cast("string").alias("label")) for s, x in fixed])
        ).alias("v"),
        F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("double").alias("sum_confidence"),
    )
    known = (
        ((F.col("v.section") == "queue") & F.col("v.label").isin(*queues))
        | ((F.col("v.section") == "decision") & F.col("v.label").isin(*decisions))
        | (F.col("v.section") == "predictions")
    )
    return (
        cells.select(F.explode(views).alias("v"), "n", "sum_confidence")
        .unionByName(grid)
        .where(known)
        .groupBy("v.section", "v.label")
        .agg(F.sum("n").alias("n"), F.sum("sum_confidence").alias("s"))
        .select(
            "section", "label", "n",
            F.when(F.col("section") == "predictions", F.col("s") / F.nullif(F.col("n"), F.lit(0).cast("long"))).alias("average_confidence"),
        )
    )


def dashboard_summary(tickets: DataFrame, log: DataFrame, queues: Sequence[str] = K.QUEUES, decisions: Sequence[str] = K.DECISIONS) -> DataFrame:
    """Dashboard figures in long form: `summarize_cells` plus a `tickets` total."""
    total = tickets.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("tickets").alias("section"),
        F.lit(None).cast("string").alias("label"),
        "n",
        F.lit(None).cast("double").alias("average_confidence"),
    )
    return summarize_cells(log_cells(log), queues, decisions).unionByName(total)


def dashboard_document(summary: DataFrame) -> DataFrame:
    """The long-form summary as one row with maps, as a dashboard reads it."""

    def entries(section: str):
        pair = F.when(F.col("section") == section, F.struct("label", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(pair)))

    def single(section: str, column: str):
        return F.max(F.when(F.col("section") == section, F.col(column)))

    return summary.agg(
        single("tickets", "n").alias("total_tickets"),
        single("predictions", "n").alias("total_predictions"),
        entries("queue").alias("queue_distribution"),
        entries("decision").alias("decision_counts"),
        single("predictions", "average_confidence").alias("average_confidence"),
    )


def review_rates(log: DataFrame) -> DataFrame:
    """One row: predictions, auto-routed and reviewed counts and their rates (null if empty)."""
    counted = log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("decision") == "auto_route").alias("auto_route"),
        F.count_if(F.col("decision") == "human_review").alias("human_review"),
    )
    return counted.select(
        "*",
        ratio(F.col("auto_route"), F.col("total")).alias("auto_route_rate"),
        ratio(F.col("human_review"), F.col("total")).alias("review_rate"),
    )


def recent_predictions(log: DataFrame, limit: int = 20) -> DataFrame:
    """The newest predictions, ties by id descending; the limit lies in 1..100."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie between 1 and 100")
    return log.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def recent_latency(log: DataFrame, limit: int = 20) -> DataFrame:
    """Minimum, average and maximum latency of the newest predictions."""
    return recent_predictions(log, limit).agg(
        F.min("latency_ms").cast("double").alias("min_latency_ms"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.max("latency_ms").cast("double").alias("max_latency_ms"),
    )


def recent_confidences(log: DataFrame, limit: int = 20) -> DataFrame:
    """(prediction, confidence) of the newest predictions, oldest first, numbered from 1."""
    newest = recent_predictions(log, limit).agg(
        F.sort_array(F.collect_list(F.struct("created_at", "id", F.coalesce("confidence", F.lit(0.0)).alias("c")))).alias("r")
    )
    return newest.select(F.posexplode("r").alias("i", "p")).select(
        (F.col("i") + 1).cast("long").alias("prediction"), F.col("p.c").alias("confidence")
    )


def probability_breakdown(log: DataFrame, id_column: str = "id") -> DataFrame:
    """(id, rank, queue, probability), most probable first.

    The outer form of explode saves ranking each map a second time to see if it is empty.
    """
    ranked = F.posexplode_outer(ranked_probabilities(F.col("probabilities")))
    return log.select(id_column, ranked.alias("i", "p")).where(F.col("p").isNotNull()).select(
        id_column,
        (F.col("i") + 1).cast("int").alias("rank"),
        tx.humanize(F.col("p.label"), K.QUEUE_DISPLAY).alias("queue"),
        F.col("p.probability").alias("probability"),
    )


def ticket_page(tickets: DataFrame, skip: int = 0, limit: int = 100, order: str = "id") -> DataFrame:
    """A page of tickets by id, of any type, nulls first; rows with one id by a hash of the row.

    A top-n down to a deep page would bring `skip` rows to one task. Ids are counted and put
    into ranges instead; the range where the page starts is found from the ranges' sizes, the
    starting id and the place among its rows inside that range, and the page is a top-n from
    there on.
    """
    tie = F.xxhash64(*[F.col(c) for c in tickets.columns])
    counts = tickets.groupBy(F.col(order).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    parts = int(tickets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(counts.repartitionByRange(parts, F.asc_nulls_first("key")).withColumn("part", F.spark_partition_id()))
    before = 0
    for row in ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        if skip < before + row["n"]:
            break
        before += row["n"]
    else:
        return tickets.where(F.lit(False))
    running = Window.partitionBy("part").orderBy(F.asc_nulls_first("key")).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.where(F.col("part") == row["part"]).withColumn("upto", F.sum("n").over(running) + before)
    start = inside.where(F.col("upto") > skip).orderBy("upto").first()
    key = F.lit(start["key"])
    rest = tickets if start["key"] is None else tickets.where(F.col(order) >= key)
    return rest.orderBy(F.asc_nulls_first(order), tie).offset(skip - (start["upto"] - start["n"])).limit(limit)


def _time(df: DataFrame, name: str) -> Column:
    return tx.display_time(F.col(name), isinstance(df.schema[name].dataType, T.StringType))


def display_predictions(log: DataFrame) -> DataFrame:
    """Predictions as the dashboard table shows them."""
    return log.select(
        _time(log, "created_at").alias("timestamp"),
        tx.humanize(F.col("predicted_queue"), K.QUEUE_DISPLAY).alias("queue"),
        "confidence",
        tx.humanize(F.col("decision"), {}).alias("decision"),
        "threshold",
        "latency_ms",
        tx.preview(F.col("subject")).alias("subject"),
    )


def display_tickets(tickets: DataFrame) -> DataFrame:
    """Tickets as the dashboard table shows them."""
    blank = F.lit("")
    origin = F.concat_ws(" / ", F.nullif(F.col("source"), blank), F.nullif(F.col("channel"), blank))
    return tickets.select(
        "id",
        tx.humanize(F.col("status"), K.QUEUE_DISPLAY).alias("status"),
        tx.humanize(F.col("true_category"), K.QUEUE_DISPLAY).alias("category"),
        tx.humanize(F.col("true_priority"), K.QUEUE_DISPLAY).alias("priority"),
        F.coalesce(F.nullif(origin, blank), F.lit("Unknown")).alias("source_channel"),
        tx.preview(F.col("customer_message"), 110).alias("message"),
        _time(tickets, "created_at").alias("created"),
        _time(tickets, "updated_at").alias("updated"),
    )
