"""Routing, ingestion and dashboard figures as Structured Streaming jobs.

Each job is the batch operator on a stream; `run_available` drains what is there and stops.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..functions.labels import correct_flag
from ..operators.dashboard import log_cells, summarize_cells
from ..operators.ordinals import first_per_key
from ..operators.scoring import route_scored
from ..operators.validation import check_predictions
from ..session import broadcast_checked, remove_path, replace_table
from ..sources import folders
from ..sources.key_index import KeyIndex

MERGED_AFTER = 32  # batches


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def read_table_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table as a stream, be it one Parquet file or a folder of them."""
    if folders.is_folder(spark, path):
        return read_stream(spark, path, schema)
    parent, _, name = path.rstrip("/").rpartition("/")
    return read_stream(spark, parent, schema, name)


def _checkpoint(stream: DataFrame, path: str, given: str | None) -> str:
    """Where a job's progress is kept: inside its store, apart for each source, unless given.

    A second run over the same source goes on where the first ended; another source has
    progress of its own, since a checkpoint cannot change its source.
    """
    if given:
        return given
    plan = stream._jdf.queryExecution().analyzed().toString()
    sources = ",".join(sorted(set(re.findall(r"\w+Source\[[^\]]*\]", plan)))) or "source"
    return f"{path.rstrip('/')}/_progress/{hashlib.sha256(sources.encode()).hexdigest()[:16]}"


def _run(batch: DataFrame) -> str:
    """The streaming query a micro-batch belongs to; the same after a restart from its checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def _write_batch(rows: DataFrame, path: str, run: str, number: int) -> None:
    """Store a micro-batch under its query and number, in place of what an earlier attempt of it left."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")


def route_stream(
    scored: DataFrame,
    path: str,
    rejected_path: str | None = None,
    model_id: str = "model",
    threshold: float = K.ROUTE_THRESHOLD,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Route scored tickets and append the records that keep the contract.

    `scored` has subject, body, probabilities and created_at. Records are written under
    their query and micro-batch number, replacing what an interrupted attempt left there, so
    a batch that runs twice is stored once and another query's records stay. Rejected records
    go to `rejected_path` with their errors. Progress is kept in the store, for each source
    apart, unless `checkpoint` names another place.
    """
    if "latency_ms" not in scored.columns:
        scored = scored.withColumn("latency_ms", F.lit(0.0))
    records = check_predictions(route_scored(scored, model_id, threshold))

    def store(batch: DataFrame, number: int) -> None:
        run = _run(batch)
        batch = batch.persist()
        try:
            _write_batch(batch.where(F.size("errors") == 0).drop("errors"), path, run, number)
            if rejected_path:
                _write_batch(batch.where(F.size("errors") > 0), rejected_path, run, number)
        finally:
            batch.unpersist()

    return (
        records.writeStream.foreachBatch(store)
        .option("checkpointLocation", _checkpoint(scored, path, checkpoint))
        .trigger(availableNow=True)
        .start()
    )


def _latest_versions(spark: SparkSession, root: str, but: str | None = None) -> list[str]:
    """The folder of each run's last complete version."""
    found = []
    for run in folders.names(spark, root):
        versions = sorted((int(n[8:]) for n in folders.names(spark, f"{root}/{run}") if n.startswith("version=")), reverse=True)
        whole = (v for v in versions if "_SUCCESS" in folders.names(spark, f"{root}/{run}/version={v}"))
        last = next(whole, None)
        if run != but and last is not None:
            found.append(f"{root}/{run}/version={last}")
    return found


def dashboard_stream(log: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Keep the dashboard figures up to date, reading each log file once.

    State is one row per (queue, decision), in versions beside the figures (`<path>-state`):
    version n of a run is version n - 1 and the cells of micro-batch n, so a batch that is
    repeated gives the same version. Progress lies there too, for each source apart, unless
    `checkpoint` names another place; a later run over the same log takes in new files only.
    The figures add up the last versions of all runs.
    """
    root = f"{path.rstrip('/')}-state"

    def store(batch: DataFrame, number: int) -> None:
        spark, run = batch.sparkSession, f"run={_run(batch)}"
        cells = log_cells(batch)
        schema = cells.schema

        def with_stored(cells: DataFrame, stored: list[str]) -> DataFrame:
            both = cells.unionByName(spark.read.schema(schema).parquet(*stored)) if stored else cells
            return both.groupBy("predicted_queue", "decision").agg(F.sum("n").alias("n"), F.sum("sum_confidence").alias("sum_confidence"))

        own = f"{root}/cells/{run}"
        before = [f"{own}/version={number - 1}"] if number and folders.names(spark, f"{own}/version={number - 1}") else []
        with_stored(cells, before).coalesce(1).write.mode("overwrite").parquet(f"{own}/version={number}")
        if number > 1 and folders.names(spark, f"{own}/version={number - 2}"):
            remove_path(spark, f"{own}/version={number - 2}")
        current = [f"{own}/version={number}", *_latest_versions(spark, f"{root}/cells", but=run)]
        whole = with_stored(spark.createDataFrame([], schema), current)
        replace_table(summarize_cells(whole).coalesce(1), path)

    return (
        log.writeStream.foreachBatch(store)
        .option("checkpointLocation", _checkpoint(log, root, checkpoint))
        .trigger(availableNow=True)
        .start()
    )


def observed_stream(scored: DataFrame, path: str, checkpoint: str | None = None, completed: str = "completed_at") -> StreamingQuery:
    """Store scored rows and, per micro-batch, one row of figures observed while they are written.

    Rows go to `<path>/rows`, figures to `<path>/figures` (see `running_figures`), both under
    query and batch, so a repeated batch replaces itself. No row is read again for a figure.
    """

    def store(batch: DataFrame, number: int) -> None:
        run, seen = _run(batch), Observation()
        at = F.unix_micros(F.col(completed).cast("timestamp"))
        watched = batch.observe(
            seen,
            F.count(F.lit(1)).alias("n"),
            F.sum(correct_flag(F.col("true_label"), F.col("predicted_label")).cast("long")).alias("n_correct"),
            F.min(at).alias("first_micros"),
            F.max(at).alias("last_micros"),
        )
        _write_batch(watched, f"{path.rstrip('/')}/rows", run, number)
        figures = seen.get
        row = batch.sparkSession.createDataFrame([tuple(figures[c] for c in FIGURES)], ", ".join(f"{c} long" for c in FIGURES))
        _write_batch(row.coalesce(1), f"{path.rstrip('/')}/figures", run, number)

    return (
        scored.writeStream.foreachBatch(store)
        .option("checkpointLocation", _checkpoint(scored, path, checkpoint))
        .trigger(availableNow=True)
        .start()
    )


FIGURES = ["n", "n_correct", "first_micros", "last_micros"]


def running_figures(spark: SparkSession, path: str) -> DataFrame:
    """(run, batch, done, n_correct, accuracy, rows_per_second) up to each stored micro-batch of a run; one row a batch."""
    stored = spark.read.parquet(f"{path.rstrip('/')}/figures").select(F.col("run").cast("string").alias("run"), F.col("batch").cast("long").alias("batch"), *FIGURES)
    upto = Window.partitionBy("run").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    done, right = F.sum("n").over(upto), F.sum("n_correct").over(upto)
    seconds = (F.max("last_micros").over(upto) - F.min("first_micros").over(upto)) / 1e6
    return stored.select("run", "batch", done.alias("done"), right.alias("n_correct"), F.try_divide(right.cast("double"), done.cast("double")).alias("accuracy"), F.try_divide(done.cast("double"), seconds).alias("rows_per_second"))


def ingest_stream(
    incoming: DataFrame, path: str, order: str, key: str = "external_id", checkpoint: str | None = None
) -> StreamingQuery:
    """Add tickets whose external id is not stored yet; tickets without one are always added.

    An index of the stored ids (`KeyIndex`) lies beside the table: a micro-batch opens only
    the buckets of ids that its own may be in, so no state grows with the stream and the
    stored rows are not read; any number of runs, from any source, may add to one store. A
    micro-batch is written under its query and number and ignores what an interrupted attempt
    of itself left, so a repeat gives the same table. `order` decides which of several rows
    with one id comes first inside a batch. Progress is kept in the store, for each source
    apart, unless `checkpoint` names another place. Entries of `MERGED_AFTER` batches are
    folded into one.
    """
    def store(batch: DataFrame, number: int) -> None:
        run, spark = _run(batch), batch.sparkSession
        own = (f"run={run}", f"batch={number}")
        index = KeyIndex(spark, path, key)
        keyed = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
        first = first_per_key(batch.where(keyed), key, order)
        known, _ = index.known(first.select(F.col(key).cast("string").alias("key")), but=own)
        few = broadcast_checked(known.select(F.col("key").alias("_known")), known.count())
        first = first.join(few, F.col(key).cast("string") == F.col("_known"), "left_anti").select(*batch.columns)
        _write_batch(first.unionByName(batch.where(~keyed)), path, run, number)
        index.caught_up()
        if number % MERGED_AFTER == MERGED_AFTER - 1:
            index.merge()

    return (
        incoming.writeStream.foreachBatch(store)
        .option("checkpointLocation", _checkpoint(incoming, path, checkpoint))
        .trigger(availableNow=True)
        .start()
    )


def ingest_event_time(incoming: DataFrame, event_time: str, delay: str = "1 day", key: str = "external_id") -> DataFrame:
    """Streaming deduplication by key whose state is bounded by a watermark.

    For sources with an event time: copies of a key are recognised within the delay. Rows
    with a null or blank key all stay: each takes a key of its own, so they neither count as
    copies nor meet in one partition.
    """
    timed = incoming.withColumn(event_time, F.col(event_time).cast("timestamp"))
    given = F.nullif(F.col(key).cast("string"), F.lit(""))
    own = F.coalesce(F.concat(F.lit("k"), given), F.concat(F.lit("u"), F.expr("uuid()")))
    once = timed.withColumn("_own_key", own).withWatermark(event_time, delay)
    return once.dropDuplicatesWithinWatermark(["_own_key"]).drop("_own_key")


def run_available(start: Callable[[], StreamingQuery]) -> None:
    """Start a job and wait until it has taken in everything that is there."""
    start().awaitTermination()
