"""Session settings and the shared folder for checkpoints, tables and streams."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "queuesight", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir` as the session names it.

    Only a local session that names none (a test) gets a folder of its own; a cluster whose
    executors have disks of their own must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="queuesight-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


ARROW_BYTES, SMALL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send rows to Python in batches of 4 MB, unless the session names a size itself.

    A batch is 64 MB else. Every Python step of every task holds several, beside the heap of the
    JVM and in its worker, so that is most of what texts and blocks take of an executor.
    """
    if spark.conf.get(ARROW_BYTES, None) is not None:
        yield
        return
    spark.conf.set(ARROW_BYTES, SMALL_BATCH)
    try:
        yield
    finally:
        spark.conf.unset(ARROW_BYTES)


BLOCKS_A_FILE = 8


def write_blocks(df: DataFrame, path: str) -> None:
    """Store rows of some MB each, such as packed arrays, a few to a file and one to a page.

    A Parquet writer first looks at its size after 100 rows and until then holds them all,
    with buffers of the codec as large as a page; a reader fills its columns with up to
    4,096 rows of a file. Small files bound both, however many rows a task has.
    """
    df.write.option("maxRecordsPerFile", BLOCKS_A_FILE).option("parquet.page.size.row.check.min", 1).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write `df` beside a stored table and put it in the table's place by renaming.

    Until the new rows are written in full the old table stays as it is, so a job that fails
    changes nothing and `df` may read the table it replaces. Should the last rename fail, the
    old table gets its name back. Readers that listed the old files must read again.
    """
    spark = df.sparkSession
    parent, _, name = path.rstrip("/").rpartition("/")
    fresh = f"{parent}/_{name}-new-{uuid.uuid4().hex}"
    try:
        df.write.parquet(fresh)
    except Exception:
        remove_path(spark, fresh)
        raise
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = f"{parent}/_{name}-old-{uuid.uuid4().hex}"
    had = files.exists(at(path))
    if had and not files.rename(at(path), at(old)):
        remove_path(spark, fresh)
        raise OSError(f"cannot move {path} aside")
    if not files.rename(at(fresh), at(path)):
        if had:
            files.rename(at(old), at(path))
        raise OSError(f"cannot put the new table at {path}")
    if had:
        remove_path(spark, old)


def settle(df: DataFrame) -> DataFrame:
    """Compute a small frame once and read it back from the shared folder.

    Used for metadata-sized frames (class counts, hash histograms, file splits)
    that several later steps read, so that the table behind them is scanned once.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a table scan whose rows are not spread over the cores.

    For steps that are heavy per row: one large file would otherwise keep a single task
    busy. A file is cut by bytes, but a Parquet row group is read whole by one task, so a
    file of one group gives many partitions of which one has all rows; counting them reads
    no columns. A table of many files is left as it is. Meant for scans only: counting the
    partitions of a frame with shuffles would run them.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if parts >= cores:
        rows = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
        held = rows.agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
        if not held["rows"] or held["most"] * cores <= 2 * held["rows"]:
            return df
    return df.repartition(max(cores, parts))


# A broadcast side stays below this many narrow rows (tens of MB); beyond it the
# same join runs as an ordinary shuffled join.
BROADCAST_ROWS = 200_000


def broadcast_checked(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """Mark `df` for broadcast when its known row count is small, else leave it to Spark."""
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if most is None else most) else df
