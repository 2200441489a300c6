"""Row positions in source order, and operators that depend on them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_checked, fresh_path, settle


def _has_column(df: DataFrame, name: str) -> bool:
    try:
        df.select(name).schema
    except AnalysisException:
        return False
    return True


_ROWWISE = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}


def _is_scan(df: DataFrame) -> bool:
    """Whether a frame is rows of files and row-wise steps only, so that its order is the files'."""
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in _ROWWISE:
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return _has_column(df, "_metadata.file_path")


def with_source_order(df: DataFrame, name: str = "source_order") -> DataFrame:
    """Add a sortable key that follows the source order (one pass, no shuffle).

    Parquet tells the row's place in its file. Other files are read in order by one task
    per split, so a running number inside the task orders the rows of a split and the path
    and split start order the splits; this needs a scan with row-wise steps only. Frames
    that do not come from files are ordered by partition.
    """
    number = F.monotonically_increasing_id().alias("position")
    if _is_scan(df) and _has_column(df, "_metadata.row_index"):
        parts = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("position")]
    elif _is_scan(df):
        parts = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), number]
    else:
        parts = [number]
    return df.select("*", F.struct(*parts).alias(name))


def with_ordinal(df: DataFrame, name: str = "ordinal", start: int = 0) -> DataFrame:
    """Number the rows start, start+1, ... in source order.

    Two passes over a file scan and no sort of the rows: the first counts the rows of each
    file split (a table as long as the list of splits), the second adds the split's offset
    to the position inside the split. A frame that is no plain scan could come out in
    another order the second time, so it is written to the shared folder first.
    """
    if not _is_scan(df):
        return with_ordinal(_written(df), name, start)
    offsets = _split_offsets(df)
    return _numbered(df, broadcast_checked(offsets, offsets.count(), SPLITS), name, start)


# A split is four whole numbers here: so many splits are some tens of MB.
SPLITS = 1_000_000


def _placed(df: DataFrame) -> DataFrame:
    """The rows of a scan with their file (as a hash of its path), block and position."""
    return df.select(
        "*",
        F.xxhash64("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_position"),
    )


def _split_offsets(df: DataFrame) -> DataFrame:
    """(_file, _block, _path, _first, _offset): where each file split starts in source order."""
    placed = df.select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_position")
    )
    splits = placed.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_position").alias("_first"))
    # Bounded input: one row per file split.
    earlier = Window.partitionBy(F.lit(0)).orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    return settle(splits.select(F.xxhash64("_path").alias("_file"), "_block", "_path", "_first", offset.alias("_offset")))


def _numbered(df: DataFrame, offsets: DataFrame, name: str, start: int) -> DataFrame:
    numbered = _placed(df).join(offsets.drop("_path"), ["_file", "_block"])
    ordinal = F.col("_offset") + F.col("_position") - F.col("_first") + F.lit(start)
    return numbered.select(*df.columns, ordinal.cast("long").alias(name))


def _written(df: DataFrame) -> DataFrame:
    path = fresh_path(df.sparkSession, "ordered")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def surrogate_id(ordinal: Column, prefix: str) -> Column:
    """`<prefix>000042`: zero-padded to six digits, longer numbers in full."""
    return F.concat(F.lit(prefix), F.format_string("%06d", ordinal))


def head_limit(df: DataFrame, n: int, order: str | None = None) -> DataFrame:
    """The first n rows in source order, or by a dense 0-based ordinal column.

    Of a scan only the files that reach into the first n rows are numbered; the order of any
    other frame, a sorted one say, is its own.
    """
    if order is not None:
        return df.where(F.col(order) < n)
    if not _is_scan(df):
        return df.limit(n)
    offsets = _split_offsets(df).where(F.col("_offset") < n)  # at most n splits that have rows
    paths = [r["_path"] for r in offsets.select("_path").distinct().collect()]
    if not paths:
        return df.limit(0)
    first = df.where(F.col("_metadata.file_path").isin(paths))
    return with_ordinal(first, "_ordinal").where(F.col("_ordinal") < n).drop("_ordinal")


def dedupe_first(df: DataFrame, text: str | Column, order: str | None = None) -> DataFrame:
    """Keep the first row of each exact text, by a unique `order` or else in source order.

    Digests and positions alone are grouped, in fixed-width buffers that each map task fills
    with its own copies first; a text that makes up a third of the table is one row per map
    task. What is not first is taken out by its position, so the rows themselves are only
    shuffled where more of them go than can be broadcast.
    """
    content = F.col(text) if isinstance(text, str) else text
    key = order or "_order"
    placed = with_ordinal(df, "_order") if order is None else df
    marked = placed.select(F.sha2(F.coalesce(content, F.lit("")), 256).alias("_digest"), F.isnull(content).alias("_null"), F.col(key).alias("_at"))
    return _without_later(placed, marked, ["_digest", "_null"], key).select(*df.columns)


def _without_later(rows: DataFrame, marked: DataFrame, group: list[str], key: str) -> DataFrame:
    """The rows whose position is the least of their group; `marked` has the groups and positions (`_at`)."""
    first = marked.groupBy(*group).agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    later = settle(marked.join(first, group).where(F.col("_at") > F.col("_least")).select("_at"))
    return rows.join(broadcast_checked(later, later.count()), F.col(key) == F.col("_at"), "left_anti")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by an order column, exactly one where rows tie.

    For batches: the rows themselves are aggregated. The key stays the grouping column, so a
    following join on it needs no further shuffle.
    """
    first = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("_row"))
    return first.select(*[F.col(c) if c == key else F.col("_row")[c].alias(c) for c in df.columns])


def first_by_position(df: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key by a position that no two rows share; narrow rows are grouped only."""
    marked = df.select(F.col(key).alias("_key"), F.col(position).alias("_at"))
    return _without_later(df, marked, ["_key"], position)
