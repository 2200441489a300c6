"""Large text files whose records cross line and block borders, read by many tasks.

Spark splits a text file into blocks and a block into pieces at a separator, but where a
record ends depends on all that came before (an open quote, the nesting depth). So that state
is computed for every block at once: each block says what it does to the state, a prefix scan
over the blocks gives the state each begins with, and then every block cuts its own records.
A record that is open at its block's end is completed with what the next blocks begin with.
Only text is read, through Spark, so any path that Spark opens will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_checked, settle

# A block's state is some numbers and, of the few that have one, a text shorter than a record.
MOST_BLOCKS = 1_000_000
BLOCK = ["file", "block"]


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, value): the pieces of the files under `path`, in order within a block."""
    text = spark.read.option("lineSep", separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def prefix_sums(blocks: DataFrame, column: str) -> Column:
    """The sum of `column` over the earlier blocks of the same file; one row a block."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0)).cast("long")


# Of the pieces' effects (whole numbers, one column each) and the state a block begins with:
# whether a record begins with each piece, and whether one is open after the last.
Cut = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, bool]]


def _streamed(cut: Cut, effects: list[str], starts: list[str], separator: str, heads: bool):
    """Cuts the pieces of successive blocks into records.

    With `heads`, one row a block: the text before its first record, whether that closes what
    was open, and whether its own last record is left open. Otherwise one row a record, marked
    where it is the block's last and left open.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, held, begun, at = None, None, [], False, 0

        def ended() -> dict:
            """What is left of a block: its head if it began no record, else its last record."""
            text = separator.join(held)
            if heads:
                return {"file": key[0], "block": key[1], "head": first if begun else text, "closes": bool(begun), "leaves": bool(begun and open_after)}
            return {"file": key[0], "block": key[1], "at": at, "open": bool(open_after), "value": text}

        first, open_after = None, False
        for batch in batches:
            out = []
            ids = list(zip(batch["file"].tolist(), batch["block"].tolist(), strict=True))
            edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)] if ids else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if ids[lo] != key:
                    if key is not None and (heads or begun):
                        out.append(ended())
                    key, held, begun, at, first = ids[lo], [], False, 0, None
                    state = batch[starts].iloc[lo].to_numpy(np.int64)
                rows = batch.iloc[lo:hi]
                begins, open_after, state = cut(rows[effects].to_numpy(np.int64), state)
                values = rows["value"].tolist()
                places = np.flatnonzero(begins).tolist()
                last = 0
                for place in places:
                    held += values[last:place]
                    if not begun:
                        first, begun = separator.join(held) if held else None, True
                    elif not heads:
                        out.append({"file": key[0], "block": key[1], "at": at, "open": False, "value": separator.join(held)})
                        at += 1
                    held, last = [], place
                if begun and heads:
                    held = []  # only what comes before the first record is asked for
                else:
                    held += values[last:]
            if out:
                yield pd.DataFrame(out)
        if key is not None and (heads or begun):
            yield pd.DataFrame([ended()])

    return run


def records(read: DataFrame, blocks: DataFrame, cut: Cut, effects: list[str], starts: list[str], separator: str) -> DataFrame:
    """(file, block, at, value): the records, each with the block it begins in and its place among that block's.

    `read` has pieces with their effects, `blocks` the state each block begins with. A record
    left open at the end of a file ends there.
    """
    known = read.join(broadcast_checked(blocks.select(*BLOCK, *starts), blocks.count(), MOST_BLOCKS), BLOCK)
    known = known.select(*BLOCK, *starts, *effects, "value")
    heads = known.mapInPandas(_streamed(cut, effects, starts, separator, True), "file string, block long, head string, closes boolean, leaves boolean")
    heads = settle(heads)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    owned = heads.withColumn("owner", F.last(F.when(F.col("closes"), F.struct("block", "leaves")), ignorenulls=True).over(earlier))
    tails = owned.where(F.col("head").isNotNull() & F.col("owner.leaves")).groupBy("file", F.col("owner.block").alias("block"))
    tails = tails.agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("b"), "head"))).alias("heads"))
    tails = settle(tails.select(*BLOCK, F.lit(True).alias("open"), F.array_join(F.transform("heads", lambda h: h["head"]), separator).alias("tail")))
    cut_rows = known.mapInPandas(_streamed(cut, effects, starts, separator, False), "file string, block long, at long, open boolean, value string")
    whole = cut_rows.join(broadcast_checked(tails, tails.count()), [*BLOCK, "open"], "left")
    return whole.select(*BLOCK, "at", F.concat_ws(separator, "value", "tail").alias("value"))
