"""One delimited file with line breaks in its cells, read by many tasks.

A line begins a record if an even number of quotes comes before it in the file. Blocks count
their quotes in parallel; the parity of all earlier blocks is where a block starts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .blocks import BLOCK, pieces, prefix_sums, records

POSITION = "struct<file:string,block:bigint,at:bigint>"


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def _cut(effects: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, bool, np.ndarray]:
    """A line begins a record where the quotes before it are even in number."""
    after = start[0] + np.cumsum(effects[:, 0])
    before = after - effects[:, 0]
    return before % 2 == 0, bool(after[-1] % 2), after[-1:] % 2


def _well_quoted(record: Column, separator: str) -> Column:
    """Whether every quote opens a cell, closes one or is doubled inside one.

    Parted at the quotes, every other part is outside of a quoted cell: it is empty between
    doubled quotes, and else begins and ends with the separator.
    """
    parts = F.split(record, '"', -1)
    last = F.size(parts) - 1
    outside = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["i"] % 2 == 0)

    def fits(x: Column) -> Column:
        p, i = x["p"], x["i"]
        inner = (p == "") & (i > 0) & (i < last)
        starts = (i == 0) | p.startswith(separator) | ((i == last) & (p == ""))
        ends = (i == last) | p.endswith(separator) | ((i == 0) & (p == ""))
        return inner | (starts & ends)

    return F.forall(outside, fits) & (last % 2 == 0)


def read_delimited_blocks(
    spark: SparkSession, path: str, separator: str = ",", schema: T.StructType | str | None = None, position: str | None = None, check: bool = True
) -> DataFrame:
    """The rows of delimited files with a header, as a multi-line read gives them, by many tasks a file.

    Cells may hold line breaks, separators and doubled quotes. Lines end with a line feed; in a
    file whose first line ends with a carriage return before it all do, and those inside cells
    are read as line feeds. Cells are text unless `schema` says otherwise. `position`
    names a column to add, a struct (file, block, at) that orders the rows as they stand in
    the files. Quotes inside unquoted cells, or text after a closing quote, would shift every
    later record: with `check` they are an error that names the path (one more pass). Empty
    lines are no rows; short rows are filled with nulls; a file without rows gives none.
    """
    named = spark.read.csv(path, header=True, sep=separator, quote='"', escape='"', multiLine=True)
    wanted = named.schema if schema is None else (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    read = pieces(spark, path, "\n").withColumn("quotes", _quotes(F.col("value")).cast("long"))
    blocks = settle(read.groupBy(*BLOCK).agg(F.sum("quotes").alias("quotes")))
    blocks = settle(blocks.select(*BLOCK, (prefix_sums(blocks, "quotes") % 2).alias("parity")))
    found = records(read, blocks, _cut, ["quotes"], ["parity"], "\n")
    found = found.where(~F.col("value").isin("", "\r"))
    first = found.groupBy("file").agg(F.min_by(F.struct("block", "at", "value"), F.struct("block", "at")).alias("header"))
    first = first.select("file", "header.block", "header.at", F.col("header.value").rlike("^[^\n]*\r(\n|$)").alias("returns"))
    first = settle(first.select("file", F.struct("block", "at").alias("header"), "returns"))
    found = found.join(F.broadcast(first), "file")  # one row a file
    plain_ends = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\r$", "")
    found = found.withColumn("value", F.when(F.col("returns"), plain_ends).otherwise(F.col("value")))
    if check:
        body = F.regexp_replace("value", "^﻿", "")
        bad = found.where(F.contains("value", F.lit('"')) & ~_well_quoted(body, separator)).select("file", "value").first()
        if bad:
            raise ValueError(f"quotes out of place in {bad['file']}: {bad['value'][:80]!r}")
    rows = found.where(F.struct("block", "at") != F.col("header"))
    safe = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(wanted))
    options = {"sep": separator, "quote": '"', "escape": '"', "multiLine": "true"}
    cells = rows.select(F.from_csv("value", safe, options).alias("x"), F.struct("file", "block", "at").alias("p"))
    columns = [F.col(f"x.c{i}").alias(f.name) for i, f in enumerate(wanted)]
    return cells.select(*columns, *([F.col("p").alias(position)] if position else []))
