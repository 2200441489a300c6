"""One `.json` document that lists rows, read by many tasks.

The text is parted at closing braces. A row ends with a brace outside of any string that
leaves only the list open, so a block has to know whether it begins inside a string and how
many brackets are open by then. Each block says what it does to both, for either beginning;
a prefix scan over the blocks picks the one that holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .blocks import BLOCK, pieces, prefix_sums, records

BRACE = "}"
EFFECTS = ["quotes", "outside", "inside"]


def _effects(value: Column) -> list[Column]:
    """Unescaped quotes, and brackets opened less closed if the piece begins outside or inside a string."""
    parts = F.split(F.regexp_replace(value, r"\\(?s:.)", ""), '"', -1)
    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i")))

    def opened(odd: int) -> Column:
        text = F.array_join(F.transform(F.filter(numbered, lambda x: x["i"] % 2 == odd), lambda x: x["p"]), "")
        count = lambda bracket: F.length(text) - F.length(F.replace(text, F.lit(bracket), F.lit("")))
        return (count("{") + count("[") - count("]")).cast("long")

    return [(F.size(parts) - 1).cast("long").alias("quotes"), opened(0).alias("outside"), opened(1).alias("inside")]


def _states(effects: np.ndarray, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Before each piece and after the last: inside a string or not, and the brackets open."""
    quotes = np.r_[inside, effects[:, 0]].cumsum() % 2
    change = np.where(quotes[:-1] == 1, effects[:, 2], effects[:, 1]) - (quotes[1:] == 0)  # the brace after the piece
    return quotes, np.r_[depth, change].cumsum()


def _cut(effects: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, bool, np.ndarray]:
    """A piece begins a row where it stands outside of strings with the list alone, or nothing yet, open."""
    quotes, depth = _states(effects, int(start[0]), int(start[1]))
    between = (quotes == 0) & (depth <= 1)
    return between[:-1], bool(~between[-1]), np.array([quotes[-1], depth[-1]])


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a block: its quotes, and the change of depth for either beginning."""
    key, states = None, None

    def row() -> pd.DataFrame:
        return pd.DataFrame({"file": [key[0]], "block": [key[1]], "quotes": [states[0][0]], "outside": [states[0][1]], "inside": [states[1][1]]})

    for batch in batches:
        ids = list(zip(batch["file"].tolist(), batch["block"].tolist(), strict=True))
        edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)] if ids else []
        for lo, hi in zip(edges, edges[1:], strict=False):
            if ids[lo] != key:
                if key is not None:
                    yield row()
                key, states = ids[lo], [(0, 0), (1, 0)]
            effects = batch[EFFECTS].iloc[lo:hi].to_numpy(np.int64)
            states = [tuple(int(x[-1]) for x in _states(effects, *state)) for state in states]
    if key is not None:
        yield row()


def read_json_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `.json` files that are lists of objects, as a multi-line read gives them, by many tasks a file.

    Anything else (another document, a row that does not parse, brackets that do not match,
    text around or between rows) is an error that names the path. An empty list has no rows.
    """
    read = pieces(spark, path, BRACE)
    read = read.select(*BLOCK, "value", *_effects(F.col("value")))
    blocks = settle(read.select(*BLOCK, *EFFECTS).mapInPandas(_summaries, "file string, block long, quotes long, outside long, inside long"))
    blocks = settle(blocks.select("*", (prefix_sums(blocks, "quotes") % 2).alias("begins")))
    blocks = blocks.withColumn("change", F.when(F.col("begins") == 1, F.col("inside")).otherwise(F.col("outside")))
    blocks = settle(blocks.select(*BLOCK, "begins", prefix_sums(blocks, "change").alias("depth")))
    found = records(read, blocks, _cut, EFFECTS, ["begins", "depth"], BRACE)

    place = F.struct("block", "at")
    ends = found.groupBy("file").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    found = found.join(F.broadcast(settle(ends)), "file")  # one row a file
    first, last = place == F.col("first"), place == F.col("last")
    text = F.regexp_replace("value", r"^\s+", "")
    opening = F.when(first, F.regexp_replace(text, "^﻿?\\s*\\[", "[")).otherwise(text)
    found = found.select("file", first.alias("first"), last.alias("last"), opening.alias("text"))
    row = F.regexp_replace(F.expr("substr(text, 2)"), r"^\s+", "")
    lead = F.substring("text", 1, 1)
    ending = F.col("last") & F.col("text").rlike(r"^(\[\s*)?\]\s*$") & (F.col("first") == (lead == "["))
    good = ending | (~F.col("last") & (lead == F.when(F.col("first"), "[").otherwise(",")) & row.startswith("{"))
    wrong = found.where(~good).select("file", "text").first()
    if wrong or found.isEmpty():
        raise ValueError(f"malformed JSON, or no list of rows: {wrong['file'] if wrong else path}{': ' + repr(wrong['text'][:80]) if wrong else ''}")
    texts = found.where(~F.col("last")).select(F.concat(row, F.lit(BRACE)).alias("value"))
    strings = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    df = DataFrame(spark.read._jreader.json(strings), spark)
    if "_corrupt_record" in df.columns:
        raise ValueError(f"malformed JSON: {path}")
    return df
