"""Which keys a stored table holds, without reading the table.

Beside the table lies an index of its keys: hash buckets, and for each bucket and batch a
Bloom filter. A new batch asks the filters of the buckets its keys fall into; only buckets
where some key may be known are opened, and there the keys themselves decide. A batch's entries
are written after its rows, under the same name; batches of the table without entries (an
older table, a run that stopped in between) are indexed before the next question.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_path, settle
from . import folders

BUCKETS = 64
BITS, PROBES = 10, 7  # a key: 1 in 120 unknown ones passes a filter
FOLDER = "_keys"


def _probes(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return (first.astype(np.uint64) + steps * (second.astype(np.uint64) | np.uint64(1))) % np.uint64(size)


def filter_of(first: np.ndarray, second: np.ndarray) -> bytes:
    """A Bloom filter of keys given by two hashes each."""
    size = max(64, BITS * len(first) + 7) // 8 * 8
    bits = np.zeros(size, np.uint8)
    bits[_probes(first, second, size).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_hold(data: bytes, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(data, np.uint8)
    at = _probes(first, second, len(bits) * 8)
    return ((bits[at // np.uint64(8)] >> (np.uint64(7) - at % np.uint64(8)).astype(np.uint8)) & 1).all(axis=0)


def _hashed(keys: DataFrame, buckets: int) -> DataFrame:
    """(key, h1, h2, bucket) of a frame of keys."""
    h1 = F.xxhash64("key")
    return keys.select("key", h1.alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"), F.pmod(h1, F.lit(buckets)).cast("int").alias("bucket"))


class KeyIndex:
    """The index beside the table at `path`; `key` is the column, null and blank keys are not in it."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.table, self.key = spark, path.rstrip("/"), key
        self.root = f"{self.table}/{FOLDER}"
        known = [n for n in folders.names(spark, self.root) if n.startswith("of-")]
        self.buckets = int(known[0][3:]) if known else buckets  # the number stays what it was at first
        self.root = f"{self.root}/of-{self.buckets}"

    def _batches(self, root: str) -> set[tuple[str, str]]:
        runs = [n for n in folders.names(self.spark, root) if n.startswith("run=")]
        return {(r, b) for r in runs for b in folders.names(self.spark, f"{root}/{r}") if b.startswith("batch=")}

    def _covered(self) -> set[tuple[str, str]]:
        at = f"{self.root}/covered"
        return {tuple(b) for n in folders.names(self.spark, at) if n.endswith(".json") for b in folders.read_json(self.spark, f"{at}/{n}")["batches"]}

    def _active(self) -> set[tuple[str, str]]:
        """The batches with entries of their own; merged ones are among them."""
        return self._batches(f"{self.root}/filters") - self._covered()

    def add(self, keys: DataFrame, run: str, batch: str) -> None:
        """Enter the keys of one batch of the table: its keys by bucket, then a filter for each bucket.

        The filters come last: only a batch that has them counts as indexed.
        """
        hashed = settle(_hashed(keys.select("key").distinct(), self.buckets))
        hashed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/keys/{run}/{batch}")

        def built(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "data": [filter_of(rows["h1"].to_numpy(), rows["h2"].to_numpy())]})

        filters = hashed.select("bucket", "h1", "h2").groupBy("bucket").applyInPandas(built, "bucket int, data binary")
        filters.write.mode("overwrite").parquet(f"{self.root}/filters/{run}/{batch}")

    def caught_up(self, but: tuple[str, str] | None = None) -> list[tuple[str, str]]:
        """Index the batches of the table that are not yet; returns them. Reads those batches only."""
        missing = sorted(self._batches(self.table) - self._batches(f"{self.root}/filters") - self._covered() - {but})
        for run, batch in missing:
            rows = self.spark.read.parquet(f"{self.table}/{run}/{batch}")
            if self.key in rows.columns:
                self.add(self._keys(rows), run, batch)
        return missing

    def _keys(self, rows: DataFrame) -> DataFrame:
        key = F.col(f"`{self.key}`").cast("string")
        return rows.where(F.coalesce(key, F.lit("")) != "").select(key.alias("key"))

    def known(self, keys: DataFrame, but: tuple[str, str] | None = None) -> tuple[DataFrame, list[int]]:
        """(key): those of the distinct `keys` that the table holds outside of batch `but`, and the buckets opened.

        A group of the filter test holds the batch's keys of one bucket and that bucket's filters.
        """
        self.caught_up(but)
        hashed = settle(_hashed(keys, self.buckets))
        batches = sorted(self._active() - {but})
        none = self.spark.createDataFrame([], "key string")
        asked = sorted(r[0] for r in hashed.select("bucket").distinct().collect())  # at most `buckets`
        if not batches or not asked:
            return none, []
        filters = self.spark.read.schema("bucket int, data binary").parquet(*[f"{self.root}/filters/{r}/{b}" for r, b in batches])

        def passed(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            first, second = rows["h1"].to_numpy(), rows["h2"].to_numpy()
            maybe = np.zeros(len(rows), bool)
            for data in found["data"]:
                maybe |= may_hold(data, first, second)
            return rows.loc[maybe, ["key", "bucket"]]

        some = filters.where(F.col("bucket").isin(asked))
        maybe = settle(hashed.groupBy("bucket").cogroup(some.groupBy("bucket")).applyInPandas(passed, "key string, bucket int"))
        opened = sorted(r[0] for r in maybe.select("bucket").distinct().collect())
        held = {(r, b): set(folders.names(self.spark, f"{self.root}/keys/{r}/{b}")) for r, b in batches} if opened else {}
        paths = [f"{self.root}/keys/{r}/{b}/bucket={n}" for r, b in batches for n in opened if f"bucket={n}" in held[r, b]]
        if not paths:
            return none, []
        stored = self.spark.read.schema("key string").parquet(*paths)
        return settle(maybe.select("key").join(stored, "key", "left_semi")), opened

    def merge(self, but: tuple[str, str] | None = None) -> int:
        """Fold the entries of all indexed batches into one, a filter and a folder a bucket; returns how many they were.

        A list of the batches it stands for is written last; their own entries then go.
        """
        batches = sorted(self._active() - {but})
        if len(batches) < 2:
            return len(batches)
        keys = self.spark.read.schema("key string").option("recursiveFileLookup", True).parquet(*[f"{self.root}/keys/{r}/{b}" for r, b in batches])
        number = len(folders.names(self.spark, f"{self.root}/covered"))
        entry = ("run=merged", f"batch={number}")
        self.add(keys, *entry)
        folders.create_json(self.spark, f"{self.root}/covered/{number:09d}.json", {"batches": [list(b) for b in batches]})
        for run, batch in batches:
            for kind in ("filters", "keys"):
                remove_path(self.spark, f"{self.root}/{kind}/{run}/{batch}")
        return len(batches)
