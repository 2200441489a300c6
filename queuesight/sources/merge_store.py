"""A stored table that takes changes without being rewritten: merge on read.

Rows lie in hash buckets of their key. A batch of changes adds change files to the buckets it
touches and nothing else. Reading folds the changes of each key, latest first, into the rows
of the touched buckets; the other buckets are read as they are. Compaction rewrites the
touched buckets. What belongs to the table is named by numbered state files, each created once,
so readers see a whole state and of two writers one fails and may try again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_checked, fresh_path, remove_path, settle
from . import folders

BUCKETS = 64
ORDER = "decimal(38,0)"


def _quoted(name: str) -> str:
    return f"`{name}`"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(_quoted(key)), F.lit(buckets)).cast("int")


def _latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    found = [n for n in folders.names(spark, f"{path}/state") if n.endswith(".json")]
    if not found:
        raise FileNotFoundError(f"no table at {path}")
    return int(found[-1][:-5]), folders.read_json(spark, f"{path}/state/{found[-1]}")


def _commit(spark: SparkSession, path: str, number: int, state: dict) -> None:
    folders.create_json(spark, f"{path}/state/{number:09d}.json", state)


def _buckets_in(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in folders.names(spark, folder) if n.startswith("bucket="))


def create_store(rows: DataFrame, path: str, key: str = "id", stamp: str = "updated_at", buckets: int = BUCKETS) -> None:
    """Store `rows`, one for each key, in hash buckets. A table already there is an error."""
    spark = rows.sparkSession
    if folders.names(spark, f"{path}/state"):
        raise FileExistsError(path)
    folder = f"{path}/base-{fresh_path(spark, 'x').rsplit('-', 1)[1]}"
    placed = rows.withColumn("bucket", bucket_of(key, buckets))
    placed.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(folder)
    base = {str(b): folder.rsplit("/", 1)[1] for b in _buckets_in(spark, folder)}
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])  # changes may set nulls
    _commit(spark, path, 0, {"key": key, "stamp": stamp, "buckets": buckets, "schema": schema.json(), "base": base, "changes": [], "batch": 0})


def add_changes(changes: DataFrame, path: str) -> list[int]:
    """Add a batch of changes (see `upsert_tickets`); returns the buckets written, the only ones touched.

    A later batch counts as later than all of an earlier one, whatever their `seq`; within a
    batch `seq` orders the changes of a row, a delete after others of the same `seq`, and of
    equal ones any, but always the same, comes last.
    """
    spark = changes.sparkSession
    number, state = _latest(spark, path)
    batch = state["batch"] + 1
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    at = F.col("at") if "at" in changes.columns else F.current_timestamp()
    removes = F.coalesce(F.col("delete"), F.lit(False))
    key_type = T.StructType.fromJson(json.loads(state["schema"]))[state["key"]].dataType  # equal keys hash alike only in one type
    placed = changes.withColumn("at", at).withColumn("delete", removes).withColumn(state["key"], F.col(_quoted(state["key"])).cast(key_type))
    # From the highest digits down: batch, seq, delete or not, and the row's own number.
    upper = F.lit(batch).cast("long") * 2**33 + (F.coalesce(seq.cast("int"), F.lit(0)).cast("long") + 2**31) * 2 + removes.cast("int")
    order = upper.cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + F.monotonically_increasing_id().cast("decimal(19,0)")
    placed = placed.withColumn("order", order.cast(ORDER)).withColumn("bucket", bucket_of(state["key"], state["buckets"]))
    folder = f"changes-{fresh_path(spark, 'x').rsplit('-', 1)[1]}"
    placed.write.partitionBy("bucket").parquet(f"{path}/{folder}")
    written = _buckets_in(spark, f"{path}/{folder}")
    _commit(spark, path, number + 1, state | {"batch": batch, "changes": [*state["changes"], {"folder": folder, "buckets": written, "schema": placed.drop("bucket").schema.json()}]})
    return written


def folded_changes(changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row a key: whether it ends deleted, was emptied on the way, its last time, and per field the value set last.

    The winning change of each field is found from numbers alone, in fixed-width buffers that
    combine on the map side; only the winners' values, at most one a field, are gathered.
    """
    removes = F.col("delete")
    sets = [F.max(F.when(~removes & F.array_contains("set_fields", f), F.col("order"))).alias(f"at_{i}") for i, f in enumerate(fields)]
    found = changes.groupBy(F.col(_quoted(key)).alias("_key")).agg(
        F.max(F.when(removes, F.col("order"))).alias("_removed"),
        F.max(F.when(~removes, F.col("order"))).alias("_set"),
        F.max("at").alias("_at"),
        *sets,
    )
    found = settle(found)
    wins = F.array(*[F.col(f"at_{i}") for i in range(len(fields))]) if fields else F.array().cast(f"array<{ORDER}>")
    values = changes.select(F.col(_quoted(key)).alias("_k"), F.col("order").alias("_order"), *[F.col(_quoted(f)).alias(f"v_{i}") for i, f in enumerate(fields)])
    winners = values.join(found.select(F.col("_key").alias("_k"), wins.alias("_wins")), "_k").where(F.array_contains("_wins", F.col("_order")))
    winners = winners.groupBy("_k").agg(F.collect_list(F.struct("_order", *[f"v_{i}" for i in range(len(fields))])).alias("_values"))
    joined = found.join(winners, F.col("_key") == F.col("_k"), "left")
    after = lambda c: F.coalesce(F.col(c) > F.coalesce(F.col("_removed"), F.lit(-1).cast(ORDER)), F.lit(False))
    out = [F.col("_key"), (F.col("_removed").isNotNull() & ~after("_set")).alias("_delete"), F.col("_removed").isNotNull().alias("_emptied"), F.col("_at")]
    for i in range(len(fields)):
        out += [after(f"at_{i}").alias(f"set_{i}"), F.get(_won(i), 0)[f"v_{i}"].alias(f"new_{i}")]
    return joined.select(*out)


def _won(i: int) -> Column:
    return F.filter("_values", lambda x: x["_order"] == F.col(f"at_{i}"))


def read_store(spark: SparkSession, path: str, keys: Sequence | None = None) -> DataFrame:
    """The table as it is now; of given `keys` only the buckets that may hold them are opened."""
    _, state = _latest(spark, path)
    if keys is None:
        return _state_rows(spark, path, state, range(state["buckets"]))
    key = state["key"]
    asked = spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructType.fromJson(json.loads(state["schema"]))[key]]))
    wanted = [r[0] for r in asked.select(bucket_of(key, state["buckets"])).distinct().collect()]
    return _state_rows(spark, path, state, wanted).where(F.col(_quoted(key)).isin(*keys))


def _state_rows(spark: SparkSession, path: str, state: dict, wanted: Sequence[int]) -> DataFrame:
    """The rows of some buckets; those without changes are read as they are."""
    schema = T.StructType.fromJson(json.loads(state["schema"]))
    touched = {b for c in state["changes"] for b in c["buckets"]} & set(wanted)

    def base(some: set[int]) -> DataFrame:
        found = [f"{path}/{state['base'][str(b)]}/bucket={b}" for b in sorted(some) if str(b) in state["base"]]
        return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)

    rows = base(set(wanted) - touched)
    if not touched:
        return rows
    changed = None
    for kind in sorted({c["schema"] for c in state["changes"]}):  # batches may bring other fields
        parts = [f"{path}/{c['folder']}/bucket={b}" for c in state["changes"] if c["schema"] == kind for b in c["buckets"] if b in touched]
        if parts:
            some = spark.read.schema(T.StructType.fromJson(json.loads(kind))).parquet(*parts)
            changed = some if changed is None else changed.unionByName(some, allowMissingColumns=True)
    return rows.unionByName(_merged(base(touched), changed, state["key"], state["stamp"]))


def _merged(old: DataFrame, changes: DataFrame, key: str, stamp: str) -> DataFrame:
    """Stored rows after their changes, and the rows that changes add.

    The stored rows meet the folded changes by a broadcast when these are few, and are then
    not shuffled.
    """
    fields = [c for c in old.columns if c not in (key, stamp) and c in changes.columns]
    folded = settle(folded_changes(changes, key, fields))
    few = broadcast_checked(folded, folded.count())
    at = {f: i for i, f in enumerate(fields)}
    own, emptied = F.col(_quoted(key)), F.coalesce("_emptied", F.lit(False))
    met = settle(old.select(own.alias("_met")).join(few.select("_key"), F.col("_met") == F.col("_key"), "left_semi").distinct())
    fresh = folded.where(~F.col("_delete")).join(broadcast_checked(met, met.count()), F.col("_key") == F.col("_met"), "left_anti")

    def value(name: str, kept: Column, inserted: bool) -> Column:
        if name == key:
            return (F.col("_key") if inserted else own).alias(name)
        if name == stamp:
            return F.coalesce(F.col("_at"), kept).alias(name)
        out = F.when(F.coalesce(F.col(f"set_{at[name]}"), F.lit(False)), F.col(f"new_{at[name]}")).otherwise(kept) if name in at else kept
        if name == "status":
            out = F.when(F.lit(inserted) | emptied, F.coalesce(out, F.lit("new"))).otherwise(out)
        if name == "created_at":
            out = F.coalesce(out, F.col("_at"))
        return out.cast(old.schema[name].dataType).alias(name)

    kept_rows = old.join(few, own == F.col("_key"), "left").where(~F.coalesce("_delete", F.lit(False)))
    updated = kept_rows.select(*[value(c, F.when(~emptied, F.col(_quoted(c))), False) for c in old.columns])
    empty = {f.name: F.lit(None).cast(f.dataType) for f in old.schema}
    return updated.unionByName(fresh.select(*[value(c, empty[c], True) for c in old.columns]))


def compact(spark: SparkSession, path: str, remove: bool = True) -> list[int]:
    """Rewrite the buckets that have changes and drop the changes; returns those buckets.

    Readers that began before still find their files unless `remove` deletes what no state
    names any more: then they must read again.
    """
    number, state = _latest(spark, path)
    touched = sorted({b for c in state["changes"] for b in c["buckets"]})
    if not touched:
        return []
    folder = f"base-{fresh_path(spark, 'x').rsplit('-', 1)[1]}"
    part = state | {"base": {b: f for b, f in state["base"].items() if int(b) in touched}}
    rows = _state_rows(spark, path, part, touched)
    rows.withColumn("bucket", bucket_of(state["key"], state["buckets"])).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    written = _buckets_in(spark, f"{path}/{folder}")
    base = {b: f for b, f in state["base"].items() if int(b) not in touched} | {str(b): folder for b in written}
    _commit(spark, path, number + 1, state | {"base": base, "changes": []})
    if remove:
        for c in state["changes"]:
            remove_path(spark, f"{path}/{c['folder']}")
        for b in touched:
            if str(b) in state["base"]:
                remove_path(spark, f"{path}/{state['base'][str(b)]}/bucket={b}")
    return touched
