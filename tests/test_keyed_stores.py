"""Stores with indexes: keys in buckets, merge on read, pages by ranges."""

import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuesight.operators.stores import upsert_tickets
from queuesight.sources import folders, merge_store
from queuesight.sources.key_index import KeyIndex, filter_of, may_hold
from queuesight.sources.paged import append_paged, page_files, read_page


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_filters_hold_all_and_little_else():
    rng = np.random.default_rng(1)
    known, other = (rng.integers(-(2**63), 2**63, (2, 5_000)) for _ in range(2))
    data = filter_of(*known)
    assert may_hold(data, *known).all() and may_hold(data, *other).mean() < 0.02 and len(data) < 6_300
    assert not may_hold(filter_of(*known[:, :0]), *other).any()


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch, names in enumerate((["a", "b", None, ""], ["c"], ["", None])):
        spark.createDataFrame([(n, 1) for n in names], "k string, v int").write.parquet(f"{path}/run=x/batch={batch}")
    return path


def test_index_answers_what_the_table_holds(spark, stored):
    index = KeyIndex(spark, stored, "k", buckets=16)
    asked = ["a", "c", "d", "e", "ä"]
    found, opened = index.known(keys(spark, asked))
    assert sorted(r.key for r in found.collect()) == ["a", "c"] and len(opened) <= 3
    assert index.caught_up() == []
    again = KeyIndex(spark, stored, "k", buckets=99)
    assert again.buckets == 16  # as at first
    found, _ = again.known(keys(spark, asked), but=("run=x", "batch=1"))
    assert [r.key for r in found.collect()] == ["a"]
    assert index.known(keys(spark, []))[0].collect() == []


def test_only_touched_buckets_are_opened(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3_000).select(F.concat(F.lit("k"), "id").alias("k")).write.parquet(f"{path}/run=x/batch=0")
    index = KeyIndex(spark, path, "k", buckets=64)
    index.caught_up()
    kept = {b: glob.glob(f"{path}/_keys/of-64/keys/*/*/bucket={b}/*.parquet") for b in range(64)}
    for b in range(64):  # files of other buckets than those of the asked keys may as well be unreadable
        for name in kept[b]:
            os.rename(name, name + ".away")
    _, opened = index.known(keys(spark, [f"new{i}" for i in range(20)]))
    assert len(opened) <= 2  # the filters know that none is stored
    asked = [f"k{i}" for i in range(5)]
    buckets = {r[0] for r in keys(spark, asked).select(F.pmod(F.xxhash64("key"), F.lit(64))).collect()}
    for b in buckets:
        for name in kept[b]:
            os.rename(name + ".away", name)
    found, opened = index.known(keys(spark, asked))
    assert sorted(r.key for r in found.collect()) == asked and set(opened) == buckets


def test_entries_merge_into_one(spark, stored):
    index = KeyIndex(spark, stored, "k", buckets=8)
    index.caught_up()
    assert index.merge(but=("run=x", "batch=2")) == 2 and index.merge() == 2 and index.merge() == 1
    assert index.caught_up() == [] and len(folders.names(spark, f"{stored}/_keys/of-8/filters/run=x")) == 0
    found, _ = index.known(keys(spark, ["a", "b", "c", "d"]))
    assert sorted(r.key for r in found.collect()) == ["a", "b", "c"]


def test_a_state_is_created_once(spark, tmp_path):
    at = f"{tmp_path}/s/1.json"
    folders.create_json(spark, at, {"a": 1})
    with pytest.raises(FileExistsError):
        folders.create_json(spark, at, {"a": 2})
    assert folders.read_json(spark, at) == {"a": 1} and folders.names(spark, f"{tmp_path}/s") == ["1.json"]


TICKETS = "id long, language string, status string, created_at timestamp, updated_at timestamp"
CHANGES = "id int, set_fields array<string>, language string, status string, delete boolean, seq int"


def random_changes(rng, n, ids):
    rows = []
    for seq in range(n):
        fields = [f for f in ("language", "status") if rng.random() < 0.6]
        rows.append((rng.choice(ids), fields, rng.choice([None, "x", "y", "z"]), rng.choice([None, "open"]), rng.choice([True, False, False, None]), seq - n // 2))
    rng.shuffle(rows)
    return rows


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_reads_equal_the_rewritten_table(spark, tmp_path, seed):
    rng, path = random.Random(seed), str(tmp_path / "t")
    time = "timestamp'2024-01-01'"
    stored = spark.range(60).selectExpr("id", "'en' AS language", "'old' AS status", f"{time} AS created_at", f"{time} AS updated_at")
    merge_store.create_store(stored, path, buckets=8)
    with pytest.raises(FileExistsError):
        merge_store.create_store(stored, path)
    want = stored
    base = sorted(glob.glob(f"{path}/base-*/*/*.parquet"))
    for batch, ids in enumerate((list(range(10)), [3, 70, 71], [5] * 3 + list(range(40, 75)))):
        changes = spark.createDataFrame(random_changes(rng, 30, ids), CHANGES).withColumn("at", F.expr(f"timestamp'2024-0{batch + 2}-01'"))
        touched = merge_store.add_changes(changes, path)
        own = changes.withColumn("id", F.col("id").cast("long"))
        assert touched == sorted(r[0] for r in own.select(merge_store.bucket_of("id", 8)).distinct().collect())
        want = spark.createDataFrame(upsert_tickets(want, changes).collect(), TICKETS)
        assert rows_of(merge_store.read_store(spark, path)) == rows_of(want)
        assert sorted(glob.glob(f"{path}/base-*/*/*.parquet")) == base  # no stored row was written again
    some = [3, 5, 50, 999]
    assert rows_of(merge_store.read_store(spark, path, some)) == rows_of(want.where(F.col("id").isin(some)))
    plan = merge_store.read_store(spark, path)._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan
    compacted = merge_store.compact(spark, path)
    assert compacted and rows_of(merge_store.read_store(spark, path)) == rows_of(want)
    assert merge_store.compact(spark, path) == [] and not glob.glob(f"{path}/changes-*")
    merge_store.add_changes(spark.createDataFrame([(4_000, ["status"], None, "s", False, 1)], CHANGES), path)
    assert rows_of(merge_store.read_store(spark, path, [4_000]).select("id", "status")) == [(4_000, "s")]


def test_changes_write_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_store.create_store(spark.range(500).selectExpr("id", "'a' AS v", "current_timestamp() AS updated_at"), path, buckets=32)
    change = spark.createDataFrame([(7, ["v"], "b", False)], "id long, set_fields array<string>, v string, delete boolean")
    touched = merge_store.add_changes(change, path)
    assert len(touched) == 1 and [os.path.basename(p) for p in glob.glob(f"{path}/changes-*/bucket=*")] == [f"bucket={touched[0]}"]
    base = {os.path.basename(p) for p in glob.glob(f"{path}/base-*/bucket=*")}
    assert merge_store.compact(spark, path, remove=False) == touched and len(glob.glob(f"{path}/base-*/bucket=*")) == len(base) + 1
    assert rows_of(merge_store.read_store(spark, path).groupBy("v").count()) == [("a", 499), ("b", 1)]
    assert merge_store.read_store(spark, path, [7]).inputFiles() and len(merge_store.read_store(spark, path, [7]).inputFiles()) == 1


def test_empty_store_and_empty_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_store.create_store(spark.createDataFrame([], TICKETS), path, buckets=4)
    assert merge_store.read_store(spark, path).collect() == []
    assert merge_store.add_changes(spark.createDataFrame([], CHANGES), path) == []
    merge_store.add_changes(spark.createDataFrame([(1, ["language"], "en", None, None, 1), (2, [], None, None, True, 1)], CHANGES), path)
    assert rows_of(merge_store.read_store(spark, path).select("id", "language", "status")) == [(1, "en", "new")]


@pytest.mark.parametrize("seed", range(3))
def test_pages_of_any_depth(spark, tmp_path, seed):
    rng, path = random.Random(seed), str(tmp_path / "t")
    rows = []
    for _ in range(rng.randint(1, 4)):
        part = [(rng.choice([None, rng.randint(0, 40), rng.randint(0, 300)]), rng.random()) for _ in range(rng.randint(0, 150))]
        append_paged(spark.createDataFrame(part, "id long, v double").repartition(3), path)
        rows += part
    if not rows:
        return
    order = spark.createDataFrame(rows, "id long, v double").orderBy(F.asc_nulls_first("id"), F.xxhash64("id", "v")).collect()
    for skip, limit in [(0, 10), (0, 1_000), (5, 1), (len(rows) // 2, 20), (len(rows) - 3, 10), (len(rows), 5), (3, 0), (rng.randint(0, len(rows)), 17)]:
        got = read_page(spark, path, skip, limit)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in order[skip : skip + limit]], (skip, limit)


def test_a_page_opens_the_files_it_crosses(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        append_paged(spark.range(0, 4_000).repartition(5), path)
        append_paged(spark.range(4_000, 8_000), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(glob.glob(f"{path}/part-*/*.parquet")) >= 8
    for skip in (0, 1_234, 3_990, 7_900):
        found, _ = page_files(spark, path, skip, 50)
        assert 1 <= len(found) <= 2 and [r.id for r in read_page(spark, path, skip, 50).collect()] == list(range(skip, min(8_000, skip + 50)))
    with pytest.raises(FileNotFoundError):
        read_page(spark, str(tmp_path / "none"))
