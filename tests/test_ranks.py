import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuesight.operators import ordinals, profile, ranks, splits


def frame(spark, rows, schema, partitions=4):
    return spark.createDataFrame(rows, schema).repartition(partitions)


@pytest.mark.parametrize("kind", ["ties", "spread", "negative", "one"])
def test_percentiles_match_numpy(spark, kind):
    rng = random.Random(kind)
    values = {
        "ties": [rng.randint(0, 5) / 5 for _ in range(501)],
        "spread": [10 ** rng.uniform(-6, 9) for _ in range(700)],
        "negative": [rng.gauss(0, 1) for _ in range(400)],
        "one": [3.5],
    }[kind]
    df = frame(spark, [(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    row = ranks.exact_percentiles(df, "v", {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}).first()
    assert row["n"] == len(values)
    got = [row[c] for c in ("p0", "p25", "p50", "p95", "p100")]
    assert got == pytest.approx(list(np.percentile(values, [0, 25, 50, 95, 100])), rel=1e-12)


def test_percentiles_by_group(spark):
    rows = [(g, float(i)) for g, n in (("a", 100), ("b", 7)) for i in range(n)]
    got = {r["g"]: r["p"] for r in ranks.exact_percentiles(frame(spark, rows, "g string, v double"), "v", {"p": 0.9}, ["g"]).collect()}
    assert got == {"a": pytest.approx(np.percentile(range(100), 90)), "b": pytest.approx(np.percentile(range(7), 90))}


def test_percentiles_of_nothing(spark):
    row = ranks.exact_percentiles(spark.createDataFrame([], "v double"), "v", {"p": 0.5}).first()
    assert row["p"] is None


def test_hash_cut_takes_the_smallest_hashes(spark):
    ids = list(range(1000))
    df = frame(spark, [(i,) for i in ids], "ticket_id long")
    expected = set(sorted(ids, key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())[:137])
    for parts in (1, 8):
        assert {r[0] for r in splits.random_sample(df.repartition(parts), 137, seed=3).collect()} == expected


def test_largest_remainder_adds_up(spark):
    counts = spark.createDataFrame([("a", 129), ("b", 620), ("c", 106), ("d", 145)], "label string, n long")
    got = {r["label"]: r["quota"] for r in ranks.largest_remainder(counts, "label", F.lit(300), F.lit(1000)).collect()}
    assert got == {"a": 39, "b": 186, "c": 32, "d": 43}


def test_ordinals_follow_files(spark, tmp_path):
    """Several files and row groups: numbers are dense and follow the files by path."""
    for part in range(3):
        rows = [(part * 1000 + i, "x" * 50) for i in range(200)]
        spark.createDataFrame(rows, "k long, pad string").coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/p{part}")
    df = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path))
    numbered = ordinals.with_ordinal(df.where("k % 2 = 0"), "o", start=1).orderBy("o").collect()
    assert [r["o"] for r in numbered] == list(range(1, 301))
    assert [r["k"] for r in numbered] == sorted(r["k"] for r in numbered)


def test_ordinals_without_files(spark):
    df = spark.range(0, 100, 1, 7)
    assert [r["o"] for r in ordinals.with_ordinal(df, "o").orderBy("id").collect()] == list(range(100))


def test_dedupe_keeps_first_in_source_order(spark, tmp_path):
    for part in range(2):
        rows = [(f"t{i % 5}", f"{part}-{i}") for i in range(20)]
        spark.createDataFrame(rows, "text string, v string").coalesce(1).write.parquet(f"{tmp_path}/p{part}")
    df = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path))
    got = {r["text"]: r["v"] for r in ordinals.dedupe_first(df, "text").collect()}
    assert got == {f"t{i}": f"0-{i}" for i in range(5)}


def test_dedupe_by_column_with_nulls(spark):
    df = frame(spark, [("a", 3), ("a", 1), (None, 5), (None, 4), ("", 9)], "text string, k int")
    assert sorted((r["text"] is None, r["k"]) for r in ordinals.dedupe_first(df, "text", "k").collect()) == [(False, 1), (False, 9), (True, 4)]


def test_order_of_a_sorted_frame_is_its_own(spark, tmp_path):
    for part in range(3):
        spark.range(part * 100, part * 100 + 100, 1, 1).write.parquet(f"{tmp_path}/p{part}")
    df = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path))
    down = df.where("id % 2 = 1").orderBy(F.desc("id"))
    assert [r[0] for r in ordinals.head_limit(down, 3).collect()] == [299, 297, 295]
    assert [r["o"] for r in ordinals.with_ordinal(down, "o").orderBy(F.desc("id")).collect()] == list(range(150))
    assert sorted(r[0] for r in ordinals.head_limit(df, 130).collect()) == list(range(130))
    assert ordinals.head_limit(df.where("id < 0"), 3).count() == 0
    assert ordinals.dedupe_first(df.withColumn("t", (F.col("id") % 7).cast("string")), "t").agg(F.sum("id")).first()[0] == 21


def test_head_limit(spark):
    df = spark.range(0, 50, 1, 5)
    assert [r[0] for r in ordinals.head_limit(df, 7).orderBy("id").collect()] == list(range(7))


def test_describe_lengths(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 300, 1000).tolist()
    row = profile.describe_lengths(frame(spark, [(v,) for v in values], "n int"), ["n"]).first()
    assert (row["n"], row["min"], row["max"]) == (1000, min(values), max(values))
    assert row["mean"] == pytest.approx(np.mean(values))
    assert row["std"] == pytest.approx(np.std(values, ddof=1))
    assert [row["p25"], row["p50"], row["p75"]] == pytest.approx(list(np.percentile(values, [25, 50, 75])))


def test_deviation_of_large_numbers(spark):
    df = spark.createDataFrame([(1e9,), (1e9 + 1,), (1e9 + 2,)], "n double")
    assert profile.describe_lengths(df, ["n"]).first()["std"] == pytest.approx(1.0)


def test_token_length_stats(spark):
    texts = ["a b c", "", None, "one\n\ntwo", "x " * 50]
    row = profile.token_length_stats(spark.createDataFrame([(t,) for t in texts], "t string"), "t").first()
    counts = [len((t or "").split()) for t in texts]
    assert row["mean_whitespace_tokens"] == pytest.approx(np.mean(counts))
    assert row["max_whitespace_tokens"] == max(counts)
    assert row["p95_whitespace_tokens"] == pytest.approx(np.percentile(counts, 95))
    assert not math.isnan(row["p95_whitespace_tokens"])


def test_ordinals_behind_a_shuffle(spark, tmp_path):
    """A frame with a shuffle is written first; its numbers are dense and consistent."""
    spark.range(300).repartition(3).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").repartition(5)
    assert sorted(r["o"] for r in ordinals.with_ordinal(df, "o").collect()) == list(range(300))
    assert sorted(r["o"] for r in ordinals.with_ordinal(df.groupBy("id").count(), "o").collect()) == list(range(300))


def test_text_files_keep_their_order(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("k\n" + "".join(f"{name}{i:03d}\n" for i in range(150)))
    df = spark.read.option("header", True).csv(str(tmp_path))
    rows = ordinals.with_ordinal(df, "o").orderBy("o").collect()
    assert [r["k"] for r in rows] == [f"{n}{i:03d}" for n in "ab" for i in range(150)]
    kept = ordinals.dedupe_first(df.withColumn("g", F.substring("k", 3, 2)), "g").collect()
    assert {r["k"] for r in kept} == {f"a0{i:02d}" for i in range(100)}


def test_sizes_are_exact_over_repeated_and_missing_ids(spark):
    for ids in (["same"] * 400 + [f"t{i}" for i in range(600)], [None] * 1000, [f"t{i % 20}" for i in range(1000)]):
        df = frame(spark, [(t, "ab"[i % 2], i) for i, t in enumerate(ids)], "ticket_id string, category string, k int")
        for n in (1, 100, 999):
            assert splits.random_sample(df, n).count() == n
        assert splits.stratified_sample(df, 100, label="category").groupBy("category").count().collect().__len__() == 2
        parted, _ = splits.fixed_splits(df)
        assert {r["split"]: r["count"] for r in parted.groupBy("split").count().collect()} == {"train": 700, "val": 150, "test": 150}
        assert parted.select("k").distinct().count() == 1000
        assert splits.one_cut(df, 0.25).where("split = 'test'").count() == 250


def test_blank_ids_fall_back_on_the_message(spark):
    rows = [("", f"m{i}", "a" if i % 2 else "b") for i in range(100)]
    parted, _ = splits.fixed_splits(frame(spark, rows, "ticket_id string, customer_message string, category string"))
    assert sorted(r["count"] for r in parted.groupBy("split").count().collect()) == [15, 15, 70]
