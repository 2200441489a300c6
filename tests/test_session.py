"""Rows of one large row group are spread over the cores."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from queuesight.catalog import models
from queuesight.session import ARROW_BYTES, small_batches, spread


@pytest.fixture
def one_group(spark, tmp_path):
    """Tables of one file and one row group each, cut by bytes into a partition for each core."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), ("de", "en", "fr", "pt")[i % 4]) for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield str(tmp_path)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def holding(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_rows_of_one_group_are_spread(spark, one_group):
    scan = spark.read.parquet(f"{one_group}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert scan.rdd.getNumPartitions() >= cores and holding(scan) == 1
    found = spread(scan)
    assert holding(found) >= cores and sorted(found.collect()) == sorted(scan.collect())


def test_even_and_empty_scans_are_left_as_they_are(spark, tmp_path):
    spark.range(4_000).repartition(16).write.parquet(f"{tmp_path}/many")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    many = spark.read.parquet(f"{tmp_path}/many")
    try:
        assert spread(many) is many
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert spread(spark.range(0)).count() == 0


def test_score_batch_scores_in_many_tasks(spark, one_group):
    found = models.score_batch(spark, one_group)
    assert holding(found) > 1 and found.count() == 400


def most_rows(df):
    """Rows of the largest Arrow batch of the first column."""
    return df.mapInArrow(lambda batches: (pa.record_batch({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n long").agg(F.max("n")).first()[0]


def test_batches_are_small_inside_unless_the_session_names_a_size(spark):
    texts = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    assert spark.conf.get(ARROW_BYTES, None) is None
    with small_batches(spark):
        assert most_rows(texts) <= 5
        with small_batches(spark):
            pass
        assert most_rows(texts) <= 5
    with pytest.raises(ZeroDivisionError), small_batches(spark):
        1 / 0
    assert spark.conf.get(ARROW_BYTES, None) is None and most_rows(texts) == 24
    spark.conf.set(ARROW_BYTES, "9m")
    try:
        with small_batches(spark):
            assert 5 < most_rows(texts) <= 10
        assert spark.conf.get(ARROW_BYTES) == "9m"
    finally:
        spark.conf.unset(ARROW_BYTES)


def test_texts_of_the_features_go_to_python_in_small_batches(spark, one_group, monkeypatch):
    sizes, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *args, **kwargs: sizes.append((path, spark.conf.get(ARROW_BYTES))) or write(self, path, *args, **kwargs))
    models.tfidf_features(spark, one_group)
    models.joint_gradient(spark, one_group)
    for name in ("word-codes", "word-counts", "top-weights", "example-blocks"):
        assert {size for path, size in sizes if name in path} == {"4m"}, name
