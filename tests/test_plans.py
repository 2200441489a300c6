"""Properties of the physical plans: what is read, shuffled and broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from queuesight import session
from queuesight.operators import compare, coverage, metrics, ordinals, ranks, rules, splits, stores
from queuesight.plans import curation


@pytest.fixture(scope="module")
def predictions(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "predictions")
    spark.range(2000).select(
        F.col("id").cast("string").alias("ticket_id"),
        F.concat(F.lit("q"), F.col("id") % 3).alias("true_label"),
        F.concat(F.lit("q"), F.col("id") % 4).alias("predicted_label"),
        (F.col("id") % 997 / 997).alias("confidence"),
        (F.col("id") * 7919 % 1000).cast("double").alias("latency_ms"),
        F.lit("x" * 100).alias("body"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def plan(df, capsys, run=False):
    if run:
        df.collect()
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.split("== Initial Plan ==")[0]


def test_coverage_reads_three_columns_and_joins_nothing(predictions, capsys):
    text = plan(coverage.coverage_by_threshold(predictions), capsys)
    assert re.search(r"ReadSchema: struct<true_label:string,predicted_label:string,confidence:double>", text)
    assert text.count("FileScan") == 1 and "Join" not in text and "Python" not in text and "Window" not in text
    # The first exchange carries counts, not rows: a partial aggregate sits right below it.
    assert "partial_count" in text


def test_report_is_one_scan(predictions, capsys):
    text = plan(metrics.classification_report(predictions), capsys)
    assert text.count("FileScan") == 1 and "Join" not in text


def test_percentiles_scan_once(predictions, capsys):
    text = plan(ranks.exact_percentiles(predictions, "latency_ms", {"p50": 0.5}), capsys, run=True)
    assert text.count("FileScan") == 1 and "ReusedExchange" in text
    assert "ObjectHashAggregate" not in text  # no per-group buffer that grows with the data


def test_split_shuffles_no_rows(predictions, capsys):
    tickets = predictions.withColumnRenamed("true_label", "category")
    text = plan(splits.fixed_splits(tickets)[0], capsys)
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "Exchange range" not in text
    assert "Window" not in text and "Sort" not in text


def test_large_class_tables_are_not_broadcast(spark, predictions, capsys, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_ROWS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tickets = predictions.withColumnRenamed("true_label", "category")
        parted, _ = splits.fixed_splits(tickets)
        assert "SortMergeJoin" in plan(parted, capsys)
        sizes = {r["split"]: r["count"] for r in parted.groupBy("split").count().collect()}
        assert sizes == {"train": 1400, "val": 300, "test": 300}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rules_stay_in_the_jvm(predictions, capsys):
    df = predictions.selectExpr("body AS customer_message", "true_label AS predicted_category", "'high' AS predicted_priority", "confidence AS category_confidence", "confidence AS priority_confidence")
    text = plan(rules.route_tickets(df), capsys)
    assert "Python" not in text and "Exchange" not in text and "ReadSchema: struct<true_label:string,confidence:double,body:string>" in text


def test_deduplication_shuffles_no_rows(predictions, capsys):
    source = predictions.selectExpr("body", "true_label AS queue", "ticket_id AS id")
    for df in (curation.curate_tickets(source), ordinals.dedupe_first(source, "id")):
        text = plan(df, capsys)
        assert "Exchange hashpartitioning" not in text and "SortAggregate" not in text and "Sort [" not in text


def test_loads_shuffle_each_side_once(predictions, spark, capsys):
    batch = predictions.selectExpr("ticket_id AS external_id", "body AS customer_message", "CAST(ticket_id AS BIGINT) AS k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(stores.new_tickets(batch, batch.select("external_id"), order="k"), capsys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortAggregate" not in text


def test_already_scored_ids_are_made_unique_before_the_join(predictions, capsys):
    text = plan(compare.not_yet_scored(predictions, predictions.unionAll(predictions)), capsys)
    assert "LeftAnti" in text and "keys=[_done" in text


def test_a_cluster_must_name_the_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context
        conf = spark.conf

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(Session)


def test_folder_of_its_own_only_when_none_is_named(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert session.shared_dir(spark) == (named or session.shared_dir(spark)).rstrip("/")
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")
