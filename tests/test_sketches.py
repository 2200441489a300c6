"""Day sketches against exact figures, and streams that keep their own state."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from queuesight.operators import dashboard, sketches
from queuesight.streaming import jobs

START = datetime(2024, 1, 30)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = [(START + timedelta(hours=rng.randint(0, 24 * 5)), rng.choice([rng.gauss(100, 30), 50.0, None]), rng.choice([None, *range(400)])) for _ in range(6_000)]
    return spark.createDataFrame(rows, "at timestamp, ms double, who int")


def test_merged_days_keep_the_stated_bounds(spark, log, tmp_path):
    path, quantiles = f"{tmp_path}/s", {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    sketches.day_sketches(log.where("day(at) <> 31"), "at", "ms", "who").write.parquet(path)
    sketches.day_sketches(log.where("day(at) = 31"), "at", "ms", "who").write.mode("append").parquet(path)  # a day that comes later
    stored = spark.read.parquet(path)
    month = F.date_format("day", "yyyy-MM")
    merged = {r.period: r for r in sketches.merged_sketches(stored, quantiles, month).collect()}
    assert set(merged) == {"2024-01", "2024-02"} and sum(r.n for r in merged.values()) == 6_000
    for period, got in merged.items():
        rows = log.where(F.date_format("at", "yyyy-MM") == period)
        values = sorted(r.ms for r in rows.collect() if r.ms is not None)
        for name, q in quantiles.items():
            below, upto = (sum(v < got[name] for v in values) / len(values), sum(v <= got[name] for v in values) / len(values))
            assert below <= q + sketches.rank_error() and upto >= q - sketches.rank_error()
        exact = rows.select("who").where("who IS NOT NULL").distinct().count()
        assert abs(got["distinct"] - exact) <= max(1, sketches.distinct_error() * exact)
    checked = sketches.rank_checked(log, "at", "ms", "who", sketches.merged_sketches(stored, quantiles, month), quantiles, month).collect()
    assert all(r[c] for r in checked for c in (*quantiles, "distinct_close"))


def test_a_wrong_figure_is_found(spark, log):
    day = sketches.day_sketches(log, "at", "ms", "who")
    wrong = sketches.merged_sketches(day, {"p50": 0.6}).withColumn("distinct", F.col("distinct") * 2)
    row = sketches.rank_checked(log, "at", "ms", "who", wrong, {"p50": 0.5}, F.lit("all")).first()
    assert not row["p50"] and not row["distinct_close"]


def test_no_rows(spark, log):
    none = sketches.day_sketches(log.limit(0), "at", "ms", "who")
    assert none.collect() == [] and sketches.merged_sketches(none, {"p": 0.5}).collect() == []


LOG = "predicted_queue string, decision string, confidence double"


def write_log(spark, folder, seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice(["human_resources", "customer_general", "other"]), rng.choice(["auto_route", "human_review"]), rng.randint(0, 64) / 64) for _ in range(n)]
    spark.createDataFrame(rows, LOG).repartition(3).write.mode("append").parquet(folder)


def key(df):
    return sorted(map(tuple, df.select("section", "label", "n", F.round("average_confidence", 8)).collect()), key=str)


def run(spark, source, path, **options):
    query = jobs.dashboard_stream(jobs.read_stream(spark, source, spark.createDataFrame([], LOG).schema, files_per_trigger=2), path, **options)
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def test_a_second_run_reads_new_files_only(spark, tmp_path):
    source, other, path = f"{tmp_path}/log", f"{tmp_path}/other", f"{tmp_path}/figures"
    read = 0
    for seed, n in ((1, 200), (2, 50), (3, 70)):
        write_log(spark, source, seed, n)
        assert run(spark, source, path) == n  # what was read before is not read again
        read += n
        whole = spark.read.parquet(source)
        assert key(spark.read.parquet(path)) == key(dashboard.summarize_cells(dashboard.log_cells(whole)))
    assert run(spark, source, path) == 0
    write_log(spark, other, 4, 40)
    assert run(spark, other, path) == 40  # another log, with progress of its own, is added
    whole = whole.unionByName(spark.read.parquet(other))
    assert whole.count() == read + 40
    assert key(spark.read.parquet(path)) == key(dashboard.summarize_cells(dashboard.log_cells(whole)))


def test_figures_observed_while_storing(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice("ab"), START + timedelta(seconds=rng.randint(0, 900))) for i in range(300)]
    schema = "ticket_id int, true_label string, predicted_label string, completed_at timestamp"
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame(rows, schema).repartition(6).write.parquet(source)
    stream = lambda: jobs.read_stream(spark, source, spark.createDataFrame([], schema).schema, files_per_trigger=2)
    jobs.run_available(lambda: jobs.observed_stream(stream(), path))
    jobs.run_available(lambda: jobs.observed_stream(stream(), path))  # nothing new: nothing added
    figures = jobs.running_figures(spark, path).orderBy("batch").collect()
    assert [r.batch for r in figures] == [0, 1, 2] and figures[-1].done == 300
    for r in figures:
        stored = spark.read.parquet(f"{path}/rows").where(F.col("batch") <= r.batch).collect()
        right = sum(x.true_label == x.predicted_label for x in stored)
        times = [x.completed_at for x in stored]
        assert (r.done, r.n_correct) == (len(stored), right) and r.accuracy == right / len(stored)
        assert r.rows_per_second == pytest.approx(len(stored) / (max(times) - min(times)).total_seconds())
