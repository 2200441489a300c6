"""Dashboard figures, stored tables, files, scoring by a supplied model, streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from queuesight import constants as K
from queuesight import session
from queuesight.operators import dashboard, scoring, stores
from queuesight.sources import readers, writers
from queuesight.streaming import jobs

LOG = (
    "id int, ticket_id int, subject string, body string, predicted_queue string, confidence double, threshold double, "
    "decision string, probabilities map<string,double>, model_id string, latency_ms int, created_at timestamp"
)


def log_rows():
    even = {q: 1 / 7 for q in K.QUEUES}
    return [
        (1, 1, "s1", "b", "billing_and_payments", 0.91, 0.8, "auto_route", even, "m", 10, datetime(2024, 1, 1)),
        (2, 2, "s2", "b", "technical_product_support", 0.69, 0.8, "human_review", even, "m", 30, datetime(2024, 1, 2)),
    ]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(log_rows(), LOG)


def test_dashboard(spark, log):
    row = dashboard.dashboard_document(dashboard.dashboard_summary(spark.range(2), log)).first()
    assert (row["total_tickets"], row["total_predictions"], round(row["average_confidence"], 6)) == (2, 2, 0.8)
    assert row["queue_distribution"] == {q: int(q in ("billing_and_payments", "technical_product_support")) for q in K.QUEUES}
    assert row["decision_counts"] == {"auto_route": 1, "human_review": 1}


def test_empty_dashboard(spark, log):
    empty = log.where("false")
    row = dashboard.dashboard_document(dashboard.dashboard_summary(spark.range(0), empty)).first()
    assert (row["total_tickets"], row["total_predictions"], row["average_confidence"]) == (0, 0, None)
    assert set(row["queue_distribution"].values()) == {0} and len(row["queue_distribution"]) == 7
    rates = dashboard.review_rates(empty).first()
    assert rates["review_rate"] is None and rates["auto_route_rate"] is None


def test_unlisted_queues_are_left_out(spark, log):
    other = log.withColumn("predicted_queue", F.lit("elsewhere"))
    summary = dashboard.dashboard_summary(spark.range(2), other)
    assert summary.where("section = 'queue'").agg(F.sum("n")).first()[0] == 0
    assert summary.where("section = 'predictions'").first()["n"] == 2


def test_recent(log):
    assert [r["id"] for r in dashboard.recent_predictions(log, 1).collect()] == [2]
    assert tuple(dashboard.recent_latency(log).first()) == (10.0, 20.0, 30.0)
    assert [tuple(r) for r in dashboard.recent_confidences(log).collect()] == [(1, 0.91), (2, 0.69)]
    for bad in (0, 101):
        with pytest.raises(ValueError):
            dashboard.recent_predictions(log, bad)


def test_pages(spark):
    df = spark.range(0, 500, 1, 8).withColumn("v", F.col("id") * 2)
    expected = list(range(120, 150))
    assert [r["id"] for r in dashboard.ticket_page(df, 120, 30).collect()] == expected
    assert dashboard.ticket_page(df, 500, 30).count() == 0
    ties = [None, None, 1, 1, 2, 2**53, 2**53 + 1, 2**53 + 2] + list(range(10, 60))
    want = sorted(ties, key=lambda x: (x is not None, x or 0))
    for kind in ("long", "string"):
        rows = [(None if x is None else x if kind == "long" else f"{x:020d}", n) for n, x in enumerate(ties)]
        df = spark.createDataFrame(rows, f"id {kind}, n int").repartition(5)
        pages = [[tuple(r) for r in dashboard.ticket_page(df, skip, 7).collect()] for skip in range(0, 63, 7)]
        got = [r for page in pages for r in page]
        assert [None if r[0] is None else int(r[0]) for r in got] == want
        assert sorted(r[1] for r in got) == list(range(len(ties)))


def test_display(log):
    row = dashboard.display_predictions(log).orderBy("latency_ms").first()
    assert (row["timestamp"], row["queue"], row["decision"]) == ("2024-01-01 00:00 UTC", "Billing & Payments", "Auto Route")


# --- stored tables -----------------------------------------------------------------------


def test_new_tickets(spark):
    rows = [("a", "1"), ("b", "2"), ("a", "3"), (None, "4"), ("", "5"), ("stored", "6"), (None, "7"), ("c", "8")]
    batch = spark.createDataFrame(rows, "external_id string, customer_message string").coalesce(1)
    stored = spark.createDataFrame([("stored",), (None,)], "external_id string")
    got = lambda **o: sorted(r["customer_message"] for r in stores.new_tickets(batch, stored, **o).collect())
    assert got() == ["1", "2", "4", "5", "7", "8"]
    assert got(limit=3) == ["1", "2"]
    assert got(clear_existing=True) == ["1", "2", "4", "5", "6", "7", "8"]
    row = stores.new_tickets(batch, None).first()
    assert row["status"] == "new" and row["tags"] is None


def test_load_is_idempotent(spark, tmp_path):
    batch = spark.createDataFrame([("a", "1"), (None, "2"), ("b", "3")], "external_id string, customer_message string").coalesce(1)
    path = str(tmp_path / "tickets")
    assert writers.load_tickets(batch, path) == 3
    assert writers.load_tickets(batch, path) == 1
    stored = spark.read.parquet(path)
    assert stored.count() == 4 and stored.select("id").distinct().count() == 4
    assert writers.load_tickets(batch, path, clear_existing=True) == 3
    assert spark.read.parquet(path).count() == 3


def test_upsert(spark):
    stamp = datetime(2024, 1, 1)
    stored = spark.createDataFrame(
        [(1, "x", "new", "m", stamp, stamp), (2, "y", "new", "m", stamp, stamp), (3, "z", "new", "m", stamp, stamp)],
        "id int, external_id string, status string, customer_message string, created_at timestamp, updated_at timestamp",
    )
    changes = spark.createDataFrame(
        [
            (1, ["external_id"], None, "ignored", None, False, 1),
            (1, ["status"], "w", "closed", None, False, 3),
            (1, ["status"], "w", "open", None, False, 2),
            (2, [], None, None, None, True, 1),
            (9, ["customer_message"], None, None, "hello", False, 1),
        ],
        "id int, set_fields array<string>, external_id string, status string, customer_message string, delete boolean, seq int",
    ).withColumn("at", F.lit(datetime(2024, 6, 1)))
    rows = {r["id"]: r for r in stores.upsert_tickets(stored, changes).collect()}
    assert sorted(rows) == [1, 3, 9]
    assert (rows[1]["external_id"], rows[1]["status"], rows[1]["updated_at"].month) == (None, "closed", 6)
    assert (rows[3]["status"], rows[3]["updated_at"]) == ("new", stamp)
    assert (rows[9]["status"], rows[9]["customer_message"], rows[9]["created_at"].month) == ("new", "hello", 6)
    log = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id int, ticket_id int")
    assert sorted((r["id"], r["ticket_id"]) for r in stores.detach_deleted(log, changes).select("id", F.coalesce("ticket_id", F.lit(0)).alias("ticket_id")).collect()) == [(1, 0), (2, 1), (3, 0)]


def test_rejected_records_go_aside(spark, log, tmp_path):
    from queuesight.operators.validation import split_valid

    broken = log.withColumn("confidence", F.when(F.col("id") == 2, 2.0).otherwise(F.col("confidence")))
    valid, invalid = split_valid(broken)
    writers.append_predictions(valid, f"{tmp_path}/log", invalid, f"{tmp_path}/bad")
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/log").collect()] == [1]
    assert [r["errors"] for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == [["confidence"]]


# --- files -------------------------------------------------------------------------------


def test_read_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,body\n1,"line ""one""\nline two"\n2,NA\n')
    (tmp_path / "a.tsv").write_text("id\tbody\n1\tx, y\n")
    (tmp_path / "a.jsonl").write_text('{"id": 1, "body": "x"}\n{"id": 2}\n')
    (tmp_path / "list.json").write_text(json.dumps([{"id": 1}, {"id": 2}], indent=2))
    (tmp_path / "one.json").write_text(json.dumps({"id": 1}, indent=2))
    (tmp_path / "scalar.json").write_text('"hello"')
    read = lambda name: [tuple(r) for r in readers.read_tickets(spark, f"{tmp_path}/{name}").collect()]
    assert read("a.csv") == [("1", 'line "one"\nline two'), ("2", None)]
    assert read("a.tsv") == [("1", "x, y")]
    assert sorted(read("a.jsonl"), key=str) == [("x", 1), (None, 2)] or len(read("a.jsonl")) == 2
    assert read("list.json") == [(1,), (2,)] and read("one.json") == [(1,)]
    assert read("scalar.json") == [("hello",)]
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_tickets(spark, f"{tmp_path}/a.xlsx")


def test_malformed_json_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"id": 1}\n{"id": 2}\n{"id": \n{"id": 3}\n')
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id": 2}\nnot json\n')
    (tmp_path / "two.json").write_text('{\n"id": 1\n}\n{\n"id": 2\n}\n')
    for name in ("bad.json", "bad.jsonl", "two.json"):
        with pytest.raises(ValueError, match=name):
            readers.read_tickets(spark, f"{tmp_path}/{name}")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_tickets(spark, f"{tmp_path}/bad.jsonl", schema="id int").collect()
    (tmp_path / "good.jsonl").write_text('{"message": "x", "queue": "a"}\n')
    audit = {r["file_path"].rsplit("/", 1)[-1]: r for r in readers.audit_files(spark, str(tmp_path)).collect()}
    assert all("malformed" in audit[n]["read_error"] and not audit[n]["has_required_training_columns"] for n in ("bad.json", "bad.jsonl", "two.json"))
    assert audit["good.jsonl"]["read_error"] is None


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "tickets")
    batch = spark.createDataFrame([("a", "1"), (None, "2")], "external_id string, customer_message string").coalesce(1)
    assert writers.load_tickets(batch, path) == 2
    broken = batch.withColumn("customer_message", F.when(F.col("external_id") == "a", F.raise_error(F.lit("half-way"))).otherwise("x"))
    with pytest.raises(Exception, match="half-way"):
        writers.load_tickets(broken, path, clear_existing=True)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="half-way"):
        session.replace_table(broken, path)
    assert sorted(r[0] for r in spark.read.parquet(path).select("customer_message").collect()) == ["1", "2"]
    session.replace_table(spark.read.parquet(path).limit(1), path)
    assert spark.read.parquet(path).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["tickets"]


def test_a_change_after_a_delete_starts_afresh(spark):
    stored = spark.createDataFrame([(1, "en", "mail"), (2, "en", "mail"), (3, "en", "mail")], "id int, language string, channel string")
    rows = [
        (1, ["channel"], None, "early", False, 1), (1, [], None, None, True, 2), (1, ["language"], "fr", None, False, 3),
        (2, ["channel"], None, "web", False, 2), (2, [], None, None, True, 2),
        (3, [], None, None, True, 1), (3, ["channel"], None, None, False, 2), (3, [], None, None, True, 3),
        (4, [], None, None, True, 1), (4, ["channel"], None, "new", False, 2),
    ]
    changes = spark.createDataFrame(rows, "id int, set_fields array<string>, language string, channel string, delete boolean, seq int")
    got = sorted(map(tuple, stores.upsert_tickets(stored, changes).collect()))
    assert got == [(1, "fr", None), (4, None, "new")]


def test_audit_and_choice_of_input(spark, tmp_path):
    (tmp_path / "big.csv").write_text("message,queue\n" + "hello,a\n" * 5)
    (tmp_path / "nolabel.csv").write_text("message\n" + "hello\n" * 9)
    (tmp_path / "train.csv").write_text("message,queue\nx,a\n")
    (tmp_path / "synthetic_tickets.csv").write_text("message,queue\n" + "hello,a\n" * 20)
    (tmp_path / "broken.json").write_text('{"a": ')
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "outputs").mkdir()
    (tmp_path / "outputs" / "run.csv").write_text("message,queue\n" + "hello,a\n" * 30)
    names = [r["path"].rsplit("/", 1)[-1] for r in readers.list_dataset_files(spark, str(tmp_path)).collect()]
    assert names == ["big.csv", "broken.json", "nolabel.csv", "run.csv", "synthetic_tickets.csv"]
    audit = {r["file_path"].rsplit("/", 1)[-1]: r for r in readers.audit_files(spark, str(tmp_path)).collect()}
    assert audit["big.csv"]["row_count"] == 5 and audit["big.csv"]["duplicate_customer_message_count"] == 4
    assert audit["run.csv"]["is_smoke_or_generated_output"] and audit["broken.json"]["read_error"]
    assert readers.resolve_input(spark, root=str(tmp_path)).endswith("/big.csv")
    assert readers.resolve_input(spark, explicit="x") == "x"
    assert readers.resolve_input(spark, normalized=f"{tmp_path}/big.csv", root=str(tmp_path)).endswith("big.csv")
    assert readers.resolve_input(spark, normalized=f"{tmp_path}/none.csv", smoke="smoke.csv") == "smoke.csv"
    with pytest.raises(FileNotFoundError):
        readers.resolve_input(spark)
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.resolve_input(spark, root=f"{tmp_path}/empty")


def test_split_files(spark, tmp_path):
    (tmp_path / "train.csv").write_text("a,b\n1,2\n")
    (tmp_path / "val.csv").write_text("a\n3\n")
    df = readers.read_splits(spark, {"train": f"{tmp_path}/train.csv", "val": f"{tmp_path}/val.csv"})
    assert sorted(map(tuple, df.select("a", "b", "split").collect())) == [("1", "2", "train"), ("3", None, "val")]


# --- scoring -----------------------------------------------------------------------------


def make_scorer():
    def make():
        def score(texts):
            if any(t == "fail" for t in texts):
                raise RuntimeError("no")
            return [{"human_resources": 0.7, "customer_general": 0.3} if "hr" in t else {"customer_general": 1.0} for t in texts]

        return score

    return make


def test_scoring_goes_on_after_failures(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(["hr", "x", "fail", "hr"])], "ticket_id string, input_text string")
    scored = scoring.score_external(df, make_scorer(), batch_size=2, partitions=1)
    rows = {r["ticket_id"]: r for r in scored.collect()}
    assert rows["2"]["error"] == "RuntimeError: no" and rows["2"]["probabilities"] is None
    assert rows["3"]["probabilities"] == {"human_resources": 0.7, "customer_general": 0.3} and rows["3"]["latency_ms"] >= 0
    records = {r["ticket_id"]: r for r in scoring.prediction_records(scored).collect()}
    assert (records["0"]["predicted_label"], records["0"]["confidence"], records["0"]["top1_top2_margin"]) == ("human_resources", 0.7, 0.4)
    assert len(records["0"]["probabilities"]) == 7 and records["0"]["probabilities"]["billing_and_payments"] == 0.0
    again = scoring.resume_scoring(df, scored.where("ticket_id <> '1'"), make_scorer())
    assert [r["ticket_id"] for r in again.collect()] == ["1"]


def test_route_scored(spark):
    even = {q: 0.1 for q in K.QUEUES[:-1]}
    rows = [(1, {**even, K.QUEUES[-1]: 0.8}, 1.6), (2, {**even, K.QUEUES[-1]: 0.799999}, -3.0), (3, {"x": 1.0}, None)]
    routed = scoring.route_scored(spark.createDataFrame(rows, "id int, probabilities map<string,double>, latency_ms double"), "m")
    got = {r["id"]: (r["predicted_queue"], r["decision"], r["latency_ms"]) for r in routed.collect()}
    assert got == {1: (K.QUEUES[-1], "auto_route", 2), 2: (K.QUEUES[-1], "human_review", 0), 3: ("x", "auto_route", 0)}


# --- streams -----------------------------------------------------------------------------


def test_ingest_stream_over_several_batches(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [("a", 1), ("a", 2), (None, 3), ("b", 4)], [("b", 5), ("c", 6), ("", 7)]
    schema = "external_id string, k int"
    start = lambda: jobs.ingest_stream(
        jobs.read_stream(spark, source, spark.createDataFrame([], schema).schema, files_per_trigger=1), target, "k", checkpoint=f"{tmp_path}/cp"
    )
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.run_available(start)
    assert sorted(r["k"] for r in spark.read.parquet(target).collect()) == [1, 3, 4, 6, 7]


def test_runs_of_their_own_add_to_one_store(spark, tmp_path):
    schema = spark.createDataFrame([], "external_id string, k int").schema
    target = f"{tmp_path}/out"
    for n, rows in enumerate([[("x1", 1), ("y", 2), (None, 3)], [("x2", 4), ("y", 5), ("", 6)], [("x1", 7), ("x3", 8)]]):
        source = f"{tmp_path}/in{n}"
        spark.createDataFrame(rows, schema).write.parquet(source)
        own = f"{tmp_path}/cp" if n == 2 else None
        jobs.run_available(lambda: jobs.ingest_stream(jobs.read_stream(spark, source, schema), target, "k", checkpoint=own))  # noqa: B023
    assert sorted(r["k"] for r in spark.read.parquet(target).collect()) == [1, 2, 3, 4, 6, 8]


def test_event_time_keeps_rows_without_a_key(spark, tmp_path):
    rows = [(None, 1), (None, 1), ("", 1), ("", 1), ("a", 1), ("a", 1)]
    df = spark.createDataFrame(rows, "external_id string, n int").withColumn("ts", F.lit(datetime(2024, 1, 1)))
    df.write.parquet(f"{tmp_path}/in")
    kept = jobs.ingest_event_time(jobs.read_stream(spark, f"{tmp_path}/in", df.schema), "ts")
    jobs.run_available(lambda: kept.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out", format="parquet"))
    assert sorted((r["external_id"] or "-") for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["-", "-", "-", "-", "a"]


def test_dashboard_stream_equals_batch(spark, log, tmp_path):
    source = f"{tmp_path}/log"
    log.repartition(2).write.parquet(source)
    jobs.run_available(lambda: jobs.dashboard_stream(jobs.read_stream(spark, source, log.schema, files_per_trigger=1), f"{tmp_path}/d", f"{tmp_path}/cp"))
    batch = dashboard.summarize_cells(dashboard.log_cells(log))
    key = lambda df: sorted(map(tuple, df.select("section", "label", "n", F.round("average_confidence", 8)).collect()), key=str)
    assert key(spark.read.parquet(f"{tmp_path}/d")) == key(batch)


def test_route_stream_scores_and_sets_aside(spark, tmp_path):
    """Texts as a stream through a supplied scorer, routing, the record check and two sinks."""
    schema = "id int, subject string, body string, created_at timestamp"
    rows = [(1, "hr", "b", datetime(2024, 1, 1)), (2, "", "b", datetime(2024, 1, 1)), (3, "x", "fail", datetime(2024, 1, 1))]
    source = f"{tmp_path}/in"
    spark.createDataFrame(rows, schema).write.parquet(source)
    shape = spark.createDataFrame([], schema).schema

    def make():
        def score(texts):
            if any("fail" in t for t in texts):
                raise RuntimeError("no")
            return [dict(zip(sorted(K_QUEUES), [0.9, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0])) for _ in texts]

        return score

    K_QUEUES = list(K.QUEUES)
    start = lambda: jobs.route_stream(
        scoring.score_external(
            jobs.read_stream(spark, source, shape).withColumn("input_text", F.concat_ws(" ", "subject", "body")), make
        ).withColumn("probabilities", F.coalesce("probabilities", F.expr("CAST(map() AS MAP<STRING, DOUBLE>)"))),
        f"{tmp_path}/out", f"{tmp_path}/bad", "m", checkpoint=f"{tmp_path}/cp",
    )
    jobs.run_available(start)
    jobs.run_available(start)  # nothing new: nothing is stored twice
    stored = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r["id"], r["predicted_queue"], r["decision"], r["model_id"]) for r in stored] == [(1, "billing_and_payments", "auto_route", "m")]
    aside = {r["id"]: r["errors"] for r in spark.read.parquet(f"{tmp_path}/bad").collect()}
    assert aside[2] == ["subject"] and "probabilities" in aside[3]


@pytest.mark.parametrize("files", [1, 3])
def test_tables_of_one_file_or_many_are_streams(spark, tmp_path, files):
    from queuesight import catalog

    rows = [(i, f"text {i}", "en", f"s{i % 2}", 6) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(files).write.parquet(f"{tmp_path}/written")
    path = tmp_path / "documents.parquet"
    if files == 1:
        next((tmp_path / "written").glob("part-*.parquet")).rename(path)
    else:
        (tmp_path / "written").rename(path)
    stored = catalog.queries()["ingest_stream"](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in stored} == {2, 3, *[i for i in range(40) if i % 10 < 2]}
