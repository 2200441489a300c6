"""Column roles, curation, splits, samples and validation."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from queuesight.operators import columns, curate, profile, splits, validation
from queuesight.plans import curation

EXPORT = (
    "subject string, body string, answer string, type string, queue string, priority string, language string, "
    "version string, tag_1 string, tag_2 string, tag_3 string"
)
ROWS = [
    ("Login", "cannot access\n\"my\" account", "done", "Incident", "IT Support", "high", "EN", "51", "Security", None, "None"),
    (None, "no subject here", "ok", " Request ", "Sales and Pre-Sales", "low", "en", "51", " a ", "nan", "b"),
    ("Blank", "  ", "x", "Incident", "IT Support", "low", "en", "51", None, None, None),
    ("Missing", None, "x", "Incident", "IT Support", "low", "en", "51", None, None, None),
    ("Hallo", "deutsch", "x", "Incident", "IT Support", "low", "de", "51", None, None, None),
    ("Unknown", "no language", "x", "Incident", "IT Support", "low", None, "51", None, None, None),
    ("Login", "cannot access\n\"my\" account", "later", "Problem", "Other", "medium", "en", "52", "x", None, None),
]


@pytest.fixture(scope="module")
def export(spark):
    return spark.createDataFrame(ROWS, EXPORT).coalesce(1)


def test_curated_schema_and_rows(spark, export):
    curated = curation.curate_tickets(export, "set", validate=True)
    assert curated.columns == [
        "external_id", "subject", "body", "answer", "type", "queue", "priority", "language", "version",
        *[f"tag_{i}" for i in range(1, 9)], "combined_tags", "customer_message", "model_text", "true_category", "true_priority",
        "status", "channel", "source", "ticket_type", "reference_answer", "tags",
    ]
    rows = {r["external_id"]: r for r in curated.collect()}
    assert sorted(rows) == ["source-000001", "source-000002"]
    first, second = rows["source-000001"], rows["source-000002"]
    assert first["customer_message"] == 'Login\n\ncannot access\n"my" account'
    assert (first["priority"], first["answer"], first["version"]) == ("high", "done", "51")
    assert first["model_text"] == first["customer_message"] + "\n\nType: Incident\nTags: Security"
    assert second["customer_message"] == "no subject here"
    assert (second["type"], second["combined_tags"], second["subject"]) == ("Request", "a, b", "")
    assert (first["status"], first["channel"], first["source"]) == ("new", "dataset", "set")


def test_curation_report(export):
    row = curation.curation_report(export).first()
    assert tuple(row) == (5, 2, 1, 2)


def test_export_without_language_or_priority(spark):
    df = spark.createDataFrame([("7", "hi", "Q")], "id string, text string, queue string")
    row = curation.curate_tickets(df).first()
    assert (row["external_id"], row["language"], row["priority"], row["customer_message"]) == ("7", "en", None, "hi")


def test_message_column_that_is_also_the_body_is_not_doubled(spark):
    df = spark.createDataFrame([("S", "hello", "Q")], "title string, message string, queue string")
    assert curation.curate_tickets(df).first()["customer_message"] == "S\n\nhello"


def test_separate_message_column_comes_first(spark):
    df = spark.createDataFrame([("m", "s", "b", "Q")], "message string, subject string, body string, queue string")
    assert curation.curate_tickets(df).first()["customer_message"] == "m\n\ns\n\nb"


def test_curation_errors(spark):
    with pytest.raises(ValueError, match="category nor a priority"):
        curation.curate_tickets(spark.createDataFrame([("a",)], "text string"))
    with pytest.raises(ValueError, match="text columns"):
        curation.curate_tickets(spark.createDataFrame([("a",)], "queue string"))
    only_german = spark.createDataFrame([("a", "Q", "de")], "text string, queue string, language string")
    with pytest.raises(ValueError, match="no rows are left"):
        curation.curate_tickets(only_german, validate=True)


def test_roles():
    assert columns.find_column(["Body", "SUBJECT", "subject"], ["subject"]) == "subject"
    assert columns.resolve_columns(["Text", "queue", "Severity", "LOCALE"]) == {
        "text": "Text", "category": "queue", "priority": "Severity", "language": "LOCALE",
    }


def test_names_that_differ_by_case_keep_the_last(spark):
    df = columns.distinct_names(spark.createDataFrame([("a", "b")], "x string, y string").toDF("Queue", "queue"))
    assert df.columns == ["Queue__0", "queue"]


def test_canonical_traps(spark):
    df = spark.createDataFrame(
        [("hello", "Old Queue", "New Queue", "High", "e1"), (None, "a", "b", None, "e2"), ("  ", "a", "b", "low", "e3"), ("x", "c", None, None, "e4"), ("y", "c", "d", " ", "e5")],
        "text string, category string, true_category string, urgency string, external_id string",
    )
    rows = {r["ticket_id"]: r for r in columns.canonicalize_tickets(df).collect()}
    assert sorted(rows) == ["e1", "e5"]
    assert (rows["e1"]["category"], rows["e1"]["true_category"]) == ("new_queue", "new_queue")
    assert (rows["e1"]["priority"], rows["e5"]["priority"], rows["e5"]["true_priority"]) == ("high", "unknown", "unknown")


def test_canonical_without_priority_and_ids(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("  ", "y"), ("c", "z")], "message string, label string").coalesce(1)
    rows = columns.canonicalize_tickets(df).orderBy("ticket_id").collect()
    # Numbered after the category filter and before the text filter.
    assert [(r["ticket_id"], r["customer_message"], r["priority"]) for r in rows] == [
        ("ticket-000000", "a", "unknown"), ("ticket-000002", "c", "unknown"),
    ]


def test_canonical_needs_text_and_category(spark):
    with pytest.raises(ValueError):
        columns.canonicalize_tickets(spark.createDataFrame([("a",)], "text string"))


def test_task_examples(spark):
    df = spark.createDataFrame(
        [("s", "b", "IT Support", " "), (None, None, "IT Support", None), ("s", None, "Billing", None)],
        "subject string, body string, true_category string, category string",
    )
    got = columns.task_examples(df, "parent_queue", {"it_support": "technical_product_support"}).collect()
    assert [(r["input_text"], r["original_label_text"], r["label_text"]) for r in got] == [
        ("s\n\nb", "it_support", "technical_product_support"), ("s", "billing", "billing"),
    ]
    with pytest.raises(ValueError, match="no label column"):
        columns.select_label(df, "ticket_type")


def test_training_input_is_chosen_for_the_frame(spark):
    schema = "subject string, body string, model_text string, customer_message string"
    mixed = spark.createDataFrame([("s", "b", "m", "c"), (None, " ", "m", "c")], schema)
    text, name = columns.select_input(mixed)
    assert name == "subject + body" and [r[0] for r in mixed.select(text).collect()] == ["s\n\nb", ""]
    assert [r[0] for r in mixed.select(columns.input_text(mixed)).collect()] == ["s\n\nb", "c"]
    empty = spark.createDataFrame([(None, " ", "", "c")], schema)
    assert columns.select_input(empty)[1] == "customer_message"
    with pytest.raises(ValueError, match="input text"):
        columns.select_input(empty.select("subject", "body"))


def test_answers_stay_out():
    columns.require_no_leak(["customer_message"])
    with pytest.raises(ValueError, match="answer"):
        columns.require_no_leak(["Answer", "body"])


def test_language_check(spark):
    df = spark.createDataFrame([("en",), ("EN",), ("fr",)], "language string")
    with pytest.raises(ValueError, match="fr"):
        validation.require_language(df)
    validation.require_language(curate.language_filter(df))


def test_profile(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", "q", None), (None, "q", "x")], "customer_message string, true_category string, language string")
    row = profile.profile_dataset(df).first()
    assert (row["row_count"], row["missing_true_category"], row["missing_language"], row["missing_tags"]) == (3, 1, 1, None)
    assert (row["duplicate_customer_message_count"], row["has_required_training_columns"]) == (1, True)
    shares = {(r["field"], r["value"]): r["n"] for r in profile.distributions(df).collect()}
    assert shares == {("category", "q"): 2, ("category", "<missing>"): 1, ("language", "x"): 2, ("language", "<missing>"): 1}


def test_value_counts_and_missing(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("a", None), (None, 1)], "x string, y int")
    assert [tuple(r) for r in profile.value_counts(df, "x").collect()] == [("a", 2), ("b", 1), (None, 1)]
    assert [tuple(r) for r in profile.missing_report(df).collect()] == [("y", 2, 0.5), ("x", 1, 0.25)]
    assert [tuple(r) for r in profile.value_counts_multi(df, ["x", "y"]).collect()] == [("a", 1, 1)]


def test_select_largest(spark):
    rows = [("b", 5, True, False, None), ("a", 5, True, False, None), ("c", 9, True, True, None), ("d", 9, False, False, None), ("e", 9, True, False, "bad")]
    schema = "file_path string, row_count long, has_required_training_columns boolean, is_smoke_or_generated_output boolean, read_error string"
    assert profile.select_largest(spark.createDataFrame(rows, schema)).first()["file_path"] == "a"


# --- splits ---------------------------------------------------------------------------


def tickets(spark, sizes, partitions=4):
    rows = [(f"{label}-{i}", label, "p") for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "ticket_id string, category string, priority string").repartition(partitions)


def test_published_split_sizes(spark):
    queues = {"technical": 14124, "general": 3913, "billing": 2420, "returns": 1173, "sales": 723, "outage": 937, "hr": 457}
    assert sum(queues.values()) == 23747
    parted, strategy = splits.fixed_splits(tickets(spark, queues))
    sizes = {r["split"]: r["count"] for r in parted.groupBy("split").count().collect()}
    assert sizes == {"train": 16622, "val": 3562, "test": 3563}
    assert strategy == "category_stratified"
    parts = {(r["split"], r["category"]): r["count"] for r in parted.groupBy("split", "category").count().collect()}
    for queue, n in queues.items():
        assert abs(parts[("train", queue)] - 0.7 * n) <= 1
        assert abs(parts[("test", queue)] - 0.15 * n) <= 1.5


def test_split_does_not_depend_on_partitions(spark):
    sizes = {"a": 70, "b": 31, "c": 9}
    one, eight = (
        {r["ticket_id"]: r["split"] for r in splits.fixed_splits(tickets(spark, sizes, p))[0].collect()} for p in (1, 8)
    )
    assert one == eight and len(one) == 110


def test_split_strategies(spark):
    assert splits.fixed_splits(tickets(spark, {"a": 30, "b": 1}))[1] == "random_no_stratification"
    # Class b has one row in the rest, too few for the second cut.
    parted, strategy = splits.fixed_splits(tickets(spark, {"a": 40, "b": 4}))
    assert strategy == "category_stratified_train_temp_random_val_test"
    assert Counter(r["split"] for r in parted.collect()) == {"train": 30, "val": 7, "test": 7}
    with pytest.raises(ValueError):
        splits.fixed_splits(tickets(spark, {"a": 4}), 0.5, 0.3, 0.3)


def test_can_stratify(spark):
    assert splits.can_stratify(tickets(spark, {"a": 10, "b": 4}), "category", 0.3)
    assert not splits.can_stratify(tickets(spark, {"a": 10, "b": 3}), "category", 0.3)
    assert not splits.can_stratify(tickets(spark, {"a": 10, "b": 1}), "category", 1.0)


def test_smoke_split(spark):
    sizes = {c: 10 for c in ("billing", "technical", "access", "shipping", "cancel", "compliance")}
    parted = splits.one_cut(tickets(spark, sizes))
    assert Counter(r["split"] for r in parted.collect()) == {"test": 15, "train": 45}


def test_splits_do_not_leak(spark):
    parted, _ = splits.fixed_splits(tickets(spark, {"a": 50, "b": 50}))
    row = curate.split_leak_check(parted, ["ticket_id"]).first()
    assert (row["values"], row["leaking_values"]) == (100, 0)
    leaking = parted.withColumn("text", F.lit("same"))
    assert curate.split_leak_check(leaking, ["text"]).first()["leaking_values"] == 1


def test_stratified_sample(spark):
    df = tickets(spark, {"a": 60, "b": 30, "c": 10}).withColumnRenamed("category", "label_text")
    got = Counter(r["label_text"] for r in splits.stratified_sample(df, 20).collect())
    assert got == {"a": 12, "b": 6, "c": 2}
    assert splits.stratified_sample(df, 100).count() == 100
    assert splits.stratified_sample(df, None).count() == 100
    assert splits.stratified_sample(df, 2).count() == 2  # more classes than rows
    assert splits.stratified_sample(df, 99).count() == 99  # too few left over
    assert splits.evaluation_sample_size(1001) == 251 and splits.evaluation_sample_size(8) == 100


def test_class_weights(spark):
    df = tickets(spark, {"a": 6, "b": 2})
    assert {r["label"]: r["weight"] for r in splits.class_weights(df, "category").collect()} == {"a": 8 / 12, "b": 2.0}
    extra = spark.createDataFrame([("a",), ("b",), ("z",)], "label string")
    got = {r["label"]: r["weight"] for r in splits.class_weights(df, "category", "sqrt_balanced", extra).collect()}
    assert got == {"a": pytest.approx(math.sqrt(8 / 18)), "b": pytest.approx(math.sqrt(8 / 6)), "z": 1.0}
    assert {r["weight"] for r in splits.class_weights(df, "category", "none").collect()} == {1.0}


def test_encoding(spark):
    train, other = tickets(spark, {"b": 2, "a": 2}), tickets(spark, {"a": 1, "z": 1})
    assert {r["label"]: r["label_id"] for r in splits.label_vocabulary(train, "category").collect()} == {"a": 0, "b": 1}
    with pytest.raises(ValueError, match="val has labels.*z"):
        splits.encode_labels(train, other, "category", "val")
    assert [r["label_id"] for r in splits.encode_labels(train, other.where("category = 'a'"), "category").collect()] == [0]


def test_probability_contract(spark):
    from queuesight import constants as K

    even = {q: 1 / 7 for q in K.QUEUES}
    rows = [
        (1, "human_resources", "auto_route", 0.5, 0.8, even, 3, "s", "b"),
        (2, "other", "auto_route", 0.5, 0.8, even, 3, "s", "b"),
        (3, "human_resources", "later", 1.5, 0.8, {"human_resources": 1.0}, -1, "", "b"),
        (4, "human_resources", "auto_route", 0.5, -0.1, {**even, "x": 0.0}, 0, "s", ""),
        (5, "human_resources", "auto_route", None, 0.8, {**even, "human_resources": 1.2}, 0, "s", None),
    ]
    schema = "id int, predicted_queue string, decision string, confidence double, threshold double, probabilities map<string,double>, latency_ms int, subject string, body string"
    df = spark.createDataFrame(rows, schema)
    got = {r["id"]: r["errors"] for r in validation.check_predictions(df).collect()}
    assert got == {
        1: [], 2: ["predicted_queue"], 3: ["decision", "confidence", "probabilities", "latency_ms", "subject"],
        4: ["threshold", "probabilities", "body"], 5: ["confidence", "probabilities", "body"],
    }
    valid, invalid = validation.split_valid(df)
    assert (valid.count(), invalid.count()) == (1, 4)


@pytest.mark.parametrize("language", ["en", "ko", "english"])
def test_language_ignores_case(spark, language):
    spellings = [language, language.upper(), language.title(), f" {language}", "xx", None, "\u212ao"]
    df = spark.createDataFrame([(s,) for s in spellings], "locale string")
    expected = [s for s in spellings if s is not None and s.lower() == language]
    assert sorted(r[0] for r in curate.language_filter(df, language).collect()) == sorted(expected)


def test_language_filter_reaches_the_reader(spark, tmp_path, capsys):
    spark.createDataFrame([("a", "en")], "text string, lang string").write.parquet(f"{tmp_path}/t")
    curate.language_filter(spark.read.parquet(f"{tmp_path}/t")).explain()
    assert "PushedFilters: [In(lang" in capsys.readouterr().out
