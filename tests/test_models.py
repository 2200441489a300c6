"""TF-IDF against a plain computation, and the classifiers built on it."""

import math
import random
import re
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from queuesight import session
from queuesight.operators import models
from queuesight.plans import evaluation, training

TEXTS = [
    "Réfund my refund, please!", "login fails; password reset fails", "refund the invoice", "a I to be", "", None,
    "Straße naïve coöperate", "invoice invoice invoice",
]


def plain_terms(text):
    folded = unicodedata.normalize("NFKD", (text or "").lower())
    folded = "".join(c for c in folded if not unicodedata.combining(c))
    words = re.findall(r"\b\w\w+\b", folded)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_tfidf_against_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", models.fold_accents(F.col("t")).alias("folded"))
    fitted = models.fit_features(df, "folded")
    vocabulary = next(s for s in fitted.stages if hasattr(s, "vocabulary")).vocabulary
    rows = fitted.transform(df).select("i", "terms", vector_to_array("features").alias("f")).orderBy("i").collect()
    terms = [plain_terms(t) for t in TEXTS]
    assert [list(r["terms"]) for r in rows] == terms
    assert set(vocabulary) == {t for ts in terms for t in ts}
    df_counts = Counter(t for ts in terms for t in set(ts))
    for row, ts in zip(rows, terms):
        raw = {t: n * (math.log((1 + len(TEXTS)) / (1 + df_counts[t])) + 1) for t, n in Counter(ts).items()}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        got = {vocabulary[i]: w for i, w in enumerate(row["f"]) if w}
        assert got == pytest.approx({t: w / norm for t, w in raw.items()})


def test_vocabulary_keeps_the_most_frequent_terms(spark):
    df = spark.createDataFrame([("aa aa aa bb bb cc",)], "folded string")
    fitted = models.fit_features(df, "folded", vocabulary=2)
    vocabulary = next(s for s in fitted.stages if hasattr(s, "vocabulary")).vocabulary
    assert set(vocabulary) <= {"aa", "bb", "aa aa"} and "aa" in vocabulary


def test_equally_frequent_terms_are_taken_alphabetically(spark):
    rows = [(f"w{i % 30:02d} x{i % 30:02d}",) for i in range(60)]
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "folded string").repartition(parts)
        fitted = models.fit_features(df, "folded", vocabulary=7)
        vocabulary = next(s for s in fitted.stages if hasattr(s, "vocabulary")).vocabulary
        assert vocabulary == ["w00", "w00 x00", "w01", "w01 x01", "w02", "w02 x02", "w03"]
    with pytest.raises(ValueError, match="no terms"):
        models.fit_features(spark.createDataFrame([("a",)], "folded string"), "folded")


@pytest.fixture(scope="module")
def tickets(spark):
    words = {"billing": "invoice charge refund", "access": "login password locked", "shipping": "parcel courier late"}
    rows = []
    for i in range(90):
        label = list(words)[i % 3 if i % 5 else 0]
        text = " ".join(words[label].split()[j % 3] for j in range(i, i + 4)) + f" ticket {i % 7}"
        rows.append((str(i), text, label, "high" if i % 2 else "low"))
    return spark.createDataFrame(rows, "ticket_id string, customer_message string, category string, priority string")


@pytest.fixture(scope="module")
def category(tickets):
    return models.train_classifier(tickets, max_iterations=30)


@pytest.fixture(scope="module")
def priority(tickets):
    return models.train_classifier(tickets, label="priority", max_iterations=10)


def test_classifier_learns_and_scores(spark, tickets, category):
    scored = category.score(tickets, "customer_message", "category")
    rows = scored.collect()
    assert all(r["predicted_category"] == r["category"] for r in rows)
    for row in rows[:10]:
        spread = row["category_distribution"]
        assert set(spread) == {"billing", "access", "shipping"} and sum(spread.values()) == pytest.approx(1, abs=2e-4)
        assert row["category_confidence"] == max(spread.values()) == round(row["category_confidence"], 4)
    assert category.metadata["rows"] == 90 and category.labels == ["access", "billing", "shipping"]


def test_binary_model_and_storage(spark, tickets, priority, tmp_path):
    assert len(priority.models) == 1
    priority.save(str(tmp_path / "m"))
    loaded = models.TextClassifier.load(spark, str(tmp_path / "m"))
    key = lambda m: m.score(tickets, "customer_message", "priority").orderBy("ticket_id").collect()
    assert key(loaded) == key(priority) and loaded.metadata == priority.metadata


def test_top_features(spark, category, priority):
    rows = models.top_features(category, spark, 3).where("class = 'billing'").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3]
    assert {r["feature"] for r in rows} & {"invoice", "charge", "refund"}
    assert rows[0]["weight"] >= rows[1]["weight"] >= rows[2]["weight"]
    sides = {r["class"] for r in models.top_features(priority, spark, 2).collect()}
    assert sides == {"high", "low"}


def test_split_train_and_describe(spark, tickets, tmp_path):
    path = str(tmp_path / "splits")
    report = training.write_splits(tickets.withColumn("priority", F.lit("p")), path, "tickets")
    rows = {r["split"]: r["n"] for r in report.where("field = 'rows'").collect()}
    assert rows == {"train": 63, "val": 13, "test": 14}
    assert report.first()["split_strategy"] == "category_stratified"
    train = training.read_split(spark, path, "train")
    found = training.train_models(train, max_iterations=5)
    assert list(found) == ["category"]  # one priority only
    row = training.model_table(spark, found).first()
    assert (row["target"], row["train_rows"], row["labels"]) == ("category", 63, ["access", "billing", "shipping"])
    with pytest.raises(ValueError, match="two values"):
        training.train_models(train, ["priority"])


def test_training_needs_two_labels_and_no_answers(spark, tickets):
    with pytest.raises(ValueError, match="two labels"):
        models.train_classifier(tickets.where("category = 'billing'"))
    with pytest.raises(ValueError, match="answer"):
        models.train_classifier(tickets.withColumnRenamed("customer_message", "answer"), text="answer")


def test_evaluate_and_triage(tickets, category, priority):
    frames = evaluation.evaluate_models(tickets, category, priority)
    assert frames["category_metrics"].first()["accuracy"] == 1.0
    assert frames["category_confusion"].count() == 9
    wrong = frames["priority_metrics"].first()
    assert frames["errors"].count() == wrong["n"] - wrong["n_correct"]
    assert {"category_confidence", "priority_correct"} <= set(frames["errors"].columns)
    scored = evaluation.predict_frame(tickets, category, priority)
    assert {"escalation_risk", "policy_sensitive", "predicted_priority"} <= set(scored.columns) and "_folded" not in scored.columns
    row = evaluation.triage(tickets, category, priority, metadata={"dataset_source": "set"}).first()
    assert row["category"]["raw_model_prediction"] == row["category"]["prediction"]
    assert row["routing"]["decision"] and row["model_metadata"]["dataset_source"] == "set"
    assert 0.1 <= row["risk"]["escalation_risk"] <= 0.99


def test_pairs_of_rarer_words_are_not_sent_and_terms_are_counted_with_their_texts(spark, monkeypatch):
    texts = ["aa bb aa bb cc", "bb aa zz yy", "", "cc", "aa bb", "yy zz yy", "zz\U00010428 aa", "aa"] * 3 + ["qq"]
    df = spark.createDataFrame([(t,) for t in texts], "folded string").repartition(3)
    worded = models.tokenizing_stages("folded")[0].transform(df).select("words")
    found = [plain_terms(t) for t in texts]
    n, held = Counter(t for ts in found for t in ts), Counter(t for ts in found for t in set(ts))
    best = sorted(n, key=lambda t: (-n[t], t))
    for most in (200_000, 1):  # with the second bound all pairs are counted
        monkeypatch.setattr(models, "BROADCAST_ROWS", most)
        for size in (1, 3, 5, 100):
            rows = models.frequent_terms(worded, size).collect()
            assert [tuple(r) for r in rows] == [(t, n[t], held[t]) for t in best[:size]]
    pairs = {tuple(r) for r in models.term_counts(worded, True, ["aa", "bb"]).collect()}
    assert pairs == {(t, n[t], held[t]) for t in ("aa bb", "bb aa")}
    assert models.term_counts(worded.where("size(words) = 0"), True).count() == 0


def test_texts_scored_by_two_models_are_split_once(spark):
    rows = [(i, "refund invoice" if i % 2 else "login password", "ab"[i % 2], "xy"[i % 2]) for i in range(12)]
    df = spark.createDataFrame(rows, "i int, message string, category string, priority string")
    category, priority = (models.train_classifier(df, "message", c, max_iterations=20) for c in ("category", "priority"))
    shared = evaluation.predict_frame(df, category, priority, "message")
    assert shared._jdf.queryExecution().optimizedPlan().toString().count("concat(UDF(") == 1
    alone = category.score(df, "message", "category", None).join(priority.score(df, "message", "priority", None).select("i", "predicted_priority", "priority_confidence"), "i")
    columns = ["i", "predicted_category", "category_confidence", "predicted_priority", "priority_confidence"]
    assert sorted(shared.select(*columns).collect()) == sorted(alone.select(*columns).collect())


def awkward_texts():
    rng = random.Random(5)
    mixed = ["".join(rng.choice("ab Z_9.é€ßﬁ²語\U00010428\u0301\n") for _ in range(rng.randint(0, 15))) for _ in range(400)]
    return [None, "", "a", "ab", "b", "—aa—", "_", "__", "日本 語", "a\u0301b", "Ａ①Ⅳ", "\x00ab", *mixed, "a", "ab", None]


def test_words_and_folds_of_many_texts_are_those_of_each(monkeypatch):
    texts = awkward_texts()
    for step in (1, 64, 1 << 20):
        monkeypatch.setattr(models, "STEP", step)
        for rows in (pa.array(texts), pa.array(texts).slice(3, 50), pa.array([], pa.string()), pa.array([None, None], pa.string())):
            plain = [unicodedata.normalize("NFKD", t or "") for t in rows.to_pylist()]
            plain = ["".join(c for c in t if not unicodedata.combining(c)) for t in plain]
            folded = pa.concat_arrays([models._without_accents(part).fill_null("") for part in models._slices(rows, step)])
            assert folded.to_pylist() == plain
            names, codes, sizes = models._coded(rows)
            found = [re.findall(r"\w{2,}", t or "") for t in rows.to_pylist()]
            assert sizes.tolist() == [len(x) for x in found]
            assert names.take(pa.array(codes)).to_pylist() == [w for x in found for w in x]


def test_features_are_those_of_the_stages_without_arrays_of_terms(spark):
    texts = [*TEXTS, *awkward_texts()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", models.fold_accents(F.col("t")).alias("folded")).repartition(3)
    for size in (4, 5_000):
        fitted = models.fit_features(df, "folded", size)
        applied = fitted.transform(df)
        staged = PipelineModel(stages=fitted.stages).transform(df).select("i", F.size("terms").alias("n_terms"), "features")
        assert sorted(applied.select("i", "n_terms", "features").collect()) == sorted(staged.collect())
    plan = applied.select("n_terms", "features")._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(" not in plan and "weighed(" in plan


def test_texts_are_folded_and_weighed_in_one_step(spark):
    """Each Python step of a task has workers and batches of its own."""
    df = spark.createDataFrame([(i, f"Éa bb{i % 7}") for i in range(40)], "i int, t string")
    folded = df.select("i", models.fold_accents(F.col("t")).alias("folded"))
    applied = models.fit_features(folded, "folded").transform(folded).select("i", "n_terms", "features")
    plan = applied._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "weighed(fold(" in plan
    assert [r["n_terms"] for r in applied.collect()] == [3] * 40


def test_texts_are_split_once_by_a_fit(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for t in ["aa bb aa", "bb cc aa", None, "aa"] * 5], "folded string").repartition(2)
    calls, coded = [], models.coded_words
    monkeypatch.setattr(models, "coded_words", lambda worded: calls.append(worded.columns) or coded(worded))
    fitted = models.fit_features(df, "folded", 3)
    assert calls == [["words"]]
    assert next(s for s in fitted.stages if hasattr(s, "vocabulary")).vocabulary == ["aa", "bb", "aa bb"]


def test_stored_words_are_few_blocks_to_a_file(spark, monkeypatch):
    """A file is read, and its writer holds it, as a whole: it must not grow with the rows of a task."""
    texts = [f"aa bb{i % 7} cc{i % 11}" for i in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "words string").coalesce(1)
    paths, fresh = [], models.fresh_path
    monkeypatch.setattr(models, "fresh_path", lambda spark, name: paths.append(fresh(spark, name)) or paths[-1])
    monkeypatch.setattr(models, "BLOCK", 100)
    rows = models.frequent_terms(df, 30).collect()
    n = Counter(t for text in texts for t in plain_terms(text))
    assert [(r["term"], r["n"]) for r in rows] == sorted(n.items(), key=lambda x: (-x[1], x[0]))[:30]
    stored = next(p for p in paths if "word-codes" in p)
    blocks = spark.read.parquet(stored).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in blocks) > 40 and max(r["count"] for r in blocks) <= session.BLOCKS_A_FILE


def test_evaluation_makes_no_arrays_of_terms(tickets, category, priority):
    frames = evaluation.evaluate_models(tickets, category, priority)
    for name in ("category_metrics", "priority_metrics", "errors"):
        plan = frames[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "concat(UDF(" not in plan and "weighed(" in plan and "_folded" not in frames[name].columns, name
