import math
import random
import re

import pytest
from pyspark.sql import functions as F

from queuesight import constants as K
from queuesight.functions import labels as lb
from queuesight.functions import numeric as num
from queuesight.functions import text as tx


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def apply(spark, values, expression, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(expression(F.col("v"))).collect()]


TEXTS = [
    None, "", "  ", "\n\ta ", "　x y ", "\x1c a \x1f", "\u0085b", "a  b\n\nc", "Élan vital", "no-strip",
    "refunds were cancelled", "REFUND now", "legal_case", "a legal, case", "élegal", "legalé", "illegal", "legal",
    "charged  twice", "charged twice!", "data breach", "x" * 200,
]


def test_strip_is_pythons(spark):
    assert apply(spark, TEXTS, lambda c: tx.clean_text(c)) == [(t or "").strip() for t in TEXTS]


def test_token_count_is_pythons_split(spark):
    assert apply(spark, TEXTS, tx.token_count) == [len((t or "").split()) for t in TEXTS]


def test_normalize_label(spark):
    got = apply(spark, ["Sales and Pre-Sales", "  ", None, "IT Support ", "a_b"], tx.normalize_label)
    assert got == ["sales_and_pre_sales", None, None, "it_support", "a_b"]


def test_source_label_keeps_case(spark):
    assert apply(spark, [" Billing ", " ", None], tx.source_label) == ["Billing", None, None]


@pytest.mark.parametrize("term", ["legal", "charged twice", "refund", "data breach", "c++", "+1 off"])
def test_whole_words_match_like_python(spark, term):
    rng = random.Random(7)
    parts = [term, term.upper(), " ", "é", "_", "1", "-", ".", "a", "\n", "s"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(300)] + [t for t in TEXTS if t]
    pattern = re.compile(r"\b" + re.escape(term) + r"\b")
    expected = [bool(pattern.search(t.lower())) for t in texts]
    assert apply(spark, texts, lambda c: tx.has_term(F.lower(c), term)) == expected


def test_matched_terms_sorted_and_overlapping(spark):
    got = apply(spark, ["urgent: data breach and legal data"], lambda c: tx.matched_terms(F.lower(c), ["urgent", "legal", "data", "data breach"]))
    assert got == [["data", "data breach", "legal", "urgent"]]
    assert apply(spark, ["nothing"], lambda c: tx.matched_terms(c, K.RISK_TERMS)) == [[]]


def test_substring_count_matches_inside_words(spark):
    got = apply(spark, ["brand order", "and", "reorder account login"], lambda c: tx.substring_count(c, K.MULTI_INTENT_TERMS))
    assert got == [2, 1, 3]


def test_combine_text_leaves_no_gaps(spark):
    df = spark.createDataFrame([(" a ", None, "b"), ("", " ", "c"), (None, None, None)], "x string, y string, z string")
    got = [r[0] for r in df.select(tx.combine_text([F.col("x"), F.col("y"), F.col("z")])).collect()]
    assert got == ["a\n\nb", "c", ""]


def test_subject_body_falls_back_per_row(spark):
    df = spark.createDataFrame([("s", "b", "m"), (None, "b", "m"), (None, " ", "m"), (None, None, None)], "s string, b string, m string")
    got = [r[0] for r in df.select(tx.subject_body_text(F.col("s"), F.col("b"), F.col("m"))).collect()]
    assert got == ["s\n\nb", "b", "m", ""]


def test_tags(spark):
    df = spark.createDataFrame([(" a ", "None", "b"), (None, "nan", "  "), ("x", "x", None)], "t1 string, t2 string, t3 string")
    columns = [F.col("t1"), F.col("t2"), F.col("t3")]
    rows = df.select(tx.tag_text(columns).alias("a"), tx.tag_text(columns, "|").alias("b"), tx.clean_tags(columns).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("a, b", "a|b", ["a", "b"]), ("", "", []), ("x, x", "x|x", ["x", "x"])]


def test_model_text_is_never_empty(spark):
    df = spark.createDataFrame([("", None, ""), ("hi", "Incident", "a, b")], "m string, t string, g string")
    got = [r[0] for r in df.select(tx.model_text(F.col("m"), F.col("t"), F.col("g"))).collect()]
    assert got == ["Type: \nTags:", "hi\n\nType: Incident\nTags: a, b"]


def test_display(spark):
    assert apply(spark, ["a\nb ", "x" * 91, None], tx.preview) == ["a b", "x" * 89 + "...", ""]
    odd = ["Sales and Pre-Sales", "3rd", "don't", "ÉCOLE d'été", "a1b_c", "x"]
    assert apply(spark, odd, lambda c: tx.humanize(c, {})) == [x.replace("_", " ").title() for x in odd]
    times = ["2024-05-01T10:20:30Z", "2024-05-01 10:20", "2024-05-01", "2024-05-01T10:20:30.5+02:00", "soon", "2024-13-01", "", None]
    shown = ["2024-05-01 10:20 UTC", "2024-05-01 10:20 UTC", "2024-05-01 00:00 UTC", "2024-05-01 10:20 UTC", "soon", "2024-13-01", "N/A", "N/A"]
    assert apply(spark, times, lambda c: tx.display_time(c, text=True)) == shown
    got = apply(spark, ["human_resources", "it_support", "", None], lambda c: tx.humanize(c, K.QUEUE_DISPLAY))
    assert got == ["Human Resources", "It Support", "Unknown", "Unknown"]


VALUES = [0.285, 0.12345, 2.5, 1.5, 0.5, 0.03125, -0.285, -2.5, 1e-9, 0.64996, 0.1 + 0.2, 1e300, 0.0, 123456.785]


@pytest.mark.parametrize("digits", [0, 2, 4, 6])
def test_round_is_pythons(spark, digits):
    rng = random.Random(digits)
    values = VALUES + [rng.random() for _ in range(2000)] + [i / 20000 for i in range(2000)] + [i / 128 for i in range(129)]
    got = apply(spark, values, lambda c: num.round_exact(c, digits), "double")
    assert got == [float(round(v, digits)) for v in values]


def test_coerce_double(spark):
    values = ["", "nan", None, "1.2", " 0.5 ", "n/a", "1.5d", "0x1p3", "1e-3", "inf", ".5", "-2."]
    df = column(spark, values)
    got = [r[0] for r in df.select(num.coerce_double(df, "v")).collect()]
    assert got == [0.0, 0.0, 0.0, 1.2, 0.5, 0.0, 0.0, 0.0, 0.001, math.inf, 0.5, -2.0]
    numbers = column(spark, [0.25, float("nan"), None], "double")
    assert [r[0] for r in numbers.select(num.coerce_double(numbers, "v")).collect()] == [0.25, 0.0, 0.0]


def test_softmax(spark):
    got = apply(spark, [[1000.0, 1001.0, 1002.0], [0.0, 0.0]], num.softmax, "array<double>")
    expected = [math.exp(x - 2) for x in (0, 1, 2)]
    assert got[0] == pytest.approx([e / sum(expected) for e in expected])
    assert got[1] == [0.5, 0.5]


def test_binary_confidence(spark):
    df = column(spark, [0.2, 0.5, 0.87654], "double")
    assert [tuple(r) for r in df.select(*num.binary_confidence(F.col("v"))).collect()] == [(0, 0.8), (1, 0.5), (1, 0.8765)]


def test_probabilities(spark):
    df = spark.createDataFrame([({"b": 0.4, "a": 0.4, "c": 0.2},), ({"x": 1.0},), ({},)], "p map<string,double>")
    ranked = lb.ranked_probabilities(F.col("p"))
    rows = df.select(lb.top_probabilities(F.col("p"), 2).alias("t"), lb.top_margin(ranked).alias("m")).collect()
    assert [[tuple(x) for x in r["t"]] for r in rows] == [[("a", 0.4), ("b", 0.4)], [("x", 1.0)], []]
    assert [r["m"] for r in rows] == [0.0, 1.0, 0.0]
    full = df.select(lb.complete_probabilities(F.col("p"), ["a", "z"]).alias("p")).collect()
    assert [r["p"] for r in full] == [{"a": 0.4, "z": 0.0}, {"a": 0.0, "z": 0.0}, {"a": 0.0, "z": 0.0}]


def test_label_map_passes_unknown_through(spark):
    got = apply(spark, ["it_support", "general_inquiry", "human_resources", None], lambda c: lb.map_label(c, K.MERGED_QUEUE_MAP))
    assert got == ["technical_product_support", "customer_general", "human_resources", None]


def test_round_scaled_is_numpys(spark):
    import numpy as np

    values = [0.00005, 0.12345, 0.00015, 2.5, -0.12345] + [i / 20000 for i in range(1000)]
    got = apply(spark, values, lambda c: num.round_scaled(c, 4), "double")
    assert got == [float(np.round(v, 4)) for v in values]


def test_prediction_file_columns(spark):
    df = spark.createDataFrame([({"a": 0.50005, "b": 0.29994, "c": 0.2},), ({"x": 1.0},)], "p map<string,double>")
    rows = [tuple(r) for r in df.select(*lb.ranked_columns(F.col("p"))).collect()]
    first = (round(0.50005, 4), round(0.29994, 4))
    assert rows[0] == ("a", first[0], "b", first[1], "c", 0.2, round(first[0] - first[1], 4))
    assert rows[1] == ("x", 1.0, None, None, None, None, None)
