import math
import random

import numpy as np
import pandas as pd
from helpers import CLASHING, DOCS, awkward, documents, rows_of

from queuesight.llm.common import held_out, learnable
from queuesight.llm.language_id import BackoffModel, Predictor, identify_languages, learn_languages, words_of

STEMS = {"xx": ["ka", "ro", "mi", "to"], "yy": ["zel", "ünd", "gra", "öst"], "zz": ["ción", "ado", "llu", "ez"]}


def corpus(n=240):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        text = " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))
        rows.append((i, text.title(), lang, "s", len(text)))
    return rows


def test_held_out_documents_are_recognised(spark):
    rows = corpus() + [(1000, None, "xx", "s", 0), (1001, "12 34 !", "yy", "s", 0), (None, "zelünd", "xx", "s", 0), (1002, "zelünd", None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", *[f"1 AS `{c}`" for c in CLASHING if c != "score"])
    got = identify_languages(df, learn_languages(df)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == lang for i, _, lang, _, _ in rows[:240])
    assert all(0 <= r.score <= 1 for r in got)
    assert (by_id[1000].lang_pred, by_id[1000].score, by_id[1001].lang_pred) == ("und", 0.0, "und")
    assert by_id[None].lang_pred == "yy" == by_id[1002].lang_pred


def test_labels_of_held_out_rows_teach_nothing(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    changed = df.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 'xx' ELSE lang END AS lang", "source", "n_chars")
    a, b = learn_languages(df), learn_languages(changed)
    assert a.languages == b.languages and a.words[0].keys() == b.words[0].keys()
    assert all((a.word_scores(w) == b.word_scores(w)).all() for w in [*a.words[0], "unseen"])


def test_word_first_then_shorter_grams():
    model = BackoffModel([("a", "ab", 3), ("a", "cd", 1), ("b", "cd", 3), ("b", "xy", 1)])
    assert model.word_scores("ab")[0] == math.log(3 / 3)  # known: its frequency among known words of a
    padded = model.word_scores("cdq")  # no known 4-gram but " cdq" -> backs off
    assert padded[1] > padded[0]
    assert (model.word_scores("ß") == 0).all()  # nothing known: no evidence


def test_predictor_is_the_plain_sum_in_any_room():
    rng = random.Random(8)
    counts = [(lang, "".join(rng.choice(s) for _ in range(2)), rng.randint(1, 9)) for lang, s in STEMS.items() for _ in range(30)]
    model = BackoffModel(counts)
    for text in [r[1] for r in corpus(30)] + [t for _, t in awkward() if t]:
        words = words_of(text)
        for room in (3, 50, 10_000):
            got = Predictor(model, room).predict(text)
            if not words:
                assert got == ("und", 0.0)
                continue
            total = sum(model.word_scores(w) for w in words)
            assert got[0] == model.languages[int(total.argmax())]


def test_words_are_letters_only():
    assert words_of("Ab3c d²e _F_ ½ ³ Straße") == ["ab", "c", "d", "e", "f", "straße"]


def test_nothing_learned(spark):
    df = documents(spark, awkward()).withColumn("lang", df_null())
    got = identify_languages(df, learn_languages(df))
    assert {(r.lang_pred, r.score) for r in got.collect()} == {("und", 0.0)} and got.count() == len(awkward())
    empty = spark.createDataFrame([], DOCS)
    assert rows_of(identify_languages(empty, learn_languages(empty))) == []


def df_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def test_split_is_crc32(spark):
    import zlib

    from pyspark.sql import functions as F

    df = spark.createDataFrame(pd.DataFrame({"i": range(300)}))
    got = df.select("i", held_out(F.col("i")).alias("h"), learnable(F.col("i")).alias("l")).collect()
    assert all(r.h == (zlib.crc32(str(r.i).encode()) % 3 == 1) and r.l != r.h for r in got)


def test_words_met_once_teach_their_grams(spark):
    once = ["wuxoq woxuq quxow", "xoquw xuwoq qoxuw", "wuqox oxuqwo uqoxw"]  # no word twice
    few = [(1000 + i, once[i % 3] if i < 3 else "quwox xowuq", "qq", "s", 1) for i in range(3)]
    ids = [i for i in range(2000, 2060) if __import__("zlib").crc32(str(i).encode()) % 3 != 1][:3]
    few = [(i, *r[1:]) for i, r in zip(ids, few, strict=True)]
    df = spark.createDataFrame(corpus() + few + [(3000, "xowuq quwox", None, "s", 1)], DOCS)
    model = learn_languages(df)
    got = {r.doc_id: r.lang_pred for r in identify_languages(df, model).collect()}
    assert "qq" in model.languages and got[3000] == "qq" and all(got[i] == "qq" for i in ids)
    assert all(got[i] == lang for i, _, lang, _, _ in corpus())  # the small language takes no others
    alone = spark.createDataFrame(few, DOCS)
    assert {r.lang_pred for r in identify_languages(alone, learn_languages(alone)).collect()} == {"qq"}


def test_tables_are_those_of_all_counts(spark):
    rows = [r for r in corpus(60) if __import__("zlib").crc32(str(r[0]).encode()) % 3 != 1]
    counts = {}
    for _, text, lang, _, _ in rows:
        for w in words_of(text):
            counts[lang, w] = counts.get((lang, w), 0) + 1
    want = BackoffModel([(*k, n) for k, n in counts.items()], max_words=20, max_grams=15)
    got = learn_languages(spark.createDataFrame(rows, DOCS), max_words=20, max_grams=15)
    assert got.languages == want.languages
    for (a, x), (b, y) in zip([got.words, *got.grams], [want.words, *want.grams], strict=True):
        assert a.keys() == b.keys() and all(np.allclose(x[a[k]], y[b[k]]) for k in a)
