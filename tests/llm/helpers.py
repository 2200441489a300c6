import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, as extra columns of the input.
CLASHING = ["th", "words", "fp", "component", "key", "score", "n", "s", "e", "p0", "a", "b", "_text", "hash", "file", "chunk"]

WORDS = "the of and to in is it that for with was are erst onble thhe reou inan lyer tion sted heon wh nd es".split()


def prose(rng, n):
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "", "an", "er", "st"])
        out.append(w + ("." if rng.random() < 0.15 else "," if rng.random() < 0.05 else ""))
    return " ".join(out)


def documents(spark, rows):
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING if c not in df.columns])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def awkward(rng=None):
    """Null, empty, blank, very long, repeated and odd texts; null and repeated ids."""
    rng = rng or random.Random(7)
    long = prose(rng, 6_000)
    same = prose(rng, 80)
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, long), (5, same), (6, same), (6, same), (7, prose(rng, 60)), (7, prose(rng, 70)),
        (None, same), (None, prose(rng, 40)), (8, "x"), (9, "é" * 500), (10, "1 2 3 !!! ..."), (11, "\u0000 a\u0000b ퟿ \U0001f600 end"), (12, long[: len(long) // 2]),
    ]


raises = pytest.raises
