import hashlib
import math
import random
import re
import zlib

import pytest
from helpers import DOCS, awkward, clashing, documents, prose, rows_of
from pyspark.sql import functions as F

from queuesight.llm.importance import bracket, resample
from queuesight.llm.ranking import numbered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(rows, target, percent, least, buckets=10_000, longest=1, seed=2024):
    def features(text):
        w = words(text)
        runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for b in features(text):
                counts[b] += 1
    alls, allt = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (alls + buckets) / ((s[b] + 1) * (allt + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in rows:
        f = features(text)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): n + 1 for n, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r, rank.get(id(r))) for r in out), key=repr)


def check(spark, rows, target, percent=30, least=20, **options):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample(clashing(documents(spark, rows)), clashing(items), percent=percent, least_words=least, **options)
    got = rows_of(got.select("doc_id", "n_words", "n_features", "weight", "score", "rank"))
    want = plain(rows, target, percent, least, options.get("buckets", 10_000), options.get("longest", 1))
    assert got == want


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = awkward(rng) + [(100 + i, prose(rng, rng.randint(0, 60))) for i in range(120)]
    target = [prose(rng, 30), None, "", "Ünïcode é", rows[-1][1]]
    check(spark, rows, target)
    check(spark, rows, target, percent=100, least=0)
    check(spark, rows, target, percent=1, least=1, buckets=50, longest=2)


def test_nothing_to_draw_from_or_towards(spark):
    rng = random.Random(4)
    check(spark, [(i, prose(rng, 25)) for i in range(30)], [])
    check(spark, [(1, "few words"), (2, None)], ["few words"])
    check(spark, [(i, prose(rng, 30)) for i in range(9)], ["the of"], percent=0)
    empty = spark.createDataFrame([], DOCS)
    assert resample(empty, spark.createDataFrame([], "text string")).collect() == []


def test_scores_tied_in_masses(spark):
    same = "one two three four five"
    rows = [(None, same)] * 60 + [(5, same)] * 40 + [(i, same) for i in range(10, 20)]
    check(spark, rows, [same], percent=70, least=1)


@pytest.mark.parametrize("rank", [1, 7, 1500, 2999, 3000])
def test_rough_sketch_is_proven_or_widened(spark, rank):
    """With a sketch far too coarse the bracket still ends up holding the rank, by exact counts."""
    scores = [int(random.Random(i).gauss(0, 1e6)) if i % 3 else 17 for i in range(3_000)]
    scored = spark.createDataFrame([(s,) for s in scores], "score long").repartition(7)
    low, high, above = bracket(scored, rank, len(scores), accuracy=3)
    want = sorted(scores, reverse=True)[rank - 1]
    assert low <= want <= high and above == sum(s > high for s in scores) and above < rank


def test_numbers_follow_the_order(spark):
    frame = spark.range(5_000).select((F.col("id") % 4).alias("g"), F.expr("id * 7919 % 5000").alias("v"), F.when(F.col("id") % 4 != 3, F.lit("k")).alias("h"))
    got = numbered(frame, [F.col("v").desc()], "place").collect()
    assert {r.v: r.place for r in got} == {v: 5_000 - v for v in range(5_000)}
    for key in (["g"], ["h"]):
        places = {}
        for r in sorted(numbered(frame, [F.col("v").asc()], "place", key).collect(), key=lambda r: r.v):
            places.setdefault(r[key[0]], []).append(r.place)
        assert all(p == list(range(1, len(p) + 1)) for p in places.values())
    assert numbered(frame.limit(0), [F.col("v").asc()]).collect() == []
