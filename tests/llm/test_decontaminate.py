import random
import re

from helpers import DOCS, awkward, clashing, documents, prose, rows_of

from queuesight.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(rows, items, span=13, share=20):
    out = []
    for doc, text in rows:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            iw = words(body)
            n = min(span, len(iw))
            wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), sorted(found), len(hit) > 0 and share * len(hit) >= len(w)))
    return sorted(out, key=repr)


def check(spark, rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(clashing(documents(spark, rows)), clashing(benchmark)).drop("th")
    assert rows_of(got) == plain(rows, items)


def test_against_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(13, 60))) for i in range(12)]
    items += [(100, None), (101, ""), (3, prose(rng, 20)), (None, prose(rng, 15)), (102, items[0][1]), (103, "Ünïcode Éa " * 9)]
    rows = awkward(rng)
    for i in range(200, 240):
        item = rng.choice(items)[1] or ""
        w = item.split()
        at = rng.randint(0, max(0, len(w) - 14))
        part = " ".join(w[at : at + rng.randint(8, 40)])
        rows.append((i, f"{prose(rng, rng.randint(0, 90))} {part.upper()}, {prose(rng, rng.randint(0, 90))} {part}"))
    rows.append((300, "ÜNÏCODE éa " * 9))
    rows.append((301, "ünïcode Éa " * 9))
    check(spark, rows, items)


def test_short_items_count_whole(spark):
    rng = random.Random(4)
    items = [(1, "alpha beta"), (2, "gamma"), (3, "delta epsilon zeta eta theta"), (4, prose(rng, 30)), (5, "alpha beta")]
    rows = [(1, "one alpha, BETA gamma"), (2, "gamma"), (3, "delta epsilon zeta eta"), (4, "x " * 200 + "delta epsilon zeta. eta theta"), (5, items[3][1]), (6, None)]
    check(spark, rows, items)


def test_repetitive_texts(spark):
    check(spark, [(1, "again " * 300), (2, "a b " * 40), (3, "again " * 12)], [(1, "again " * 20), (2, "a b " * 10), (3, "b a " * 7)])


def test_empty_tables(spark):
    check(spark, awkward(), [])
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contamination(spark.createDataFrame([], DOCS), benchmark).collect() == []
