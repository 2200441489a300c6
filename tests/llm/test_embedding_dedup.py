import numpy as np
import pytest
from helpers import CLASHING, rows_of

from queuesight.llm.embedding_dedup import Plan, embedding_duplicates, meeting_chance

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, cosine=0.9):
    good, by_id = {}, {}
    for i, v in rows:
        key = [] if v is None else [float("-inf") if x is None else x for x in v]
        if i not in by_id or (by_id[i] is None or (v is not None and key < by_id[i][0])):
            by_id[i] = (key, v) if v is not None else by_id.get(i)
    for i, kv in by_id.items():
        v = kv[1] if kv else None
        if i is not None and v and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = x / np.linalg.norm(x)
    ids = sorted(good)
    near = {i: [j for j in ids if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= cosine] for i in ids}
    component = {}
    for i in ids:
        if i not in component:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in component:
                    component[x] = i
                    stack += near[x]
    return sorted(((i, len(near.get(i, [])), component.get(i, i), i is not None and component.get(i, i) == i) for i in by_id), key=repr)


def cloud(seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(16)) for i in range(150)]
    n = 1000
    for i in range(0, 150, 6):
        for _ in range(int(rng.integers(1, 40 if i == 0 else 9))):
            v = rows[i][1] + rng.standard_normal(16) * rng.uniform(0, 0.3)
            rows.append((n, v * rng.uniform(0.1, 5)))
            n += 1
    rows += [(n + k, rows[3][1]) for k in range(20)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in rows]


ODD = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [1.0, None] + [0.0] * 14), (5004, [float("nan")] * 16), (5005, [float("inf")] + [1.0] * 15), (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (5008, [1e-30, 2e-30]), (None, [1.0, 2.0]), (None, [0.5] * 16)]


@pytest.mark.parametrize("most", [4096, 7])
def test_against_brute_force(spark, most):
    rows = cloud() + ODD
    rows += rows[:3] + [(1, [9.0] * 16)]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], KIND).selectExpr("*", *[f"1 AS `{c}`" for c in [*CLASHING, "class_id", "size", "keys", "t"]])
    assert rows_of(embedding_duplicates(df, most_in_bucket=most)) == plain(rows)


def test_empty_table_and_no_valid_vector(spark):
    assert rows_of(embedding_duplicates(spark.createDataFrame([], KIND))) == []
    df = spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], KIND)
    assert rows_of(embedding_duplicates(df)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_pairs_at_the_threshold_meet_as_often_as_planned():
    rng = np.random.default_rng(1)
    plan = Plan.for_rows(50_000, 0.9, miss=0.05)
    a = rng.standard_normal((3000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((3000, 32))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    missed = 1 - (plan.keys(a) == plan.keys(b)).any(axis=1).mean()
    assert 0.02 < missed < 0.08
    assert 0 < meeting_chance(1.4, 2.0) < meeting_chance(0.4, 2.0) < 1
