"""The joint fit of all classes against dense numpy and Newton's method."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuesight import session
from queuesight.operators import logistic
from queuesight.operators.models import linear_model

WIDTH, CLASSES = 12, 3
EXAMPLES = T.StructType([T.StructField("features", VectorUDT()), T.StructField("code", T.IntegerType())])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = np.where(rng.random((240, WIDTH)) < 0.4, rng.normal(size=(240, WIDTH)), 0.0)
    x[7] = 0.0
    codes = np.argmax(x[:, :CLASSES] + 0.7 * rng.normal(size=(240, CLASSES)), axis=1)
    return x, codes


@pytest.fixture(scope="module")
def problems(spark, data):
    x, codes = data
    rows = [(Vectors.sparse(WIDTH, {j: float(v) for j, v in enumerate(r) if v}) if i % 3 else Vectors.dense(r), int(c)) for i, (r, c) in enumerate(zip(x, codes))]
    examples = spark.createDataFrame(rows, ["features", "code"]).repartition(7)
    blocks = logistic.packed(examples, "features", "code").repartition(7)
    return logistic.Problems(blocks, np.arange(CLASSES), np.array([1.5, 1.0, 3.0]), np.array([1.0, 0.5, 1.0]), WIDTH)


def plain(data, problems, k, w):
    x, codes = data
    sign = np.where(codes == k, 1.0, -1.0)
    weight = np.where(codes == k, problems.positive[k], problems.negative[k])
    wide = np.c_[x, np.ones(len(x))]
    margin = sign * (wide @ w)
    slope = -weight * sign / (1 + np.exp(margin))
    ridge = np.r_[np.ones(WIDTH), 0.0]
    curve = (weight / (1 + np.exp(margin)) / (1 + np.exp(-margin)))[:, None] * wide
    return weight @ np.log1p(np.exp(-margin)) + 0.5 * (ridge * w) @ w, wide.T @ slope + ridge * w, wide.T @ curve + np.diag(ridge)


@pytest.mark.parametrize("which", [[0, 1, 2], [2], [0, 2]])
def test_losses_and_gradients(data, problems, monkeypatch, which):
    points = np.random.default_rng(len(which)).normal(size=(len(which), WIDTH + 1))
    for part, fan in ((1 << 16, 32), (5, 2)):  # one level of sums, and many parts in three levels
        monkeypatch.setattr(logistic, "PART", part)
        monkeypatch.setattr(logistic, "FAN", fan)
        losses, gradients = problems.evaluated(np.array(which), points)
        for i, k in enumerate(which):
            loss, gradient, _ = plain(data, problems, k, points[i])
            assert losses[i] == pytest.approx(loss, rel=1e-12) and np.allclose(gradients[i], gradient, rtol=1e-10, atol=1e-10)


def test_blocks_are_bounded_in_values_and_few_to_a_file(spark, data, problems, monkeypatch):
    """However long the rows and however many a task has: neither a block nor what is read at once grows with them."""
    x, codes = data
    rows = [(Vectors.dense(r), None if i == 3 else int(c)) for i, (r, c) in enumerate(zip(x, codes))]
    examples = spark.createDataFrame(rows, EXAMPLES).coalesce(1)
    monkeypatch.setattr(logistic, "BLOCK_CELLS", 4 * WIDTH)
    blocks = logistic.packed(examples, "features", "code")
    found = blocks.select(F.input_file_name().alias("file"), "sizes", "terms", "amounts", "codes").collect()
    assert max(len(r["terms"]) for r in found) <= 4 * 5 * WIDTH and max(len(r["amounts"]) for r in found) <= 8 * 5 * WIDTH
    held = [sum(r["file"] == name for r in found) for name in {r["file"] for r in found}]
    assert len(found) >= 48 and max(held) <= session.BLOCKS_A_FILE
    read = [np.concatenate([np.frombuffer(r[c], kind) for r in found]).tolist() for c, kind in (("sizes", "<i4"), ("codes", "<i4"))]
    assert read[0] == [WIDTH] * len(x) and sorted(read[1]) == sorted([-1, *codes[:3].tolist(), *codes[4:].tolist()])
    points = np.random.default_rng(1).normal(size=(CLASSES, WIDTH + 1))
    bounded = logistic.Problems(blocks, problems.codes, problems.positive, problems.negative, WIDTH)
    losses, gradients = bounded.evaluated(problems.codes, points)
    for k in range(CLASSES):
        loss, gradient, _ = plain((x, np.r_[codes[:3], -1, codes[4:]]), problems, k, points[k])
        assert losses[k] == pytest.approx(loss, rel=1e-12) and np.allclose(gradients[k], gradient, rtol=1e-10, atol=1e-10)


def test_rows_larger_than_a_block_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(logistic, "BLOCK_CELLS", 5)
    rows = [(Vectors.dense(np.ones(n)), 0) for n in (12, 1, 1, 12)] + [(Vectors.sparse(12, {}), 1)]
    blocks = logistic.packed(spark.createDataFrame(rows, EXAMPLES).coalesce(1), "features", "code").collect()
    assert sorted(np.frombuffer(r["sizes"], "<i4").tolist() for r in blocks) == [[12, 0], [12, 1, 1]]


def test_fit_finds_each_least_loss(data, problems):
    found, figures = logistic.fitted(problems, 1e-8, 200)
    for k in range(CLASSES):
        w = np.zeros(WIDTH + 1)
        for _ in range(50):
            _, gradient, curve = plain(data, problems, k, w)
            w -= np.linalg.solve(curve, gradient)
        assert np.allclose(found[k], w, atol=1e-6)
        assert figures["gradient_norms"][k] <= figures["gradient_bounds"][k] and figures["losses"][k] < figures["losses_at_zero"][k]
    assert figures["evaluations"] < 60  # one job each, for all classes


def test_evaluations_are_bounded(problems):
    _, figures = logistic.fitted(problems, 0.0, 4)
    assert figures["evaluations"] == 4 and all(n > 0 for n in figures["gradient_norms"])


def test_steps_too_long_are_halved():
    def at(w):
        return float(np.log1p(np.exp(-50 * w[0])) + 0.5 * w[0] ** 2 + 1e3 * w[1] ** 4), np.array([-50 / (1 + np.exp(50 * w[0])) + w[0], 4e3 * w[1] ** 3])

    start = np.array([0.0, 2.0])
    way = logistic.Descent(at(start)[0], start, at(start)[1], 1e-9)
    losses = [way.loss]
    for _ in range(300):
        if way.done:
            break
        way.told(*at(way.trial()))
        losses.append(way.loss)
    assert way.norm <= way.bound and losses == sorted(losses, reverse=True)


def test_too_many_weights_are_refused(problems, monkeypatch):
    monkeypatch.setattr(logistic, "MOST_WEIGHTS", 10)
    with pytest.raises(ValueError, match="more than 10"):
        problems.evaluated(np.arange(CLASSES), np.zeros((CLASSES, WIDTH + 1)))


def test_no_examples(spark, problems):
    none = logistic.Problems(problems.blocks.where(F.lit(False)), problems.codes, problems.positive, problems.negative, WIDTH)
    losses, gradients = none.evaluated(np.arange(CLASSES), np.ones((CLASSES, WIDTH + 1)))
    assert losses.tolist() == [WIDTH / 2] * CLASSES and gradients[:, :-1].tolist() == np.ones((CLASSES, WIDTH)).tolist()


def test_linear_model_keeps_its_weights(spark):
    model = linear_model(spark, "x", np.array([0.5, -2.0, 0.25]))
    assert model.coefficients.toArray().tolist() == [0.5, -2.0] and model.intercept == 0.25


def test_curvature_spares_evaluations(spark):
    """Columns of very different size and much alike, labels by chance: plain steps need more than a hundred jobs."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(600, 1)) + 0.1 * rng.normal(size=(600, WIDTH))) * np.logspace(-1, 1, WIDTH)
    codes = rng.integers(0, 2, 600)
    rows = [(Vectors.dense(r), int(c)) for r, c in zip(x, codes)]
    blocks = logistic.packed(spark.createDataFrame(rows, ["features", "code"]).repartition(3), "features", "code")
    problems = logistic.Problems(blocks, np.array([1]), np.array([1.0]), np.array([1.0]), WIDTH)
    found, figures = logistic.fitted(problems, 1e-8, 200)
    assert figures["evaluations"] <= 12 and figures["gradient_norms"][0] <= figures["gradient_bounds"][0]
    w = np.zeros(WIDTH + 1)
    for _ in range(50):
        _, gradient, curve = plain((x, 1 - codes), problems, 0, w)  # there the class of problem 0 has code 0
        w -= np.linalg.solve(curve, gradient)
    assert np.allclose(found[0], w, atol=1e-5)


def test_wide_problems_go_without_curvature(problems, monkeypatch):
    monkeypatch.setattr(logistic, "CURVATURE_WIDTH", WIDTH)
    assert logistic.inverse_curvature(problems, 240.0) is None
    _, figures = logistic.fitted(problems, 1e-6, 200)
    assert all(n <= b for n, b in zip(figures["gradient_norms"], figures["gradient_bounds"]))
