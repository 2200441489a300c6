"""Logistic regressions of all classes against the rest, fitted together.

Each class has a problem of its own: the sum of its rows' weighted losses plus half the
squared length of its weights (the intercept is free). Examples are packed once into blocks of
sparse rows. An evaluation is one job for all classes: every task sums loss and gradient over
its blocks, and the sums of the tasks are added up in a tree, part by part of the gradient.
Directions (limited-memory BFGS) and step lengths are the driver's, each class its own, so
what the driver holds is classes times terms, whatever the number of rows. The directions
start from the inverse curvature at zero weights, estimated from the first `CURVATURE_ROWS`
examples: this changes how many evaluations a fit takes and not where it ends, since each
evaluation reads all examples and the fit ends when their gradient is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, small_batches, write_blocks

BLOCK_ROWS = 4_000
BLOCK_CELLS = 1 << 19  # values of the rows of a block, if a batch has as many: 6 MB
KINDS = {"sizes": "<i4", "terms": "<i4", "amounts": "<f8", "codes": "<i4"}
BLOCK_COLUMNS = ", ".join(f"{name} binary" for name in KINDS)
NO_CLASS = -1  # of rows without a class: they count against every class
PART = 1 << 16  # numbers in one part of a task's sums
FAN = 32  # sums added up by one task
MEMORY = 10  # steps a direction remembers
CURVATURE_ROWS = 20_000  # examples the curvature is estimated from
CURVATURE_WIDTH = 6_000  # weights up to which there is such an estimate: a square of them, 290 MB
# Weights of all classes: 80 MB. They are sent to every task and come back from it.
MOST_WEIGHTS = 10_000_000


def sparse_rows(features: str | Column) -> tuple[Column, Column]:
    """(indices, values) of a vector column."""
    raw = F.unwrap_udt(features)
    indices = F.when(raw["type"] == 0, raw["indices"]).otherwise(F.sequence(F.lit(0), F.size(raw["values"]) - 1))
    return indices, raw["values"]


def _row_blocks(rows: pa.RecordBatch, most: int, cells: int) -> Iterator[pa.RecordBatch]:
    """The rows in turn, some together: at most `most`, and those whose values end in the same `cells`."""
    if rows.column("v").null_count:
        raise ValueError("an example has no features")
    sizes = pc.list_value_length(rows.column("v")).to_numpy(zero_copy_only=False)
    at, ends = np.arange(len(sizes)), np.cumsum(sizes, dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // cells) | np.diff(at // most)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if end > start:
            yield rows.slice(start, end - start)


def packed(examples: DataFrame, features: str, code: str) -> DataFrame:
    """Blocks of sparse rows with their class codes, written once to the shared folder."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _row_blocks(batch, BLOCK_ROWS, BLOCK_CELLS):
                indices, values, codes = rows.columns
                found = pc.list_value_length(values), indices.flatten(), values.flatten(), pc.fill_null(codes, NO_CLASS)
                yield pa.record_batch({
                    name: pa.array([x.to_numpy(zero_copy_only=False).astype(kind, copy=False).tobytes()], pa.binary())
                    for x, (name, kind) in zip(found, KINDS.items(), strict=True)
                })

    indices, values = sparse_rows(features)
    rows = examples.select(indices.alias("i"), values.alias("v"), F.col(code).cast("int").alias("c"))
    path = fresh_path(examples.sparkSession, "example-blocks")
    with small_batches(examples.sparkSession):
        write_blocks(rows.mapInArrow(blocks, BLOCK_COLUMNS), path)
    return examples.sparkSession.read.schema(BLOCK_COLUMNS).parquet(path)


def block_sums(sizes: np.ndarray, terms: np.ndarray, amounts: np.ndarray, codes: np.ndarray, problems: np.ndarray, weights: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Loss, then gradient (weights, then intercept) of each problem, as rows.

    `problems` are the class codes that count as positive; `weights` has a row for each, the
    intercept last; rows of the class weigh `positive`, others `negative`.
    """
    n, width = len(sizes), weights.shape[1] - 1
    row = np.repeat(np.arange(n), sizes)
    out = np.empty((len(problems), width + 2))
    for k, code in enumerate(problems):
        sign = np.where(codes == code, 1.0, -1.0)
        weight = np.where(codes == code, positive[k], negative[k])
        margin = sign * (np.bincount(row, amounts * weights[k][terms], minlength=n) + weights[k][-1])
        slope = -weight * sign * np.exp(-np.logaddexp(0.0, margin))
        out[k, 0] = weight @ np.logaddexp(0.0, -margin)
        out[k, 1:-1] = np.bincount(terms, amounts * slope[row], minlength=width)
        out[k, -1] = slope.sum()
    return out


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of equal parts, in the order of the tasks they come from: the same whenever each arrived."""
    rows = rows.sort_values("task")
    total = np.zeros(len(rows["data"].iloc[0]) // 8)
    for data in rows["data"]:
        total += np.frombuffer(data, "<f8")
    return pd.DataFrame({"task": rows["up"].iloc[:1], "part": rows["part"].iloc[:1], "data": [total.tobytes()]})


@dataclass
class Problems:
    """The examples and what each class's problem weighs; evaluates points of all problems in one job."""

    blocks: DataFrame
    codes: np.ndarray
    positive: np.ndarray
    negative: np.ndarray
    width: int

    def evaluated(self, which: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(losses, gradients) of the problems `which` at `weights`, one row each, penalty included."""
        if weights.size > MOST_WEIGHTS:
            raise ValueError(f"{weights.shape[0]} classes of {weights.shape[1]} weights are more than {MOST_WEIGHTS}")
        session = self.blocks.sparkSession
        sent = session.sparkContext.broadcast((self.codes[which], weights, self.positive[which], self.negative[which]))
        shape = (len(which), self.width + 2)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            problems, points, positive, negative = sent.value
            total = np.zeros(shape)
            for batch in batches:
                for block in zip(*(batch.column(c) for c in KINDS), strict=True):
                    rows = [np.frombuffer(x.as_buffer(), kind) for x, kind in zip(block, KINDS.values(), strict=True)]
                    total += block_sums(*rows, problems, points, positive, negative)
            flat = total.ravel()
            parts = [flat[at : at + PART].tobytes() for at in range(0, len(flat), PART)]
            task = np.full(len(parts), TaskContext.get().partitionId())
            yield pa.record_batch({"task": pa.array(task), "part": pa.array(np.arange(len(parts))), "data": pa.array(parts, pa.binary())})

        sums = self.blocks.mapInArrow(summed, "task long, part long, data binary")
        tasks = self.blocks.rdd.getNumPartitions()
        while tasks > 1:
            sums = sums.withColumn("up", F.expr(f"task div {FAN}")).groupBy("part", "up").applyInPandas(_added, "task long, part long, data binary")
            tasks = -(-tasks // FAN)
        with small_batches(session):
            data = b"".join(r["data"] for r in sorted(sums.select("part", "data").collect(), key=lambda r: r["part"]))
        sent.destroy()
        found = np.frombuffer(data, "<f8").reshape(shape) if data else np.zeros(shape)
        inner = weights.copy()
        inner[:, -1] = 0.0  # the intercept is not penalised
        return found[:, 0] + 0.5 * (inner**2).sum(axis=1), found[:, 1:] + inner


def inverse_curvature(problems: Problems, weight: float) -> np.ndarray | None:
    """About the inverse of the second derivatives at zero weights, where the rows weigh `weight` in all.

    None where the square of the weights would be too large.
    """
    width = problems.width + 1
    if width > CURVATURE_WIDTH:
        return None
    products, seen = np.zeros((width, width), np.float32), 0
    for block in problems.blocks.select("sizes", "terms", "amounts").toLocalIterator():
        sizes, terms, amounts = (np.frombuffer(block[c], kind) for c, kind in (("sizes", "<i4"), ("terms", "<i4"), ("amounts", "<f8")))
        row = np.repeat(np.arange(len(sizes)), sizes)
        for at in range(0, len(sizes), 1_000):
            here = slice(*np.searchsorted(row, [at, at + 1_000]))
            dense = np.zeros((min(1_000, len(sizes) - at), width), np.float32)
            dense[row[here] - at, terms[here]] = amounts[here]
            dense[:, -1] = 1.0
            products += dense.T @ dense
        seen += len(sizes)
        if seen >= CURVATURE_ROWS:
            break
    if not seen:
        return None
    curvature = products.astype(float)
    del products
    curvature *= weight / (4 * seen)
    curvature[np.diag_indices(width)] += 1.0
    return np.linalg.inv(curvature).astype(np.float32)


class Descent:
    """One class's way to its least loss: directions from the last steps, steps halved until the loss falls.

    `inverse`, if given, is the first guess of the inverse curvature, else a multiple of one is.
    """

    def __init__(self, loss: float, point: np.ndarray, gradient: np.ndarray, tolerance: float, inverse: np.ndarray | None = None):
        self.loss, self.point, self.gradient, self.inverse = loss, point, gradient, inverse
        self.bound = tolerance * max(float(np.linalg.norm(gradient)), 1e-12)
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.stuck = False
        self._aim()

    @property
    def norm(self) -> float:
        return float(np.linalg.norm(self.gradient))

    @property
    def done(self) -> bool:
        return self.stuck or self.norm <= self.bound

    def _aim(self) -> None:
        q, kept = self.gradient.copy(), []
        for s, y in reversed(self.steps):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        guess = (lambda v: v) if self.inverse is None else (lambda v: (self.inverse @ v.astype(np.float32)).astype(float))
        last = self.steps[-1] if self.steps else None
        plain = 1.0 if self.inverse is not None else 1.0 / max(self.norm, 1.0)
        q = guess(q) * ((last[0] @ last[1]) / (last[1] @ guess(last[1])) if last else plain)
        for (s, y), a in zip(self.steps, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        if q @ self.gradient <= 0:  # rounding: no way down
            self.steps, q = [], self.gradient / max(self.norm, 1.0)
        self.direction, self.length = -q, 1.0

    def trial(self) -> np.ndarray:
        return self.point + self.length * self.direction

    def told(self, loss: float, gradient: np.ndarray) -> None:
        """Take the trial if its loss has fallen enough, else try half as far."""
        fall = self.length * (self.gradient @ self.direction)
        if loss <= self.loss + 1e-4 * fall + 1e-12 * abs(self.loss):
            s, y = self.length * self.direction, gradient - self.gradient
            if s @ y > 1e-12 * (y @ y):
                self.steps = [*self.steps, (s, y)][-MEMORY:]
            self.point, self.loss, self.gradient = self.point + s, loss, gradient
            self._aim()
        else:
            self.length /= 2
            self.stuck = self.length < 1e-12  # no fall left that a double can show


def fitted(problems: Problems, tolerance: float, most: int) -> tuple[np.ndarray, dict]:
    """(weights, figures): a row of weights for each problem, the intercept last, after at most `most` evaluations.

    Every evaluation is one job that serves all problems not yet done: each has its own
    direction and step. Figures: evaluations, and per problem the gradient's norm, the bound
    it was to reach (`tolerance` times the norm at zero) and the loss.
    """
    all_of = np.arange(len(problems.codes))
    start = np.zeros((len(all_of), problems.width + 1))
    losses, gradients = problems.evaluated(all_of, start)
    first = losses.tolist()
    inverse = inverse_curvature(problems, float(losses.mean()) / np.log(2.0))
    ways = [Descent(losses[k], start[k], gradients[k], tolerance, inverse) for k in all_of]
    evaluations = 1
    while evaluations < most:
        going = np.array([k for k in all_of if not ways[k].done], int)
        if not len(going):
            break
        losses, gradients = problems.evaluated(going, np.stack([ways[k].trial() for k in going]))
        for i, k in enumerate(going):
            ways[k].told(losses[i], gradients[i])
        evaluations += 1
    figures = {"evaluations": evaluations, "gradient_norms": [w.norm for w in ways], "gradient_bounds": [w.bound for w in ways], "losses_at_zero": first, "losses": [float(w.loss) for w in ways]}
    return np.stack([w.point for w in ways]), figures
