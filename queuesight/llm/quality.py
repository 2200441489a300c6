"""Document quality by attention over passages (multiple-instance learning), in numpy.

A document is a bag of passages. Each passage is encoded; gated attention gives the passages
weights that sum to one; the weighted mean of their encodings is scored. Only documents have
labels: which passages matter is learned with the rest, by gradient descent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import learnable, named

PASSAGE = 512  # bytes
BUCKETS = 512  # of hashed byte pairs
KINDS = np.zeros(256, np.uint8)  # 0 other symbols, 1 lower, 2 upper, 3 digit, 4 space, 5 line feed, 6 beyond ASCII, 7 . , ;
KINDS[ord("a") : ord("z") + 1], KINDS[ord("A") : ord("Z") + 1], KINDS[ord("0") : ord("9") + 1] = 1, 2, 3
KINDS[ord(" ")], KINDS[ord("\n")], KINDS[128:] = 4, 5, 6
KINDS[[ord(c) for c in ".,;"]] = 7
WIDTH = BUCKETS + 8 + 2


def passages(text: str | None) -> np.ndarray:
    """A row of features for each passage of the whole text; one row of zeros without text.

    Square roots of the shares of hashed byte pairs and of kinds of bytes, how much the pairs
    repeat, and how much of a passage earlier passages of the text already had.
    """
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return np.zeros((1, WIDTH), np.float32)
    n = -(-len(data) // PASSAGE)
    passage = np.arange(len(data)) // PASSAGE
    sizes = np.bincount(passage, minlength=n).astype(np.float32)[:, None]
    after = np.append(data[1:], np.uint8(10))
    pair = (data.astype(np.uint32) * 2654435761 + after.astype(np.uint32) * 40503 * 65537) >> np.uint32(16)
    pair = (pair ^ (pair >> np.uint32(7))) % BUCKETS
    pairs = np.bincount(passage * BUCKETS + pair, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32) / sizes
    kinds = np.bincount(passage * 8 + KINDS[data], minlength=n * 8).reshape(n, 8).astype(np.float32) / sizes
    repeat = np.sqrt((pairs**2).sum(axis=1, keepdims=True))
    before = np.cumsum(pairs, axis=0) / np.arange(1, n + 1, dtype=np.float32)[:, None]
    same = np.concatenate((np.zeros((1, 1), np.float32), np.minimum(pairs[1:], before[:-1]).sum(axis=1, keepdims=True)))
    return np.concatenate((np.sqrt(pairs), np.sqrt(kinds), repeat, same), axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """score = sigmoid(c . sum a_k h_k + d), h = tanh(E x + e), a = softmax(w . (tanh(V h) * sigmoid(U h)))."""

    def __init__(self, width: int = 24, attention: int = 12, seed: int = 11):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "E": scale(WIDTH, width) * 2, "e": np.zeros(width, np.float32),
            "V": scale(width, attention), "U": scale(width, attention), "w": scale(attention, 1)[:, 0],
            "c": scale(width, 1)[:, 0], "d": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Bags lie one after another in x; `starts` are their first rows."""
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (v * u) @ p["w"]
        counts = np.diff(np.append(starts, len(x)))
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), counts))
        a = s / np.repeat(np.add.reduceat(s, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "counts": counts, "y": _sigmoid(z @ p["c"] + p["d"])}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1])).astype(np.int64)
        return self.forward(np.concatenate(bags), starts)["y"].astype(np.float64)

    def gradients(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logarithmic loss."""
        p, f = self.p, self.forward(x, starts)
        spread = lambda rows: np.repeat(rows, f["counts"], axis=0)
        dy = (f["y"] - labels).astype(np.float32) / len(labels)
        g = {"c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}
        dz = spread(dy[:, None] * p["c"])
        da = (dz * f["h"]).sum(axis=1)
        ds = f["a"] * (da - spread(np.add.reduceat(f["a"] * da, starts)))
        g["w"] = (f["v"] * f["u"]).T @ ds
        dv = ds[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2)
        du = ds[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
        dh = (f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        g["E"], g["e"] = x.T @ dh, dh.sum(axis=0)
        return g

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> AttentionModel:
        """Adam over shuffled batches of documents."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            pace = rate * (1 - epoch / epochs)
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                some = [bags[i] for i in own]
                starts = np.concatenate(([0], np.cumsum([len(b) for b in some])[:-1])).astype(np.int64)
                step += 1
                for k, g in self.gradients(np.concatenate(some), starts, labels[own]).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def learn_quality(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    label: str = "quality",
    most_rows: int = 6_000,
    **settings,
) -> AttentionModel:
    """Fit on labelled rows that are not held out.

    Whole texts of about `most_rows` labelled rows (all where there are fewer), chosen by a
    hash of the id, are fitted on the driver: a bound on labelled rows, whatever the tables'
    size. Null ids, texts and labels teach nothing; of repeated label rows the largest counts.
    Without labels the model stays as it was drawn.
    """
    taught = named(labels, label_id=label_id, label=label).where(learnable(F.col("label_id")) & F.col("label").isNotNull())
    taught = taught.groupBy("label_id").agg(F.max("label").alias("label"))
    rate = min(1.0, most_rows / max(1, taught.count()))
    draw = F.pmod(F.xxhash64("label_id", F.lit("quality sample")), F.lit(1_000_000)) / 1_000_000
    taught = F.broadcast(taught.where(draw < rate))  # about most_rows narrow rows at most
    docs = named(documents, doc_id=doc_id, text=text).where(F.col("text").isNotNull())
    rows = docs.join(taught, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label").toPandas()
    rows = rows.sort_values(["doc_id", "text"]).reset_index(drop=True)
    model = AttentionModel()
    if not len(rows):
        return model
    return model.fit([passages(t) for t in rows["text"]], rows["label"].to_numpy(np.float32), **settings)


def quality_column(spark, model: AttentionModel, text: Column) -> Column:
    """The score of a text, 0 to 1; null and empty texts are scored as a bag of one empty passage."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            out: list[float] = []
            bags: list[np.ndarray] = []
            held = 0
            for text_ in batch:
                bags.append(passages(text_))
                held += len(bags[-1])
                if held > 4_096:
                    out.extend(own.scores(bags))
                    bags, held = [], 0
            if bags:
                out.extend(own.scores(bags))
            yield pd.Series(out, dtype="float64")

    return score(text)


def score_quality(documents: DataFrame, model: AttentionModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row; predicted is 1 from a score of 0.5."""
    rows = named(documents, doc_id=doc_id, text=text)
    scored = rows.select("doc_id", quality_column(documents.sparkSession, model, F.col("text")).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
