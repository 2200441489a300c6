"""Documents scored by masked pseudo-likelihood of a small bidirectional network over subword tokens.

Every token of a public tokenizer is predicted from the `side` tokens before and after it,
itself masked; a document's score is the sum of the logarithms over its whole text. Tokens
are ranked by their frequency in all documents and cut into classes, small ones for frequent
tokens; a token's probability is its class's times its own within the class, which is exact
over the whole vocabulary.

All documents are trained on, once each, in turns of growing size. In a turn every Spark task
trains a copy of the network on its own documents; the changes are averaged in Spark, those
of a token's rows by how often a task met the token, so the driver gets one network a turn.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, stored
from .token_files import worker_encoder

TURNS = (2, 8)  # sixty-fourths of the documents in the turns before the last, which has the others
TOKENS_PER_TASK = 8_000_000  # a task that trains sends a whole network, so it should have met some tokens
SMALL = 1_000_000  # tokens; a corpus of fewer is gone through several times, up to 100
BATCH = 16_384
BLOCK = 1_024  # token rows sent together
FEW = 32  # tokens whose rows are added up by a product
PIECE = 512  # places worked on at a time, so that their logits stay in the processor's caches


def class_starts(size: int, first: int = 64, growth: float = 1.1) -> np.ndarray:
    """Where the classes of ranked tokens start, with the end: about 46 classes for 49,000 tokens."""
    starts, width = [0], float(first)
    while starts[-1] < size:
        starts.append(min(size, starts[-1] + int(width)))
        width *= growth
    return np.array(starts, np.int64)


def _pieces(rows: slice, times: int = 1) -> Iterator[slice]:
    for at in range(rows.start, rows.stop, times * PIECE):
        yield slice(at, min(at + times * PIECE, rows.stop))


def _with_one(h: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows of h as columns, and a last row of ones, which the biases are weights of."""
    out = np.ones((h.shape[1] + 1, len(places)), h.dtype)
    for part in _pieces(slice(0, len(places))):
        out[:-1, part] = h.take(places[part], axis=0).T
    return out


def tokenized(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, turn, ids) of every row; `ids` are the text's token ids as bytes, none for a null text."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = worker_encoder(tokenizer, 0)
        for batch in batches:
            found = encoder.encode(["" if t is None else t for t in batch])
            yield pd.Series([x[: -len(encoder.end)] for x in found], dtype=object)

    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("turn")), F.lit(64))
    turn = sum(((draw >= sum(TURNS[: k + 1])).cast("int") for k in range(len(TURNS))), F.lit(0))
    rows = named(documents, doc_id=doc_id, text=text)
    return rows.select("doc_id", turn.alias("turn"), encode("text").alias("ids"))


def token_counts(tokens: DataFrame, size: int, kind: str) -> list[np.ndarray]:
    """How often each id occurs in each turn, over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(TURNS) + 1, size), np.int64)
        for batch in batches:
            for turn, rows in batch.groupby("turn")["ids"]:
                totals[turn] += np.bincount(np.frombuffer(b"".join(rows), kind), minlength=size)
        turns, ids = np.nonzero(totals)
        yield pd.DataFrame({"turn": turns.astype("int32"), "token": ids.astype("int32"), "n": totals[turns, ids]})

    found = tokens.select("turn", "ids").mapInPandas(count, "turn int, token int, n long").groupBy("turn", "token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((len(TURNS) + 1, size), np.int64)
    out[found["turn"], found["token"]] = found["n"]
    return list(out)


class ContextNetwork:
    """log p(token | window) = log p(class | h) + log p(token | class, h); h = tanh(b + sum of W[place] E[token there])."""

    def __init__(self, counts: np.ndarray, hidden: int = 24, side: int = 3, seed: int = 3):
        size = len(counts)
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.size, self.side, self.edge = size, side, size
        order = np.lexsort((np.arange(size), -counts))
        self.rank = np.empty(size, np.int32)
        self.rank[order] = np.arange(size)
        self.starts = class_starts(size)
        self.classes = np.repeat(np.arange(len(self.starts) - 1, dtype=np.uint16), np.diff(self.starts))
        usual = counts[order] + 0.1
        mass = np.add.reduceat(usual, self.starts[:-1])
        self.p = {
            "E": draw(size + 1, hidden),  # the last row is the edge before and after a text
            "O": np.zeros((size, hidden), np.float32),
            "o": np.log(usual / mass[self.classes]).astype(np.float32),
            "W": draw(2 * side + 1, hidden, hidden) * 3,
            "b": np.zeros(hidden, np.float32),
            "C": np.zeros((len(mass), hidden), np.float32),
            "c": np.log(mass / mass.sum()).astype(np.float32),
        }
        self.p["W"][side] = 0  # the token itself is masked

    def places(self) -> list[int]:
        return [j for j in range(2 * self.side + 1) if j != self.side]

    def stream(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Texts of ids as one row of ranks with edges around each, and which text each place is of (-1: an edge)."""
        gap = np.full(self.side, self.edge, np.int32)
        parts, own = [gap, gap], [np.full(2 * self.side, -1)]
        for i, ids in enumerate(texts):
            if len(ids):
                parts += [self.rank[ids], gap]
                own += [np.full(len(ids), i), np.full(self.side, -1)]
        return np.concatenate(parts), np.concatenate(own)

    def _met(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct tokens of a stream in order, and which of them each place has."""
        found = np.zeros(self.size + 1, bool)
        found[x] = True
        tokens = np.flatnonzero(found)
        number = np.empty(self.size + 1, np.uint16 if len(tokens) <= 1 << 16 else np.int64)  # few bits sort faster
        number[tokens] = np.arange(len(tokens))
        return tokens, number[x]

    def _moved(self, tokens: np.ndarray) -> np.ndarray:
        """What each of the tokens adds to h from each place around; `b` is in the first."""
        moved = self.p["E"][tokens] @ self.p["W"][self.places()]
        moved[0] += self.p["b"]
        return moved

    def _hidden(self, moved: np.ndarray, at: np.ndarray) -> np.ndarray:
        """h at all places of a stream but the `side` first and last."""
        out = np.empty((len(at) - 2 * self.side, moved.shape[2]), moved.dtype)
        room = np.empty_like(out[: 4 * PIECE])
        for part in _pieces(slice(0, len(out)), 4):
            total = out[part]
            for one, j in zip(moved, self.places(), strict=True):
                near = at[part.start + j : part.stop + j]
                if j:
                    total += one.take(near, axis=0, out=room[: len(total)], mode="clip")
                else:
                    one.take(near, axis=0, out=total, mode="clip")
            np.tanh(total, out=total)
        return out

    def _targets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, tokens, classes) of a stream's tokens between its `side` first and last places, by class."""
        real = np.flatnonzero(x[self.side : len(x) - self.side] != self.edge)
        targets = x[self.side + real]
        classes = self.classes[targets]
        order = np.argsort(classes, kind="stable")
        return real[order], targets[order], classes[order]

    def _weights(self, weights: str, bias: str, rows: slice = slice(None)) -> tuple[np.ndarray, bool]:  # noqa: B008
        """Weights with the bias as the last column, and whether logits under them may be too far apart for exp()."""
        both = np.column_stack((self.p[weights][rows], self.p[bias][rows]))
        most = 60  # h is between -1 and 1
        return both, max(both.max(), -both.min()) * both.shape[1] > most and np.abs(both).sum(axis=1).max() > most

    @staticmethod
    def _logits(h: np.ndarray, weights: np.ndarray, far: bool) -> np.ndarray:
        """A column for each place, fit for exp()."""
        z = weights @ h
        if far:
            top = z.max()
            z -= z.max(axis=0) if top - z.min() > 60 else top  # else no column can vanish beside another
        return z

    def _logs(self, h: np.ndarray, weights: np.ndarray, far: bool, at: np.ndarray) -> np.ndarray:
        """The logarithms of the probabilities at `at`."""
        z = self._logits(h, weights, far)
        picked = z[at, np.arange(len(at))]
        np.exp(z, out=z)
        return picked - np.log(np.ones(len(z), z.dtype) @ z)

    def _errors(self, h: np.ndarray, weights: np.ndarray, far: bool, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of minus the summed logarithms at `at`, by h and by the weights.

        Both are products with the probabilities less one at `at`; what is small is divided by
        the sums of the exponentials, not these.
        """
        z = self._logits(h, weights, far)
        np.exp(z, out=z)
        total = np.ones(len(z), z.dtype) @ z
        z[at, np.arange(len(at))] -= total
        dh = weights[:, :-1].T @ z
        dh /= total
        return dh, z @ (h / total).T

    def _groups(self, classes: np.ndarray) -> Iterator[tuple[int, int, slice]]:
        """(start, end, rows) of each class among places sorted by class."""
        cuts = [0, *(np.flatnonzero(np.diff(classes)) + 1), len(classes)]
        for first, last in zip(cuts[:-1], cuts[1:], strict=True) if len(classes) else ():
            k = classes[first]
            yield self.starts[k], self.starts[k + 1], slice(first, last)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each token of a stream between its `side` first and last places; 0 at edges."""
        out = np.zeros(len(x) - 2 * self.side)
        tokens, near = self._met(x)
        moved, c = self._moved(tokens), self._weights("C", "c")
        for at in range(0, len(out), BATCH):
            to = at + BATCH + 2 * self.side
            places, targets, classes = self._targets(x[at:to])
            h = _with_one(self._hidden(moved, near[at:to]), places)
            found = np.empty(len(places))
            for part in _pieces(slice(0, len(places))):
                found[part] = self._logs(h[:, part], *c, classes[part])
            for s, e, rows in self._groups(classes):
                o = self._weights("O", "o", slice(s, e))
                for part in _pieces(rows):
                    found[part] += self._logs(h[:, part], *o, targets[part] - s)
            out[at + places] = found
        return out

    def gradients(self, x: np.ndarray) -> Iterator[tuple[str, slice | np.ndarray, np.ndarray]]:
        """(parameter, rows, gradient) of minus the summed log probabilities of a stream."""
        k, every = self.side, slice(None)
        tokens, near = self._met(x)
        full = self._hidden(self._moved(tokens), near)
        places, targets, classes = self._targets(x)
        h = _with_one(full, places)
        dh, changes = np.empty_like(h[:-1]), []
        c, total = self._weights("C", "c"), 0
        for part in _pieces(slice(0, len(places))):
            dh[:, part], change = self._errors(h[:, part], *c, classes[part])
            total += change
        if len(places):
            changes += [("C", every, total[:, :-1]), ("c", every, total[:, -1])]
        for s, e, rows in self._groups(classes):
            o, total = self._weights("O", "o", slice(s, e)), 0
            for part in _pieces(rows):
                change_h, change = self._errors(h[:, part], *o, targets[part] - s)
                dh[:, part] += change_h
                total += change
            changes += [("O", slice(s, e), total[:, :-1]), ("o", slice(s, e), total[:, -1])]
        da = np.zeros((len(full) + 4 * k, full.shape[1]), full.dtype)
        for part in _pieces(slice(0, len(places))):
            dh[:, part] *= 1 - h[:-1, part] ** 2
            da[2 * k + places[part]] = dh[:, part].T.copy()
        sums, e, w = self._summed_around(da, near, len(tokens)), self.p["E"][tokens], self.p["W"][self.places()]
        dw = np.zeros_like(self.p["W"])
        dw[self.places()] = e.T @ sums
        yield from [*changes, ("W", every, dw), ("b", every, dh.sum(axis=1)), ("E", tokens, (sums @ w.transpose(0, 2, 1)).sum(axis=0))]

    def _summed_around(self, da: np.ndarray, near: np.ndarray, size: int) -> np.ndarray:
        """For each place around and each of `size` tokens: the sum of `da` where the token is at that place.

        `da` has twice `side` rows of zeros before and after those of the places in the middle of `near`.
        """
        order, shifts = np.argsort(near, kind="stable"), [2 * self.side - j for j in self.places()]
        sums = np.zeros((len(shifts), size, da.shape[1]), da.dtype)
        room = np.empty((len(shifts), PIECE, da.shape[1]), da.dtype)
        for part in _pieces(slice(0, len(order))):
            rows = order[part]
            for one, shift in zip(room, shifts, strict=True):
                da.take(rows + shift, axis=0, out=one[: len(rows)], mode="clip")
            held, of = room[:, : len(rows)], near[rows].astype(np.int64)
            first, last = of[0], of[-1] + 1
            if last - first <= FEW:
                sums[:, first:last] += (of == np.arange(first, last)[:, None]).astype(da.dtype) @ held
            else:
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                sums[:, of[starts]] += np.add.reduceat(held, starts, axis=1)
        return sums

    def train(self, streams: Iterable[np.ndarray], rate: float, batch: int = BATCH) -> ContextNetwork:
        """Adagrad, a step for each `batch` places."""
        seen = {key: np.ones_like(value) for key, value in self.p.items()}
        for x in streams:
            for at in range(0, len(x) - 2 * self.side, batch):
                for key, rows, g in self.gradients(x[at : at + batch + 2 * self.side]):
                    total = g * g
                    total += seen[key][rows]
                    seen[key][rows] = total
                    step = np.sqrt(total, out=total)
                    np.divide(g, step, out=step)
                    step *= rate
                    self.p[key][rows] -= step
        return self


def _parts(texts: Iterable[bytes], kind: str, most: int) -> Iterator[list[np.ndarray]]:
    """Texts of ids, some together: those after which `most` tokens are reached end a part."""
    held, total = [], 0
    for ids in texts:
        held.append(np.frombuffer(ids, kind))
        total += len(held[-1])
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def _trained(shared, kind: str, rate: float, corpus: int):
    """(block, task, n, change) from each task: of token rows by block, of the other parameters at block -1."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = shared.value
        own = ContextNetwork.__new__(ContextNetwork)
        own.__dict__ = start.__dict__ | {"p": {k: v.copy() for k, v in start.p.items()}}
        counts = np.zeros(own.size + 1, np.int64)

        def streams() -> Iterator[np.ndarray]:
            for part in _parts((ids for batch in batches for ids in batch["ids"]), kind, 16 * BATCH):
                x = own.stream(part)[0]
                counts[:] += np.bincount(x, minlength=len(counts))
                yield x

        times = min(100, SMALL // corpus)
        own.train(chain.from_iterable(repeat(list(streams()), times)) if times > 1 else streams(), rate, min(BATCH, max(256, corpus // 256)))
        if not counts[:-1].any():
            return
        change = {k: own.p[k] - start.p[k] for k in own.p}
        task = TaskContext.get().partitionId()
        rest = np.concatenate([change[k].ravel() for k in "WbCc"]) * counts[:-1].sum()
        yield pd.DataFrame({"block": [-1], "task": [task], "n": [np.array([counts[:-1].sum()], np.float32).tobytes()], "change": [rest.astype(np.float32).tobytes()]})
        rows = np.zeros((own.size + 1, 2 * change["E"].shape[1] + 1), np.float32)
        rows[:, : change["E"].shape[1]] = change["E"]
        rows[:-1, change["E"].shape[1] : -1], rows[:-1, -1] = change["O"], change["o"]
        weight = (counts + 1e-3).astype(np.float32)  # a token that no task met moves as the tasks' mean
        for at in range(0, len(rows), BLOCK):
            part = rows[at : at + BLOCK] * weight[at : at + BLOCK, None]
            yield pd.DataFrame({"block": [at // BLOCK], "task": [task], "n": [weight[at : at + BLOCK].tobytes()], "change": [part.tobytes()]})

    return train


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("task")
    out = {x: sum(np.frombuffer(b, np.float32).astype(np.float64) for b in rows[x]).astype(np.float32).tobytes() for x in ("n", "change")}
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "task": [rows["task"].iloc[0]], "n": [out["n"]], "change": [out["change"]]})


def learn_masked_lm(tokens: DataFrame, size: int, kind: str, rates: tuple[float, ...] = (0.1, 0.1, 0.05), **settings: int) -> ContextNetwork:
    """Train on every row of `tokenized`, each once; `rates` are those of the turns."""
    turns = token_counts(tokens, size, kind)
    network = ContextNetwork(sum(turns), **settings)
    spark = tokens.sparkSession
    columns = "block int, task int, n binary, change binary"
    for turn, rate in enumerate(rates):
        total = int(turns[turn].sum())
        if not total:
            continue
        shared = spark.sparkContext.broadcast(network)
        rows = tokens.where(F.col("turn") == turn).select("ids")
        tasks = min(spark.sparkContext.defaultParallelism, 1 + total // (SMALL // 4))
        rows = rows.coalesce(max(tasks, total // TOKENS_PER_TASK))
        sent = rows.mapInPandas(_trained(shared, kind, rate, int(sum(turns).sum())), columns)
        some = sent.withColumn("some", F.floor(F.col("task") / 32)).groupBy("block", "some").applyInPandas(_summed, columns)
        found = {r["block"]: r for r in some.groupBy("block").applyInPandas(_summed, columns).collect()}
        floats = lambda r, key: np.frombuffer(r[key], np.float32)
        rest = floats(found.pop(-1), "change") / total
        at = 0
        for key in "WbCc":
            own = network.p[key]
            own += rest[at : at + own.size].reshape(own.shape)
            at += own.size
        for block, r in found.items():
            n = floats(r, "n")
            change = floats(r, "change").reshape(len(n), -1) / n[:, None]
            first, hidden = block * BLOCK, network.p["E"].shape[1]
            network.p["E"][first : first + len(n)] += change[:, :hidden]
            last = min(network.size, first + len(n))
            network.p["O"][first:last] += change[: last - first, hidden:-1]
            network.p["o"][first:last] += change[: last - first, -1]
        shared.unpersist()
    return network


def score_tokens(tokens: DataFrame, network: ContextNetwork, kind: str) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of every row of `tokenized`.

    A null or empty text has no tokens, sum 0 and a null mean.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("n_tokens long, log_prob double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, k = shared.value, shared.value.side
        for batch in batches:
            sizes, sums = [], []
            for texts in _parts(batch, kind, 16 * BATCH):
                x, place = own.stream(texts)
                found, place = own.log_probabilities(x), place[k : len(place) - k]
                sums.append(np.bincount(place[place >= 0], found[place >= 0], len(texts)))
                sizes += map(len, texts)
            yield pd.DataFrame({"n_tokens": np.array(sizes, np.int64), "log_prob": np.concatenate([*sums, []])})

    out = tokens.select("doc_id", score("ids").alias("x")).select("doc_id", "x.n_tokens", "x.log_prob")
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def score_documents_masked(documents: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", **settings: int) -> DataFrame:
    """Tokens are made once and stored; the network is trained on them and scores them."""
    encoder = worker_encoder(tokenizer, 0)
    size = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
    kind = encoder.kind.str
    tokens = stored(tokenized(documents, tokenizer, doc_id, text), "masked-lm-tokens")
    return score_tokens(tokens, learn_masked_lm(tokens, size, kind, **settings), kind)
