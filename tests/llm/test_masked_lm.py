import random

import numpy as np
import public_tokenizers
from helpers import DOCS, awkward, clashing, documents, prose, rows_of
from tokenizers import Tokenizer

from queuesight.llm import masked_lm
from queuesight.llm.masked_lm import ContextNetwork, learn_masked_lm, score_documents_masked, score_tokens, token_counts, tokenized

PATH = public_tokenizers.path("word_bpe_49k.json")
SIZE, KIND = 49_408, "<u2"


def plain(network, ids):
    """The score by the definition, token for token and over the whole vocabulary."""
    p = {k: v.astype(np.float64) for k, v in network.p.items()}
    edges = [network.edge] * network.side
    x = [*edges, *network.rank[ids].tolist(), *edges]
    total = 0.0
    for i in range(network.side, len(x) - network.side):
        h = np.tanh(p["b"] + sum(p["E"][x[i + j - network.side]] @ p["W"][j] for j in network.places()))
        z = p["C"] @ h + p["c"]
        of_class = z - np.log(np.exp(z).sum())
        y = p["O"] @ h + p["o"]
        own = network.classes == network.classes[x[i]]
        total += of_class[network.classes[x[i]]] + y[x[i]] - np.log(np.exp(y[own]).sum())
    return total


def test_scores_are_sums_over_the_tokens_of_a_public_tokenizer(spark):
    rows = [r for r in awkward() if r[0] not in (4, 12)] + [(60 + i, prose(random.Random(i), 30)) for i in range(20)]
    tokens = tokenized(clashing(documents(spark, rows)), PATH)
    network = learn_masked_lm(tokens, SIZE, KIND, hidden=8)
    got = score_tokens(tokens, network, KIND).collect()
    tokenizer = Tokenizer.from_file(PATH)
    assert len(got) == len(rows)
    for r, (doc, text) in zip(got, rows, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.mean_log_prob is None) == (doc, len(ids), not ids)
        want = plain(network, ids)
        assert abs(r.log_prob - want) < 1e-3 * max(1, abs(want))


def test_gradients_are_those_of_the_loss():
    network = ContextNetwork(np.arange(200)[::-1] ** 2, hidden=5, side=3)
    rng = np.random.default_rng(0)
    network.p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.1 for k, v in network.p.items()}
    x = network.stream([rng.integers(0, 200, n) for n in (40, 0, 1, 25)])[0]
    found = {k: np.zeros_like(v) for k, v in network.p.items()}
    for key, rows, g in network.gradients(x):
        found[key][rows] += g
    for key, value in network.p.items():
        for at in rng.integers(0, value.size, 6):
            flat, step, both = value.reshape(-1), 1e-5, []
            if key == "W" and at // value[0].size == network.side:
                continue
            for sign in (1, -1):
                flat[at] += sign * step
                both.append(-network.log_probabilities(x).sum())
                flat[at] -= sign * step
            assert abs((both[0] - both[1]) / (2 * step) - found[key].reshape(-1)[at]) < 1e-4, key


def test_rare_words_and_distant_neighbours_matter(spark):
    rng = random.Random(2)
    usual = [f"{a} {b} of the {c}" for a, b, c in [("brass", "kettle", "harbour"), ("green", "garden", "village")]]
    rows = [(i, ". ".join(rng.choice(usual) for _ in range(12))) for i in range(60)]
    cases = {
        1: "brass kettle of the harbour",
        2: "brass kettle of the village",  # three tokens from its nearest cue
        3: "brass garden of the harbour",
        4: "brass qzxvkw of the harbour",  # letters of the same length and kind as 'kettle'
    }
    tokens = tokenized(documents(spark, rows), PATH)
    network = learn_masked_lm(tokens, SIZE, KIND)
    got = {r.doc_id: r.log_prob for r in score_tokens(tokenized(documents(spark, list(cases.items())), PATH), network, KIND).collect()}
    assert got[1] > max(got[2], got[3], got[4]) + 1


def test_all_rows_are_trained_on(spark):
    rows = awkward() + [(60 + i, prose(random.Random(i), 50)) for i in range(40)]
    tokens = tokenized(documents(spark, rows), PATH)
    tokenizer = Tokenizer.from_file(PATH)
    want = np.bincount([i for _, t in rows for i in tokenizer.encode(t or "", add_special_tokens=False).ids], minlength=SIZE)
    turns = token_counts(tokens, SIZE, KIND)
    assert (sum(turns) == want).all() and sum(t.any() for t in turns) > 1


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], DOCS)
    assert rows_of(score_documents_masked(empty, PATH)) == []
    got = score_documents_masked(documents(spark, [(1, None), (2, "")]), PATH).collect()
    assert [(r.n_tokens, r.log_prob, r.mean_log_prob) for r in got] == [(0, 0.0, None)] * 2


def test_pieces_and_far_logits_do_not_matter(monkeypatch):
    rng = np.random.default_rng(1)
    for far in (1, 40):
        network = ContextNetwork(np.arange(300)[::-1] ** 2, hidden=6, side=2)
        network.p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.1 for k, v in network.p.items()}
        network.p["O"] *= far
        network.p["o"] *= far
        texts = [rng.integers(0, 300, n) for n in (90, 0, 1, 40)] + [np.zeros(60, np.int64), rng.integers(0, 3, 50)]
        x, place = network.stream(texts)
        scores, changes = [], []
        for piece, few in ((512, 32), (7, 0), (7, 3), (1, 1)):
            monkeypatch.setattr(masked_lm, "PIECE", piece)
            monkeypatch.setattr(masked_lm, "FEW", few)
            scores.append(network.log_probabilities(x))
            changes.append({key: np.zeros_like(value) for key, value in network.p.items()})
            for key, rows, g in network.gradients(x):
                changes[-1][key][rows] += g
        for score, change in zip(scores, changes, strict=True):
            assert np.allclose(score, scores[0], rtol=1e-9, atol=1e-9)
            assert all(np.allclose(change[key], changes[0][key], rtol=1e-7, atol=1e-9) for key in change)
        sums = np.bincount(place[2:-2][place[2:-2] >= 0], scores[0][place[2:-2] >= 0], len(texts))
        assert np.allclose(sums, [plain(network, ids) for ids in texts], rtol=1e-9)


def test_a_stream_without_tokens():
    network = ContextNetwork(np.arange(50), hidden=4)
    x = network.stream([np.zeros(0, np.int64)])[0]
    assert not network.log_probabilities(x).any()
    assert all(not np.asarray(g).any() for _, _, g in network.gradients(np.full(9, network.edge)))
