import random

import numpy as np
from helpers import DOCS, awkward, clashing, documents, prose, rows_of

from queuesight.llm.quality import WIDTH, AttentionModel, learn_quality, passages, score_quality


def corpus(n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randint(60, 400))
        good = rng.random() < 0.7
        if not good:  # one bad passage in an otherwise usual text
            w = text.split()
            at = rng.randint(0, max(0, len(w) - 60))
            w[at : at + 60] = [x.upper() + "!!" for x in w[at : at + 60]]
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_of_held_out_documents(spark):
    rows, labels = corpus()
    df = clashing(documents(spark, rows + [(None if i is None else 1000 + i, t) for i, t in awkward()]))
    taught = spark.createDataFrame(labels + [(None, 1), (3, None), (5, 0)], "doc_id long, quality int")
    got = score_quality(df, learn_quality(df, taught)).collect()
    assert len(got) == len(rows) + len(awkward())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    import zlib

    own = {r.doc_id: r.predicted for r in got}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([own[i] == labels[i][1] for i in held]) > 0.95


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    model = AttentionModel(6, 4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, starts, labels = rng.random((9, WIDTH)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        y = model.forward(x, starts)["y"]
        return -np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y))

    for k, g in model.gradients(x, starts, labels).items():
        flat, at = model.p[k].reshape(-1), 1 % model.p[k].size
        keep, step = flat[at], 1e-6
        flat[at] = keep + step
        up = loss()
        flat[at] = keep - step
        down = loss()
        flat[at] = keep
        assert abs((up - down) / (2 * step) - g.reshape(-1)[at]) < 1e-5, k


def test_scores_do_not_depend_on_the_company():
    model = AttentionModel()
    bags = [passages(t) for _, t in awkward()]
    alone = np.concatenate([model.scores([b]) for b in bags])
    assert np.allclose(alone, model.scores(bags), atol=1e-5)
    assert all(b.shape[1] == WIDTH for b in bags) and np.isfinite(alone).all()


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    df = documents(spark, awkward())
    assert score_quality(df, learn_quality(df, none)).count() == len(awkward())
    empty = spark.createDataFrame([], DOCS)
    assert rows_of(score_quality(empty, learn_quality(empty, none))) == []


def plain_passages(text):
    """Features of each 512 bytes, one byte after another."""
    data = (text or "").encode()
    if not data:
        return [[0.0] * WIDTH]

    def bucket(a, b):
        x = ((a * 2654435761 + b * 40503 * 65537) % 2**32) >> 16
        return (x ^ (x >> 7)) % 512

    def kind(b):
        c = chr(b)
        if b >= 128:
            return 6
        return 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c == " " else 5 if c == "\n" else 7 if c in ".,;" else 0

    out, earlier = [], []
    for at in range(0, len(data), 512):
        part = data[at : at + 512]
        pairs, kinds = [0.0] * 512, [0.0] * 8
        for i, b in enumerate(part):
            pairs[bucket(b, data[at + i + 1] if at + i + 1 < len(data) else 10)] += 1 / len(part)
            kinds[kind(b)] += 1 / len(part)
        seen = [sum(p[j] for p in earlier) / len(earlier) for j in range(512)] if earlier else [0.0] * 512
        out.append([p**0.5 for p in pairs] + [k**0.5 for k in kinds] + [sum(p * p for p in pairs) ** 0.5, sum(map(min, pairs, seen))])
        earlier.append(pairs)
    return out


def plain_score(model, rows):
    p = {k: v.astype(float) for k, v in model.p.items()}
    hidden = [np.tanh(np.array(x) @ p["E"] + p["e"]) for x in rows]
    weight = [np.exp((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]) for h in hidden]
    mean = sum(w * h for w, h in zip(weight, hidden, strict=True)) / sum(weight)
    return float(1 / (1 + np.exp(-(mean @ p["c"] + p["d"][0]))))


def test_passages_and_scores_against_a_plain_version(spark):
    rng = random.Random(8)
    texts = [t for _, t in awkward(rng)][:12] + [prose(rng, n) for n in (1, 90, 300)] + ["ABC. 12;\n" * 300]
    model = AttentionModel(seed=3)
    for text in texts:
        assert np.allclose(passages(text), plain_passages(text), atol=2e-6)
    df = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: (r.score, r.predicted) for r in score_quality(df, model).collect()}
    for i, text in enumerate(texts):
        want = plain_score(model, plain_passages(text))
        assert abs(got[i][0] - want) < 1e-4 and got[i][1] == int(got[i][0] >= 0.5)
