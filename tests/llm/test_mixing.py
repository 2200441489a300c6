import random

import numpy as np
from helpers import DOCS, awkward, clashing, documents, prose, rows_of

from queuesight.llm.mixing import domain_posteriors, draw_documents, fit_rates, label_domains, learn_domains, mix_documents

SHARES = {"good": 0.7, "poor": 0.2, "toxic": 0.1}


def corpus():
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        kind = rng.choice(["good"] * 6 + ["poor"] * 2 + ["toxic"])
        text = prose(rng, rng.randint(20, 120))
        if kind == "poor":
            text = text.replace(" ", "%%% ")
        if kind == "toxic":
            text += " moron scum" * 3
        rows.append((i, text))
        if i % 3:
            labels.append((i, 0 if kind == "poor" else 1, int(kind == "toxic")))
    return rows, labels


def frames(spark, rows, labels):
    return clashing(documents(spark, rows)), label_domains(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def plain_fit(p, t, targets, steps=60, tolerance=1e-6):
    """Projected gradient descent with a rate for each document, as numpy says it."""
    moments = (t[:, None, None] * p[:, :, None] * p[:, None, :]).sum(axis=0) + 1e-9 * t.sum() * np.eye(p.shape[1])
    r, error = np.ones(len(t)), np.inf
    for _ in range(steps):
        gap = (r * t) @ p - targets
        step = np.linalg.solve(moments, gap)
        if np.abs(gap).max() <= tolerance * targets.sum() or gap @ step >= error * (1 - 1e-6):
            break
        error = gap @ step
        r = np.maximum(0, r - p @ step)
    return r


def test_rates_meet_the_targets_and_are_the_plain_ones(spark):
    rows, labels = corpus()
    df, labelled = frames(spark, rows, labels + [(None, 1, 0), (1, None, None), (2, 1, 0)])
    rates, mix = mix_documents(df, labelled, SHARES)
    got = rates.toPandas().sort_values("doc_id")
    p, t = got[["p_good", "p_poor", "p_toxic"]].to_numpy(), got["n_tokens"].to_numpy(float)
    assert np.allclose(p.sum(axis=1), 1) and (got["rate"] >= 0).all()
    reached = (got["rate"].to_numpy() * t) @ p
    assert np.allclose(reached, mix.targets, rtol=1e-3) and np.allclose(mix.targets, t.sum() * np.array([0.7, 0.2, 0.1]))
    assert np.allclose(got["rate"], plain_fit(p, t, np.array(mix.targets)), atol=1e-7)
    poor = got["doc_id"].isin([i for i, x in rows if "%%%" in x])
    assert got[poor]["p_poor"].mean() > 0.9 and got[~poor]["p_poor"].mean() < 0.05


def test_posteriors_are_naive_bayes(spark):
    rows, labels = corpus()
    df, labelled = frames(spark, rows[:40], labels)
    domains = sorted(SHARES)
    weights = {r.word: np.array(r.w) for r in learn_domains(df, labelled, domains).collect()}
    got = domain_posteriors(df, learn_domains(df, labelled, domains), domains).collect()
    for r in got:
        words = {w for w in rows[r.doc_id][1].lower().replace(".", " ").replace(",", " ").split()}
        total = weights[""] + sum((weights[w] for w in words if w in weights), np.zeros(3))
        want = np.exp(total - total.max())
        assert np.allclose([r.p0, r.p1, r.p2], want / want.sum())


def test_keep_whole_and_cut_at_zero(spark):
    rows = [(i, 1, 10, 1.0 if i < 50 else 0.5, 0.0 if i < 50 else 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, copies long, n_tokens long, p0 double, p1 double")
    kept = fit_rates(df, ["a", "b"], {"a": 0.9, "b": 0.1}, keep_whole="a")
    assert kept.targets[0] == kept.natural[0] and np.allclose(kept.reached, kept.targets, rtol=1e-4)
    none = fit_rates(df, ["a", "b"], {"a": 1.0})
    rates = df.select(none.rate().alias("r")).toPandas()["r"]
    assert rates.min() >= 0 and rates.iloc[-1] < 0.2
    p, t = np.array([r[3:] for r in rows]), np.full(60, 10.0)
    assert np.allclose(rates, plain_fit(p, t, np.array(none.targets)), atol=1e-7)


def test_awkward_rows(spark):
    rows, labels = corpus()
    odd = awkward()
    df, labelled = frames(spark, rows + [(None if i is None else 1000 + i, t) for i, t in odd], labels)
    rates, _ = mix_documents(df, labelled, SHARES)
    got = rates.collect()
    assert sum(r.copies for r in got) == len(rows) + len(odd)
    assert len(got) == len(rows) + len(set(odd)) and all(r.rate is not None and r.rate >= 0 for r in got)


def test_empty_tables(spark):
    df, labelled = frames(spark, [], [])
    assert rows_of(mix_documents(df, labelled, SHARES)[0]) == []
    df, labelled = frames(spark, [(1, "some text"), (2, None)], [])
    got = mix_documents(df, labelled, SHARES)[0].collect()
    assert len(got) == 2 and all(abs(r.p_good - 1 / 3) < 1e-9 for r in got)
    assert spark.createDataFrame([], DOCS).count() == 0


def test_domains_below_their_targets_reach_them_when_drawn(spark):
    rows = [(i, *((0.02, 0.97, 0.01) if i % 40 == 0 else (0.01, 0.02, 0.97) if i % 90 == 1 else (0.98, 0.015, 0.005))) for i in range(3_600)]
    df = spark.createDataFrame([(i, 0, 1, 100, *p) for i, *p in rows], "doc_id long, th long, copies long, n_tokens long, p0 double, p1 double, p2 double")
    shares = {"good": 0.87, "poor": 0.09, "toxic": 0.04}  # poor has under 5 % of the tokens, toxic under 2 %
    mix = fit_rates(df, list(shares), shares, keep_whole="good", most=1.0)
    got = df.withColumn("rate", mix.rate()).toPandas()
    assert got["rate"].between(0, 1).all()
    share = [(got["rate"] * got[f"p{k}"]).sum() / got["rate"].sum() for k in range(3)]
    assert np.allclose(share, [0.87, 0.09, 0.04], atol=2e-3)
    assert np.allclose(mix.reached, mix.targets, atol=2e-3 * sum(mix.targets)) and sum(mix.targets) < sum(mix.natural)
    assert got["rate"].max() > 0.99
    texts = df.selectExpr("doc_id", "CAST(NULL AS STRING) AS text", "p1", "p2")
    key = spark.sql("SELECT xxhash64('') AS th").first().th
    drawn = draw_documents(texts, df.withColumn("rate", mix.rate()).withColumn("th", df["th"] + key)).toPandas()
    assert abs(drawn["p1"].mean() - 0.09) < 0.02 and abs(drawn["p2"].mean() - 0.04) < 0.015


def test_rates_written_between_steps_are_those_of_one_expression(spark, monkeypatch, tmp_path):
    from queuesight.llm import mixing

    rng = random.Random(7)
    rows = [(i, i, 1, rng.randint(0, 90), *(p := sorted((rng.random(), rng.random())))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, th long, copies int, n_tokens long, p0 double, p1 double")
    df = df.selectExpr("doc_id", "th", "copies", "n_tokens", "p0 / (p0 + p1) AS p0", "p1 / (p0 + p1) AS p1")
    depths, plain = [], mixing.Mix.rate
    monkeypatch.setattr(mixing.Mix, "rate", lambda self, start=None, done=0: depths.append(len(self.steps) - done) or plain(self, start, done))
    fits = []
    for held in (2, 1_000):
        monkeypatch.setattr(mixing, "STEPS_HELD", held)
        fits.append(fit_rates(df, ["a", "b"], {"a": 0.97, "b": 0.03}, most_steps=9, tolerance=1e-12))
        assert len(fits[-1].steps) > 3 and max(depths) <= held
        depths.clear()
    one, other = (np.array(df.select(f.rate()).collect()) for f in fits)
    assert np.allclose(one, other, atol=1e-9) and np.allclose(fits[0].reached, fits[1].reached)
