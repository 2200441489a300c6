"""Soft-membership mixing: document rates whose expected domain totals match target weights.

A classifier fitted on a labelled table gives every document a posterior over the domains.
A document of t tokens at rate r is expected to give r * t * p_k tokens to domain k. Projected
gradient descent finds rates, none negative, whose totals are closest to the targets in
least squares, starting from rate 1. The gaps are weighed by the inverse of the posteriors'
second moments, which makes the curvature the same in all directions: without a rate at zero
one step meets the targets, and with the least change to the rates.

Every step moves a rate by the same few numbers (one for each domain) times the posterior and
cuts it at zero, so a rate is an expression of the posterior and the steps so far. A step is
one aggregate over the posteriors. The expression would grow with the steps, so the rates are
written every few steps and the next steps start from them. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, remove_path
from .common import matching, named, small, stored, text_key

BETWEEN_WORDS = r"[\s.,;:]+"
STEPS_HELD = 6  # steps in one expression while the rates are fitted
ANY = ""  # the pseudo-word every document has; its weights are the priors


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS, -1)


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit(ANY)), _words(text)))


def learn_domains(
    documents: DataFrame,
    labelled: DataFrame,
    domains: list[str],
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    domain: str = "domain",
    most_rows: int = 20_000,
    most_words: int = 5_000,
    least_rows: int = 10,
) -> DataFrame:
    """(word, w): the weights of a multinomial naive Bayes classifier on a document's distinct words.

    `w` holds a logarithm for each of `domains`; a word's share in a domain is smoothed
    towards its share in all of them, by one count on average. The fit uses about
    `most_rows` labelled rows (all where there are fewer), chosen by a hash of the id, and keeps
    the `most_words` words with the largest chi-square among those that `least_rows` labelled
    rows have: bounds on the model, not on the documents scored. Rows with a null id, text or domain, or another domain, teach nothing.
    """
    labels = named(labelled, label_id=label_id, domain=domain).where(F.col("label_id").isNotNull() & F.col("domain").isin(domains))
    labels = labels.dropDuplicates(["label_id"])
    rate = min(1.0, most_rows / max(1, labels.count()))
    draw = F.pmod(F.xxhash64("label_id", F.lit("domain sample")), F.lit(1_000_000)) / 1_000_000
    labels = F.broadcast(labels.where(draw < rate))  # about most_rows narrow rows at most
    docs = named(documents, doc_id=doc_id, text=text).where(F.col("text").isNotNull())
    taught = docs.join(labels, F.col("doc_id") == F.col("label_id"))
    counts = [F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains)]
    found = stored(taught.select("domain", F.explode(_distinct_words(F.col("text"))).alias("word")).groupBy("word").agg(*counts), "domain-words")
    sizes = found.where(F.col("word") == ANY).first()
    n = [sizes[f"n{k}"] if sizes else 0 for k in range(len(domains))]
    total = max(1, sum(n))
    seen = sum((F.col(f"n{k}") for k in range(len(n))), F.lit(0))
    chi = sum((F.pow(F.col(f"n{k}") - seen * (n[k] / total), 2) / (seen * max(n[k], 0.5) / total) for k in range(len(n))), F.lit(0.0))
    known = found.where((F.col("word") != ANY) & (seen >= least_rows))
    best = stored(known.orderBy(chi.desc(), "word").limit(most_words), "domain-vocabulary")
    sums = best.agg(F.count("*").alias("v"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(n))]).first()
    mass = [sums[f"n{k}"] or 0 for k in range(len(n))]
    share = seen / max(1, sum(mass))
    weights = F.array(*[F.log((F.col(f"n{k}") + share * sums["v"]) / (m + sums["v"])) for k, m in enumerate(mass)])
    priors = F.array(*[F.log(F.lit((x + 0.5) / (total + 0.5 * len(n)))) for x in n])
    any_word = documents.sparkSession.range(1).select(F.lit(ANY).alias("word"), priors.alias("w"))
    return best.select("word", weights.alias("w")).unionByName(any_word)


def domain_posteriors(documents: DataFrame, weights: DataFrame, domains: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, copies, n_tokens, p0, p1, ...) of each distinct (id, text).

    `copies` counts the rows that repeat both. Null and empty texts have no tokens and the
    prior as posterior. The words of a document meet the model by a broadcast of at most
    `most_words` rows and are summed before the shuffle.
    """
    docs = named(documents, doc_id=doc_id, text=text)
    parts = docs.select("doc_id", text_key(F.col("text")).alias("th"), F.size(F.array_remove(_words(F.col("text")), "")).alias("n"), _distinct_words(F.col("text")).alias("words"))
    words = parts.select("doc_id", "th", "n", F.explode("words").alias("word"))
    hits = words.join(F.broadcast(weights), "word")
    sums = hits.groupBy("doc_id", "th").agg(
        F.sum(F.when(F.col("word") == ANY, 1).otherwise(0)).alias("copies"),
        F.max("n").cast("long").alias("n_tokens"),
        *[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(domains))],
    )
    logs = [F.col(f"s{k}") / F.col("copies") for k in range(len(domains))]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    mass = [F.exp(x - top) for x in logs]
    return sums.select("doc_id", "th", "copies", "n_tokens", *[(m / sum(mass[1:], mass[0])).alias(f"p{k}") for k, m in enumerate(mass)])


@dataclass
class Mix:
    """What was fitted: natural and target totals, what the rates reach, and the steps."""

    domains: list[str]
    natural: list[float]
    targets: list[float]
    reached: list[float]
    steps: list[list[float]] = field(default_factory=list)
    most: float | None = None

    def rate(self, start: Column | None = None, done: int = 0) -> Column:
        """The rate of a row with the posteriors p0, p1, ...; `start` is the rate after `done` steps, if at hand."""
        out = F.lit(1.0) if start is None else start
        for step in self.steps[done:]:
            out = F.greatest(F.lit(0.0), out - sum((F.col(f"p{k}") * g for k, g in enumerate(step)), F.lit(0.0)))
            if self.most is not None:
                out = F.least(F.lit(self.most), out)
        return out


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a system of as many equations as domains (symmetric, positive definite)."""
    rows = [[*row, x] for row, x in zip(matrix, right, strict=True)]
    for i, row in enumerate(rows):
        for other in rows[i + 1 :]:
            share = other[i] / row[i]
            other[i:] = [x - share * y for x, y in zip(other[i:], row[i:], strict=True)]
    out = [0.0] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        out[i] = (rows[i][-1] - sum(rows[i][j] * out[j] for j in range(i + 1, len(rows)))) / rows[i][i]
    return out


def fit_rates(
    posteriors: DataFrame,
    domains: list[str],
    shares: dict[str, float],
    total: float | None = None,
    keep_whole: str | None = None,
    tolerance: float = 1e-6,
    most_steps: int = 60,
    most: float | None = None,
) -> Mix:
    """Projected gradient descent on the rates.

    `shares` are the target weights (missing domains: 0; scaled to sum 1). The total is
    `total` tokens, or such that domain `keep_whole` keeps its natural total, or the natural
    total of all. Ends when every reached total is within `tolerance` of the sum of targets,
    or no longer comes closer (targets that no rates can meet, such as a domain that no
    document belongs to). Without tokens every rate stays 1.

    `most` bounds the rates, at 1 for rows that are drawn once or not at all. Where the total
    cannot be had with such rates, it is lowered to what the scarcest domain reached allows,
    again until the shares are met within a thousandth of it: that domain is then kept whole.
    `targets` are those of the lowered total. A domain of under a millionth of all tokens
    lowers nothing, so its target is not met.
    """
    ks = range(len(domains))
    mass = [F.col("copies") * F.col("n_tokens") * F.col(f"p{k}") for k in ks]
    gram = [F.sum(mass[i] * F.col(f"p{j}")).alias(f"m{i}_{j}") for i in ks for j in ks]
    first = posteriors.agg(*[F.sum(m).alias(f"n{k}") for k, m in enumerate(mass)], *gram).first()
    natural = [first[f"n{k}"] or 0.0 for k in ks]
    whole = sum(shares.get(d, 0.0) for d in domains)
    if whole <= 0:
        raise ValueError("no target weight is positive")
    share = [shares.get(d, 0.0) / whole for d in domains]
    if total is None:
        at = domains.index(keep_whole) if keep_whole else None
        total = sum(natural) if at is None else natural[at] / share[at]
    mix = Mix(domains, natural, [total * s for s in share], list(natural), most=most)
    if not sum(natural):
        return mix
    # A little is added to the diagonal for domains that no document belongs to.
    least = 1e-9 * sum(natural)
    moments = [[first[f"m{i}_{j}"] + (least if i == j else 0.0) for j in ks] for i in ks]
    error = float("inf")
    rows, done, start, path = posteriors, 0, None, None
    for _ in range(most_steps):
        gaps = [r - t for r, t in zip(mix.reached, mix.targets, strict=True)]
        step = _solved(moments, gaps)
        now = sum(g * s for g, s in zip(gaps, step, strict=True))
        if max(abs(g) for g in gaps) <= tolerance * total or most is None and now >= error * (1 - 1e-6):
            break
        if most is not None and now >= error * 0.5:  # the bound holds the rates back
            scarce = [r / s for r, s, n in zip(mix.reached, share, natural, strict=True) if s and n > 1e-6 * sum(natural)]
            lower = min([total, *scarce])
            if max(abs(g) for g in gaps) <= 1e-3 * total:
                break
            if lower < total:
                total = lower
                mix.targets = [total * s for s in share]
                error = float("inf")
                gaps = [r - t for r, t in zip(mix.reached, mix.targets, strict=True)]
                step = _solved(moments, gaps)
                now = sum(g * s for g, s in zip(gaps, step, strict=True))
            elif now >= error * (1 - 1e-6):
                break
        error = now
        mix.steps.append(step)
        rate = mix.rate(start, done)
        sums = rows.agg(*[F.sum(m * rate).alias(f"n{k}") for k, m in enumerate(mass)]).first()
        mix.reached = [sums[f"n{k}"] or 0.0 for k in ks]
        if len(mix.steps) - done == STEPS_HELD:
            last, path = path, fresh_path(posteriors.sparkSession, "domain-rates")
            held = rows.select("copies", "n_tokens", *[f"p{k}" for k in ks], rate.alias("rate"))
            held.write.parquet(path)
            rows, done, start = posteriors.sparkSession.read.schema(held.schema).parquet(path), len(mix.steps), F.col("rate")
            if last:
                remove_path(posteriors.sparkSession, last)
    if path:
        remove_path(posteriors.sparkSession, path)
    return mix


def mix_documents(
    documents: DataFrame,
    labelled: DataFrame,
    shares: dict[str, float],
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    domain: str = "domain",
    total: float | None = None,
    keep_whole: str | None = None,
    **settings: int,
) -> tuple[DataFrame, Mix]:
    """Posteriors and rate of each distinct (id, text), and the fit.

    Columns doc_id, th (a hash of the text), copies, n_tokens, rate and p_<domain>. The rate
    is how often the document should be drawn; a row that repeats id and text is another copy
    at the same rate. An empty table gives no rows. With `keep_whole` no rate exceeds 1, so
    that rows can be drawn; see fit_rates for the total then met.
    """
    domains = sorted(shares)
    weights = stored(learn_domains(documents, labelled, domains, doc_id, text, label_id, domain, **settings), "domain-weights")
    posteriors = stored(domain_posteriors(documents, weights, domains, doc_id, text), "domain-posteriors")
    mix = fit_rates(posteriors, domains, shares, total, keep_whole, most=1.0 if keep_whole else None)
    named_posteriors = [F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)]
    return posteriors.select("doc_id", "th", "copies", "n_tokens", mix.rate().alias("rate"), *named_posteriors), mix


def draw_documents(documents: DataFrame, rates: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 29) -> DataFrame:
    """The rows kept when each stays with probability min(1, rate), fixed by a hash of id and text.

    Rates of over 1 keep a row once, so rates to draw by should be fitted with `most` 1, as
    mix_documents does with `keep_whole`. All columns are kept as they are, whatever their names.
    """
    draw = F.pmod(F.xxhash64("doc_id", "th", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    gone = stored(rates.where(draw >= F.col("rate")).select("doc_id", "th"), "not-drawn")
    found, same = matching(documents, small(gone), doc_id, text)
    return documents.join(found, same, "left_anti")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a label table: toxic before poor before good; null labels name none."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))
