"""Resampling towards a target distribution by hashed features.

Each document is weighed by how much likelier its features are in the target than in the
corpus. The gains of all buckets are one array, so a weight is a fold over a document's
buckets. Gumbel noise from a hash of the id turns the draw without replacement into taking
the highest scores; where they end is found from a quantile sketch, which only brackets the
cut: exact counts outside the bracket prove that it holds the cut, else it is widened, and
only the bracket is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, stored
from .decontaminate import words_of
from .ranking import numbered

SCORED = ["doc_id", "n_words", "n_features", "weight", "score", "row"]


def feature_buckets(words: Column, buckets: int, shortest: int = 1, longest: int = 1) -> Column:
    """The bucket of every run of `shortest` to `longest` words joined by a space, repeats kept."""

    def runs(n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return words if n == 1 else F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))

    features = [runs(n) for n in range(shortest, longest + 1)]
    return F.transform(F.concat(*features), lambda run: F.crc32(run.cast("binary")) % buckets)


def bucket_counts(texts: DataFrame, buckets: int, shortest: int = 1, longest: int = 1, text: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket; each map task sends at most one row a bucket."""
    found = named(texts, text=text).select(F.explode(feature_buckets(words_of(F.col("text")), buckets, shortest, longest)).alias("bucket"))
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """floor(1000 ln of the ratio of smoothed shares, target over corpus) for bucket 0, 1, ...

    Both frames are counts by bucket; the result has `buckets` entries, a parameter.
    """
    totals = [counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for counts in (corpus, target)]
    both = corpus.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "full")
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    wide = [F.lit(float(total + buckets)) for total in totals]
    gain = F.floor(1000 * F.log((t + 1) * wide[0] / ((s + 1) * wide[1])))
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(both, "bucket", "left")
    return [r["gain"] for r in every.orderBy("bucket").select(gain.alias("gain")).collect()]


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variate) from the id's hash; a null id hashes like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def score_documents(documents: DataFrame, gains: list[int], seed: int, doc_id: str = "doc_id", text: str = "text", shortest: int = 1, longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, row) of every row, stored; `row` tells rows apart.

    A null or empty text has no features and weight 0. Other columns of the input, whatever
    their names, play no part.
    """
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded into one constant
    rows = named(documents, doc_id=doc_id, text=text).select("doc_id", words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), feature_buckets(F.col("words"), len(gains), shortest, longest).alias("buckets"))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.get(table, b.cast("int")))
    rows = rows.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return stored(rows.select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), F.monotonically_increasing_id().alias("row")), "scored-documents")


def in_order() -> list[Column]:
    """Highest score first; ties to the smaller id, null ids last, then by row."""
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]


def bracket(scored: DataFrame, rank: int, rows: int, accuracy: int = 10_000) -> tuple[int, int, int]:
    """(low, high, above): the row at `rank` of `rows` has a score from low to high, and `above` rows exceed high.

    A mergeable sketch names the two scores; counting the rows on either side is exact. A
    bracket that misses the rank is widened on the side it misses, up to the least or greatest score.
    """
    at = 1 - rank / rows
    below = over = 2 / accuracy
    while True:
        ends = F.percentile_approx("score", [max(0.0, at - below), min(1.0, at + over)], accuracy)
        found = scored.agg(ends.alias("ends"), F.min("score").alias("least"), F.max("score").alias("most")).first()
        low = found["ends"][0] if at > below else found["least"]
        high = found["ends"][1] if at + over < 1 else found["most"]
        counts = scored.agg(F.count(F.when(F.col("score") > high, 1)).alias("above"), F.count(F.when(F.col("score") >= low, 1)).alias("reached")).first()
        if counts["above"] < rank <= counts["reached"]:
            return low, high, counts["above"]
        below, over = (below, 8 * over) if counts["above"] >= rank else (8 * below, over)


def drawn(scored: DataFrame, rank: int, rows: int, accuracy: int = 10_000) -> Column:
    """Whether a row of `scored` is among the first `rank` of its `rows`, as a test on the row alone."""
    if rank <= 0:
        return F.lit(False)
    low, high, above = bracket(scored, rank, rows, accuracy)
    inside = numbered(scored.where(F.col("score").between(low, high)), in_order(), "place")
    last = inside.where(F.col("place") == rank - above).first()
    same_id = F.col("doc_id").eqNullSafe(F.lit(last["doc_id"])) & (F.col("row") <= last["row"])
    before = F.col("doc_id").isNotNull() if last["doc_id"] is None else F.col("doc_id") < last["doc_id"]
    tied = (F.col("score") == last["score"]) & (F.coalesce(before, F.lit(False)) | same_id)
    return (F.col("score") > last["score"]) | tied


def resample(
    documents: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = 10,
    least_words: int = 20,
    buckets: int = 10_000,
    shortest: int = 1,
    longest: int = 1,
    seed: int = 2024,
    accuracy: int = 10_000,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank, row) of every row of `documents`.

    Of the rows with at least `least_words` words, floor(percent / 100) of them are drawn: the
    highest scores, ties to the smaller id, null ids after all others. `rank` numbers the drawn
    rows 1, 2, 3...; others have none. Rows that repeat an id, or a whole row, are rows of their
    own. Null and empty texts weigh 0 and, with no words, are not drawn; an empty target gives
    every bucket the smoothed share of none; no documents give no rows. Columns of the same
    names as those used inside play no part.
    """
    corpus = stored(bucket_counts(documents, buckets, shortest, longest, text), "corpus-buckets")
    wanted = stored(bucket_counts(target, buckets, shortest, longest, target_text), "target-buckets")
    scored = score_documents(documents, bucket_gains(corpus, wanted, buckets), seed, doc_id, text, shortest, longest)
    able = scored.where(F.col("n_words") >= least_words)
    rows = able.count()
    chosen = (F.col("n_words") >= least_words) & drawn(able, rows * percent // 100, rows, accuracy)
    ranked = numbered(scored.where(chosen), in_order())
    rest = scored.where(~chosen).select("*", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank", "row")
