"""Language identification by word-first backoff.

A word known from training counts with its logarithmic frequency in each language. A word
never seen falls back to character n-grams of its padded form: the longest order of which
any n-gram is known decides, down to single characters. A text's language is the one with
the largest sum.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import learnable, named, stored

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; marks such as superscript digits split words."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


class BackoffModel:
    """Log frequencies of words and of n-grams of orders 1 to `order`, for each language.

    Built from (language, word, count) triples. Words below `min_count` are left to the
    n-grams; the `max_words` most frequent words and `max_grams` most frequent n-grams of
    an order are kept for each language, which bounds the model by its parameters. A level
    is the row of each key in a table with a column for each language.
    """

    def __init__(
        self,
        counts: Iterable[tuple[str, str, int]],
        order: int = 4,
        min_count: int = 2,
        max_words: int = 30_000,
        max_grams: int = 8_000,
    ):
        self.order = order
        words: dict[str, Counter] = {}
        grams: list[dict[str, Counter]] = [{} for _ in range(order)]
        for language, word, n in counts:
            own = words.setdefault(language, Counter())
            if n >= min_count:
                own[word] += n
            for k in range(1, order + 1):
                level = grams[k - 1].setdefault(language, Counter())
                for gram in self._grams(word, k):
                    level[gram] += n
        self.languages = sorted(words)
        self.words = self._logs([words[x] for x in self.languages], max_words)
        self.grams = [self._logs([level[x] for x in self.languages], max_grams) for level in grams]

    @classmethod
    def of_tables(cls, languages: list[str], levels: list[dict[str, Counter]], totals: list[dict[str, int]], most: list[int]) -> BackoffModel:
        """From the largest counts of words (level 0) and n-grams of each order, and the sums of all counts."""
        model = cls([], len(levels) - 1)
        model.languages = sorted(languages)
        tables = [
            cls._logs([level.get(x, Counter()) for x in model.languages], n, [total.get(x, 0) for x in model.languages])
            for level, total, n in zip(levels, totals, most, strict=True)
        ]
        model.words, model.grams = tables[0], tables[1:]
        return model

    @staticmethod
    def _grams(word: str, k: int) -> list[str]:
        """The n-grams of order k of a word between spaces; single characters without them."""
        padded = f" {word} " if k > 1 else word
        return [padded[at : at + k] for at in range(len(padded) - k + 1)]

    @staticmethod
    def _logs(counters: list[Counter], most: int, sums: list[int] | None = None) -> tuple[dict[str, int], np.ndarray]:
        """Unknown keys count alike in all languages, so that one of few rows does not win by what it lacks."""
        totals = [max(1, n) for n in sums or [sum(c.values()) for c in counters]]
        kept = [sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most] for c in counters]
        rows: dict[str, int] = {}
        for own in kept:
            for key, _ in own:
                rows.setdefault(key, len(rows))
        table = np.full((len(rows), len(counters)), math.log(0.5 / max(totals, default=1)))
        for i, own in enumerate(kept):
            for key, n in own:
                table[rows[key], i] = math.log(n / totals[i])
        return rows, table

    def word_scores(self, word: str) -> np.ndarray:
        rows, table = self.words
        if word in rows:
            return table[rows[word]]
        for k in range(self.order, 0, -1):
            rows, table = self.grams[k - 1]
            found = [rows[g] for g in self._grams(word, k) if g in rows]
            if found:
                return table[found].mean(axis=0)
        return np.zeros(len(self.languages))


class Predictor:
    """Scores texts with a model; remembers the scores of words it has met, in bounded room."""

    def __init__(self, model: BackoffModel, room: int = 400_000):
        self.model, self.room = model, room
        self.seen: dict[str, int] = {}
        self.table = np.zeros((room, max(1, len(model.languages))))

    def rows(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        found = [seen.get(w, -1) for w in words]
        if -1 in found:
            new = [w for w, at in zip(words, found, strict=True) if at < 0]
            if len(seen) + len(set(new)) > self.room:
                seen.clear()
                new = words
            for w in dict.fromkeys(new):
                if len(seen) == self.room:  # one text with more words than there is room for
                    return np.array([self.model.word_scores(w) for w in words])
                self.table[len(seen)] = self.model.word_scores(w)
                seen[w] = len(seen)
            found = [seen[w] for w in words]
        return self.table[found]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        total = self.rows(words).sum(axis=0)
        best = int(np.argmax(total))
        return self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def learn_languages(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows_per_language: int = 2_000,
    min_count: int = 2,
    order: int = 4,
    max_words: int = 30_000,
    max_grams: int = 8_000,
) -> BackoffModel:
    """Fit a model on the rows that are not held out and name a language.

    The fit uses whole texts of about `rows_per_language` rows of each language (all, where
    there are fewer), chosen by a hash of the id: a bound on labelled rows, whatever the
    table's size. N-grams are counted of all words, those met once too, in Spark; only the
    counts that the model keeps, and those equal to the least kept, come to the driver. Rows
    with a null id, text or language teach nothing, nor do languages without a letter.
    """
    rows = named(documents, _id=doc_id, _text=text, _lang=lang)
    rows = rows.where(learnable(F.col("_id")) & F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return BackoffModel([], order)
    share = F.create_map(*[F.lit(x) for lang_, n in sizes.items() for x in (lang_, min(1.0, rows_per_language / n))])
    draw = F.pmod(F.xxhash64("_id", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(draw < share[F.col("_lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for language, body in zip(batch["_lang"], batch["_text"], strict=True):
                counts.setdefault(language, Counter()).update(words_of(body))
            flat = [(language, w, n) for language, c in counts.items() for w, n in c.items()]
            yield pd.DataFrame(flat, columns=["lang", "word", "n"])

    counted = sample.select("_lang", "_text").mapInPandas(count, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def levels_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for language, word, n in zip(batch["lang"], batch["word"], batch["n"].tolist(), strict=True):
                if n >= min_count:
                    counts[language, 0, word] += n
                for k in range(1, order + 1):
                    for gram in BackoffModel._grams(word, k):
                        counts[language, k, gram] += n
            flat = [(*key, n) for key, n in counts.items()]
            yield pd.DataFrame(flat, columns=["lang", "level", "key", "n"])

    kind = "lang string, level int, key string, n long"
    tables = stored(counted.mapInPandas(levels_of, kind).groupBy("lang", "level", "key").agg(F.sum("n").alias("n")), "language-counts")
    # How many keys have each count: from it the sums, and the least count that is kept.
    totals: list[dict[str, int]] = [{} for _ in range(order + 1)]
    least, met = {}, Counter()
    most = [max_words, *[max_grams] * order]
    for r in sorted(tables.groupBy("lang", "level", "n").agg(F.count("*").alias("keys")).collect(), key=lambda r: -r["n"]):
        language, level = r["lang"], r["level"]
        totals[level][language] = totals[level].get(language, 0) + r["n"] * r["keys"]
        if met[language, level] < most[level]:
            least[language, level] = r["n"]
        met[language, level] += r["keys"]
    bounds = documents.sparkSession.createDataFrame([(*key, n) for key, n in least.items()], "lang string, level int, least long")
    found = tables.join(F.broadcast(bounds), ["lang", "level"]).where(F.col("n") >= F.col("least")).select("lang", "level", "key", "n").toArrow()
    levels: list[dict[str, Counter]] = [{} for _ in range(order + 1)]
    for batch in found.to_batches(10_000):
        for language, level, key, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            levels[level].setdefault(language, Counter())[key] = n
    return BackoffModel.of_tables(list(totals[1]) if order else list(totals[0]), levels, totals, most)


def language_column(spark, model: BackoffModel, text: Column) -> Column:
    """struct(lang_pred, score) of a text column.

    `und` with score 0 where the text is null or has no letter, or where no language was
    learned. Equal sums go to the language that sorts first.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(shared.value)
        for batch in batches:
            yield pd.DataFrame([predictor.predict(t) for t in batch], columns=["lang_pred", "score"])

    return predict(text)


def identify_languages(documents: DataFrame, model: BackoffModel, text: str = "text") -> DataFrame:
    """The rows with `lang_pred` and `score` appended; every row once, whatever its text."""
    kept = [F.col(f"`{c}`") for c in documents.columns if c not in ("lang_pred", "score")]
    found = language_column(documents.sparkSession, model, F.col(f"`{text}`"))
    scored = documents.select(*kept, found.alias("_found_language"))
    return scored.select(*kept, "_found_language.lang_pred", "_found_language.score")
