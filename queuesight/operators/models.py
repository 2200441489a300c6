"""Text classifiers on Spark ML: TF-IDF features and one-vs-rest logistic regression."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.numeric import round_exact
from ..session import BROADCAST_ROWS, fresh_path, small_batches, write_blocks
from .columns import require_no_leak
from .logistic import Problems, fitted, packed
from .splits import class_counts


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends, data): the bytes of all texts in a row, and where each begins, with the end. A null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return ends - ends[0], data[ends[0] : ends[-1]]


def _foreign(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lead, extra, point) of each character that is not ASCII: its first byte, how many follow, its code point."""
    lead = np.flatnonzero(data >= 0xC0)
    extra = (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0) + 1
    point = data[lead] & np.array([0, 0x1F, 0x0F, 0x07])[extra]
    for k in (1, 2, 3):
        more = extra >= k
        point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
    return lead, extra, point


def _without_accents(texts: pa.Array) -> pa.Array:
    """Texts whose characters are decomposed, each by itself, and rid of combining marks. No text is null."""
    ends, data = _utf8(texts)
    lead, _, point = _foreign(data)
    if not len(lead):
        return texts
    found, which = np.unique(point, return_inverse=True)
    forms = [unicodedata.normalize("NFKD", chr(p)) for p in found]
    forms = [np.frombuffer("".join(c for c in form if not unicodedata.combining(c)).encode(), np.uint8) for form in forms]
    lengths = np.array([len(form) for form in forms])
    size = (data < 0x80).astype(np.int32)
    size[lead] = lengths[which]
    place = np.append(0, np.cumsum(size, dtype=np.int64))
    out = np.empty(place[-1], np.uint8)
    plain = data < 0x80
    out[place[:-1][plain]] = data[plain]
    for k in range(lengths.max()):
        byte = np.array([form[k] if len(form) > k else 0 for form in forms], np.uint8)
        at = lengths[which] > k
        out[place[lead[at]] + k] = byte[which[at]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(place[ends].astype("<i4").tobytes()), pa.py_buffer(out.tobytes()))


STEP = 1 << 20  # bytes of text worked on at a time: little enough to stay in the processor's caches
BLOCK = 1 << 23  # bytes of text whose words are numbered together, if a batch has as many


def _slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Texts in turn, some together: those that end in the same `size` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // size)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(texts)], strict=True):
        yield texts.slice(start, end - start)


def _give_back() -> None:
    """Return what Arrow has freed to the system: a worker would keep what its largest batch took, also while it waits."""
    pa.default_memory_pool().release_unused()


def fold_accents(c: Column) -> Column:
    """Lower case without accents (compatibility decomposition, combining marks dropped).

    Only what is not ASCII is decomposed, character by character: a decomposition does not
    depend on the neighbours, and the marks whose order it could change are dropped. A function
    of one batch, not of an iterator, so that a function of the folded text runs in the same step.
    """

    @F.arrow_udf(T.StringType())
    def fold(texts: pa.Array) -> pa.Array:
        _give_back()
        return pa.concat_arrays([_without_accents(part).cast(pa.string()) for part in _slices(texts, STEP)])

    return fold(F.lower(F.coalesce(c, F.lit(""))))


FOLDED = "_folded"


def with_folded(df: DataFrame, text: str) -> DataFrame:
    """Add the folded text that the feature models read."""
    return df.withColumn(FOLDED, fold_accents(F.col(text)))


def tokenizing_stages(text: str) -> list:
    """Words of two characters or more and pairs of neighbouring words, as one array."""
    return [
        RegexTokenizer(
            inputCol=text, outputCol="words", gaps=False, toLowercase=False,
            pattern=r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]{2,}",
        ),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
    ]


TERMS = "_terms"


def with_terms(df: DataFrame, text: str) -> DataFrame:
    """Add the terms that every feature model counts, for frames that several models score in a row."""
    tokenized = PipelineModel(stages=tokenizing_stages(FOLDED)).transform(with_folded(df, text))
    return tokenized.select(*df.columns, F.col("terms").alias(TERMS))


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    """Whether each code point is a letter, a numeral or `_`, as the tokenizing stage has it."""
    return np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(words per text, words): runs of two word characters or more, found in the UTF-8 bytes of all texts at once."""
    ends, data = _utf8(texts)
    known = _word_characters()
    word, after = np.append(known[:128], np.zeros(128, bool))[data], data & 0xC0 == 0x80
    lead, extra, point = _foreign(data)
    for k in range(4):
        word[lead[extra >= k] + k] = known[point[extra >= k]]
    border = np.zeros(len(data) + 1, bool)  # where a text begins or ends
    border[ends] = border[-1:] = True
    first = np.flatnonzero(word & (border[:-1] | ~np.append(False, word)[:-1]))
    last = np.flatnonzero(word & (border[1:] | ~np.append(word, False)[1:])) + 1
    seen = np.append(0, np.cumsum(after, dtype=np.int32)) if len(lead) else np.zeros(len(data) + 1, np.int32)
    long = last - first - (seen[last] - seen[first]) >= 2
    for k in range(4):  # words of one character
        at = first[~long & (last - first > k)]
        word[at + k] = False
    first, last = first[long], last[long]
    places = np.append(0, np.cumsum(last - first)).astype("<i4")
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(places.tobytes()), pa.py_buffer(data[word].tobytes()))
    return np.diff(np.searchsorted(first, ends)), words


def _coded(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(names, codes, sizes) of folded texts or of word arrays: the distinct words, each word's place among them, words per row."""
    if pa.types.is_list(words.type):
        sizes, flat = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False), words.flatten()
    else:
        found = [_words(part) for part in _slices(words, STEP)]
        sizes, flat = np.concatenate([n for n, _ in found]), pa.concat_arrays([w for _, w in found])
    coded = pc.dictionary_encode(flat)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), sizes


def coded_words(worded: DataFrame) -> DataFrame:
    """(names, codes, sizes) in blocks of rows of `words`, which are word arrays or folded texts."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _give_back()
            column = batch.column(0)
            for part in [column] if pa.types.is_list(column.type) else _slices(column, BLOCK):
                names, codes, sizes = _coded(part)
                yield pa.record_batch({
                    "names": pa.ListArray.from_arrays([0, len(names)], names.cast(pa.string())),
                    "codes": pa.array([codes.astype("<i4").tobytes()]),
                    "sizes": pa.array([sizes.astype("<i4").tobytes()]),
                })

    return worded.select("words").mapInArrow(blocks, "names array<string>, codes binary, sizes binary")


def _counted(names: pa.Array, code: np.ndarray, sizes: np.ndarray, pairs: bool, known: pa.Array | None) -> pa.Table:
    """(term, n, texts) of one block: occurrences, and texts that have the term.

    Terms are the words, or the pairs of neighbours, both of them in `known` if given.
    """
    code, text = code.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    if pairs:
        inside = text[1:] == text[:-1]
        if known is not None:
            kept = pc.is_in(names, value_set=known).to_numpy(zero_copy_only=False)[code]
            inside &= kept[1:] & kept[:-1]
        code, text = code[:-1][inside] * len(names) + code[1:][inside], text[1:][inside]
        seen = pc.dictionary_encode(pa.array(code))
        found, code = seen.dictionary.to_numpy(), seen.indices.to_numpy().astype(np.int64)
        first, second = np.divmod(found, max(len(names), 1))
        names = pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second)), pa.scalar(" ", names.type))
    once = np.sort(text * len(names) + code)
    once = once[np.diff(once, prepend=-1) > 0] % max(len(names), 1)
    n, texts = (np.bincount(x, minlength=len(names)) for x in (code, once))
    return pa.table({"term": names.cast(pa.string()), "n": pa.array(n, pa.int64()), "texts": pa.array(texts, pa.int64())})


def term_counts(worded: DataFrame, pairs: bool, known: list[str] | None = None) -> DataFrame:
    """(term, n, texts) over all rows of `words`, or blocks of them: each block is counted in its task, Spark adds the counts up."""
    among = None if known is None else worded.sparkSession.sparkContext.broadcast(known)
    blocks = coded_words(worded) if "words" in worded.columns else worded

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = None if among is None else pa.array(among.value, pa.string())
        for batch in batches:
            _give_back()
            for names, codes, sizes in zip(*(batch.column(c) for c in ("names", "codes", "sizes")), strict=True):
                rows = [np.frombuffer(x.as_buffer(), "<i4") for x in (codes, sizes)]
                yield from _counted(names.values, *rows, pairs, value_set).to_batches(max_chunksize=100_000)

    sent = blocks.select("names", "codes", "sizes").mapInArrow(counted, "term string, n long, texts long")
    return sent.groupBy("term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def frequent_terms(worded: DataFrame, size: int) -> DataFrame:
    """(term, n, texts): the terms that occur most often in the corpus, ties in alphabetical order.

    A pair is at most as frequent as either of its words. So where `size` words occur at least
    m times, a pair of a word that occurs less often is not among the `size` first: pairs are
    counted of the other words alone. Where too many words are as frequent as that to be sent
    to every task, all pairs are counted. Texts are split once: their words are stored as codes.
    """
    spark = worded.sparkSession
    coded, path = (fresh_path(spark, name) for name in ("word-codes", "word-counts"))
    write_blocks(coded_words(worded), coded)
    blocks = spark.read.schema("names array<string>, codes binary, sizes binary").parquet(coded)
    term_counts(blocks, pairs=False).write.parquet(path)
    words = spark.read.schema("term string, n long, texts long").parquet(path)
    first = words.orderBy(F.desc("n"), "term").limit(size)
    least = first.agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("rows")).first()
    known = None
    if least["rows"] == size:
        often = words.where(F.col("n") >= least["least"])
        known = [r["term"] for r in often.select("term").limit(BROADCAST_ROWS + 1).collect()]
    pairs = term_counts(blocks, pairs=True, known=None if known is None or len(known) > BROADCAST_ROWS else known)
    return first.unionByName(pairs.orderBy(F.desc("n"), "term").limit(size)).orderBy(F.desc("n"), "term").limit(size)


def _weighed(texts: pa.Array, vocabulary: pa.Array, idf: np.ndarray) -> pa.Array:
    """(n_terms, features) of folded texts: how many terms each has, and its unit vector of counts times idf."""
    size = len(vocabulary)
    names, code, sizes = _coded(texts)
    places = lambda among: pc.fill_null(pc.index_in(names, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
    text, at = np.repeat(np.arange(len(sizes)), sizes), places(vocabulary)
    cells = [(text * size + at)[at >= 0]]
    double = np.flatnonzero(pc.match_substring(vocabulary, " ").to_numpy(zero_copy_only=False))
    if len(double):
        sides = pc.dictionary_encode(pc.list_flatten(pc.split_pattern(vocabulary.take(pa.array(double)), " ")))
        first, second = sides.indices.to_numpy().astype(np.int64).reshape(-1, 2).T
        keys = first * len(sides.dictionary) + second
        order = np.argsort(keys)
        side = places(sides.dictionary)
        near = np.flatnonzero((text[1:] == text[:-1]) & (side[1:] >= 0) & (side[:-1] >= 0))
        key = side[near] * len(sides.dictionary) + side[near + 1]
        found = np.minimum(np.searchsorted(keys[order], key), len(keys) - 1)
        held = keys[order][found] == key
        cells.append(text[near[held]] * size + double[order[found[held]]])
    every = np.sort(np.concatenate(cells))
    start = np.flatnonzero(np.diff(every, prepend=-1))
    row, term = np.divmod(every[start], size)
    value = np.diff(start, append=len(every)) * idf[term]
    value /= np.sqrt(np.bincount(row, value * value, len(sizes)))[row]
    ends = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((term, pa.int32()), (value, pa.float64()))]
    sparse = [pa.array(np.full(len(sizes), x), kind) for x, kind in ((0, pa.int8()), (size, pa.int32()))]
    vectors = pa.StructArray.from_arrays([*sparse, *lists], ["type", "size", "indices", "values"])
    return pa.StructArray.from_arrays([pa.array(np.maximum(2 * sizes - 1, 0), pa.int32()), vectors], ["n_terms", "features"])


class FeatureModel(PipelineModel):
    """The stages of the features; applied, it adds their columns and `n_terms`, the number of terms.

    `features` is computed from the text in Arrow batches, equal to what the stages give (but
    for letters that the JVM's Unicode tables lack), so the other columns cost only those who read them.
    """

    def _transform(self, dataset: DataFrame) -> DataFrame:
        counting, weigh = self.stages[-3:-1]
        sent = dataset.sparkSession.sparkContext.broadcast((list(counting.vocabulary), weigh.getScalingVec().toArray()))

        @F.arrow_udf(T.StructType([T.StructField("n_terms", T.IntegerType()), T.StructField("features", VectorUDT())]))
        def weighed(texts: pa.Array) -> pa.Array:
            _give_back()
            vocabulary, idf = pa.array(sent.value[0], pa.string()), sent.value[1]
            return pa.concat_arrays([_weighed(part, vocabulary, idf) for part in _slices(texts, STEP)])

        shaped = PipelineModel(stages=self.stages[:-1]).transform(dataset)
        shaped = shaped.withColumn("_weighed", weighed(F.col(self.stages[0].getInputCol())))
        return shaped.select("*", "_weighed.n_terms", "_weighed.features").drop("_weighed")


def fit_features(df: DataFrame, text: str, vocabulary: int = K.VOCABULARY_SIZE) -> FeatureModel:
    """TF-IDF model: the most frequent terms, idf = ln((n+1)/(df+1)) + 1, unit-length rows.

    The vocabulary is chosen here rather than by CountVectorizer, whose choice among equally
    frequent terms depends on the partitioning, and the texts that have a term are counted
    with its occurrences. Spark's idf lacks the `+ 1`, which would erase a term found in every text.
    """
    with small_batches(df.sparkSession):
        terms = frequent_terms(df.select(F.col(text).alias("words")), vocabulary).collect()
    if not terms:
        raise ValueError("the texts hold no terms")
    counting = CountVectorizerModel.from_vocabulary([r["term"] for r in terms], inputCol="terms", outputCol="counts")
    idf = np.log((df.count() + 1.0) / (np.array([r["texts"] for r in terms]) + 1.0)) + 1.0
    weigh = ElementwiseProduct(scalingVec=DenseVector(idf), inputCol="counts", outputCol="weighted")
    unit = Normalizer(p=2.0, inputCol="weighted", outputCol="features")
    return FeatureModel(stages=[*tokenizing_stages(text), counting, weigh, unit])


@dataclass
class TextClassifier:
    """A fitted classifier: feature model, one binary model per class, and its metadata."""

    features: FeatureModel
    labels: list[str]
    models: list[LogisticRegressionModel]
    metadata: dict = field(default_factory=dict)

    @property
    def vocabulary(self) -> list[str]:
        return next(s for s in self.features.stages if hasattr(s, "vocabulary")).vocabulary

    def probabilities(self, df: DataFrame, text: str, name: str = "probabilities") -> DataFrame:
        """Add the map label -> probability (class sigmoids scaled to sum to 1).

        A frame that went through `with_terms` keeps its terms; scored by several models in
        a row, the text is then folded and split once, below all of them.
        """
        columns = list(df.columns)
        if TERMS in columns:
            counting = self.features.stages[len(tokenizing_stages(FOLDED)) :]
            shaped = PipelineModel(stages=counting).transform(df.withColumn("terms", F.col(TERMS)))
        else:
            shaped = self.features.transform(df if FOLDED in columns else with_folded(df, text))
        shaped = shaped.select(*columns, "features")
        for i, model in enumerate(self.models):
            scored = model.setRawPredictionCol("").setProbabilityCol("_prob").setPredictionCol("").transform(shaped)
            shaped = scored.withColumn(f"_p{i}", vector_to_array("_prob")[1]).drop("_prob")
        if len(self.labels) == 2 and len(self.models) == 1:
            parts = [1 - F.col("_p0"), F.col("_p0")]
        else:
            total = sum((F.col(f"_p{i}") for i in range(1, len(self.models))), F.col("_p0"))
            even = F.lit(1.0 / len(self.labels))
            parts = [F.when(total > 0, F.col(f"_p{i}") / total).otherwise(even) for i in range(len(self.models))]
        pairs = [x for label, p in zip(self.labels, parts) for x in (F.lit(label), p)]
        return shaped.select(*columns, F.create_map(*pairs).alias(name))

    def score(self, df: DataFrame, text: str, target: str = "label", digits: int | None = 4) -> DataFrame:
        """Add predicted_<target>, <target>_confidence and <target>_distribution.

        The prediction is the most probable label, ties by label; figures are rounded to
        `digits`, or left as they are with None.
        """
        shaped = self.probabilities(df, text, "_all")
        shaped = shaped.withColumn("_top", F.array_max(F.map_values("_all")))
        top = F.col("_top")
        first = F.array_min(F.map_keys(F.map_filter("_all", lambda k, v: v == top)))

        def shown(c: Column) -> Column:
            return c if digits is None else round_exact(c, digits)

        spread = F.create_map(*[x for label in self.labels for x in (F.lit(label), shown(F.col("_all")[label]))])
        return shaped.select(
            *df.columns,
            first.alias(f"predicted_{target}"),
            shown(top).alias(f"{target}_confidence"),
            spread.alias(f"{target}_distribution"),
        )

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.features.write().overwrite().save(f"{path}/features")
        for i, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/class-{i}")
        about = [(json.dumps(self.labels), len(self.models), json.dumps(self.metadata))]
        spark.createDataFrame(about, "labels string, models int, metadata string").coalesce(1).write.mode("overwrite").json(
            f"{path}/about"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextClassifier:
        about = spark.read.schema("labels string, models int, metadata string").json(f"{path}/about").first()
        models = [LogisticRegressionModel.load(f"{path}/class-{i}") for i in range(about["models"])]
        return cls(FeatureModel(PipelineModel.load(f"{path}/features").stages), json.loads(about["labels"]), models, json.loads(about["metadata"]))


def linear_model(spark: SparkSession, name: str, weights: np.ndarray) -> LogisticRegressionModel:
    """A binary model of given weights, the intercept last."""
    java = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"class-{name}", _py2java(spark.sparkContext, DenseVector(weights[:-1])), float(weights[-1])
    )
    return LogisticRegressionModel(java)


def train_classifier(
    df: DataFrame,
    text: str = "customer_message",
    label: str = "category",
    vocabulary: int = K.VOCABULARY_SIZE,
    max_iterations: int = K.MAX_ITERATIONS,
    balanced: bool = True,
    tolerance: float = 1e-5,
) -> TextClassifier:
    """Fit one logistic regression per class against the rest (one in all for two classes).

    A class's rows weigh n/(K*n_c) in its own problem and the other rows 1, as a
    per-class liblinear fit has it; with two classes both carry their weight. The penalty
    is 0.5*|w|^2 against the plain sum of losses. All classes are fitted together, a job for
    each evaluation, until each gradient is `tolerance` times what it was at zero weights or
    `max_iterations` is reached; the metadata says what was reached.
    """
    require_no_leak([text])
    # The folded text is read by three passes (counts and vocabulary, idf, features).
    base = df.where(F.col(label).isNotNull()).select(fold_accents(F.col(text)).alias(FOLDED), F.col(label).alias("_class"))
    base = base.persist()
    counts = {r["_class"]: r["n"] for r in class_counts(base, "_class").collect()}
    labels = sorted(counts)
    if len(labels) < 2:
        base.unpersist()
        raise ValueError("a classifier needs at least two labels")
    rows = sum(counts.values())
    weight = {c: rows / (len(labels) * n) if balanced else 1.0 for c, n in counts.items()}
    try:
        features = fit_features(base, FOLDED, vocabulary)
        code = F.create_map(*[x for i, c in enumerate(labels) for x in (F.lit(c), F.lit(i))])
        examples = features.transform(base).select("features", code[F.col("_class")].alias("code"))
        blocks = packed(examples, "features", "code")
    finally:
        base.unpersist()
    positive = labels[1:] if len(labels) == 2 else labels
    problems = Problems(
        blocks,
        np.array([labels.index(c) for c in positive]),
        np.array([weight[c] for c in positive]),
        np.array([weight[labels[0]] if len(labels) == 2 else 1.0] * len(positive)),
        len(next(s for s in features.stages if hasattr(s, "vocabulary")).vocabulary),
    )
    found, figures = fitted(problems, tolerance, max_iterations)
    models = [linear_model(df.sparkSession, c, found[k]) for k, c in enumerate(positive)]
    metadata = {
        "model_type": K.MODEL_TYPE,
        "text": text,
        "target": label,
        "rows": rows,
        "labels": labels,
        "vocabulary": vocabulary,
        "max_iterations": max_iterations,
        "class_weight": "balanced" if balanced else "none",
        **figures,
    }
    return TextClassifier(features, labels, models, metadata)


def top_features(classifier: TextClassifier, spark: SparkSession, top: int = 25) -> DataFrame:
    """(class, rank, feature, weight): the strongest terms per class, ties by feature.

    A two-class model gives the second class its largest and the first its most negative
    coefficients.
    """
    terms = classifier.vocabulary
    if len(classifier.models) == 1:
        found = classifier.models[0].coefficients.toArray()
        sides = [(classifier.labels[1], found), (classifier.labels[0], -found)]
    else:
        sides = [(c, m.coefficients.toArray()) for c, m in zip(classifier.labels, classifier.models)]
    rows = [(c, term, float(w)) for c, weights in sides for term, w in zip(terms, weights)]
    ranked = spark.createDataFrame(rows, "class string, feature string, weight double").withColumn(
        "rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("weight"), "feature"))
    )
    return ranked.where(F.col("rank") <= top).select("class", "rank", "feature", "weight")
