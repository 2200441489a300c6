"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every window of consecutive k-gram hashes the smallest is kept as a fingerprint. Two
texts that share `span` words share all k-grams of a window, hence a fingerprint at the same
place: no shared span of that length is missed. Fingerprints of documents and benchmark are
joined; each hit fixes an alignment of one item with one document, which is compared word by
word and extended to whole runs of at least `span` equal words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, matching, named, small, stored, text_key

# What parts words once A-Z are lower-cased: every ASCII character but digits and letters.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["doc_id", "th"]


def words_of(text: Column) -> Column:
    """The words compared: A-Z lower-cased, nothing else folded. Null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS, -1)
    return F.array_remove(parts, "")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def placed_grams(hashes: Column, k: int) -> Column:
    """For each position its k-gram hash in the upper 32 bits and the position in the lower.

    Ordered by hash, then position: the smallest of a window is its leftmost smallest hash.
    """
    def gram(i: Column) -> Column:
        parts = [F.get(hashes, i + j) for j in range(k)]
        return F.shiftleft(F.xxhash64(*parts), 32).bitwiseOR(i.cast("long"))

    many = F.size(hashes) >= k
    return F.when(many, F.transform(F.sequence(F.lit(0), F.size(hashes) - k), gram)).otherwise(F.array().cast("array<bigint>"))


def winnowed(grams: Column, window: int) -> Column:
    """The distinct smallest entries of all windows of `window` entries."""
    if window == 1:
        return grams
    at = F.sequence(F.lit(1), F.size(grams) - window + 1)
    least = F.array_distinct(F.transform(at, lambda i: F.array_min(F.slice(grams, i, window))))
    return F.when(F.size(grams) >= window, least).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(rows: DataFrame, keys: list[str], k: int, window: int, pos: str) -> DataFrame:
    """One row per fingerprint: the keys, the hash and its position. `rows` has the word hashes in `wh`."""
    grams = rows.select(*keys, placed_grams(F.col("wh"), k).alias("grams"))
    kept = grams.select(*keys, F.explode(winnowed(F.col("grams"), window)).alias("v"))
    return kept.select(*keys, F.shiftright("v", 32).alias("hash"), F.col("v").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias(pos))


def _with_spans(aligned: DataFrame, span: int) -> DataFrame:
    """A row per span of document words (s to e) where the aligned texts agree on at least `span` words.

    `aligned` has the words of document and item (dw, iw) and where the item starts (shift);
    an item of fewer words must agree as a whole. One pass over the aligned places counts the
    words that agree in a row up to each; runs end where the next place does not agree.
    """
    start = F.greatest(F.lit(0), F.col("shift"))
    length = F.least(F.size("dw"), F.col("shift") + F.size("iw")) - start
    same = F.zip_with(F.slice("dw", F.col("start") + 1, F.col("length")), F.slice("iw", F.col("start") - F.col("shift") + 1, F.col("length")), lambda a, b: a == b)
    runs = F.aggregate(
        F.concat("same", F.array(F.lit(False))),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.array().cast("array<struct<s:int,e:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(x, acc["n"] + 1).otherwise(F.lit(0)).alias("n"),
            F.when(
                ~x & (acc["n"] >= F.col("need")),
                F.concat(acc["spans"], F.array(F.struct((F.col("start") + acc["i"] - acc["n"]).alias("s"), (F.col("start") + acc["i"] - 1).alias("e")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    need = F.least(F.lit(span), F.size("iw"))
    placed = aligned.select("*", start.alias("start"), length.alias("length"), need.alias("need")).where(F.col("length") >= F.col("need"))
    return placed.withColumn("same", same).withColumn("x", F.explode(runs))


def _union_length(spans: Column) -> Column:
    """Words covered by any of the spans."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("last")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["last"] + 1) + 1)).alias("n"),
            F.greatest(acc["last"], x["e"]).alias("last"),
        ),
        lambda acc: acc["n"],
    )


def shared_spans(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = 13,
    k: int = 8,
) -> DataFrame:
    """(doc_id, th, item_id, s, e): runs of document words s to e that an item shares.

    Runs are maximal and at least `span` words long; an item of fewer words counts where all
    of it occurs. `th` tells apart rows that repeat an id with another text. Item ids are
    strings, a null id the empty one. Texts that are null or have no words share nothing.
    """
    docs = named(documents, doc_id=doc_id, text=text).select("doc_id", text_key(F.col("text")).alias("th"), "text")
    items = named(benchmark, item_id=item_id, text=item_text)
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_key(F.col("text")).alias("ih"), words_of(F.col("text")).alias("iw"), word_hashes(F.col("text")).alias("wh"))
    items = stored(items.where(F.size("iw") > 0).distinct(), "benchmark-items")
    window = span - k + 1
    hashed = docs.select("doc_id", "th", word_hashes(F.col("text")).alias("wh"))
    lengths = items.where(F.size("iw") < span).agg(F.min(F.size("iw"))).first()[0]
    ways = [(items.where(F.size("iw") >= span), hashed, k, window, None)]
    if lengths:  # short items: the first words of each are looked up at every position
        ways.append((items.where(F.size("iw") < span), hashed, lengths, 1, 0))
    hits = None
    for some, texts, size, wide, only in ways:
        marks = _fingerprints(some, ["item_id", "ih"], size, wide, "ipos")
        marks = small(stored(marks if only is None else marks.where(F.col("ipos") == only), "benchmark-fingerprints"))
        found = _fingerprints(texts, KEY, size, wide, "pos").join(marks, "hash")
        found = found.select(*KEY, "item_id", "ih", (F.col("pos") - F.col("ipos")).alias("shift"))
        hits = found if hits is None else hits.unionByName(found)
    hits = stored(hits.distinct(), "alignments")
    wanted = small(hits.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th")).distinct())
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left_semi")
    texts = texts.dropDuplicates(KEY).select(F.col("doc_id").alias("own_id"), F.col("th").alias("own_th"), words_of(F.col("text")).alias("dw"))
    aligned = hits.join(small(items.select("item_id", "ih", "iw")), ["item_id", "ih"])
    aligned = aligned.join(texts, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th")))
    return _with_spans(aligned, span).select(*KEY, "item_id", "x.s", "x.e")


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = 13,
    k: int = 8,
    share: int = 20,
) -> DataFrame:
    """Per document row: words, words hit, items found and whether it counts as contaminated.

    Columns doc_id, th, n_words, n_hit, item_ids (sorted as strings) and contaminated: some
    word is hit and `share` times the hit words are at least all words. Rows that repeat an
    id are judged by their own text. Null and empty texts have no words and are clean; an
    empty benchmark leaves every row clean. Repeated item ids count once.
    """
    runs = shared_spans(documents, benchmark, doc_id, text, item_id, item_text, span, k)
    by_doc = runs.groupBy(*KEY).agg(F.collect_set(F.struct("s", "e")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("found_ids"))
    by_doc = by_doc.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), _union_length(F.col("spans")).alias("hit"), "found_ids")
    by_doc = small(stored(by_doc, "hits-by-document"))
    docs = named(documents, doc_id=doc_id, text=text)
    docs = docs.select("doc_id", text_key(F.col("text")).alias("th"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
    hit = F.coalesce("hit", F.lit(0).cast("long"))
    return out.select(
        *KEY,
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("found_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, judged: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that `contamination` over the same rows calls clean, with all their columns, whatever these are called."""
    bad = judged.where("contaminated").select("doc_id", "th").distinct()
    found, same = matching(documents, small(stored(bad, "contaminated")), doc_id, text)
    return documents.join(found, same, "left_anti")
