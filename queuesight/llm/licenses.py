"""Licence detection by ordered signature rules, in DataFrame operations only.

A text's words are compared with the keywords of all rules; only where one occurs are the
rules that it opens run, as regular expressions over the words. What they find are intervals
of words. Overlaps are resolved section by section, the most reliable first: a detection that
touches one kept from an earlier section goes, then one that lies within another of its own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, small, stored
from .decontaminate import words_of
from .license_rules import CONFIDENCE, Rule, parsed

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
PHRASE_CONFIDENCE = 0.9
RULE = "array<struct<level:int,number:int,label:string,keywords:array<string>,pattern:string>>"
OPEN, CLOSE = "\x01", "\x02"  # never part of a word


def spaced(pattern: str) -> str:
    """The pattern for words that have a space of their own on either side, so that neighbours share none."""
    return " (" + pattern.replace(" ", "  ") + ") "


def _places(words: Column, phrase: str) -> Column:
    """Where the words of `phrase` stand consecutively, overlaps included."""
    wanted = phrase.split(" ")
    whole = F.array(*[F.lit(w) for w in wanted])
    at = F.transform(words, lambda w, i: F.when((w == wanted[0]) & (F.slice(words, i + 1, len(wanted)) == whole), i))
    return F.filter(at, lambda i: i.isNotNull())


def _detections(spaced_words: Column, rules: Column) -> Column:
    """(s, e, level, number) of every match of the rules: words s up to but without e."""

    def found(rule: Column) -> Column:
        marked = F.call_function("regexp_replace", spaced_words, rule["pattern"], F.lit(f" {OPEN}$1{CLOSE} "))
        parts = F.split(F.trim(marked), "  ")
        starts = F.filter(F.transform(parts, lambda w, i: F.when(w.startswith(OPEN), i)), lambda i: i.isNotNull())
        ends = F.filter(F.transform(parts, lambda w, i: F.when(w.endswith(CLOSE), i + 1)), lambda i: i.isNotNull())
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"), rule["level"].alias("level"), rule["number"].alias("number")))

    matching = F.filter(rules, lambda rule: F.call_function("rlike", spaced_words, rule["pattern"]))
    return F.flatten(F.transform(matching, found))


def scanned(documents: DataFrame, doc_id: str, text: str, phrases: dict[str, str], rules: list[Rule]) -> DataFrame:
    """(row, doc_id, n_words, n_base, first_word, last_word, base_labels, hits) of every row, stored."""
    fixed = [{**rule._asdict(), "pattern": spaced(rule.pattern)} for rule in rules]
    table = F.from_json(F.lit(json.dumps(fixed)), RULE)  # folded into one constant
    rarest = {phrase: max(phrase.split(" "), key=len) for phrase in phrases}
    keywords = sorted({k for rule in rules for k in rule.keywords} | set(rarest.values()))
    rows = named(documents, doc_id=doc_id, text=text).select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    rows = rows.withColumn("met", F.array_intersect("words", F.split(F.lit(" ".join(keywords)), " ")))
    none = F.array().cast("array<int>")
    places = [F.when(F.array_contains("met", rarest[p]), _places(F.col("words"), p)).otherwise(none) for p in phrases]
    rows = rows.select("row", "doc_id", "words", "met", F.array(*places).alias("places") if places else F.array().cast("array<array<int>>").alias("places"))
    labels = [F.when(F.size(F.get("places", i)) > 0, F.lit(label)) for i, label in enumerate(phrases.values())]
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))) if labels else F.array().cast("array<string>")
    spaced_words = F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))
    opened = F.filter(table, lambda rule: F.arrays_overlap(rule["keywords"], F.col("met")))
    hits = F.when(F.size("met") > 0, _detections(spaced_words, opened))
    base = F.flatten("places")
    return stored(
        rows.select(
            "row",
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.size(base).cast("long").alias("n_base"),
            F.array_min(base).cast("long").alias("first_word"),
            F.array_max(base).cast("long").alias("last_word"),
            labels.alias("base_labels"),
            hits.alias("hits"),
        ),
        "scanned-documents",
    )


def resolved(found: DataFrame, levels: int) -> DataFrame:
    """The rows of `found` (row, s, e, level, number) that stay once overlaps are resolved.

    Level by level, best first: out goes what shares a word with a kept detection of a better
    level, then what lies within another of its own level that was still in; of equal
    intervals the lower number stays. One shuffle by row; the windows scan a row's detections in order.
    """
    kept = F.lit(False)
    by_row = Window.partitionBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = found.withColumn("kept", kept)
    for level in range(levels):
        rising = by_row.orderBy(F.col("s"), F.col("kept").desc())
        falling = by_row.orderBy(F.col("s").desc(), F.col("kept").desc())
        reach = F.max(F.when(F.col("kept"), F.col("e"))).over(rising)  # of what starts here or before
        near = F.min(F.when(F.col("kept"), F.col("s"))).over(falling)  # of what starts here or later
        rows = rows.withColumn("reach", reach).withColumn("near", near)
        clear = (F.coalesce(F.col("reach"), F.lit(0)) <= F.col("s")) & (F.coalesce(F.col("near") >= F.col("e"), F.lit(True)))
        rows = rows.withColumn("free", (F.col("level") == level) & clear)
        outer = Window.partitionBy("row").orderBy("s", F.col("e").desc(), "number").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("around", F.max(F.when(F.col("free"), F.col("e"))).over(outer))
        rows = rows.withColumn("kept", F.col("kept") | (F.col("free") & (F.coalesce(F.col("around"), F.lit(0)) < F.col("e"))))
    return rows.where("kept").drop("kept", "reach", "near", "free", "around")


def detections(scans: DataFrame, rules: list[Rule]) -> DataFrame:
    """(row, s, e, level, number, label): the detections kept, words s up to but without e."""
    found = scans.where(F.size("hits") > 0).select("row", F.inline("hits"))
    kept = resolved(found, 1 + max((rule.level for rule in rules), default=-1))
    labels = F.split(F.lit(" ".join(rule.label for rule in rules)), " ")
    return kept.withColumn("label", F.get(labels, F.col("number")))


def scan_licenses(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, rules: list[Rule] | None = None
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, row) of every row.

    Base places are where a phrase's words stand consecutively; first_word and last_word are
    the least and greatest start, null without any. `labels` (sorted array) are the base labels
    and those of the detections kept; score is the best confidence among them, 0 without any.
    Null and empty texts have no words and no label; whole texts of any length are searched;
    rows that repeat, or repeat an id, are scanned each for itself (`row` tells them apart); no
    documents give no rows. Other columns, whatever their names, play no part.
    """
    phrases = PHRASES if phrases is None else phrases
    rules = parsed() if rules is None else rules
    scans = scanned(documents, doc_id, text, phrases, rules)
    best = F.array(*[F.lit(c) for c in CONFIDENCE])
    kept = detections(scans, rules).groupBy("row").agg(F.collect_set("label").alias("own"), F.max(F.get(best, F.col("level"))).alias("best"))
    out = scans.join(small(stored(kept, "licence-labels")), "row", "left")
    base = F.when(F.size("base_labels") > 0, F.lit(PHRASE_CONFIDENCE)).otherwise(F.lit(0.0))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union(F.col("base_labels"), F.coalesce("own", none)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), F.greatest(base, F.coalesce("best", F.lit(0.0))).alias("score"), "row")
