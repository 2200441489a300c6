"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .decontaminate import contamination
from .divergence import source_divergence
from .embedding_dedup import embedding_duplicates
from .importance import resample
from .language_id import identify_languages, learn_languages
from .license_rules import CONFIDENCE, parsed
from .licenses import PHRASE_CONFIDENCE, scan_licenses
from .masked_lm import score_documents_masked
from .mixing import label_domains, mix_documents
from .quality import learn_quality, score_quality
from .simhash import near_duplicate_groups
from .span_dedup import remove_repeated_spans
from .token_counts import count_tokens
from .token_files import token_digest

TOKEN_END = 2
DOMAIN_SHARES = {"good": 0.9, "poor": 0.07, "toxic": 0.03}

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = identify_languages(documents, learn_languages(documents))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return groups.select("doc_id", "fingerprint", "component_id")


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=13, k=8, share=20)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLES["op5_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), lens AS (
  SELECT DISTINCT least(13, len(w)) AS n FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, win FROM (
    SELECT item_id, least(13, len(w)) AS n,
      unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS win
    FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256,
  coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN places p USING (doc_id) LEFT JOIN items t USING (doc_id)
"""


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(table(spark, sf_dir, "documents"))


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = label_domains(table(spark, sf_dir, "labels"))
    return mix_documents(table(spark, sf_dir, "documents"), labelled, DOMAIN_SHARES)[0].drop("th")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = learn_quality(documents, table(spark, sf_dir, "labels"))
    scored = score_quality(documents, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents_masked(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), TOKEN_END)


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1_024)


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, buckets=10_000, seed=2024)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op11_importance_resampling"] = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark
), dw AS (
  SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM d) GROUP BY ALL
), hexed AS (
  SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM dw UNION SELECT f FROM b)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda c, y: xor(c // 256, tab[CAST(xor(c % 256, y) AS BIGINT) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc
), s AS (
  SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (f) GROUP BY ALL
), t AS (
  SELECT bucket, count(*) AS t FROM b JOIN hashed USING (f) GROUP BY ALL
), gains AS (
  SELECT r.bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) r LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), weights AS (
  SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY ALL
), scored AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN able AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM placed
"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), least_documents=3, top=200)


ORACLES["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), met AS (
  SELECT row, lang, source, term, count(*) AS n FROM (SELECT row, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), kept AS (
  SELECT lang, term FROM met GROUP BY ALL HAVING count(DISTINCT row) >= 3
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, CAST(sum(n) AS HUGEINT) AS n FROM met JOIN kept USING (lang, term) GROUP BY ALL
), size AS (
  SELECT g.lang, g.source, coalesce(any_value(k.v), 0) AS v, CAST(coalesce(any_value(t.n), 0) AS HUGEINT) AS total
  FROM g LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY ALL) k USING (lang)
    LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) t USING (lang, source) GROUP BY ALL
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (s.total + s.v) AS p
  FROM size s JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 1)) // (any_value(a.total) + any_value(a.v)) AS q
  FROM p JOIN (SELECT lang, CAST(sum(total) AS HUGEINT) AS total, any_value(v) AS v FROM size GROUP BY ALL) a USING (lang) GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', item, value FROM terms
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 200
"""


@query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    joined = [F.concat_ws(",", c).alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def _rule_rows() -> str:
    """The rules as SQL rows; the patterns are those of the rule list, with a space of its own around each word."""
    return ",\n  ".join(f"({r.number}, {r.level}, '{r.label}', ' {r.pattern.replace(' ', '  ')} ')" for r in parsed())


# Every rule over every text, without keywords; overlaps are resolved one section after another.
ORACLES["op12_license_scan"] = (
    r"""
WITH rules(number, level, label, pattern) AS (VALUES
  RULES
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (
  SELECT doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS body FROM d
), phrases(label, phrase) AS (VALUES ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(phrase)] = phrase)) AS i FROM d, phrases) GROUP BY ALL
), matched AS (
  SELECT doc_id, number, level, label, string_split_regex(body, pattern) AS gaps, regexp_extract_all(body, pattern) AS hits
  FROM t, rules WHERE regexp_matches(body, pattern)
), parts AS (
  SELECT doc_id, number, level, label, unnest(list_transform(gaps[:-2], lambda g: length(trim(g)))) AS gap_chars, unnest(gaps[:-2]) AS gap, unnest(hits) AS hit,
    unnest(range(len(hits))) AS k FROM matched
), counted AS (
  SELECT doc_id, number, level, label, k, CASE WHEN gap_chars = 0 THEN 0 ELSE len(string_split(trim(gap), '  ')) END AS before, len(string_split(trim(hit), '  ')) AS own FROM parts
), found AS (
  SELECT doc_id, number, level, label, CAST(sum(before + own) OVER w - own AS BIGINT) AS s, CAST(sum(before + own) OVER w AS BIGINT) AS e
  FROM counted WINDOW w AS (PARTITION BY doc_id, number ORDER BY k ROWS UNBOUNDED PRECEDING)
), KEPT labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM (
    SELECT doc_id, label, CONFIDENCES AS c FROM (KEPT_ALL)
    UNION ALL SELECT doc_id, unnest(string_split(base_labels, ',')), PHRASE FROM base) GROUP BY ALL
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id)
""".replace("RULES", _rule_rows())
    .replace(
        "KEPT_ALL", " UNION ALL ".join(f"SELECT * FROM kept{n}" for n in range(len(CONFIDENCE)))
    )
    .replace(
        "KEPT",
        "".join(
            f"free{n} AS (SELECT * FROM found a WHERE level = {n}"
            + "".join(f" AND NOT EXISTS (SELECT 1 FROM kept{m} b WHERE b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e)" for m in range(n))
            + f"), kept{n} AS (SELECT * FROM free{n} a WHERE NOT EXISTS (SELECT 1 FROM free{n} b WHERE b.doc_id = a.doc_id AND b.s <= a.s AND a.e <= b.e"
            + " AND (b.s < a.s OR a.e < b.e OR b.number < a.number))), "
            for n in range(len(CONFIDENCE))
        ),
    )
    .replace("CONFIDENCES", "CASE level " + " ".join(f"WHEN {n} THEN {c}" for n, c in enumerate(CONFIDENCE)) + " END")
    .replace("PHRASE ", f"{PHRASE_CONFIDENCE} ")
)
