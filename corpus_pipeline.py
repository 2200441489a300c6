"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last keep the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuesight.llm.common import stored, table
from queuesight.llm.decontaminate import contamination, drop_contaminated
from queuesight.llm.language_id import UNDETERMINED, language_column, learn_languages
from queuesight.llm.mixing import draw_documents, label_domains, mix_documents
from queuesight.llm.simhash import keep_one_of_each, near_duplicate_groups
from queuesight.llm.token_files import token_digest

END_ID = 2
SHARES = {"good": 0.9, "poor": 0.07, "toxic": 0.03}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go. All columns stay as they are."""
    found = language_column(spark, learn_languages(docs), F.col("text"))
    return docs.where(found["lang_pred"] != UNDETERMINED)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal fingerprints stays, with all its columns."""
    groups = stored(near_duplicate_groups(docs, shingle=4, radius=4), "near-duplicate-groups")
    return keep_one_of_each(docs, groups)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark stay, with all their columns."""
    return drop_contaminated(docs, contamination(docs, table(spark, sf_dir, "benchmark"), span=13, k=8, share=20))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poor and toxic documents are drawn at their rates; good ones keep their total, so their rate is about 1.

    All columns stay as they are; a table without documents stays empty.
    """
    rates, _ = mix_documents(docs, label_domains(table(spark, sf_dir, "labels")), SHARES, keep_whole="good")
    return draw_documents(docs, rates)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token files, and each document as read back from them; other columns play no part."""
    return token_digest(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]
ORACLE_SQL = None  # language, fingerprints, rates and tokens are beyond SQL; tests/llm/test_pipeline.py checks each


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
