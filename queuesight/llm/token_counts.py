"""Token counts of whole texts; huge documents by overlapping chunks that are spliced.

A huge document is cut into overlapping chunks that different tasks encode, with offsets. Two
neighbours are spliced at a place that both encodings show as the start of a piece and that
is proven to start one in the whole text too: a single space between two characters that are
not white space. No piece of a byte-level pattern crosses such a space to its left, so the
text after it is cut the same way whatever stands before, and the text before it whatever
follows. Documents without such a place in some overlap are encoded again with a wider one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import named, small, stored, text_key

STABLE = re.compile(r"(?<=\S) (?=\S)")
MARGIN = 32  # characters before a chunk's cut that the cut may change; longer than any special token


def splits_at_spaces(tokenizer: str) -> bool:
    """Whether the tokenizer's pieces never cross a lone space to its left (byte-level pattern, no folding)."""
    with open(tokenizer, encoding="utf-8") as f:
        setting = json.load(f)
    step = setting.get("pre_tokenizer") or {}
    plain = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
    tokens = [t["content"] for t in setting.get("added_tokens", [])]
    stripping = any(t.get("lstrip") or t.get("rstrip") for t in setting.get("added_tokens", []))
    short = all(" " not in t and len(t) < MARGIN for t in tokens)
    return bool(plain and short and not stripping and not setting.get("normalizer") and not setting.get("post_processor"))


class Counter:
    """Counts tokens of texts; remembers the counts of pieces between stable places.

    Up to `room` pieces are remembered. Then further ones are counted as they come, until as
    many more have passed: the memory starts over, in case the texts have changed.
    """

    def __init__(self, path: str, room: int = 1_000_000):
        self.sentencepiece = path.endswith(".model")
        if self.sentencepiece:
            import sentencepiece

            self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already take every core
            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        self.by_piece = not self.sentencepiece and splits_at_spaces(path)
        self.room, self.seen, self.passed = room, {}, 0

    def counts(self, texts: list[str]) -> list[int]:
        if self.sentencepiece:
            return [len(ids) for ids in self.processor.encode(texts, num_threads=1)]
        if not self.by_piece:
            return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [self._count(t) for t in texts]

    def _count(self, text: str) -> int:
        # Pieces stand without the space before them, but for the first: two kinds of key.
        first, *rest = STABLE.split(text)
        seen = self.seen
        try:
            return sum([seen[p] for p in rest]) + self._alone(first)
        except KeyError:
            new = {}
            pieces = list({p for p in rest if p not in seen})
            for at in range(0, len(pieces), 1_000):
                part = pieces[at : at + 1_000]
                found = self.tokenizer.encode_batch_fast([" " + p for p in part], add_special_tokens=False)
                new.update(zip(part, (len(x.ids) for x in found), strict=True))
            total = sum([seen[p] if p in seen else new[p] for p in rest]) + self._alone(first)
            if len(seen) + len(new) <= self.room:
                seen.update(new)
            else:
                self.passed += len(new)
                if self.passed > self.room:
                    self.seen, self.passed = {}, 0
            return total

    def _alone(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids) if text else 0


@lru_cache(maxsize=1)
def worker_counter(path: str) -> Counter:
    """One counter for all tasks that a Python worker runs, with what it remembers."""
    return Counter(path)


def stable_starts(tokenizer: Tokenizer, chunk: str) -> tuple[int, list[tuple[int, int]]]:
    """Tokens of a chunk, and (place, tokens before it) of every piece that starts at a stable place."""
    found = tokenizer.encode(chunk, add_special_tokens=False)
    words, offsets = found.word_ids, found.offsets
    starts = []
    for j in range(1, len(words)):
        at = offsets[j][0]
        if words[j] != words[j - 1] and 0 < at < len(chunk) - 1 and chunk[at] == " " and not chunk[at - 1].isspace() and not chunk[at + 1].isspace():
            starts.append((at, j))
    return len(words), starts


def _chunks(size: int, overlap: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                last = 0 if size + overlap >= len(text) else max(0, (len(text) - overlap - 1) // size)
                for at in range(0, last + 1, 16):
                    some = range(at, min(at + 16, last + 1))
                    yield pd.DataFrame(
                        {
                            "key": key,
                            "i": list(some),
                            "is_last": [i == last for i in some],
                            "chunk": [text[i * size :] if i == last else text[i * size : (i + 1) * size + overlap] for i in some],
                        }
                    )

    return cut


def _encoded(path: str, size: int, overlap: int):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            rows = []
            for key, i, is_last, chunk in batch.itertuples(index=False):
                total, starts = stable_starts(tokenizer, chunk)
                left = [(i * size + at, j) for at, j in starts if at < overlap] if i else []
                right = [] if is_last else [(i * size + at, j) for at, j in starts if size < at < len(chunk) - MARGIN]
                rows.append((key, i, is_last, total, *([x[k] for x in side] for side in (left, right) for k in (0, 1))))
            yield pd.DataFrame(rows, columns=["key", "i", "is_last", "total", "left_at", "left_n", "right_at", "right_n"])

    return encode


def spliced_counts(texts: DataFrame, tokenizer: str, size: int = 16_384, overlap: int = 256) -> DataFrame:
    """(key, n) for distinct keys with huge texts (columns key, text).

    Chunks are dealt out to all tasks. Where two neighbours share no stable place, the
    document is done again with eight times the overlap; a chunk that reaches the text's end
    is the last, so in the end one chunk holds the whole text and needs no splice.
    """
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = None
    while True:
        cut = texts.mapInPandas(_chunks(size, overlap), "key string, i long, is_last boolean, chunk string").repartition(parts)
        kind = "key string, i long, is_last boolean, total long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"
        encoded = stored(cut.mapInPandas(_encoded(tokenizer, size, overlap), kind), "chunk-encodings")
        after = encoded.select("key", (F.col("i") - 1).alias("i"), F.col("left_at").alias("next_at"), F.col("left_n").alias("next_n"))
        pairs = encoded.join(after, ["key", "i"], "left")
        at = F.array_min(F.array_intersect("right_at", "next_at"))
        pairs = pairs.withColumn("at", at)
        until = F.when(F.col("is_last"), F.col("total")).otherwise(F.get("right_n", F.array_position("right_at", F.col("at")).cast("int") - 1))
        dropped = F.when(F.col("is_last"), 0).otherwise(F.get("next_n", F.array_position("next_at", F.col("at")).cast("int") - 1))
        sums = pairs.groupBy("key").agg(F.sum(until - dropped).alias("n"), F.max(F.col("at").isNull() & ~F.col("is_last")).alias("failed"))
        sums = stored(sums, "chunk-counts")
        good = sums.where(~F.col("failed")).select("key", "n")
        done = good if done is None else done.unionByName(good)
        bad = sums.where("failed").select("key")
        if bad.limit(1).count() == 0:
            return done
        texts = texts.join(small(bad), "key", "left_semi")
        overlap *= 8


def count_tokens(
    documents: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = 1_024,
    huge: int = 32_768,
    chunk: int = 16_384,
    overlap: int = 256,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    No special tokens are added; their strings in a text count as the library reads them. A
    null text counts as an empty one: 0 bytes, 0 tokens. Texts of more than `huge` characters
    go by chunks where the tokenizer's pieces allow it, else whole. Rows that repeat an id are
    counted each for itself.
    """
    rows = named(documents, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    by_chunk = not tokenizer.endswith(".model") and splits_at_spaces(tokenizer)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = worker_counter(tokenizer)
        for batch in batches:
            yield pd.Series(counter.counts(batch.tolist()), dtype="int64")

    size = F.octet_length("text").cast("long")
    usual = rows.where(F.length("text") <= huge) if by_chunk else rows
    out = usual.select("doc_id", size.alias("n_bytes"), count("text").alias("n_tokens"))
    if by_chunk:
        long_rows = rows.where(F.length("text") > huge)
        long_rows = long_rows.select("doc_id", size.alias("n_bytes"), F.concat_ws(":", F.col("doc_id").cast("string"), text_key(F.col("text")).cast("string")).alias("key"), "text")
        counts = spliced_counts(long_rows.select("key", "text").dropDuplicates(["key"]), tokenizer, chunk, overlap)
        out = out.unionByName(long_rows.join(counts, "key").select("doc_id", "n_bytes", F.col("n").alias("n_tokens")))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
