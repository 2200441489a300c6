"""Token ids of a corpus as files, in ascending document order, and their reading.

Documents are dealt into ranges of their id and sorted; each task encodes its range and
writes shards of bounded size, one wavelet matrix to a file. A shard is written under another
name and moved, so a repeated or lost task leaves whole files only.
"""

from __future__ import annotations

import json
import os
import re
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import fresh_path
from .common import named, small, stored, text_key
from .wavelet import WaveletShard, write_shard


MARKS = string.punctuation


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Visible Latin-1 characters stand for themselves, the other bytes in turn for those from U+0100 on.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class ChunkEncoder:
    """Encodes texts by their chunks between spaces and line feeds, remembering chunks met before.

    Only for tokenizers that drop white space and never join text across it, so that the ids
    of a text are those of its chunks in turn; `whole` tells. Other tokenizers get whole
    texts. Up to `room` words, without case and marks, and half as many chunks as they stand
    are remembered; further ones are encoded as they come, until as many more have passed:
    the memory starts over, in case the texts have changed.
    """

    def __init__(self, path: str, end_id: int, room: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already take every core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            setting = json.load(f)
        steps = (setting.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = steps[0] if steps else {}
        pattern = split.get("pattern", {}).get("Regex", "")
        drops_space = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
        self.whole = not (drops_space and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"))
        folds = [step["type"] for step in (setting.get("normalizer") or {}).get("normalizers", [])]
        # A run of letters is one piece to such a tokenizer, in lower case and by its bytes'
        # characters; letters below U+0130 are composed and have a plain lower case.
        bytewise = [step.get("type") for step in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space")
        self.letters = not self.whole and bytewise and folds == ["NFC", "Replace", "Lowercase"]
        characters = byte_characters()
        self.bytewise = {o: "".join(characters[b] for b in chr(o).encode()) for o in range(128, 0x130)}
        highest = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id)
        self.bits = max(1, highest.bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.room, self.passed = room, 0
        self.seen: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def _encoded(self, chunks: set[str]) -> dict[str, bytes]:
        new, rest, split = {}, [], {}
        tokenize, code, words = self.tokenizer.model.tokenize, "H" if self.kind.itemsize == 2 else "I", self.words

        def is_word(text: str) -> bool:
            return text.isalpha() and (text.isascii() or max(text) < "\u0130")

        def word(text: str) -> bytes:
            text = text.lower()
            found = words.get(text)
            if found is None:
                found = array(code, [t.id for t in tokenize(text if text.isascii() else text.translate(self.bytewise))]).tobytes()
                if len(words) < self.room:
                    words[text] = found
                else:
                    self.passed += 1
            return found

        for chunk in chunks:
            if not self.letters:
                rest.append(chunk)
            elif is_word(chunk):
                new[chunk] = word(chunk)
            else:
                # Marks after a word are pieces of their own, but for special tokens.
                head = chunk.rstrip(MARKS)
                if head is not chunk and is_word(head):
                    split[chunk] = head, chunk[len(head) :]
                else:
                    rest.append(chunk)
        rest += {tail for _, tail in split.values()}
        new |= {chunk: words[chunk] for chunk in rest if chunk in words}  # no letters' word is among them
        rest = [chunk for chunk in rest if chunk not in new]
        for at in range(0, len(rest), 1_000):
            part = rest[at : at + 1_000]
            for chunk, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                new[chunk] = np.array(found.ids, self.kind).tobytes()
                if len(words) < self.room:
                    words[chunk] = new[chunk]
                else:
                    self.passed += 1
        for chunk, (head, tail) in split.items():
            new[chunk] = word(head) + new[tail]
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, with the end id, as bytes."""
        if self.whole:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(x.ids, self.kind).tobytes() + self.end for x in found]
        out = []
        for text in texts:
            chunks = text.replace("\n", " ").split(" ")
            found = list(map(self.seen.get, chunks))
            if None in found:
                missing = [i for i, ids in enumerate(found) if ids is None]
                new = self._encoded({chunks[i] for i in missing})
                for i in missing:
                    found[i] = new[chunks[i]]
                if len(self.seen) + len(new) <= max(2, self.room // 2):
                    self.seen.update(new)
                if self.passed > self.room:
                    self.seen, self.words, self.passed = {"": b""}, {}, 0
            out.append(b"".join(found) + self.end)
        return out


@lru_cache(maxsize=1)
def worker_encoder(path: str, end_id: int) -> ChunkEncoder:
    """One encoder for all tasks that a Python worker runs, with what it remembers."""
    return ChunkEncoder(path, end_id)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def _write_file(uri: str, data: bytes) -> None:
    files, path = _place(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, path)


def write_token_files(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_tokens: int = 4_000_000,
) -> DataFrame:
    """Write the shards into the folder `path` and return their manifest.

    Manifest: file (name, sorting as the documents do), n_docs, n_tokens. Documents come in
    ascending id, null ids first, rows that repeat an id by their text. A null or empty text
    is the end id alone. A shard closes with the document that brings it to `shard_tokens`.
    """
    spark = documents.sparkSession
    files, folder = _place(path)
    files.create_dir(folder, recursive=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = named(documents, doc_id=doc_id, text=text)
    rows = rows.select("doc_id", text_key(F.col("text")).alias("th"), "text")
    rows = rows.repartitionByRange(parts, "doc_id", "th").sortWithinPartitions("doc_id", "th", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, end_id)
        part, ids, docs, lengths, made = TaskContext.get().partitionId(), [], [], [], []

        def close() -> None:
            tokens = np.frombuffer(b"".join(ids), encoder.kind)
            name = f"shard-{part:06d}-{len(made):06d}.wm"
            _write_file(f"{path}/{name}", write_shard(tokens, docs, lengths, encoder.bits))
            made.append((name, len(docs), len(tokens)))
            ids.clear(), docs.clear(), lengths.clear()

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                encoded = encoder.encode([t or "" for t in some.column(1).to_pylist()])
                for d, data in zip(some.column(0).to_pylist(), encoded, strict=True):
                    ids.append(data)
                    docs.append(d)
                    lengths.append(len(data) // encoder.kind.itemsize)
                    held += lengths[-1]
                    if held >= shard_tokens:
                        close()
                        held = 0
        if docs:
            close()
        if made:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(made, columns=["file", "n_docs", "n_tokens"]), preserve_index=False)

    made = rows.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, "file string, n_docs long, n_tokens long")
    return stored(made, "token-manifest")


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files themselves.

    `start` counts the ids of all documents before it; `ids_crc32` is over its ids as
    little-endian unsigned 32-bit integers. An empty manifest gives no rows.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    places = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"))
    kind = "doc_id long, place long, n_tokens long, ids_crc32 long, file string"
    if manifest.limit(1).count() == 0:
        empty = spark.createDataFrame([], kind)
        return empty.select("doc_id", F.col("place").alias("start"), "n_tokens", "ids_crc32")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py().rsplit("/", 1)[-1]
                shard = WaveletShard(batch.column(1)[i].as_buffer().to_pybytes())
                rows = [(d, place, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, place, ids in shard.documents()]
                doc, place, n, crc = (list(x) for x in zip(*rows, strict=True))
                columns = [pa.array(x, pa.int64()) for x in (doc, place, n, crc)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([name] * len(doc))], ["doc_id", "place", "n_tokens", "ids_crc32", "file"])

    content = spark.read.format("binaryFile").load(f"{path}/*.wm").select("path", "content")
    found = content.mapInArrow(read, kind).join(small(places), "file")
    return found.select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(documents: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write a corpus as token files in the shared folder and describe each document from them."""
    spark = documents.sparkSession
    path = fresh_path(spark, "token-files")
    return read_token_files(spark, path, write_token_files(documents, path, tokenizer, end_id, doc_id, text))
