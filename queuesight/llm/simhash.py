"""SimHash fingerprints, and groups of near-equal ones found by covering hashing.

Masks are built so that two fingerprints that differ in at most `radius` bits agree on the
masked bits of at least one of 2^(radius+1)-1 tables: each bit gets a vector of radius+1
bits, and table v keeps the bits whose vector has odd parity with v. The vectors of the
differing bits span at most `radius` dimensions, so some v is orthogonal to all of them and
masks every difference away. No pair within the radius can be missed.

Fingerprints, not documents, are compared: copies of one text share one. In a bucket only a
spanning forest of the links is produced, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import matching, named, small, stored, text_key
from .components import connected_components

BITS = 64


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text, unsigned: a bit is 1 where over half the shingle hashes have it.

    A-Z are lower-cased, words part at ASCII white space. Fewer words than `shingle`: the
    whole sequence is the one shingle. No words (or null): 0.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    first, last = starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist()
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(first, last, strict=True)), np.uint64, len(first))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        block = np.ascontiguousarray(hashes[at : at + 4096], dtype="<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint_column(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(simhash(t, shingle, seed)) for t in texts], dtype="int64")

    return fingerprint(text)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2^(radius+1)-1 masks; the bits' vectors take all non-zero values about equally often."""
    top = (1 << (radius + 1)) - 1
    vectors = [i % top + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, top + 1)]


def _forest(group: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join what is connected within `radius` in one bucket, at most one less than members."""
    a, b = [], []
    rest = group
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                rest = rest[~near]
    return a, b


def _bucket_links(radius: int):
    """Over rows sorted by bucket: the forest of each bucket; a bucket may span batches."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        bucket = None

        def close() -> tuple[list, list]:
            group = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            return _forest(group, radius) if len(group) > 1 else ([], [])

        def batch(a: list, b: list) -> pa.RecordBatch:
            ends = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

        for rows in batches:
            if not rows.num_rows:
                continue
            t, key, fp = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(t)]
            a, b = [], []
            for s, e in zip(bounds, bounds[1:], strict=False):
                if (t[s], key[s]) != bucket:
                    more = close()
                    a += more[0]
                    b += more[1]
                    held, bucket = [], (t[s], key[s])
                held.append(fp[s:e].astype(np.int64).view(np.uint64))
            yield batch(a, b)
        yield batch(*close())

    return links


def _balls(reach: int):
    """(hub, fp): every value within `reach` bits of a fingerprint; of one batch, the smallest for each hub and the fingerprint itself."""
    flips = [0] + [sum(1 << i for i in c) for k in range(1, reach + 1) for c in combinations(range(BITS), k)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.array(flips, np.uint64)
        for rows in batches:
            values = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(values), 256):
                part = values[at : at + 256]
                hubs = (part[:, None] ^ steps[None, :]).ravel().view(np.int64)
                owners = np.repeat(part.view(np.int64), len(steps))
                yield pa.RecordBatch.from_arrays([pa.array(hubs), pa.array(owners)], ["hub", "fp"])

    return spread


def near_links(fingerprints: DataFrame, radius: int = 4, most_in_bucket: int = 8_192) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column `fp`) within `radius` bits.

    The links returned are a subset that connects the same groups. A bucket of up to
    `most_in_bucket` fingerprints is linked by one task. The members of a larger one are
    linked exactly without meeting in a group: two values differ in at most `radius` bits
    only if some value lies within half the radius (rounded up and down) of both, so each
    is joined with the smallest fingerprint near every such middle value.
    """
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(covering_masks(radius))])
    rows = fingerprints.select("fp", F.explode(tables).alias("x")).select(F.col("x.t").alias("t"), F.col("x.key").alias("key"), "fp")
    large = stored(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > most_in_bucket).select("t", "key"), "large-buckets")
    hot = large.limit(1).count() > 0
    if hot:
        rows_left = rows.join(large, ["t", "key"], "left_anti")
    else:
        rows_left = rows
    dealt = rows_left.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")
    found = dealt.mapInArrow(_bucket_links(radius), "a long, b long")
    if hot:
        members = rows.join(large, ["t", "key"], "left_semi").select("fp").distinct()
        far = members.mapInArrow(_balls((radius + 1) // 2), "hub long, fp long")
        near = members.mapInArrow(_balls(radius // 2), "hub long, fp long")
        least = near.groupBy("hub").agg(F.min("fp").alias("m"))
        # for an odd radius the two reaches differ: a's wide ball meets b's narrow one
        found = found.unionByName(far.join(least, "hub").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")))
    return found


def near_duplicate_groups(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    radius: int = 4,
    most_in_bucket: int = 8_192,
) -> DataFrame:
    """(doc_id, th, fingerprint, component_id, group_id) of every row.

    `fingerprint` is 16 lowercase hex digits. `component_id` is the smallest id among the
    rows reachable over links of at most `radius` differing bits, itself included. Texts
    without words (null, empty, white space) have fingerprint zero and link like others. A
    row with a null id belongs to its group but never names it; a group of such rows alone
    has a null component_id. Rows that repeat an id stay rows; `th`, a hash of the text, tells
    them apart. `group_id` is a fingerprint of the group. An empty table gives no rows.
    """
    rows = named(documents, doc_id=doc_id, text=text)
    print_of = fingerprint_column(F.col("text"), shingle)
    rows = stored(rows.select("doc_id", text_key(F.col("text")).alias("th"), print_of.alias("fp")), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    groups = connected_components(near_links(distinct.select("fp"), radius, most_in_bucket))
    linked = distinct.join(groups.withColumnRenamed("node", "fp"), "fp")
    named_by = linked.groupBy("component").agg(F.min("least").alias("name"))
    of_linked = linked.join(named_by, "component").select("fp", "name", "component")
    # Written, so that the join with the rows stands alone and a hot fingerprint can be split.
    groups_of = stored(distinct.join(of_linked, "fp", "left"), "fingerprint-groups")
    out = rows.join(groups_of, "fp")
    hex_digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(
        "doc_id", "th", hex_digits.alias("fingerprint"), F.coalesce("name", "least").alias("component_id"), F.coalesce("component", "fp").alias("group_id")
    )


def keep_one_of_each(documents: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without all but one of each group: the one with the smallest id (null ids last), then text hash.

    `groups` comes from `near_duplicate_groups` over the same rows. Of rows that repeat id and
    text one stays. All columns are kept as they are, whatever their names.
    """
    rows = groups.groupBy("group_id", "doc_id", "th").agg(F.count("*").alias("n"))
    first = rows.groupBy("group_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "th")).alias("first"))
    judged = rows.join(first, "group_id")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    judged = judged.select("doc_id", "th", is_first.alias("stays"), "n")
    judged = stored(judged.where(~F.col("stays") | (F.col("n") > 1)), "near-duplicates")
    gone, again = small(judged.where(~F.col("stays"))), judged.where("stays")
    found, same = matching(documents, gone, doc_id, text)
    kept = documents.join(found, same, "left_anti")
    if again.limit(1).count() == 0:
        return kept
    again, same = matching(documents, small(again), doc_id, text)
    once = kept.join(again, same, "left_semi").dropDuplicates([doc_id, text])
    return kept.join(again, same, "left_anti").unionByName(once)
