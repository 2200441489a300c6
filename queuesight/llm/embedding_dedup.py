"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

A table of hashing projects normalised vectors on `width` Gaussian directions, shifts them at
random and cuts them into cells of length `cell`; vectors in one bucket agree on all cells.
Vectors at the threshold's distance meet in a table with a known probability, so the number
of tables is set for a chosen chance of missing such a pair, and the number of directions
grows with the logarithm of the rows so that strangers rarely meet.

Equal vectors are compared once. A bucket is compared in blocks; what leaves it are the number
of links of each vector and a spanning forest of its links, not the pairs. A pair counts in
the first table where it meets, so no link counts twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, small, stored
from .components import connected_components


def _normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def meeting_chance(distance: float, cell: float) -> float:
    """Chance that two vectors at a distance fall into one cell of a random direction."""
    r = cell / distance
    return 1 - 2 * _normal_cdf(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Plan:
    """Tables, directions of each, and cell length."""

    tables: int
    width: int
    cell: float
    seed: int = 17

    @classmethod
    def for_rows(cls, rows: int, cosine: float, miss: float = 1e-4, cell: float = 2.0, strangers: int = 512) -> Plan:
        """Directions so that a vector meets about `strangers` unrelated ones, tables so that a pair at the threshold is missed with chance `miss`."""
        apart = meeting_chance(math.sqrt(2), cell)
        width = max(1, math.ceil(math.log(max(2.0, rows / strangers)) / -math.log(apart)))
        met = meeting_chance(math.sqrt(2 - 2 * cosine), cell) ** width
        return cls(max(1, math.ceil(math.log(miss) / math.log1p(-met))), width, cell)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """A 32-bit bucket key for each vector (normalised, one length) and table."""
        rng = np.random.default_rng([self.seed, vectors.shape[1]])
        directions = rng.standard_normal((vectors.shape[1], self.tables * self.width))
        shift = rng.uniform(0, self.cell, self.tables * self.width)
        mixers = rng.integers(1, 1 << 62, (1, self.tables, self.width), dtype=np.int64) | 1
        cells = np.floor((vectors @ directions + shift) / self.cell).astype(np.int64)
        mixed = (cells.reshape(len(vectors), self.tables, self.width) * mixers).sum(axis=2)
        mixed ^= np.int64(vectors.shape[1] * 0x9E3779B1)
        return ((mixed ^ (mixed >> 32)) & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _normalised(values: np.ndarray, width: int) -> np.ndarray:
    rows = values.astype(np.float64).reshape(-1, width)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _with_keys(plan: Plan):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch.column("embedding"))
            widths = np.diff(offsets)
            keys = np.zeros((batch.num_rows, plan.tables), np.int32)
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                places = offsets[own][:, None] + np.arange(width)
                keys[own] = plan.keys(_normalised(values[places].ravel(), int(width)))
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, plan.tables, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "keys"])

    return add


class _Forest:
    """Keeps the labels of a bucket's members and picks the links that join two labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def joining(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        picked: list[np.ndarray] = []
        at = np.arange(len(p))
        while True:
            a, b = self.label[p[at]], self.label[q[at]]
            cross = a != b
            if not cross.any():
                break
            at, a, b = at[cross], a[cross], b[cross]
            _, first = np.unique(a, return_index=True)
            parent = {}

            def find(x: int) -> int:
                while x in parent:
                    x = parent[x]
                return x

            chosen = []
            for i in first.tolist():
                x, y = find(int(a[i])), find(int(b[i]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    chosen.append(i)
            moved = {x: find(x) for x in parent}
            old = np.array(sorted(moved))
            new = np.array([moved[x] for x in old.tolist()])
            place = np.searchsorted(old, self.label).clip(max=len(old) - 1)
            self.label = np.where(old[place] == self.label, new[place], self.label)
            picked.append(at[chosen])
        kept = np.concatenate(picked) if picked else np.zeros(0, np.int64)
        return p[kept], q[kept]


def _compare(table: int, ids, sizes, vectors, keys, sides, cosine: float, out: list) -> None:
    """Links of one bucket, or between the two sides of one part of a large bucket."""
    n = len(ids)
    links = np.zeros(n, np.int64)
    forest = _Forest(n)
    for at in range(0, n, 512):
        near = vectors[at : at + 512] @ vectors.T >= cosine
        p, q = np.nonzero(near)
        p += at
        fresh = p < q
        if sides is not None:
            fresh &= sides[p] != sides[q]
        p, q = p[fresh], q[fresh]
        for earlier in range(table):
            if not len(p):
                break
            new = keys[p, earlier] != keys[q, earlier]
            p, q = p[new], q[new]
        if len(p):
            links += np.bincount(p, weights=sizes[q], minlength=n).astype(np.int64)
            links += np.bincount(q, weights=sizes[p], minlength=n).astype(np.int64)
            a, b = forest.joining(p, q)
            out.append((ids[a], ids[b], np.zeros(len(a), np.int64)))
    linked = np.flatnonzero(links)
    if len(linked):
        out.append((ids[linked], ids[linked], links[linked]))


def _bucket_links(cosine: float):
    """Over rows sorted by bucket: (a, b, 0) for a link of the forest, (a, a, n) for n links."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bucket = None

        def close(out: list) -> None:
            if sum(len(x[0]) for x in held) < 2:
                return
            ids, sizes, sides, values, keys = (np.concatenate([x[i] for x in held]) for i in range(5))
            vectors = _normalised(values, len(values) // len(ids))
            _compare(bucket[0], ids, sizes, vectors, keys.reshape(len(ids), -1), sides if bucket[2] != bucket[3] else None, cosine, out)

        def batch(out: list) -> pa.RecordBatch:
            columns = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])

        for rows in batches:
            if not rows.num_rows:
                continue
            marks = np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "key", "low", "high")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            bounds = [0, *cuts.tolist(), rows.num_rows]
            ids, sizes, sides = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("class_id", "size", "side"))
            (values, places), (keys, key_places) = _lists(rows.column("embedding")), _lists(rows.column("keys"))
            out: list = []
            for s, e in zip(bounds, bounds[1:], strict=False):
                own = tuple(marks[:, s].tolist())
                if own != bucket:
                    close(out)
                    held, bucket = [], own
                held.append((ids[s:e], sizes[s:e], sides[s:e], values[places[s] : places[e]], keys[key_places[s] : key_places[e]]))
            yield batch(out)
        out = []
        close(out)
        yield batch(out)

    return links


def embedding_duplicates(
    embeddings: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    cosine: float = 0.9,
    miss: float = 1e-4,
    most_in_bucket: int = 4_096,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each distinct vec_id.

    Vectors link when their cosine, in double precision, is at least `cosine`; a pair at the
    threshold is missed with chance `miss`, a closer one more rarely, and no pair below it
    links. Null, empty and zero vectors and those with a null or non-finite component link
    with nothing; vectors of different length do not link. Rows that repeat an id are one
    vector, the least of theirs. A null id is one row without links or component, not kept.

    A bucket of more than `most_in_bucket` distinct vectors is cut into parts; each pair of
    parts is compared by a task of its own, so every pair is still compared.
    """
    rows = named(embeddings, vec_id=vec_id, embedding=embedding)
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = stored(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    classes = valid.groupBy("embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("size"))
    classes = stored(classes.select(F.col("class_id").cast("long"), "size", "embedding"), "vector-classes")
    plan = Plan.for_rows(classes.count(), cosine, miss)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in classes.schema)}, keys array<int>"
    keyed = stored(classes.mapInArrow(_with_keys(plan), schema), "vector-keys")

    dealt = keyed.select("class_id", "size", "embedding", "keys", F.posexplode("keys").alias("t", "key"))
    sizes = keyed.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").agg(F.count("*").alias("n"))
    large = stored(sizes.where(F.col("n") > most_in_bucket).select("t", "key", F.ceil(F.col("n") / most_in_bucket).cast("int").alias("parts")), "large-buckets")
    whole = [F.lit(0).alias(c) for c in ("low", "high", "side")]
    names = ["t", "key", "low", "high", "side", "class_id", "size", "embedding", "keys"]
    if large.limit(1).count():
        parted = dealt.join(small(large), ["t", "key"]).withColumn("side", F.pmod(F.xxhash64("class_id"), "parts").cast("int"))
        parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        parted = parted.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})
        dealt = dealt.join(small(large.select("t", "key")), ["t", "key"], "left_anti").select("*", *whole).select(names).unionByName(parted.select(names))
    else:
        dealt = dealt.select("*", *whole).select(names)
    order = ["t", "key", "low", "high"]
    found = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_bucket_links(cosine), "a long, b long, n long")
    found = stored(found, "vector-links")

    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("a <> b").select("a", "b"))
    of_class = classes.join(counts, F.col("class_id") == F.col("a"), "left").join(groups, F.col("class_id") == F.col("node"), "left")
    of_class = of_class.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "class_id").alias("name"))
    linked = valid.join(of_class, "embedding").select(F.col("vec_id").alias("own_id"), "links", "name")
    out = rows.select("vec_id").join(linked, F.col("vec_id") == F.col("own_id"), "left")
    component = F.coalesce("name", F.col("vec_id").cast("long"))
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
