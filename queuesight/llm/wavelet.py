"""A wavelet matrix over one shard of token ids, in one compressed file.

The ids are kept as bit planes, from the highest bit down; after each plane the ids are
reordered stably, zeros first. Planes are compressed in blocks with a directory of ones
before each block, so access, counting and occurrence lookup read only the blocks they touch.

Layout, little-endian: magic, header length, header (JSON), then the sections the header
places: document ids, document lengths and, for each plane, its compressed blocks.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"WMTX1\n"
BLOCK = 1 << 18  # bits of a plane in a block
NULL_ID = -(1 << 63)  # stands for a null document id


def _planes(ids: np.ndarray, bits: int):
    """Each plane as booleans, with its number of zeros."""
    now = ids
    for level in range(bits - 1, -1, -1):
        ones = (now >> level) & 1 == 1
        zeros = ~ones
        yield ones, int(np.count_nonzero(zeros))
        now = np.concatenate((now[zeros], now[ones]))


def write_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], bits: int, level: int = 1) -> bytes:
    """The file's bytes for documents of the given lengths, whose ids follow one another."""
    pack = zstandard.ZstdCompressor(level=level).compress
    body: list[bytes] = []
    place = 0

    def section(data: bytes) -> list[int]:
        nonlocal place
        body.append(data)
        place += len(data)
        return [place - len(data), len(data)]

    header: dict = {"n_tokens": len(ids), "n_docs": len(doc_ids), "bits": bits, "block": BLOCK}
    header["doc_ids"] = section(pack(np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes()))
    header["lengths"] = section(pack(np.array(lengths, "<u8").tobytes()))
    header["planes"] = []
    for ones, zeros in _planes(ids, bits):
        packed = np.packbits(ones, bitorder="little").tobytes()
        blocks = [section(pack(packed[at : at + BLOCK // 8])) for at in range(0, len(packed), BLOCK // 8)]
        counts = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK), dtype=np.int64) if len(ones) else []
        before = np.concatenate(([0], np.cumsum(counts))).astype(int).tolist()
        header["planes"].append({"zeros": zeros, "blocks": blocks, "ones_before": before})
    head = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, *body])


class WaveletShard:
    """Random access to the bytes of one shard."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        (size,) = struct.unpack_from("<Q", data, len(MAGIC))
        start = len(MAGIC) + 8
        self.header = json.loads(data[start : start + size])
        self.body, self.bits = memoryview(data)[start + size :], self.header["bits"]
        self.n_tokens, self.planes = self.header["n_tokens"], self.header["planes"]
        self._unpack = zstandard.ZstdDecompressor().decompress
        self._blocks: dict[tuple[int, int], np.ndarray] = {}
        ids = np.frombuffer(self._section(self.header["doc_ids"]), "<i8")
        self.doc_ids = [None if d == NULL_ID else d for d in ids.tolist()]
        self.lengths = np.frombuffer(self._section(self.header["lengths"]), "<u8").astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))

    def _section(self, at: list[int]) -> bytes:
        return self._unpack(self.body[at[0] : at[0] + at[1]])

    def _bits(self, plane: int, block: int) -> np.ndarray:
        key = (plane, block)
        if key not in self._blocks:
            if len(self._blocks) >= 64:
                self._blocks.clear()
            packed = np.frombuffer(self._section(self.planes[plane]["blocks"][block]), np.uint8)
            self._blocks[key] = np.unpackbits(packed, bitorder="little")
        return self._blocks[key]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, within = divmod(i, BLOCK)
        before = self.planes[plane]["ones_before"][block]
        return before + (int(self._bits(plane, block)[:within].sum(dtype=np.int64)) if within else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a plane."""
        before = np.array(self.planes[plane]["ones_before"])
        if not bit:
            edges = np.minimum(np.arange(len(before)) * BLOCK, self.n_tokens)
            before = edges - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        own = self._bits(plane, block)[: self.n_tokens - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(own == bit)[k - before[block]])

    def _down(self, plane: int, bit: int, i: int) -> int:
        ones = self._ones(plane, i)
        return self.planes[plane]["zeros"] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The id at a place."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            bit = int(self._bits(plane, i // BLOCK)[i % BLOCK])
            value = value << 1 | bit
            i = self._down(plane, bit, i)
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Places of an id's occurrences among [low, high) in the order below the last plane."""
        if token >> self.bits or token < 0:
            return 0, 0
        for plane in range(self.bits):
            bit = token >> (self.bits - 1 - plane) & 1
            low, high = self._down(plane, bit, low), self._down(plane, bit, high)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id among the places [low, high)."""
        start, end = self._range(token, low, self.n_tokens if high is None else high)
        return end - start

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        start, end = self._range(token, 0, self.n_tokens)
        if not 0 <= k < end - start:
            raise IndexError(k)
        at = start + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            at = self._select(plane, bit, at - self.planes[plane]["zeros"] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All ids in order."""
        now = np.zeros(self.n_tokens, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            packed = b"".join(self._section(at) for at in self.planes[plane]["blocks"])
            ones = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n_tokens, bitorder="little").view(bool)
            zeros, order = self.planes[plane]["zeros"], np.empty_like(now)
            order[~ones] = now[:zeros]
            order[ones] = now[zeros:] | now.dtype.type(1 << (self.bits - 1 - plane))
            now = order
        return now

    def documents(self):
        """(doc_id, first place, ids) of each document."""
        tokens = self.tokens()
        for i, doc_id in enumerate(self.doc_ids):
            yield doc_id, int(self.starts[i]), tokens[self.starts[i] : self.starts[i + 1]]
