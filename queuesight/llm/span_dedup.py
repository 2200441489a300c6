"""Removal of passages that repeat across documents, by sliding spans of sentences.

Every run of consecutive sentences is hashed: from each sentence on, and up to each sentence,
the shortest run of at least `sentences` sentences and `words` words. Runs with equal hashes
are joined over the whole corpus, and the sentences that a run covers go wherever it is not
the first of its kind. Words, cuts and hashes are computed for many texts at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS
from .common import named, stored, text_key

WINDOW = 8  # of any so many words of a sentence, at least one ends a piece; a power of two
CHUNK = 4 << 20  # bytes of text handled at a time
STEP = 1 << 19  # words hashed at a time
HELD = 1 << 20  # runs compared inside a task before they are sent on
SPACE = np.zeros(256, bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
LOWERED = np.arange(256, dtype=np.uint64)
LOWERED[0x41:0x5B] += np.uint64(32)
FULL_STOP = np.zeros(256, bool)
FULL_STOP[[0x21, 0x2E, 0x3F]] = True
# Odd multipliers of the three rolling hashes, modulo 2**64.
OF_BYTES, OF_WORDS = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a number over all of its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word buffer[start:end], A-Z taken as a-z."""
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), STEP):
        s, e = starts[at : at + STEP], ends[at : at + STEP]
        sizes = e - s
        offsets = np.cumsum(sizes) - sizes
        inside = np.arange(sizes.sum()) - np.repeat(offsets, sizes)
        values = (LOWERED[buffer[inside + np.repeat(s, sizes)]] + np.uint64(1)) * _powers(OF_BYTES, int(sizes.max()))[inside]
        out[at : at + STEP] = _mixed(np.add.reduceat(values, offsets))
    return out


def _least(values: np.ndarray) -> np.ndarray:
    """The least of each WINDOW successive values, by doubling."""
    size = 1
    while size < WINDOW:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values


def ends_of_pieces(hashes: np.ndarray, stops: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """True where a word ends a piece: a full stop, the end of its text, or the least hash of some WINDOW words of its sentence.

    Whether a word ends a piece depends on fewer than WINDOW words of its sentence to either side.
    """
    last = np.r_[docs[1:] != docs[:-1], True] if len(docs) else np.zeros(0, bool)
    ends = stops | last
    if len(hashes) < WINDOW:
        return ends
    sentence = np.cumsum(np.r_[0, ends[:-1]])
    values = (hashes >> np.uint64(1)).astype(np.int64)
    least = np.where(sentence[: len(values) - WINDOW + 1] == sentence[WINDOW - 1 :], _least(values), -1)
    none = np.full(WINDOW - 1, -1)
    return ends | (-_least(-np.r_[none, least, none]) == values)


class Pieces(NamedTuple):
    """The pieces of some texts: their words (first, end), text, first byte, and the words' hashes."""

    first: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    byte: np.ndarray
    hashes: np.ndarray


def pieces_of(texts: Sequence[bytes]) -> Pieces:
    """Cuts texts into pieces: up to a full stop and the white space after it, or a word of least hash.

    Line ends are white space like any other, so a text wrapped otherwise is cut alike. A
    piece has at most WINDOW words, and all but the first and last WINDOW - 1 words of a
    passage are cut alike wherever it stands. So any 50 words that two texts share hold an
    equal run of three pieces and twenty words: 15 words up to the first sure cut, from it at
    most 28 words, and the last cut is sure 7 words before the end. Texts of white space only
    have no pieces.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    buffer = np.frombuffer(b"\n".join(texts), np.uint8)
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~SPACE[buffer]
    edges = np.diff(inside)
    word_starts, word_ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    docs = np.searchsorted(starts, word_starts, "right") - 1
    hashes = word_hashes(buffer, word_starts, word_ends)
    end = np.flatnonzero(ends_of_pieces(hashes, FULL_STOP[buffer[word_ends - 1]], docs)) + 1
    first = np.r_[0, end[:-1]] if len(end) else end
    doc = docs[first]
    leads = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    return Pieces(first, end, doc, np.where(leads, starts[doc], word_starts[first]), hashes)


def runs_of(pieces: Pieces, sentences: int = 3, words: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) piece of every run: the shortest from each piece and up to each piece."""
    n = len(pieces.end)
    at = np.arange(n)
    last = np.maximum(at + sentences - 1, np.searchsorted(pieces.end, pieces.first + words))
    lead = np.minimum(at - sentences + 1, np.searchsorted(pieces.first, pieces.end - words, "right") - 1)
    good, also = last < n, lead >= 0
    good[good] = pieces.doc[last[good]] == pieces.doc[good]
    also[also] = pieces.doc[lead[also]] == pieces.doc[also]
    pairs = np.unique(np.r_[at[good] * n + last[good], lead[also] * n + at[also]])
    return (pairs // n, pairs % n) if n else (pairs, pairs)


def run_hashes(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the words first up to end, as two arrays; the same words give the same bits anywhere."""
    out = []
    for base in OF_WORDS:
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, len(hashes)), dtype=np.uint64)]
        back = _powers(pow(base, -1, 1 << 64), len(hashes))
        out.append(_mixed((sums[end] - sums[first]) * back[first]).view(np.int64))
    return out[0], out[1]


def _chunks(batch: pd.DataFrame) -> Iterator[tuple[slice, list[bytes]]]:
    """The rows of a batch, about CHUNK bytes of text at a time; nulls as empty texts."""
    held, size, at = [], 0, 0
    for i, text in enumerate(batch["text"]):
        data = (text or "").encode("utf-8", "replace")
        held.append(data)
        size += len(data)
        if size > CHUNK:
            yield slice(at, i + 1), held
            held, size, at = [], 0, i + 1
    if held:
        yield slice(at, len(batch)), held


def _first_here(runs: pd.DataFrame) -> pd.DataFrame:
    """Of equal runs held together only the first can be the first of all; the others are marked `later`.

    A copy of a row says nothing new and goes.
    """
    order = ["h1", "h2", "doc_id", "th", "place"]
    runs = runs.sort_values(order, ignore_index=True)
    columns = {c: runs[c].to_numpy() for c in order}
    equal = lambda names: np.logical_and.reduce([columns[c][1:] == columns[c][:-1] for c in names])
    keep = np.r_[True, ~equal(order)]
    follows = np.r_[False, equal(order[:2])]
    runs["later"] |= follows
    return pd.concat([runs[keep & ~runs["later"]], _merged(runs[keep & runs["later"]])])


def _merged(runs: pd.DataFrame) -> pd.DataFrame:
    """Places of a text that overlap or touch as one."""
    if not len(runs):
        return runs
    runs = runs.sort_values(["doc_id", "th", "place"], ignore_index=True)
    ids, hashes, place = (runs[c].to_numpy() for c in ("doc_id", "th", "place"))
    s, e = place >> 32, place & 0xFFFFFFFF
    text = np.cumsum(np.r_[False, (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])])
    reach = np.maximum.accumulate((text << 32) + e)  # within its text, since texts ascend
    fresh = np.r_[True, (text << 32)[1:] + s[1:] > reach[:-1] + 1]
    fresh[1:] |= text[1:] != text[:-1]
    at = np.flatnonzero(fresh)
    ends = reach[np.r_[at[1:], len(reach)] - 1] & 0xFFFFFFFF
    return runs.iloc[at].assign(place=(s[at] << 32) + ends)


def _spans(sentences: int, words: int):
    """(h1, h2, doc_id, th, place, later) of every run, place being s * 2**32 + e.

    `later`: the text had the run before, or another one among the HELD runs at hand did.
    """

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for rows, texts in _chunks(batch):
                pieces = pieces_of(texts)
                s, e = runs_of(pieces, sentences, words)
                if not len(s):
                    continue
                h1, h2 = run_hashes(pieces.hashes, pieces.first[s], pieces.end[e])
                doc = pieces.doc[s]
                order = np.lexsort((s, h2, h1, doc))
                same = (doc[order][1:] == doc[order][:-1]) & (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
                later = np.zeros(len(s), bool)
                later[order[1:]] = same
                base = np.searchsorted(pieces.doc, doc)  # a text's first piece
                ids, hashes = batch["doc_id"].to_numpy()[rows], batch["th"].to_numpy()[rows]
                held.append(pd.DataFrame({"h1": h1, "h2": h2, "doc_id": ids[doc], "th": hashes[doc], "place": ((s - base) << 32) + (e - base), "later": later}))
                size += len(s)
                if size > HELD:
                    yield _first_here(pd.concat(held))
                    held, size = [], 0
        if held:
            yield _first_here(pd.concat(held))

    return spans


def repeated_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: int = 3, words: int = 20) -> DataFrame:
    """(doc_id, th, s, e): runs of sentences, s to e, that are not the first of their kind.

    Order is by id, a null id first, then by `th`, a hash of the text that tells rows of one id
    apart, then by place. Rows that repeat id and text are one document. Columns of other
    names play no part.

    Of a run as common as may be each task sends one row for every HELD runs to the run's
    group, so groups stay short; places known to be later are dealt evenly beside them.
    """
    lowest = F.lit(-(1 << 63))
    rows = named(documents, doc_id=doc_id, text=text)
    rows = rows.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("doc_id"), text_key(F.col("text")).alias("th"), "text")
    spans = rows.mapInPandas(_spans(sentences, words), "h1 long, h2 long, doc_id long, th long, place long, later boolean")
    dealt = F.when(F.col("later"), F.xxhash64("doc_id", "th", "place")).otherwise(F.col("h1"))
    spans = spans.select(dealt.alias("h1"), "h2", "doc_id", "th", "place", "later")
    kind = Window.partitionBy("h1", "h2").orderBy("doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)
    judged = spans.select("doc_id", "th", "place", "later", F.first("doc_id").over(kind).alias("first_id"), F.first("th").over(kind).alias("first_th"))
    judged = judged.where(F.col("later") | (F.col("doc_id") != F.col("first_id")) | (F.col("th") != F.col("first_th")))
    ends = [F.shiftright("place", 32).cast("int").alias("s"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("e")]
    return judged.select(F.nullif("doc_id", lowest).alias("doc_id"), "th", *ends)


def _islands(spans: DataFrame) -> DataFrame:
    """(hit_id, hit_th, covers): the spans of each text without overlaps, in order.

    Spans of one text are sorted and merged as rows; what is gathered is shorter than the text.
    """
    spans = spans.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), "s", "e")
    before = Window.partitionBy("hit_id", "hit_th").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("fresh", (F.col("s") > F.coalesce(F.max("e").over(before), F.lit(-2)) + 1).cast("int"))
    upto = Window.partitionBy("hit_id", "hit_th").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    islands = spans.withColumn("island", F.sum("fresh").over(upto)).groupBy("hit_id", "hit_th", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return islands.groupBy("hit_id", "hit_th").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("covers"))


def remove_repeated_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: int = 3, words: int = 20) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) of every row, the text without repeated passages.

    The text kept is the remaining sentences as they were. A null text stays null and, like a
    blank one, has no sentences; a text all of whose sentences repeat becomes empty. Different
    texts count against one another whatever their ids, null and repeated ones included; rows
    that repeat id and text are treated alike. Columns of other names play no part.
    """
    covers = stored(_islands(repeated_spans(documents, doc_id, text, sentences, words)), "covered-sentences")
    size = covers.agg(F.count("*"), F.coalesce(F.sum(F.size("covers")), F.lit(0))).first()
    if sum(size) <= 2 * BROADCAST_ROWS:  # documents and spans: some tens of bytes each
        covers = F.broadcast(covers)
    rows = named(documents, doc_id=doc_id, text=text).select("doc_id", text_key(F.col("text")).alias("th"), "text")
    marked = rows.join(covers, F.col("doc_id").cast("long").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")

    @F.pandas_udf("n_sentences int, n_removed int, text string")
    def cut(texts: pd.Series, covered: pd.Series) -> pd.DataFrame:
        counts, removed, kept = [], [], []
        for rows, data in _chunks(pd.DataFrame({"text": texts})):
            pieces = pieces_of(data)
            total = np.bincount(pieces.doc, minlength=len(data))
            begin = np.cumsum([0] + [len(d) + 1 for d in data])  # of each text in the joined ones
            firsts = np.cumsum(total) - total
            for i, (spans, body) in enumerate(zip(covered.iloc[rows], texts.iloc[rows], strict=True)):
                counts.append(total[i])
                if spans is None or not len(spans):
                    removed.append(0)
                    kept.append(body)
                    continue
                gone = np.zeros(total[i], bool)
                for span in spans:
                    gone[span["s"] : span["e"] + 1] = True
                edges = np.r_[pieces.byte[firsts[i] : firsts[i] + total[i]] - begin[i], len(data[i])]
                removed.append(gone.sum())
                kept.append(b"".join(data[i][edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone)).decode("utf-8", "replace"))
        return pd.DataFrame({"n_sentences": counts, "n_removed": removed, "text": kept}).astype({"n_sentences": "int32", "n_removed": "int32"})

    return marked.select("doc_id", cut("text", "covers").alias("x")).select("doc_id", "x.n_sentences", "x.n_removed", "x.text")
