"""How far the sources of a language drift apart, over the language's own vocabulary.

The terms kept for a language are sorted and numbered, and each block of them becomes a
minimal transducer that gives a term its number. Texts stream through it to be counted anew;
from there on terms are numbers: counts, shares, divergences and ties (numbers ascend as the
terms' bytes do). Shares are whole billionths and all sums exact.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import transducer
from .common import ascii_lower, named, small, stored
from .ranking import numbered

BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_TERMS = 200_000  # terms of one transducer: some MB, built by one task
TASK_BYTES = 48 << 20  # transducers that every task may hold at once
CHUNK = 4 << 20  # bytes of text matched at a time
HELD = 2_000_000  # counts a task gathers before it passes them on
TILE_TERMS, TILE_SOURCES = 8_192, 64  # shares that one task compares: at most 2 x 64 x 8,192


def terms_of(text: Column) -> Column:
    """Runs of ASCII letters and other non-ASCII characters, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN_TERMS, -1), "")


def labelled_texts(documents: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(gid, lang, source, text) with nulls as ''; gid is a hash of language and source."""
    rows = named(documents, lang=lang, source=source, text=text)
    rows = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.select(F.xxhash64("lang", "source").alias("gid"), "lang", "source", "text")


def vocabulary(texts: DataFrame, least_documents: int) -> DataFrame:
    """(lang, term, ordinal): the terms in enough rows of a language, numbered from 0 as their bytes ascend."""
    met = texts.select("lang", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    kept = met.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_documents)
    ranked = numbered(kept.select("lang", "term"), [F.col("term").asc()], "place", within=["lang"])
    return stored(ranked.select("lang", "term", (F.col("place") - 1).alias("ordinal")), "vocabulary")


def transducers(vocab: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, block, first, base, data): one transducer for each block of successive terms."""

    def built(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal")
        data = transducer.build(t.encode() for t in rows["term"]).to_bytes()
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "block": rows["block"].iloc[:1], "first": rows["term"].iloc[:1], "base": rows["ordinal"].iloc[:1], "data": [data]})

    blocks = vocab.select("*", F.expr(f"ordinal div {int(block_terms)}").alias("block"))
    built_blocks = blocks.groupBy("lang", "block").applyInPandas(built, "lang string, block long, first string, base long, data binary")
    return stored(built_blocks, "transducers")


class Counts:
    """Counts by (gid, ordinal), gathered in bounded room and handed over as frames."""

    def __init__(self):
        self.gids, self.ordinals, self.counts, self.held = [], [], [], 0

    def add(self, gids: np.ndarray, ordinals: np.ndarray, counts: np.ndarray) -> None:
        self.gids.append(gids)
        self.ordinals.append(ordinals)
        self.counts.append(counts)
        self.held += len(gids)

    def merged(self) -> pd.DataFrame:
        gids, ordinals, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.gids, self.ordinals, self.counts))
        order = np.lexsort((ordinals, gids))
        gids, ordinals, counts = gids[order], ordinals[order], counts[order]
        fresh = np.flatnonzero(np.r_[True, (gids[1:] != gids[:-1]) | (ordinals[1:] != ordinals[:-1])]) if len(gids) else np.zeros(0, np.int64)
        self.__init__()
        return pd.DataFrame({"gid": gids[fresh], "ordinal": ordinals[fresh], "n": np.add.reduceat(counts, fresh) if len(fresh) else counts})

    def taken(self) -> Iterator[pd.DataFrame]:
        """A frame to pass on once merging alone no longer makes room."""
        if self.held > HELD:
            frame = self.merged()
            if len(frame) > HELD // 2:
                yield frame
            else:
                self.add(*(frame[c].to_numpy() for c in ("gid", "ordinal", "n")))


def _chunks(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, first byte of each text, its gid): texts parted by a zero byte, about CHUNK bytes at a time."""
    parts, firsts, gids, size = [], [], [], 0
    for gid, text in zip(rows["gid"].tolist(), rows["text"], strict=True):
        if not text:
            continue
        data = text.encode("utf-8", "replace")
        parts.append(data)
        firsts.append(size)
        gids.append(gid)
        size += len(data) + 1
        if size > CHUNK:
            yield np.frombuffer(b"\0".join(parts), "u1"), np.array(firsts), np.array(gids, np.int64)
            parts, firsts, gids, size = [], [], [], 0
    if parts:
        yield np.frombuffer(b"\0".join(parts), "u1"), np.array(firsts), np.array(gids, np.int64)


def _streamed(texts: DataFrame, built: DataFrame) -> DataFrame:
    """Whole texts through all transducers of their language; the tasks hold them all."""
    sent = texts.sparkSession.sparkContext.broadcast([(r["lang"], r["base"], r["data"]) for r in built.select("lang", "base", "data").collect()])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list] = {}
        for lang, base, data in sent.value:
            known.setdefault(lang, []).append((base, transducer.from_bytes(data)))
        counts = Counts()
        for batch in batches:
            for lang, rows in batch.groupby("lang", sort=False):
                for buffer, firsts, gids in _chunks(rows) if lang in known else ():
                    starts, ends = transducer.term_places(buffer)
                    lowered = transducer.LOWERED[buffer]
                    text_at = np.searchsorted(firsts, starts, "right") - 1
                    groups, group_at = np.unique(gids, return_inverse=True)
                    for base, machine in known[lang]:
                        found = transducer.ordinals(machine, lowered, starts, ends)
                        hit = found >= 0
                        terms = int(found.max(initial=0)) + 1
                        keys, n = np.unique(group_at[text_at[hit]] * terms + found[hit], return_counts=True)
                        counts.add(groups[keys // terms], keys % terms + base, n)
                        yield from counts.taken()
        yield counts.merged()

    return texts.select("gid", "lang", "text").mapInPandas(counted, "gid long, ordinal long, n long")


def _routed(texts: DataFrame, built: DataFrame) -> DataFrame:
    """Terms counted per group first, then each sent to the one block that may know it.

    For vocabularies beyond what a task may hold. A task holds one transducer at a time; the
    terms of its block stream past it. Only the first term of each block is known to all.
    """
    firsts: dict[str, list[str]] = {}
    for r in built.select("lang", "block", "first").orderBy("lang", "block").collect():  # one row a block
        firsts.setdefault(r["lang"], []).append(r["first"].encode())
    sent = texts.sparkSession.sparkContext.broadcast(firsts)

    @F.pandas_udf("long")
    def block_of(langs: pd.Series, terms: pd.Series) -> pd.Series:
        known = sent.value
        return pd.Series([bisect_right(known.get(lang, ()), term.encode()) - 1 for lang, term in zip(langs, terms, strict=True)], dtype="int64")

    terms = texts.select("gid", "lang", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("gid", "lang", "term").agg(F.count(F.lit(1)).alias("n"))
    terms = terms.select("lang", block_of("lang", "term").alias("block"), "gid", "term", "n", F.lit(0).cast("long").alias("base"), F.lit(None).cast("binary").alias("data"))
    machines = built.select("lang", "block", F.lit(0).cast("long").alias("gid"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "base", "data")
    both = terms.where("block >= 0").unionByName(machines).repartition("lang", "block")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, machine = 0, None
        for batch in batches:
            cuts = np.flatnonzero(batch["data"].notna().to_numpy()).tolist()
            for start, end in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                rows = batch.iloc[start:end]
                if len(rows) and rows["data"].iloc[0] is not None:
                    base, machine = int(rows["base"].iloc[0]), transducer.from_bytes(rows["data"].iloc[0])
                    rows = rows.iloc[1:]
                if not len(rows):
                    continue
                words = [t.encode() for t in rows["term"]]
                ends = np.cumsum([len(w) for w in words])
                found = transducer.ordinals(machine, np.frombuffer(b"".join(words), "u1"), np.r_[0, ends[:-1]], ends)
                hit = found >= 0
                yield pd.DataFrame({"gid": rows["gid"].to_numpy()[hit].astype(np.int64), "ordinal": found[hit] + base, "n": rows["n"].to_numpy()[hit]})

    return both.sortWithinPartitions("lang", "block", F.col("data").isNull()).mapInPandas(counted, "gid long, ordinal long, n long")


def recounted(texts: DataFrame, built: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(gid, ordinal, n): how often each group of texts has each kept term of its language.

    Both ways give the same rows. Transducers of at most `task_bytes` together are sent to
    every task and whole texts stream through them; larger ones stay apart, block by block.
    """
    size = built.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    found = (_streamed if size <= task_bytes else _routed)(texts, built)
    return stored(found.groupBy("gid", "ordinal").agg(F.sum("n").alias("n")), "recounts")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 (count + 1) / (total + kept)), exact for any count."""
    whole = lambda c: c.cast("decimal(19,0)")
    above = (F.lit(1_000_000_000).cast("decimal(10,0)") * whole(count + 1)).cast("decimal(38,0)")
    below = F.greatest(whole(total + kept), F.lit(1).cast("decimal(19,0)")).cast("decimal(38,0)")  # no term kept: no share is used
    return F.lit(1) + F.call_function("div", above, below).cast("long")


def _tiled_divergences(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, other, value): for each ordered pair of groups of a language the summed divergence of all kept terms.

    Shares are laid out as tiles of sources by terms. A task holds two tiles of the same
    terms and emits one partial sum for each pair of their sources.
    """
    spot = groups.select("gid", "lang", "base_share", "kept", F.expr(f"spot div {TILE_SOURCES}").alias("tile"), F.expr(f"(sources + {TILE_SOURCES - 1}) div {TILE_SOURCES}").alias("tiles"))
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(kept + {TILE_TERMS - 1}) div {TILE_TERMS} - 1"), F.lit(0).cast("long")))
    empty = spot.select("gid", "lang", "tile", "tiles", F.explode(blocks).alias("block"), F.lit(-1).cast("long").alias("ordinal"), F.col("base_share").alias("p"), "kept")
    filled = shares.join(small(spot.select("gid", "tile", "tiles")), "gid")
    filled = filled.select("gid", "lang", "tile", "tiles", F.expr(f"ordinal div {TILE_TERMS}").alias("block"), "ordinal", "p", "kept")
    both = empty.unionByName(filled).withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    both = both.select("lang", "block", F.least("tile", "partner").alias("tile_a"), F.greatest("tile", "partner").alias("tile_b"), "tile", "gid", "ordinal", "p", "kept")

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        block, tile_a, tile_b = (int(rows[c].iloc[0]) for c in ("block", "tile_a", "tile_b"))
        width = min(TILE_TERMS, int(rows["kept"].iloc[0]) - block * TILE_TERMS)
        marks = rows[rows["ordinal"] < 0]
        gids, tiles = marks["gid"].to_numpy(), marks["tile"].to_numpy()
        order = np.argsort(gids)
        gids, tiles = gids[order], tiles[order]
        p = np.repeat(marks["p"].to_numpy()[order][:, None], max(width, 0), axis=1)
        found = rows[rows["ordinal"] >= 0]
        p[np.searchsorted(gids, found["gid"].to_numpy()), found["ordinal"].to_numpy() - block * TILE_TERMS] = found["p"].to_numpy()
        out = []
        for i in range(len(gids)):
            d = p[i] - p
            sums = (d * d // p).sum(axis=1)
            wanted = (tiles != tiles[i]) if tile_a != tile_b else (gids != gids[i])
            out.append(pd.DataFrame({"gid": gids[i], "other": gids[wanted], "value": sums[wanted]}))
        return pd.concat(out)

    parts = both.groupBy("lang", "block", "tile_a", "tile_b").applyInPandas(compared, "gid long, other long, value long")
    return parts.groupBy("gid", "other").agg(F.sum("value").alias("value"))


def source_divergence(
    documents: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_documents: int = 3,
    top: int = 200,
    block_terms: int = BLOCK_TERMS,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of language and source that occurs.

    Part `pair`: each other source of the language with the divergence summed over its kept
    terms (those in `least_documents` rows). Part `term`: the terms that a group has more often
    than its language does, the `top` by divergence. Ranks go from 1 by value, ties by the
    item's bytes. Null text, language and source count as ''; rows that repeat, or repeat an
    id, are documents of their own; a group without terms has the shares of none; a language
    without kept terms has pairs of 0 and no terms; no documents give no rows. Other columns
    of the input, whatever their names, play no part.
    """
    texts = labelled_texts(documents, text, lang, source)
    vocab = vocabulary(texts, least_documents)
    counts = recounted(texts, transducers(vocab, block_terms), task_bytes)

    occurring = stored(texts.select("gid", "lang", "source").distinct(), "groups")
    if occurring.count() != occurring.select("gid").distinct().count():
        raise ValueError("two groups of language and source share a 64-bit hash")
    kept = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = counts.groupBy("gid").agg(F.sum("n").alias("total"))
    groups = occurring.join(totals, "gid", "left").join(kept, "lang", "left")
    groups = groups.select("gid", "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    by_lang = Window.partitionBy("lang")  # one row a source
    groups = groups.select(
        "*",
        share(F.lit(0), F.col("total"), F.col("kept")).alias("base_share"),
        F.sum("total").over(by_lang).alias("lang_total"),
        F.count(F.lit(1)).over(by_lang).alias("sources"),
        (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("spot"),
    )
    groups = stored(groups, "group-totals")
    placed = counts.join(small(groups.select("gid", "lang", "total", "kept", "lang_total")), "gid")
    shares = stored(placed.select("gid", "lang", "ordinal", "n", "kept", "lang_total", share(F.col("n"), F.col("total"), F.col("kept")).alias("p")), "shares")

    names = groups.select(F.col("gid").alias("other"), F.col("source").alias("item"))
    pairs = _tiled_divergences(shares, groups).join(small(names), "other").join(small(groups.select("gid", "lang", "source")), "gid")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))

    whole = shares.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n"), F.first("kept").alias("kept"), F.first("lang_total").alias("lang_total"))
    whole = whole.select("lang", "ordinal", share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    higher = shares.select("gid", "lang", "ordinal", "p").join(whole, ["lang", "ordinal"]).where(F.col("p") > F.col("q"))
    higher = higher.select("gid", "lang", "ordinal", F.expr("(p - q) * (p - q) div q").alias("value"))
    best = Window.partitionBy("gid").orderBy(F.col("value").desc(), "ordinal")  # a map task sends its own `top` at most
    terms = stored(higher.select("*", F.row_number().over(best).alias("rank")).where(F.col("rank") <= top), "top-terms")
    terms = vocab.join(small(terms), ["lang", "ordinal"]).join(small(groups.select("gid", "source")), "gid")
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
