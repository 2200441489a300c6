import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import DOCS, awkward, clashing, prose, rows_of

from queuesight.llm import divergence, transducer
from queuesight.llm.divergence import labelled_texts, recounted, source_divergence, transducers, vocabulary

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(rows, least=3, top=200):
    rows = [(lang or "", source or "", terms(text)) for text, lang, source in rows]
    df, counts = Counter(), {}
    for lang, source, found in rows:
        df.update((lang, t) for t in set(found))
        counts.setdefault((lang, source), Counter()).update(found)
    out = []
    for lang, source in counts:
        kept = sorted((t for (own, t), n in df.items() if own == lang and n >= least), key=str.encode)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return [1 + 1_000_000_000 * (count[t] + 1) // (total + len(kept)) for t in kept]

        own = counts[lang, source]
        p = shares(own)
        pairs = []
        for (other_lang, other), count in counts.items():
            if other_lang == lang and other != source:
                pairs.append((other, sum((a - b) ** 2 // b for a, b in zip(p, shares(count), strict=True))))
        q = shares(sum((c for (own_lang, _), c in counts.items() if own_lang == lang), Counter()))
        found = [(t, (a - b) ** 2 // b) for t, a, b in zip(kept, p, q, strict=True) if own[t] and a > b]
        for part, items, most in (("pair", pairs, None), ("term", found, top)):
            items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, n + 1) for n, (item, value) in enumerate(items)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 0) for i, (t, lang, source) in enumerate(rows)], DOCS)


def corpus(seed, n=150):
    rng = random.Random(seed)
    langs, sources = ["en", "en", "de", None, "fr"], ["a", "a", "a", "b", "é", None, ""]
    rows = [(t, rng.choice(langs), rng.choice(sources)) for _, t in awkward(rng)]
    rows += [(prose(rng, rng.randint(0, 40)) + rng.choice(["", " Ünïcode Éa", " straße ÄB", " \U0001f600x"]), rng.choice(langs), rng.choice(sources)) for _ in range(n)]
    return rows + [("only here", "xx", "a"), ("and here", "xx", "b"), (None, "xx", "c"), (None, "yy", "a")]


def test_against_brute_force(spark):
    rows = corpus(5)
    assert rows_of(source_divergence(clashing(frame(spark, rows)))) == plain(rows)
    assert rows_of(source_divergence(frame(spark, rows), least_documents=1, top=3)) == plain(rows, 1, 3)


def test_blocks_tiles_and_routed_terms_give_the_same(spark, monkeypatch):
    rows = corpus(6)
    monkeypatch.setattr(divergence, "TILE_TERMS", 7)
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    assert rows_of(source_divergence(frame(spark, rows), block_terms=9)) == plain(rows)
    assert rows_of(source_divergence(frame(spark, rows), block_terms=9, task_bytes=0)) == plain(rows)


def test_counts_leave_a_task_whole_in_little_room(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "CHUNK", 300)
    rows = corpus(7)
    texts = labelled_texts(frame(spark, rows), "text", "lang", "source")
    vocab = vocabulary(texts, 2)
    names = {(r.lang, r.ordinal): r.term for r in vocab.collect()}
    groups = {r.gid: (r.lang, r.source) for r in texts.collect()}
    got = {(*groups[r.gid], names[groups[r.gid][0], r.ordinal]): r.n for r in recounted(texts, transducers(vocab, 11)).collect()}
    want = Counter((lang or "", source or "", t) for text, lang, source in rows for t in terms(text) if (lang or "", t) in {(k[0], v) for k, v in names.items()})
    assert got == want
    for lang in {k[0] for k in names}:
        known = [names[k] for k in sorted(names) if k[0] == lang]
        assert known == sorted(known, key=str.encode)


def test_empty_and_wordless_tables(spark):
    assert source_divergence(spark.createDataFrame([], DOCS)).collect() == []
    rows = [("1 2 3", "en", "a"), (None, "en", "b"), ("", "en", None)]
    assert rows_of(source_divergence(frame(spark, rows))) == plain(rows)


def random_terms(rng, n):
    return sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))).encode() for _ in range(n)})


@pytest.mark.parametrize("seed", range(5))
def test_transducer_is_minimal_and_gives_ordinals(seed):
    rng = random.Random(seed)
    known = random_terms(rng, rng.choice([0, 1, 40, 400]))
    built = transducer.build(known)
    asked = known + random_terms(rng, 300) + [b"abc" * 50]
    ends = np.cumsum([len(t) for t in asked])
    again = transducer.from_bytes(built.to_bytes())
    got = transducer.ordinals(again, np.frombuffer(b"".join(asked), "u1"), np.r_[0, ends[:-1]], ends)
    assert got.tolist() == [known.index(t) if t in known else -1 for t in asked]
    prefixes = {t[:i] for t in known for i in range(len(t) + 1)} or {b""}
    endings = {frozenset(t[len(p) :] for t in known if t.startswith(p)) for p in prefixes}
    assert len(built.final) == len(endings)


def test_transducer_wants_ascending_terms():
    with pytest.raises(ValueError):
        transducer.build([b"b", b"a"])
    with pytest.raises(ValueError):
        transducer.build([b"a", b"a"])


def test_places_of_terms():
    text = "aB1é-ü\u0000Z@[`{~ x"
    buffer = np.frombuffer(text.encode(), "u1")
    starts, ends = transducer.term_places(buffer)
    assert [transducer.LOWERED[buffer][s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)] == terms(text)
