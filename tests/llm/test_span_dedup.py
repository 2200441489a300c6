import random

import numpy as np
import pytest
from helpers import DOCS, awkward, clashing, documents, prose, rows_of

from queuesight.llm import span_dedup
from queuesight.llm.span_dedup import pieces_of, remove_repeated_spans, run_hashes, runs_of, word_hashes

SPACE = " \t\n\v\f\r"


def plain_words(text):
    """(word, start, end) in the bytes of a text."""
    data, out, start = (text or "").encode(), [], None
    for i, b in enumerate(data + b" "):
        if chr(b) in SPACE:
            if start is not None:
                out.append((data[start:i], start, i))
            start = None
        elif start is None:
            start = i
    return out


def plain_pieces(text):
    """Pieces as (words, text): cut after full stops, and inside a sentence after a word whose hash is the least of some 8 words."""
    words = plain_words(text)
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w, _, _ in words]
    value = [int(word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) >> 1 for w in low]
    ends, sentence = set(), []
    for i, w in enumerate(low):
        sentence.append(i)
        if w[-1:] in (b".", b"!", b"?") or i == len(low) - 1:
            for at in range(len(sentence) - 7):
                window = sentence[at : at + 8]
                ends |= {k for k in window if value[k] == min(value[j] for j in window)}
            ends.add(i)
            sentence = []
    data, out, first = (text or "").encode(), [], 0
    for i in sorted(ends):
        begin = words[first][1] if out else 0
        stop = words[i + 1][1] if i + 1 < len(words) else len(data)
        out.append((tuple(low[first : i + 1]), data[begin:stop].decode()))
        first = i + 1
    return out


def plain_runs(pieces, sentences=3, words=20):
    n, out = len(pieces), set()
    long_enough = lambda s, e: e - s + 1 >= sentences and sum(len(p[0]) for p in pieces[s : e + 1]) >= words
    for i in range(n):
        e = next((e for e in range(i, min(n, i + 40)) if long_enough(i, e)), None)
        s = next((s for s in range(i, max(-1, i - 40), -1) if long_enough(s, i)), None)
        out |= ({(i, e)} if e is not None else set()) | ({(s, i)} if s is not None else set())
    return sorted(out)


def plain(rows, sentences=3, words=20):
    """A run goes unless its document, by id (null first) and hash of the text, is the first with it and the place the first in it."""
    key = lambda row: (row[0] is not None, row[0] or 0, row[2])
    first, found = {}, {}
    for row in rows:
        pieces = plain_pieces(row[1])
        runs = [(s, e, sum((p[0] for p in pieces[s : e + 1]), ())) for s, e in plain_runs(pieces, sentences, words)]
        found[row] = pieces, runs
        for _, _, run in runs:
            first[run] = min(first.get(run, key(row)), key(row))
    out = []
    for row in rows:
        pieces, runs = found[row]
        gone, met = set(), set()
        for s, e, run in runs:
            if first[run] != key(row) or run in met:
                gone |= set(range(s, e + 1))
            met.add(run)
        kept = row[1] if row[1] is None or not gone else "".join(p[1] for i, p in enumerate(pieces) if i not in gone)
        out.append((row[0], len(pieces), len(gone), kept))
    return sorted(out, key=repr)


def check(spark, rows, **options):
    frame = documents(spark, rows)
    hashed = frame.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS th").collect()
    got = rows_of(remove_repeated_spans(clashing(frame), **options))
    assert got == plain([tuple(r) for r in hashed], **options)


def test_against_the_plain_rule(spark, monkeypatch):
    rng = random.Random(9)
    passage = prose(rng, 70)
    rows = awkward(rng)
    for i in range(100, 130):
        rows.append((i if i % 5 else None, prose(rng, rng.randint(5, 90)) + ".\n" + (passage.upper() if i % 2 else prose(rng, 30)) + "\n" + prose(rng, 40)))
    rows.append((200, "Again and again it says so. Then it stops for a while. And begins anew here. " * 4))
    rows += [(201, prose(rng, 20) + " " + passage), (201, passage + " " + prose(rng, 20)), (201, passage + " " + prose(rng, 9))]
    check(spark, rows)
    monkeypatch.setattr(span_dedup, "CHUNK", 700)
    monkeypatch.setattr(span_dedup, "STEP", 37)
    monkeypatch.setattr(span_dedup, "HELD", 60)
    check(spark, rows, sentences=2, words=9)


def test_pieces_are_the_text():
    texts = [t for _, t in awkward() if t and t.strip(SPACE)] + ["a", " a ", "\n\na. b.\n"]
    found = pieces_of([t.encode() for t in texts])
    for i, text in enumerate(texts):
        mine = np.flatnonzero(found.doc == i)
        begin = found.byte[mine[0]]
        edges = [*(found.byte[mine] - begin), len(text.encode())]
        assert [text.encode()[a:b].decode() for a, b in zip(edges, edges[1:], strict=False)] == [p[1] for p in plain_pieces(text)]


def test_a_passage_stays_once_and_other_text_stays(spark):
    passage = " ".join(f"word{i}" + ("." if i % 9 == 8 else "") for i in range(63))
    own = {i: [f"own{i}x{j}" for j in range(60)] for i in range(40)}
    rows = [(i, " ".join(own[i][:30]) + ".\n" + passage + "\n" + " ".join(own[i][30:]) + ".") for i in range(40)]
    got = {r.doc_id: r.text for r in remove_repeated_spans(documents(spark, rows)).collect()}
    assert passage in got[0]
    for i in range(40):
        assert all(w in got[i] for w in own[i])
        assert i == 0 or "word30" not in got[i] and sum(f"word{j}" in got[i].split() for j in range(63)) == 0


def test_empty_table(spark):
    assert rows_of(remove_repeated_spans(spark.createDataFrame([], DOCS))) == []


def runs_in(text):
    pieces = pieces_of([text.encode()])
    s, e = runs_of(pieces)
    return set(zip(*(h.tolist() for h in run_hashes(pieces.hashes, pieces.first[s], pieces.end[e])), strict=True))


def some_words(rng, n, mark):
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 400)) + ("." if mark and rng.random() < 0.07 else "") for _ in range(n))


def wrapped(text, width):
    words = text.split()
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


@pytest.mark.parametrize("size", [50, 80, 120])
def test_any_fifty_shared_words_give_an_equal_run(size):
    """On one line or wrapped every 12 words, with or without marks, whatever stands around: none is missed."""
    rng = random.Random(size)
    for trial in range(600):
        passage = some_words(rng, size, trial % 2)
        around = lambda: some_words(rng, rng.randint(0, 30), trial % 3 == 0)  # noqa: B023, E731
        one = f"{around()} {passage} {around()}".strip()
        other = f"{around()} {wrapped(passage, 12)}\n{around()}".strip()
        assert runs_in(one) & runs_in(other)


def test_equal_words_alone_give_equal_hashes():
    rng = random.Random(3)
    for _ in range(50):
        text = some_words(rng, 60, True)
        assert runs_in(text) == runs_in("\n " + wrapped(text.upper(), 7) + "\t")
    runs = [runs_in(some_words(rng, 400, True)) for _ in range(20)]
    assert sum(map(len, runs)) == len(set().union(*runs))


def test_lead_in_words_do_not_hide_a_passage(spark):
    for marks in (True, False):
        passage = " ".join(f"word{i}" + ("." if marks and i % 18 == 17 else "") for i in range(54))
        rows = [(1, "Heading\n" + passage + "\nother text"), (2, "Before all of it " + wrapped(passage, 10) + " and after it")]
        got = {r.doc_id: r.text for r in remove_repeated_spans(documents(spark, rows)).collect()}
        left = [w for w in got[2].replace(".", " ").split() if w.startswith("word")]
        assert passage in got[1] and len(left) <= 28
        assert all(w in got[2].split() for w in "Before all of it and after it".split())
