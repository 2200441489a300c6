import random
import re
from re import _parser

import pytest
from helpers import DOCS, awkward, clashing, documents, prose, rows_of
from pyspark.sql import functions as F

from queuesight.llm.license_rules import CONFIDENCE, Rule, parsed
from queuesight.llm.licenses import PHRASES, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = parsed()


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def example(pattern, rng):
    """A random text that the pattern matches."""

    def some(parts):
        out = ""
        for kind, value in parts:
            kind = str(kind)
            if kind == "LITERAL":
                out += chr(value)
            elif kind == "IN":
                kind, found = rng.choice(value)
                out += chr(found if str(kind) == "LITERAL" else rng.randint(*found))
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = value
                out += "".join(some(inner) for _ in range(rng.randint(low, min(int(high), low + 3))))
            elif kind == "SUBPATTERN":
                out += some(value[3])
            elif kind == "BRANCH":
                out += some(rng.choice(value[1]))
            else:
                raise ValueError(kind)
        return out

    return some(_parser.parse(pattern))


def plain(rows, rules=RULES, phrases=PHRASES):
    out = []
    for doc, text in rows:
        w = words(text)
        places, base = [], set()
        for phrase, label in phrases.items():
            p = phrase.split(" ")
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        body = " " + "  ".join(w) + " "
        found = []
        for r in rules:
            for m in re.finditer(" (?:" + r.pattern.replace(" ", "  ") + ") ", body):
                before = len(body[: m.start()].split())
                found.append((before, before + len(m.group().split()), r))
        kept = []
        for level in range(len(CONFIDENCE)):
            free = [f for f in found if f[2].level == level and not any(k[0] < f[1] and f[0] < k[1] for k in kept)]

            def hidden(a, free=free):
                return any(b[0] <= a[0] and a[1] <= b[1] and (b[:2] != a[:2] or b[2].number < a[2].number) for b in free)

            kept += [f for f in free if not hidden(f)]
        labels = base | {f[2].label for f in kept}
        score = max([0.9] * bool(base) + [CONFIDENCE[f[2].level] for f in kept], default=0.0)
        out.append((doc, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    return sorted(out, key=repr)


def check(spark, rows, **options):
    got = scan_licenses(clashing(documents(spark, rows)), **options).drop("row")
    got = got.select(*[F.concat_ws(",", c) if c.endswith("labels") else F.col(c) for c in got.columns])
    want = plain(rows, options.get("rules", RULES), options.get("phrases", PHRASES))
    assert rows_of(got) == want


def test_hundreds_of_rules_with_sound_keywords():
    rng = random.Random(1)
    assert len(RULES) > 250 and [r.number for r in RULES] == list(range(len(RULES)))
    for r in RULES:
        for _ in range(60):
            text = example(r.pattern, rng)
            assert re.fullmatch(r.pattern, text) and text == text.strip(), (r, text)
            assert set(r.keywords) & set(words(text)), (r, text)


def test_every_rule_alone(spark):
    rng = random.Random(2)
    rows = [(r.number, f"{prose(rng, 5)}. {example(r.pattern, rng).upper()}, {prose(rng, 3)}") for r in RULES]
    check(spark, rows)
    got = {r.doc_id: r.labels for r in scan_licenses(documents(spark, rows)).collect()}
    alone = [r for r in RULES if r.label in got[r.number]]
    assert len(alone) >= 0.97 * len(RULES), [r for r in RULES if r not in alone]


def test_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    rows = awkward(rng)
    for i in range(100, 220):
        parts = []
        for _ in range(rng.randint(1, 9)):
            said = rng.choice([example(rng.choice(RULES).pattern, rng), rng.choice(list(PHRASES)), prose(rng, rng.randint(0, 3))])
            said = said.split()
            parts += said[rng.choice([0, 0, 0, 1]) : len(said) - rng.choice([0, 0, 0, 1])]
        rows.append((i, "-".join(parts).title() if i % 3 else " ".join(parts)))
    check(spark, rows)


def test_own_rules_and_phrases(spark):
    rules = [Rule(0, 0, "ab", ("a",), "a b"), Rule(0, 1, "abc", ("a",), "a b c"), Rule(1, 2, "wide", ("z",), "z a b c z"), Rule(1, 3, "twice", ("c",), "b c|c z"), Rule(3, 4, "far", ("q",), "q(?: q){0,2}")]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abczq") for _ in range(rng.randint(0, 30)))) for i in range(150)]
    rows += [(1_000, "a b a b a b"), (1_001, "z a b c z a b c z"), (1_002, "q " * 50)]
    check(spark, rows, rules=rules, phrases={"a b a": "aba", "q q": "qq"})
    check(spark, rows[:20], rules=rules, phrases={})
    check(spark, rows[:20], rules=[], phrases={"a b": "ab"})


def test_long_text_of_nothing_but_licences(spark):
    line = "under the mit license gpl v3 "
    rows = [(1, line * 4_000), (2, ("x " * 20_000) + line)]
    got = {r.doc_id: r for r in scan_licenses(documents(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (4_000, 0, 3_999 * 6) and got[2].first_word == 20_000
    assert got[1].labels == got[2].labels == ["gpl-3.0", "mit"]


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], DOCS)).collect() == []


def test_no_python_in_the_plan(spark):
    frame = documents(spark, [(1, "under the mit license")])
    plan = scan_licenses(frame)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("line", ["label | only", "", "  "])
def test_malformed_lines(line):
    if line.strip():
        with pytest.raises(ValueError):
            parsed((line,))
    else:
        assert parsed((line,)) == []
