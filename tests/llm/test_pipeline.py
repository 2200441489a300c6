import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, prose
from test_decontaminate import plain as plain_contamination
from test_simhash import plain_fingerprint, plain_groups
from tokenizers import Tokenizer

import corpus_pipeline
from queuesight.llm.mixing import label_domains, mix_documents


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randint(14, 40))) for i in range(6)]
    rows, labels = [], []
    for i in range(160):
        text = prose(rng, rng.randint(30, 160))
        kind = rng.choice(["good"] * 6 + ["poor", "toxic"])
        if kind == "poor":
            text = text.replace(" ", "%%% ")
        if kind == "toxic":
            text += " moron scum loser"
        if i % 11 == 0:
            text += " " + items[i % 6][1]
        rows.append((i, text))
        if i % 2:
            labels.append((i, 0 if kind == "poor" else 1, int(kind == "toxic")))
    long = prose(rng, 500).split()
    for i in range(500, 506):
        near = long[:]
        near[20 * (i - 499)] = "changed"
        rows.append((i, " ".join(near)))
    rows += [(600 + k, rows[k][1]) for k in range(5)] + [(700, None), (701, ""), (702, "12 - 34"), (703, "ok"), rows[3], (None, "an id less text of its own"), (None, rows[4][1])]
    path = str(tmp_path_factory.mktemp("corpus"))
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, items


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_each_stage_does_what_it_says(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "mix_sources", "token_files"]
    stage = dict(corpus_pipeline.STAGES)

    one = stage["language_id"](spark, docs, path)
    want = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    assert pairs(one) == sorted(want, key=repr) and one.columns == columns

    two = stage["simhash_near_dedup"](spark, one, path)
    labels = plain_groups([(n, plain_fingerprint(t)) for n, (_, t) in enumerate(want)], 4)
    groups = {}
    for row, label in zip(want, labels, strict=True):
        groups.setdefault(label, []).append(row)
    kept = pairs(two)
    assert len(kept) == len(groups) and two.columns == columns
    assert all(sum(row in g for row in kept) == 1 for g in groups.values())
    assert all(min(g, key=lambda r: (r[0] is None, r[0]))[0] in [r[0] for r in kept if r in g] for g in groups.values())

    three = stage["benchmark_decontamination"](spark, two, path)
    bad = {r[0] for r in plain_contamination(kept, items) if r[4]}
    clean = [(i, t) for i, t in kept if i not in bad]
    assert pairs(three) == clean and bad and three.columns == columns

    four = stage["mix_sources"](spark, three, path)
    left = pairs(four)
    assert set(left) <= set(clean) and len(set(left)) == len(left) and four.columns == columns
    rates, _ = mix_documents(three, label_domains(spark.read.parquet(f"{path}/labels.parquet")), corpus_pipeline.SHARES, keep_whole="good")
    rate = {r.doc_id: r.rate for r in rates.collect()}
    assert all(rate[i] < 1 for i, t in set(clean) - set(left)) and {i for i, r in rate.items() if r >= 1} <= {i for i, _ in left}
    assert len(left) < len(clean)

    five = sorted(stage["token_files"](spark, four, path).collect(), key=lambda r: r.start)
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    order = sorted(left, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in five] == [i for i, _ in order]
    for r, (_, t) in zip(five, order, strict=True):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run_is_the_stages_in_turn(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert sorted(map(tuple, docs.collect()), key=repr) == sorted(map(tuple, corpus_pipeline.run(spark, path).collect()), key=repr)


EXTRA = {"own_id": "long", "own_th": "long", "score": "double", "lang_pred": "string", "stays": "boolean", "n": "int", "th": "long", "_own_id": "string", "found": "string"}


def with_extra(docs):
    return docs.selectExpr("*", *[f"CAST(doc_id % 7 AS {t}) AS `{c}`" for c, t in EXTRA.items()])


def test_extra_columns_pass_through_as_they_are(spark, folder, tmp_path):
    """Every filtering stage leaves the columns of its input alone, whatever they are called, and decides as without them."""
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(900, prose(random.Random(3), 30_000), "en", "src0", 0)], docs.schema))
    wide = with_extra(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, extra = stage(spark, docs, path), stage(spark, wide, path)
        assert extra.columns == wide.columns
        rows = sorted(map(tuple, with_extra(plain).collect()), key=repr)
        assert sorted(map(tuple, extra.collect()), key=repr) == rows and rows
        docs, wide = plain, extra
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted(map(tuple, last(spark, wide, path).collect()), key=repr) == sorted(map(tuple, last(spark, docs, path).collect()), key=repr)


def test_no_documents(spark, folder):
    path = folder[0]
    none = with_extra(spark.read.parquet(f"{path}/documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, path)
        assert out.columns == none.columns and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, none, path).collect() == []
