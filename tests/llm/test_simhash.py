import random

import xxhash
from helpers import DOCS, awkward, clashing, documents, prose, rows_of

from queuesight.llm.components import connected_components
from queuesight.llm.simhash import covering_masks, keep_one_of_each, near_duplicate_groups, near_links, signed, simhash


def plain_fingerprint(text, k=4):
    table = {i: i + 32 for i in range(65, 91)}
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r " else " " for c in (text or "").translate(table)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(pairs, radius):
    """pairs: (id, fingerprint) -> smallest id reachable."""
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(pairs))]


def test_fingerprint_is_the_plain_one():
    for _, text in awkward():
        assert simhash(text) == plain_fingerprint(text)


def test_masks_leave_no_close_pair_apart():
    rng = random.Random(3)
    for radius in (1, 2, 3, 4):
        masks = covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(3000):
            difference = sum(1 << i for i in rng.sample(range(64), rng.randint(0, radius)))
            assert any(not difference & m for m in masks)


def cloud(rng):
    values = {rng.getrandbits(64) for _ in range(40)}
    for base in list(values)[:12]:
        for _ in range(15):
            x = base
            for i in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << i
            values.add(x)
    return sorted(values)


def test_links_connect_as_brute_force_does(spark):
    rng = random.Random(5)
    values = cloud(rng)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for radius, most in ((4, 8192), (4, 4), (3, 4)):
        want = plain_groups([(signed(v), v) for v in values], radius)
        got = {r.node: r.component for r in connected_components(near_links(df, radius, most)).collect()}
        assert [got.get(signed(v), signed(v)) for v in values] == want


def test_groups_of_documents(spark):
    rng = random.Random(1)
    base = prose(rng, 400)
    near = base.split()
    near[200] = "changed"
    rows = [*awkward(rng), (20, base), (30, base), (25, " ".join(near)), (26, base.upper())]
    df = clashing(documents(spark, rows))
    groups = near_duplicate_groups(df)
    got = rows_of(groups.select("doc_id", "fingerprint", "component_id"))
    prints = [simhash(t) for _, t in rows]
    want = plain_groups(list(zip([i for i, _ in rows], prints, strict=True)), 4)
    assert got == sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, want, strict=True)), key=repr)
    kept = keep_one_of_each(df, groups)
    assert kept.columns == df.columns
    labels = plain_groups(list(enumerate(prints)), 4)
    members = {}
    for (i, t), label in zip(rows, labels, strict=True):
        members.setdefault(label, []).append((i, t))
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == len(members)
    for group in members.values():
        least = min((i for i, _ in group if i is not None), default=None)
        assert sum((i, t) in group for i, t in left if i == least) == 1


def test_empty_table(spark):
    assert near_duplicate_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 150)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
