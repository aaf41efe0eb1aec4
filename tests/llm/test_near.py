"""SimHash groups and components against all pairs."""

import random

import numpy as np
import xxhash

from docket_spark.llm import components, simhash
from tests.llm.tables import PROSE, documents, hard_rows


def plain_fingerprint(text, words=4):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    hashes = [
        xxhash.xxh64_intdigest(b" ".join(parts[k : k + words]), 42)
        for k in range(max(1, len(parts) - words + 1))
    ]
    return sum(
        1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )


def all_pairs(fingerprints, budget):
    """id to smallest id of its component, by comparing every two."""
    ids = sorted(fingerprints)
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= budget:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def clouds(draw, n, flips):
    centres = [draw.getrandbits(64) for _ in range(max(1, n // 40))]
    keys = set()
    while len(keys) < n:
        key = draw.choice(centres)
        for _ in range(draw.randint(0, flips)):
            key ^= 1 << draw.randrange(64)
        keys.add(key)
    return sorted(keys)


def test_trie_components_equal_all_pairs():
    draw = random.Random(1)
    for n, flips, budget in ((1, 1, 4), (60, 2, 4), (400, 3, 4), (400, 9, 7), (300, 4, 0)):
        keys = clouds(draw, n, flips)
        labels = simhash.trie_components(np.array(keys, np.uint64), np.array([0]), budget)
        assert labels.tolist() == list(all_pairs(dict(enumerate(keys)), budget).values())


def test_links_span_components_also_when_tries_are_dealt_in_parts(spark):
    draw = random.Random(2)
    keys = [k - (1 << 63) for k in clouds(draw, 600, 3)]
    signed = spark.createDataFrame(
        [(0, k, k) for k in keys], "print int, node long, fingerprint long"
    )
    want = all_pairs({k: k % (1 << 64) for k in keys}, 4)
    for leaf in (simhash.LEAF, 50):
        links = simhash.trie_links(signed, 4, leaf)
        assert links.count() <= 15 * len(keys) * (1 if leaf > 600 else 30)
        roots = {r.node: r.root for r in components.connected_components(links).collect()}
        assert {k: roots.get(k, k) for k in keys} == want


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, 1000 + k) for k in range(1, 60)]
    links = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    found = {r.node: r.root for r in components.connected_components(links).collect()}
    assert found == {k: 0 for k in range(61)} | {k: 1000 for k in range(1000, 1060)}


def test_near_duplicates_equal_all_pairs(spark):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = [r for r in hard_rows() if r[0] is not None]
    for k in range(40):
        text = [draw.choice(words) for _ in range(draw.choice([2, 30, 200]))]
        for copy in range(draw.randint(1, 4)):
            if copy:
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((100 + 10 * k + copy, " ".join(text)))
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    found = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == all_pairs(prints, 4)


def test_a_null_id_never_names_a_group_that_has_another(spark):
    rows = [(None, PROSE), (7, PROSE), (None, "other words than those")]
    found = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == [
        ("7", "7"),
        ("None", "7"),
        ("None", "None"),
    ]


def test_keep_one(spark):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows = hard_rows()
    for k in range(30):
        text = [draw.choice(words) for _ in range(300)]
        rows.append((100 + 10 * k, " ".join(text)))
        text[draw.randrange(300)] = "changed"
        rows.append((101 + 10 * k, " ".join(text)))
    groups = all_pairs({r[0]: plain_fingerprint(r[1]) for r in rows if r[0] is not None}, 4)
    docs = documents(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    assert set(ids) == set(groups.values()) and len(ids) < len(groups)
    none = documents(spark, [])
    assert simhash.keep_one(none).count() == simhash.near_duplicates(none).count() == 0


def test_keep_one_keeps_the_smallest_id_of_each_group(spark):
    draw = random.Random(25)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        text = [draw.choice(words) for _ in range(draw.choice([1, 5, 40, 200]))]
        for copy in range(draw.randint(1, 5)):
            text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((1000 - 10 * k - copy, " ".join(text)))
    groups = all_pairs({i: plain_fingerprint(text) for i, text in rows}, 4)
    kept = [r.doc_id for r in simhash.keep_one(documents(spark, rows)).collect()]
    assert sorted(kept) == sorted(set(groups.values())) and len(kept) < len(rows)
