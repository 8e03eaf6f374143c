"""SimHash groups against comparing all pairs."""

import random

import numpy as np
import pytest
import xxhash

from sluiceway.llm import simhash_trie as S
from sluiceway.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, bits=4):
    """Smallest member position by union of all near pairs."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def planted(rng, n):
    """Random fingerprints with chains and dense groups of near ones."""
    values = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        v = rng.choice(values)
        for b in rng.sample(range(64), rng.randint(0, 6)):
            v ^= 1 << b
        values.append(v)
    dense = rng.getrandbits(64)
    values += [dense ^ (1 << a) ^ (1 << b) for a in range(9) for b in range(a)]
    return values


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("leaf", [1, 16, 4096])
def test_walk(leaf):
    values = sorted(set(planted(random.Random(3), 150)))
    keys = np.array(values, np.uint64)
    label = S.walk(keys, np.array([[0, len(keys), 0, len(keys), 0, 0]]), 4, leaf)
    assert label.tolist() == plain_groups(values)


@pytest.mark.parametrize("max_group", [30, 50_000])
def test_links_connect_what_is_near(spark, monkeypatch, max_group):
    # A small limit cuts the tries of the dense group into node pairs, several times over.
    monkeypatch.setattr(S, "SPLIT_BITS", 8)
    values = sorted(set(planted(random.Random(8), 30)) | {0x00FF_0000_0000_0000 | i << 56 for i in range(40)})
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long").coalesce(1)
    rows = S.links(frame, max_group=max_group, leaf=4).collect()
    position = {signed(v): k for k, v in enumerate(values)}
    expected, label = plain_groups(values), np.arange(len(values))
    label = S._merge(label, np.array([position[r.a] for r in rows]), np.array([position[r.b] for r in rows]))
    assert label.tolist() == expected


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (500, 501), (501, 500)]
    rows = components(spark.createDataFrame(path, "a long, b long")).collect()
    assert {(r.node, r.root) for r in rows} == {(i, 1) for i in range(1, 61)} | {(i, 100) for i in range(100, 140)} | {(500, 500), (501, 500)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_all_pairs(spark):
    from sluiceway.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    prints = [plain_fingerprint(t) for _, t in docs]
    ids = [d for d, _ in docs]
    expected = {(d, f"{p:016x}", ids[g]) for d, p, g in zip(ids, prints, plain_groups(prints))}
    assert {tuple(r) for r in QUERIES["op9_simhash"](spark, sf).collect()} == expected


def test_odd_input(odd_docs, no_docs):
    rows = S.groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8}
    assert all(r.simhash == signed(plain_fingerprint(t)) for r in rows for i, t in [(x.doc_id, x.text) for x in odd_docs.collect()] if i == r.doc_id)
    assert sorted(r.doc_id for r in S.keep_one(odd_docs).collect()) == [0, 3, 5, 6, 7, 8]
    assert S.groups(no_docs).count() == 0 and S.keep_one(no_docs).count() == 0


def test_null_keys(spark):
    docs = spark.createDataFrame([(None, "same text"), (5, "same text"), (None, "alone"), (None, "alone")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in S.groups(docs).collect()) == [("5", "5"), ("None", "5"), ("None", "None"), ("None", "None")]
    assert S.keep_one(docs).count() == 4
