"""Dual-tree search and filter audit against plain Python."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from sluiceway.llm import dual_tree_rank as D
from sluiceway.llm import filter_audit as A

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_rank(docs, items, k):
    found = [(i, Counter(words(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = {}
    for item in {i for i, _ in items}:
        asked = {w for i, t in items if i == item for w in words(t)}
        scored = []
        for i, c in found:
            m = 50 + 50 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked & c.keys())
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out[item] = [(None if null else i, -s) for s, null, i in sorted(scored)[:k]]
    return out


def ranked(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        assert r["rank"] == len(out.setdefault(r.item_id, [])) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return out


def test_terms():
    text = "Äb c_D-9É\x00日本 Z"
    assert [w.decode() for w in D.terms(text.encode())] == words(text) == ["Äb", "c", "d", "9É", "日本", "z"]


@pytest.mark.parametrize("k, item_bytes", [(3, 1 << 20), (50, 200)])
def test_rank_equals_plain(spark, monkeypatch, k, item_bytes):
    rng = random.Random(k)
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(pool, k=rng.choice([0, 1, 5, 30, 200])))) for i in range(500)]
    docs += [(None, "w1 w2 w3 rare"), (7, docs[8][1]), (7, docs[8][1]), (1000, None), (1001, " .,; "), (1002, "W1 w2;RARE")]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 30)))) for i in range(40)] + [(40, None), (41, ""), (42, "rare nowhere"), (42, "w5"), (None, "w1 rare")]
    expected = {i: x for i, x in plain_rank(docs, items, k).items() if x}
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    assert ranked(D.rank(*frames, k=k, item_bytes=item_bytes)) == expected


def test_pruning_drops_pairs_and_keeps_results(spark):
    """A tree over one task's documents: far fewer leaf pairs are scored than there are, and none that matters is missed."""
    rng = np.random.default_rng(3)
    n, width = 4000, 60
    weights = np.floor(rng.uniform(100, 9000, width))
    own = [sorted(rng.choice(width, 6, replace=False).tolist()) for _ in range(40)]
    items = D.Items(list(range(40)), own, weights)
    term = np.sort(rng.integers(0, width, (n, 4)), axis=1)
    value = np.floor(rng.uniform(1, 900, (n, 4)) * (rng.random((n, 1)) < 0.05)) + 1
    by = np.lexsort((term[:, 1], term[:, 0]))
    term, value = term[by], value[by]
    keep = np.c_[np.ones((n, 1), bool), term[:, 1:] != term[:, :-1]]
    best, looked = D.Best(40, 10), []
    add, best.add = best.add, lambda item, scores, ids, nulls: (looked.append(len(ids)), add(item, scores, ids, nulls))
    D.search(items, np.arange(n), np.zeros(n, bool), np.r_[0, np.cumsum(keep.sum(1))], term[keep], value[keep], best)
    dense = np.zeros((n, width))
    dense[np.repeat(np.arange(n), keep.sum(1)), term[keep]] = value[keep]
    for i, found in enumerate(own):
        scores = dense[:, found] @ weights[found]
        order = np.lexsort((np.arange(n), -scores))[:10]
        order = order[scores[order] > 0]
        assert best.ids[i].tolist() == order.tolist() and best.scores[i].tolist() == scores[order].tolist()
    assert sum(looked) < 0.2 * n * len(own)


def test_rank_odd_input(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "WORD a", 5), (2, "x" * 30_000, 5), (3, "zwei 日本語", 5)], "item_id long, text string, rank int")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert ranked(D.rank(odd_docs, items)) == {i: x for i, x in plain_rank(docs, [(r.item_id, r.text) for r in items.collect()], 50).items() if x}
    assert D.rank(no_docs, items).count() == 0 and D.rank(odd_docs, items.limit(0)).count() == 0
    assert D.rank(odd_docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def fails(docs, i):
    key, text, _ = docs[i]
    text = text or ""
    found = text.encode().split()
    return {n for n, bad in (
        ("A", len(found) < 200), ("B", 100 * len(set(found)) < 50 * len(found)), ("C", 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)),
        ("D", bool(set(text) & set("#$%&*|"))), ("E", key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in docs))) if bad}


def plain_audit(docs, good, toxic):
    own = [fails(docs, i) for i in range(len(docs))]
    out = {}
    for part in {p or "" for _, _, p in docs}:
        rows = [(k, f) for (k, _, p), f in zip(docs, own) if (p or "") == part]
        shapley = Counter()
        for order in map("".join, permutations(A.FILTERS)):
            gone: list = []
            left = rows
            for step, name in enumerate(order, 1):
                here = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                shapley[name] += len(here)
                out[part, order, step] = [len(left), len(here), sum(name in r[1] for r in gone), sum(r[1] == {name} for r in rows),
                                          sum(r[0] in good for r in here), sum(r[0] in toxic for r in here)]
                gone += here
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {key: tuple(row) for key, row in out.items()}


def audited(docs, labels):
    known = A.facts(docs)
    return A.audit(known, A.failing(known), {"good": labels.where("quality = 1").select("doc_id"), "toxic": labels.where("toxic = 1").select("doc_id")})


def test_audit_equals_plain(spark):
    rng = random.Random(5)
    make = lambda: " ".join(rng.choices(["one", "Two", "THREE", "#4", "five"] + [f"w{i}" for i in range(rng.choice([1, 400]))], k=rng.choice([3, 250])))
    docs = [(i, make(), f"s{i % 3}") for i in range(150)]
    docs += [(200 + i, docs[i % 40][1], None if i % 2 else "s0") for i in range(60)] + [(3, docs[9][1], "s1"), (3, docs[3][1], "s2"), (3, docs[3][1], "s2")]
    docs += [(None, docs[5][1], "s1"), (None, docs[5][1], "s1"), (300, None, ""), (301, "", ""), (302, None, "s0"), (0, "#", "s0"), (-4, "# #", None)]
    labels = [(i, i % 2, i % 5 == 0 and 1 or 0) for i in range(0, 260, 2)] + [(3, 1, 1), (3, 1, 1), (None, 1, 1), (5, None, 1)]
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    rows = audited(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(rows) == len(got) and got == plain_audit(docs, good, toxic)


def test_audit_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    rows = audited(odd_docs, labels).collect()
    docs = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert got == plain_audit(docs, {3, 4}, {4})
    assert audited(no_docs, labels).count() == 0
