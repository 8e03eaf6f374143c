"""Curriculum mixing, exact top-k and trie counts."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sluiceway.llm import curriculum_mix as M
from sluiceway.llm import tiled_topk as K
from sluiceway.llm import trie_counts as T

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def filled(sizes, weights, repeats=3):
    """Targets by capping and sharing again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in capped]
        level = (total - sum(capped.values())) / max(1, sum(weight[n] for n in free))
        over = [n for n in free if weight[n] * level > repeats * sizes[n]]
        if not over:
            return capped | {n: weight[n] * level for n in free}
        capped |= {n: repeats * sizes[n] for n in over}


def test_shares(spark):
    rng = random.Random(1)
    for _ in range(3):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 100, 1000]) for i in range(9)} | {None: 50, "é": 3, "Z": 400}
        frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in M.shares(frame).collect()}
        expected = filled(sizes, M.WEIGHTS)
        assert got.keys() == expected.keys() and all(math.isclose(got[n], expected[n], abs_tol=1e-6) for n in got)


def mixture(n=400, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.randint(0, 40)), None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}") for i in range(n)]


def test_plan(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_BUCKET", 20)
    docs = spark.createDataFrame(mixture(), "doc_id long, text string, source string")
    rows = M.plan(docs).collect()
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == sum(c["take"] for c in r.copies)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    again = {(r.doc_id, str(r.copies)) for r in M.plan(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, str(r.copies)) for r in rows}


def test_positions_follow_the_schedules(spark):
    docs = spark.createDataFrame(mixture(), "doc_id long, text string, source string")
    rows = [(r.source, c["position"], c["take"], r.target) for r in M.plan(docs).collect() for c in r.copies]
    total = sum(take for _, _, take, _ in rows)
    rank = {s: k for k, s in enumerate(sorted({r[0] for r in rows}, key=lambda s: (s is None, s or "")))}
    for source, k in rank.items():
        (t0, w0), (t1, w1) = M.SCHEDULES[k % 3]
        mine = sorted((p, t) for s, p, t, _ in rows if s == source)
        target = next(x[3] for x in rows if x[0] == source)
        done = 0
        for position, take in mine:
            t = position / total
            assert math.isclose(done, target * (w0 * t + (w1 - w0) * t * t / 2), rel_tol=1e-2, abs_tol=2)
            done += take


def test_pieces_of_schedules(spark):
    schedule = ((0.0, 0.0), (0.25, 2.0), (1.0, 1.0))
    pieces = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(p, ("before", "start", "density", "slope"))]) for p in M.segments(schedule)])
    whole = 0.25 + 0.75 * 1.5
    shares = spark.createDataFrame([(0.0,), (0.25 / whole,), (1.0,), (0.1,)], "share double")
    got = [r[0] for r in shares.select(M.when_used(F.col("share"), pieces)).collect()]
    assert np.allclose(got[1:3], [0.25, 1.0]) and np.isclose(4 * got[3] ** 2 / whole, 0.1)


def test_mix_is_sorted_and_whole(spark, odd_docs, no_docs):
    docs = spark.createDataFrame(mixture(), "doc_id long, text string, source string")
    rows = M.mix(docs).collect()
    positions = [r.position for r in rows]
    assert positions == sorted(positions) and {r.doc_id for r in rows} <= {i for i, _, _ in mixture()}
    assert M.mix(docs).columns == ["doc_id", "text", "source", "position"]
    planned = M.plan(odd_docs).collect()
    assert len(planned) == odd_docs.count() and all(r.taken == 0 for r in planned if not (r.text or "").split())
    assert M.plan(no_docs).count() == 0 and M.mix(no_docs).count() == 0


def plain_topk(rows, k):
    whole = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in {i for i, _ in whole if i % 100 == 0}:
        hits = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j) for i, v in whole if i == q for j, w in whole if j != q)[:k]
        out |= {(q, n, j, -s) for n, (s, j) in enumerate(hits, 1)}
    return out


@pytest.mark.parametrize("cells,fan", [(64, 2), (1 << 20, 8)])
def test_topk(spark, cells, fan):
    rng = random.Random(cells)
    rows = [(i, [rng.randint(-4, 4) / 4 for _ in range(8)]) for i in range(240)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)] + [(300, None), (400, [1.0] * 3 + [None]), (401, [float("nan")] * 8), (402, [float("inf")] * 8), (500, []), (501, [0.25] * 3), (None, [1.0] * 8), rows[7], rows[100]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = K.search(frame, F.col("vec_id") % 100 == 0, k=7, cells=cells, fan=fan)
    assert {tuple(r) for r in got.collect()} == plain_topk(rows, 7)


def test_topk_large_numbers_and_empty(spark):
    rows = [(0, [3e30, 1.0]), (1, [2e30, -5.0]), (2, [-3e30, 2.0]), (3, [1e-3, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in K.search(frame, F.col("vec_id") % 100 == 0, k=3).collect()}
    assert got == plain_topk(rows, 3)
    assert K.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def best_count(word, pieces):
    """Highest score, then fewest pieces, over all segmentations."""
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        width = len(word[end - 1].encode())
        options = [(best[end - 1][0] + pieces.byte_score * width, -(best[end - 1][1] + width))]
        options += [(best[s][0] + pieces.scores[word[s:end]], -(best[s][1] + 1)) for s in range(end) if word[s:end] in pieces.scores]
        score, fewest = max(options)
        best[end] = (score, -fewest)
    return best[-1][1]


def test_trie_counts(spark, odd_docs, no_docs, monkeypatch):
    pieces = T.Pieces({"model_file": MODEL})
    words = ["▁the", "▁then", "▁there", "the", "▁▁", "▁🙂x", "▁Überraschung", "\n", "▁" + "ab" * 300]
    trie = T.Trie(pieces)
    trie.learn(set(words))
    assert [trie.ends[w] for w in words] == [best_count(w, pieces) for w in words]
    nodes = len(trie.score)
    trie.learn({"▁th", "▁them"})
    assert len(trie.score) == nodes + 1  # only what no earlier word had
    monkeypatch.setattr(T, "MAX_NODES", 3)
    rows = T.count_tokens(odd_docs, MODEL).collect()
    expected = {r.doc_id: sum(best_count(w.replace(" ", "▁"), pieces) for w in T.pre_tokens(r.text or "")) for r in odd_docs.collect() if len(r.text or "") < 1000}
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in expected} == expected and len(rows) == odd_docs.count()
    assert T.count_tokens(no_docs, MODEL).count() == 0
    assert "".join(T.pre_tokens("a  b\n c \n")) == "▁a▁▁b\n▁c▁\n"


def test_counts_query_equals_plain(spark):
    from sluiceway.llm.queries import QUERIES

    sf, pieces, known = "/root/testdata/sf0.001", T.Pieces({"model_file": MODEL}), {}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}

    def count(word):
        if word not in known:
            known[word] = best_count(word.replace(" ", "▁"), pieces)
        return known[word]

    rows = QUERIES["op8_token_counts"](spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: sum(map(count, T.pre_tokens(t or ""))) for i, t in docs.items()}
