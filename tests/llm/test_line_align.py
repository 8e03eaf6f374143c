"""Line dedup against plain Python over all documents."""

import random

import pytest

from sluiceway.llm import line_align as A


def longest_increasing(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] += max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    return max(best, default=0)


def test_increasing():
    rng = random.Random(2)
    for _ in range(200):
        values = [rng.randrange(12) for _ in range(rng.randrange(12))]
        places = A.increasing(values)
        assert places == sorted(places) and all(values[a] < values[b] for a, b in zip(places, places[1:]))
        assert len(places) == longest_increasing(values)


def test_align_is_a_matching_that_keeps_order():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(10))] for _ in range(2))
        pairs = A.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert A.align("abcdxyz", "qabcdz") == [(0, 1), (1, 2), (2, 3), (3, 4), (6, 5)]
    assert A.align("abc", "cab") == [(0, 1), (1, 2)]  # of crossing unique lines, the longest run in order


def plain(docs, min_words):
    """Texts without the lines of every run of enough words that the earliest holder of one of a document's lines has as well: all pairs of
    places of all documents, no alignment."""
    lines = {i: [(n, x.strip(" \t\n\r\x0b\x0c"), len(x.encode().split())) for n, x in enumerate(t.split("\n")) if x.encode().split()] for i, t in docs}
    first = {}
    for i in sorted(lines):
        for _, x, _ in lines[i]:
            first.setdefault(x, i)
    out = {}
    for i, t in docs:
        own, gone = lines[i], set()
        for e in {first[x] for _, x, _ in own} - {i}:
            there = lines[e]
            for a in range(len(there)):
                for b in range(len(own)):
                    n = 0
                    while a + n < len(there) and b + n < len(own) and there[a + n][1] == own[b + n][1]:
                        n += 1
                    if sum(x[2] for x in own[b:b + n]) >= min_words:
                        gone |= {x[0] for x in own[b:b + n]}
        out[i] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    return out


@pytest.mark.parametrize("times", [1, 30])
def test_dedup_equals_plain(spark, times):
    """Also where a line occurs hundreds of times."""
    rng = random.Random(times)
    pool = [" ".join(rng.choice(["la", "le", "lu", "lo"]) + str(k) for _ in range(rng.randint(1, 7))) for k in range(60)]
    docs = []
    for i in range(60):
        own = [rng.choice(pool) if rng.random() < 0.5 else f"own {i} {n}" for n in range(rng.randrange(14))]
        if docs and rng.random() < 0.4:
            own[3:3] = docs[rng.randrange(len(docs))][1].split("\n")[2:7]
        docs.append((i, "\n".join([*own, *["a very common closing line of six"] * times] if i % 3 else own)))
    rows = A.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    expected = plain(docs, A.MIN_WORDS)
    assert {r.doc_id: r.text for r in rows} == expected
    assert all(r.n_words - r.deleted_words == len(r.text.split()) for r in rows)
    kept = {x for t in expected.values() for x in t.split("\n")}
    assert kept >= {x for _, t in docs for x in t.split("\n")}  # no line is lost altogether


@pytest.mark.parametrize("copies", [1, 150])
def test_common_lines_need_one_earlier_document(spark, copies):
    """Two short lines owned by two documents are no block of either, however many documents have both."""
    docs = [(1, "alpha one two"), (2, "beta one two")] + [(k, "alpha one two\nbeta one two") for k in range(3, 3 + copies)]
    rows = {r.doc_id: r.text for r in A.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == dict(docs)


def test_copies_and_passages(spark):
    passage = "\n".join(" ".join(f"p{k}w{n}" for n in range(20)) for k in range(3))
    docs = [(5, passage), (1, f"first of all\n{passage}\nthe end of one"), (9, f"another\n{passage}"), (7, f"first of all\n{passage}\nthe end of one"), (7, f"first of all\n{passage}\nthe end of one")]
    rows = sorted((r.doc_id, r.text) for r in A.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert rows == [(1, docs[1][1]), (5, ""), (7, ""), (7, ""), (9, "another")]


def test_odd_input(spark, odd_docs, no_docs):
    rows = A.dedup(odd_docs).collect()
    assert sorted((r.doc_id, r.text) for r in rows if r.text is not None) == sorted((r.doc_id, r.text) for r in odd_docs.collect() if r.text is not None)
    assert [r.text for r in rows if r.doc_id == 0] == [None] and len(rows) == odd_docs.count()
    assert A.dedup(no_docs).count() == 0
    clash = spark.createDataFrame([(1, "one two three four five", 3), (None, "one two three four five", 3)], "doc_id long, text string, n_lines int")
    assert sorted((str(r.doc_id), r.text, r.n_lines) for r in A.dedup(clash).collect()) == [("1", "one two three four five", 1), ("None", "", 1)]


def test_longest_runs():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice([0, 1, 2, None]) for _ in range(rng.randrange(12))] for _ in range(2))
        inside = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1) if None not in a[i:j]}
        assert A.longest_runs(a, b) == [max((n for n in range(1, e + 2) if tuple(b[e + 1 - n:e + 1]) in inside), default=0) for e in range(len(b))]


def test_moved_and_repeated_blocks(spark):
    p, q = ("\n".join(f"{name} line {k} has three more" for k in range(12)) for name in "pq")  # 72 words each
    short = "two words\nof blocks"  # below five words
    docs = [(1, f"start\n{p}\nmiddle\n{q}\n{short}"), (2, f"{q}\nown two\n{p}"), (3, f"{p}\nown three\n{p}\n{p}"), (4, f"{short}\nown four\n{q}\n{short}\nown"),
            (5, "a one two\nb three four\nx\na one two\nb three four"), (6, "own\na one two\nb three four\nown six\na one two\nb three four\nown 6")]
    rows = {r.doc_id: r.text for r in A.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {1: docs[0][1], 2: "own two", 3: "own three", 4: f"{short}\nown four\nown", 5: docs[4][1], 6: "own\nown six\nown 6"}
