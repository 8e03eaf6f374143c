"""Removal of repeated byte strings against plain Python over all texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluiceway.llm import cover_repeats as R


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    times = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if times[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, kept))
    return out


@pytest.mark.parametrize("order", [2, 3, 5, 13])
def test_cover(order):
    period, line = R.cover(order)
    assert period == order**2 + order + 1 and len(line) == order + 1
    assert {(i - j) % period for i in line for j in line} == set(range(period))
    shift = R.shifts(order)
    assert all((i + shift[i, j]) % period in line and (j + shift[i, j]) % period in line for i in range(period) for j in range(period))


def test_hashes_of_parts():
    data = bytes(random.Random(1).choices(range(4), k=600))
    sums, at = R.Sums(data), np.arange(590)
    for width in (1, 2, 7, 10):
        keys = sums.keys(at, width)
        same = {}
        for i, k in zip(at.tolist(), keys.tolist()):
            assert same.setdefault(data[i:i + width], k) == k
        assert len(set(same.values())) == len(same) and (sums.windows(width)[:590] == keys).all()


def corpus(seed, n=60, word=30):
    """Texts that share passages at shifted places, copies, edited copies, texts that repeat themselves, and periodic ones."""
    rng = random.Random(seed)
    new = lambda k: bytes(rng.choices(b"abcd \n", k=k))
    passages = [new(rng.randint(20, 90)) for _ in range(8)]
    out = [b"", b"x" * 300, b"ab" * 100, b"x" * 299]
    for _ in range(n):
        text = b"".join(rng.choice([new(rng.randint(0, word)), rng.choice(passages), rng.choice(out)[:rng.randint(0, 80)]]) for _ in range(rng.randint(1, 5)))
        out.append(text)
        if rng.random() < 0.3:
            at = rng.randrange(len(text) + 1)
            out.append(text[:at] + rng.choice([b"", b"#", new(3)]) + text[at:])
        if rng.random() < 0.2:
            out += [text] * rng.randint(1, 3)
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed, most", [(1, 4096), (2, 4096), (3, 3), (4, 1)])
def test_equals_plain(spark, seed, most):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    rows = R.remove(docs, length=40, order=3, most=most).collect()
    assert len(rows) == len(texts)
    got = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sorted(rows, key=lambda r: r.doc_id)]
    assert got == plain(texts, 40)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept).hexdigest() for r in rows)


def test_query_equals_plain(spark):
    from sluiceway.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in QUERIES["op13_cover_repeats"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    expected = plain([(r.text or "").encode() for r in docs], 400)
    assert sum(e[1] for e in expected) > 0
    assert [(rows[d.doc_id].n_bytes, rows[d.doc_id].n_removed, rows[d.doc_id].n_spans, rows[d.doc_id].kept_sha256) for d in docs] == [
        (*e[:3], hashlib.sha256(e[3]).hexdigest()) for e in expected]


def test_odd_input(spark, odd_docs, no_docs):
    rows = R.remove(odd_docs.withColumn("n_spans", F.lit("old"))).collect()
    texts = [(r.text or "").encode() for r in rows]
    assert len(rows) == odd_docs.count() and [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows] == plain(texts, 400)
    assert R.remove(no_docs).count() == 0
    with pytest.raises(ValueError):
        R.remove(odd_docs, length=100)


def test_names_are_small():
    texts = [bytes(random.Random(i).choices(range(256), k=3000)) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["text_id", "_text"])
    rows = list(R.names(400, 13, 64)(iter([batch])))
    n = sum(int((np.arange(0, 3000, 183)[:, None] + R.cover(13)[1] <= 3000 - 218).sum()) for _ in texts)
    assert sum(r.nbytes for r in rows) < 15 * n
    assert sum(len(x) for r in rows for x in r.column("low").to_pylist()) == n


@pytest.mark.parametrize("parts, size", [(1, 1), (7, 1), (7, 3), (64, 1000)])
def test_repeated_names(parts, size):
    """Places whose window is elsewhere, whatever batches the names are made and met in."""
    texts = [t for t in dict.fromkeys(corpus(5))] + [b"ab" * 30_000]
    period, line = R.cover(3)
    width, at = 40 - period + 1, {}
    for k, t in enumerate(texts):
        for p in range(len(t) - width + 1):
            if p % period in line:
                at.setdefault(t[p:p + width], set()).add((k, p))
    made = []
    for i in range(0, len(texts), 9):
        rows = [(k, texts[k]) for k in range(i, min(i + 9, len(texts)))] + [(0, texts[0]), (i, texts[i])]
        batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], names=["text_id", "_text"])
        made += [row for b in R.names(40, 3, parts)(iter([batch])) for row in b.to_pylist()]
    made = pa.Table.from_pylist(sorted(made, key=lambda r: r["part"]), pa.schema([("part", pa.int32()), *[(n, pa.binary()) for n in ("told", "name", "text", "low", "high")]]))
    got = [(r["text_id"], r["place"]) for b in R.repeated_names(3)(iter(made.to_batches(size))) for r in b.to_pylist()]
    assert set(got) == {p for places in at.values() if len(places) > 1 for p in places}


def test_texts_shuffle_once(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
        plan = R.remove(docs, outputs=("n_removed",)).select("doc_id", "n_removed")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("FileScan") == 2  # the texts, and their ids for copies


def test_text_comes_back(spark, odd_docs):
    rows = R.remove(odd_docs, outputs=("n_bytes",))
    assert rows.columns == [*odd_docs.columns, "n_bytes"]
    assert sorted(map(repr, rows.drop("n_bytes").collect())) == sorted(map(repr, odd_docs.collect()))


def test_text_keeps_its_type(spark):
    docs = spark.createDataFrame([(1, b"ab\xff"), (2, None)], "doc_id long, text binary")
    rows = R.remove(docs, outputs=("n_bytes",))
    assert rows.schema["text"].dataType == docs.schema["text"].dataType
    assert sorted((r.doc_id, r.text and bytes(r.text), r.n_bytes) for r in rows.collect()) == [(1, b"ab\xff", 3), (2, None, 0)]
