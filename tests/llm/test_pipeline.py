"""The pipeline against plain Python, and its frame."""

import sys
from collections import Counter

import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from sluiceway.llm import matrix_bpe

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_line_align import plain as plain_lines  # noqa: E402
from test_quality_cascade import plain as plain_measures  # noqa: E402
from test_simhash_trie import plain_fingerprint, plain_groups  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs.collect())
    return out


def test_frame(stages, spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mix", "tokens"]
    assert all(tuple(rows[0].__fields__) == pipeline.COLUMNS for rows in stages[:-1])
    assert entry.queries()["pipeline"] is pipeline.run
    rows = pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in rows) == sorted((r.doc_id, r.ids_sha256) for r in stages[-1])


def test_quality_stage(stages):
    kept = {r.doc_id for r in stages[1]}
    for r in stages[0]:
        words, chars, symbols, dups, repeats = plain_measures(r.text)
        junk = words < 50 or 100 * repeats > 50 * words or 10 * symbols > words or 10 * (r.text or "").count("!") > 3 * words
        assert not (junk and r.doc_id in kept)
    assert len(kept) > 0.6 * len(stages[0])


def test_line_stage(stages):
    before = {r.doc_id: r.text for r in stages[1]}
    expected = plain_lines(sorted(before.items()), 5)
    assert {r.doc_id: r.text for r in stages[2]} == {i: t for i, t in expected.items() if t.encode().split()}
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_duplicate_stage(stages):
    docs = sorted((r.doc_id, r.text) for r in stages[2])
    root = plain_groups([plain_fingerprint(t) for _, t in docs])
    assert sorted(r.doc_id for r in stages[3]) == [docs[k][0] for k in sorted(set(root))]


def test_mix_and_token_stages(stages):
    before = {r.doc_id: r.text for r in stages[3]}
    copies = Counter(r.doc_id for r in stages[4])
    assert copies.keys() <= before.keys() and max(copies.values()) <= 3 and all(r.text == before[r.doc_id] for r in stages[4])
    vocabulary = matrix_bpe.vocabulary(open(public_tokenizers.path(pipeline.RANKS), "rb").read(), public_tokenizers.PATTERN)
    assert Counter((r.doc_id, r.n_tokens, vocabulary.decode(r.ids)) for r in stages[5]) == Counter((r.doc_id, len(ids), r.text.encode()) for r, ids in zip(stages[4], vocabulary.encode([r.text for r in stages[4]])))


def test_training_order_reaches_the_result(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"document {i} " + "word " * (i % 90 + 1), "en", f"s{i % 3}", 1) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        pipeline.mix(spark, docs, SF).write.option("maxRecordsPerFile", 40).parquet(str(tmp_path / "mix"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "mix").glob("*.parquet"))) > 12
    rows = pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "mix")), SF).collect()
    assert len({(r.order_file, r.order_row) for r in rows}) == len(rows) > len({r.doc_id for r in rows})
    found = [r.doc_id for r in sorted(rows, key=lambda r: (r.order_file, r.order_row))]
    position = {}
    for r in pipeline.curriculum_mix.mix(docs).collect():
        position.setdefault(r.doc_id, []).append(r.position)
    turns = {i: iter(sorted(p)) for i, p in position.items()}
    places = [next(turns[i]) for i in found]
    assert len(places) == sum(map(len, position.values())) and places == sorted(places)


def test_line_stage_keeps_small_rests(spark):
    shared = "\n".join(f"shared line {k} of six words" for k in range(90))
    docs = [(1, shared), (2, f"{shared}\n" + "own " * 30), (3, f"{shared}\nrest"), (4, shared)]
    rows = pipeline.line_dedup(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in rows} == {1: (shared, len(shared)), 2: ("own " * 30, 120), 3: ("rest", 4)}
