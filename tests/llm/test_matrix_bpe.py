"""Matrix BPE against the public tokenizer library, and the round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from sluiceway.llm import matrix_bpe as B

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RAW = open(PATH, "rb").read()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_kind_of_space_and_letter(library):
    rng = random.Random(5)
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}c" for c in range(0x3100)]
    texts += ["".join(rng.choice("abcdeéß 日 \n'stre12.,!🙂\t") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += ["", " ", "  ", "a ", " a", "a  b", "<|endoftext|>", "ab" * 2000, "z" * 3000]
    assert list(B.Vocabulary(RAW, PATTERN).encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "KNOWN_BYTES", 2000)
    monkeypatch.setattr(B, "SLICE_CHARS", 50)
    monkeypatch.setattr(B, "CELLS", 64)
    texts = [f"word{i} other{i * 7} wörd " + "longword" * i for i in range(50)]
    assert list(B.Vocabulary(RAW, PATTERN).encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_pair_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 300, (4000, 2)), axis=0)
    table = B.PairTable(keys[:, 0], keys[:, 1], np.arange(len(keys)))
    every = {(a, b): i for i, (a, b) in enumerate(keys.tolist())}
    left, right = (x.reshape(300, 300) for x in np.meshgrid(np.arange(300), np.arange(300)))
    expected = [[every.get((int(a), int(b)), int(B.NO_RANK)) for a, b in zip(x, y)] for x, y in zip(left, right)]
    assert table.ranks(left, right).tolist() == expected
    assert table.ranks(np.array([-1]), np.array([3])).tolist() == [int(B.NO_RANK)]


def test_round_trip_and_digests(odd_docs, no_docs, library):
    outputs = ("ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256")
    encoded = B.encode(odd_docs, PATH, PATTERN, outputs=outputs)
    rows = B.decode(encoded.withColumnRenamed("decoded", "first"), PATH, PATTERN).collect()
    assert len(rows) == odd_docs.count() and rows[0].lang == "en"
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert (r.ids, r.n_tokens, bytes(r.decoded), bytes(r.first)) == (ids, len(ids), (r.text or "").encode(), (r.text or "").encode())
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert B.encode(no_docs, PATH, PATTERN).count() == 0


def test_query_equals_library(spark, library):
    from sluiceway.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op5_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    ids = {i: library.encode_ordinary(t or "") for i, t in texts.items()}
    sha = lambda data: hashlib.sha256(data).hexdigest()
    assert {tuple(r) for r in rows} == {(i, len(ids[i]), sha(" ".join(map(str, ids[i])).encode()), sha((t or "").encode())) for i, t in texts.items()}
