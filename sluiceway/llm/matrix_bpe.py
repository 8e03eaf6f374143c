"""Byte-level BPE by padded matrices.

Texts are cut into pre-tokens by the tokenizer's pattern. Pre-tokens not met before by the task are put into matrices of token
ids, one row each, bucketed by length and padded with -1. In every round each row merges its leftmost pair of minimum rank:
pair ranks come from an open-addressing hash table, the merged neighbour is squeezed out, and only the two pairs around
the merge are looked up again. Rows without a mergeable pair leave the matrix.

Defined cases: a null or empty text has no tokens (an empty array) and decodes to no bytes. Texts and pre-tokens of any length
are encoded whole. Rows are independent: repeated rows give equal results, an empty table an empty one. Input columns named
like an output are replaced. Bytes that are not UTF-8 read as U+FFFD. Decoding a null array gives no bytes; an id outside
the vocabulary is an error.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import release_memory, utf8, with_fields

NO_RANK = np.int32(2**31 - 1)
CELLS = 1_000_000  # cells of one matrix
KNOWN_BYTES = 24 << 20  # of the pre-tokens that a task remembers, about; memory only, forgotten ones are worked out again
LONG_WORD = 100  # characters; longer words are not remembered
ENTRY_BYTES = 200  # of a remembered pre-token besides its characters and ids
SLICE_CHARS = 1_000_000  # text worked on at once
KINDS = {"ids": "array<int>", "n_tokens": "bigint", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
ARROW = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "decoded": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


class PairTable:
    """Hash table from pairs of ids to the id of their merge, probed linearly for whole arrays at once."""

    FREE = np.uint64(2**64 - 1)
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64(2**bits - 1)
        self.keys, self.values = np.full(2**bits, self.FREE, np.uint64), np.full(2**bits, NO_RANK, np.int32)
        keys, values = self._key(left, right), merged.astype(np.int32)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == self.FREE
            taken, first = np.unique(np.where(free, slots, -1), return_index=True)
            first = first[taken >= 0]
            self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & self.mask

    def _key(self, left, right):
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slot(self, keys):
        return ((keys * self.MIX) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NO_RANK`` where the pair does not merge or one side is padding."""
        out = np.full(left.shape, NO_RANK, np.int32)
        real = (left >= 0) & (right >= 0)
        at = np.flatnonzero(real)
        keys = self._key(left[real], right[real])
        slots = self._slot(keys)
        flat = out.reshape(-1)
        while len(at):
            found = self.keys[slots]
            hit = found == keys
            flat[at[hit]] = self.values[slots[hit]]
            on = ~hit & (found != self.FREE)
            at, keys, slots = at[on], keys[on], (slots[on] + 1) & self.mask
        return out


class Vocabulary:
    """Ranks of a tiktoken file, the pairs that merge, and pre-tokens encoded so far."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.number = {rank: rank for rank in self.tokens}  # one object per id, whatever its uses
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        ranks = self.ranks
        halves = (number for token, rank in ranks.items() for cut in range(1, len(token)) if token[:cut] in ranks and token[cut:] in ranks
                  for number in (ranks[token[:cut]], ranks[token[cut:]], rank))
        self.pairs = PairTable(*np.fromiter(halves, np.int64).reshape(-1, 3).T)
        self.find = regex.compile(pattern).findall
        self.odd_space = regex.compile(r" (?!\S)").search
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}
        self.spaced: dict[str, tuple[int, ...]] = {}
        self.older: tuple[dict, dict] = ({}, {})
        self.held = 0  # bytes of the younger two, about

    def _age(self) -> None:
        """Set what is remembered aside once it fills half of the room; what was set aside before and not met since is forgotten."""
        if self.held > KNOWN_BYTES // 2:
            self.older = self.known, self.spaced
            self.known, self.spaced, self.held = {}, {}, 0

    def _remember(self, memory: dict[str, tuple[int, ...]], found: dict[str, tuple[int, ...]]) -> None:
        memory.update(found)
        self.held += ENTRY_BYTES * len(found) + sum(map(len, found)) + 8 * sum(map(len, found.values()))

    def _recall(self, words: set[str], memory: dict[str, tuple[int, ...]], older: dict[str, tuple[int, ...]]) -> set[str]:
        """The words that have to be worked out; those met before are remembered on."""
        missing = words - memory.keys()
        again = missing & older.keys()
        self._remember(memory, {word: older[word] for word in again})
        return missing - again

    def merged(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of pre-tokens."""
        out: dict[str, tuple[int, ...]] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            if (rank := self.ranks.get(data)) is not None:
                out[piece] = (rank,)
            else:
                width = len(data) if len(data) <= 16 else 1 << (len(data) - 1).bit_length()
                buckets.setdefault(width, []).append((piece, data))
        for width, items in buckets.items():
            step = max(1, CELLS // width)
            for start in range(0, len(items), step):
                part = items[start:start + step]
                for (piece, _), ids in zip(part, merge_rows([data for _, data in part], width, self.byte_ids, self.pairs)):
                    out[piece] = tuple(map(self.number.__getitem__, ids))
        return out

    def encode(self, texts: list[str]):
        """Ids of each text, a slice of texts at a time.

        The pattern always ends a pre-token before a space that a visible character follows. Where every space of a
        text is such a space, the text is cut at its spaces, and the ids of a whole word with its space are
        remembered. Other texts go through the pattern as they are.
        """
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= SLICE_CHARS):
                chars += len(texts[end])
                end += 1
            yield from self._encode_slice(texts[start:end])
            start = end

    def _encode_slice(self, texts: list[str]):
        self._age()
        heads, words, met = [], [], set()
        for text in texts:
            if self.odd_space(text):
                heads.append(self.find(text))
                words.append(())
            else:
                first, *rest = text.split(" ")
                heads.append(self.find(first))
                words.append(rest)
                met.update(rest)
        known, spaced = self.known, self.spaced
        self._remember(known, self.merged(self._recall(set(chain.from_iterable(heads)), known, self.older[0])))
        new = {word: self.find(" " + word) for word in self._recall(met, spaced, self.older[1])}
        parts = self.merged(set(chain.from_iterable(new.values())))  # needed for these words alone
        self._remember(spaced, {
            word: parts[pieces[0]] if len(pieces) == 1 else tuple(chain.from_iterable(map(parts.__getitem__, pieces))) for word, pieces in new.items()})
        for head, rest in zip(heads, words):
            ids = list(chain.from_iterable(map(known.__getitem__, head)))
            ids.extend(chain.from_iterable(map(spaced.__getitem__, rest)))
            yield ids
        for word in new:
            if len(word) > LONG_WORD:
                del spaced[word]

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def merge_rows(pieces: list[bytes], width: int, byte_ids: np.ndarray, pairs: PairTable) -> list[tuple[int, ...]]:
    """Token ids of each piece; no piece is longer than ``width``."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    matrix = np.full((len(pieces), width), -1, np.int32)
    matrix[np.arange(width) < lengths[:, None]] = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    ranks = pairs.ranks(matrix[:, :-1], matrix[:, 1:])
    rows, done = np.arange(len(pieces)), [()] * len(pieces)
    while len(rows):
        at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
        best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NO_RANK)
        live = best != NO_RANK
        if not live.all():
            for row, ids in zip(rows[~live].tolist(), matrix[~live].tolist()):
                done[row] = tuple(ids[:ids.index(-1)] if ids[-1] < 0 else ids)
            rows, matrix, ranks, at, best = rows[live], matrix[live], ranks[live], at[live], best[live]
            if not len(rows):
                break
        n, w = matrix.shape
        line = np.arange(n)
        matrix[line, at] = best
        if n <= 4:  # few long rows: moving the tail costs less than masks over the whole matrix
            for k, j in enumerate(at.tolist()):
                matrix[k, j + 1:-1] = matrix[k, j + 2:]
                ranks[k, j:-1] = ranks[k, j + 1:]
            matrix, ranks = matrix[:, :-1], ranks[:, :-1]
        else:
            stays = np.ones((n, w), bool)
            stays[line, at + 1] = False
            matrix = matrix[stays].reshape(n, w - 1)
            stays = np.ones((n, w - 1), bool)
            stays[line, at] = False
            ranks = ranks[stays].reshape(n, w - 2)
        before = at > 0
        ranks[line[before], at[before] - 1] = pairs.ranks(matrix[line[before], at[before] - 1], best[before])
        after = at < w - 2
        ranks[line[after], at[after]] = pairs.ranks(best[after], matrix[line[after], at[after] + 1])
    return done


_loaded: dict[tuple[bytes, str], Vocabulary] = {}


def vocabulary(raw: bytes, pattern: str) -> Vocabulary:
    """The tables of a rank file, built once per Python worker."""
    key = (hashlib.sha256(raw).digest(), pattern)
    if key not in _loaded:
        _loaded[key] = Vocabulary(raw, pattern)
    return _loaded[key]


def _shared(df: DataFrame, ranks_path: str):
    """The rank file's bytes for the executors: a file of fixed size, under a megabyte for 50 thousand tokens."""
    with open(ranks_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """``docs`` with the tokens of each text. ``outputs``: any of ids, n_tokens, decoded (the ids turned back into bytes),
    ids_sha256 (hex digest of the decimal ids joined by a space) and decoded_sha256. One row in, one row out, no shuffle."""
    raw = _shared(docs, ranks_path)

    def work(vocab: Vocabulary, column: pa.Array) -> pa.Array:
        out = {name: [] for name in outputs}
        for ids in vocab.encode([data.decode("utf-8", "replace") for data in column.to_pylist()]):
            decoded = vocab.decode(ids) if {"decoded", "decoded_sha256"} & out.keys() else b""
            for name in outputs:
                if name == "ids":
                    value = ids
                elif name == "n_tokens":
                    value = len(ids)
                elif name == "decoded":
                    value = decoded
                elif name == "ids_sha256":
                    value = hashlib.sha256(" ".join([vocab.names[i] for i in ids]).encode()).hexdigest()
                else:
                    value = hashlib.sha256(decoded).hexdigest()
                out[name].append(value)
        return pa.StructArray.from_arrays([pa.array(v, ARROW[n]) for n, v in out.items()], names=list(out))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(raw.value, pattern)
        gc.disable()  # millions of short tuples and no cycles: tracing them would cost more than the encoding
        try:
            for column in columns:
                yield work(vocab, column)
        finally:  # the worker waits for other tasks with its memory free
            vocab.forget()
            gc.enable()
            release_memory()

    kind = "struct<" + ", ".join(f"{n}: {KINDS[n]}" for n in outputs) + ">"
    return with_fields(docs, F.arrow_udf(run, kind)(utf8(text)), outputs)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that the ids stand for."""
    raw = _shared(encoded, ranks_path)

    def run(column: pa.Array) -> pa.Array:
        vocab = vocabulary(raw.value, pattern)
        out = pa.array([vocab.decode(row or ()) for row in column.to_pylist()], pa.binary())
        return pa.StructArray.from_arrays([out], names=[into])

    return with_fields(encoded, F.arrow_udf(run, f"struct<{into}: binary>")(F.col(ids)), (into,))
