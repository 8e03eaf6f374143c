"""Token counts by dynamic programming over a trie.

A text's tokens under a piece vocabulary with scores are the pieces of its best segmentation: the one of the highest sum of
scores, of equal sums the one of fewest pieces. Text is read as the vocabulary does: a space is written as U+2581 and one is
put in front; pieces have that mark only in front or alone, and never hold a line break, so a text falls into pre-tokens at
these places and each is segmented by itself. Characters outside the vocabulary count as their bytes, one piece each.

A task puts the pre-tokens it meets into a trie. Every node stands for a prefix and holds the best score and number of pieces of
that prefix, worked out once from the nodes above it, however many pre-tokens share it; the node at a pre-token's end has
its count. The vocabulary is an automaton with links to the longest proper suffix, so that a new node looks at the pieces that end in it and at no other
substring. Pre-tokens are independent, so the trie can be dropped at any time; it is when it has many nodes.

Defined cases: a null or empty text has 0 tokens. Texts are counted whole; a very long pre-token is a long path. Repeated rows
are counted row by row; an empty table gives an empty result. An input column named like the output is replaced.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import release_memory, utf8, with_fields

MARK = "▁"
PRE_TOKENS = re.compile(f"{MARK}+(?:[^{MARK}\n]+)?|[^{MARK}\n]+|\n")
MAX_NODES = 1_000_000  # of one task's trie; memory only
TEXTS = 500  # learnt together
LONG_PIECE = 200  # longer pre-tokens are counted along their path without keeping its nodes


class Pieces:
    """Piece scores of a vocabulary file, without control and byte pieces."""

    def __init__(self, path_or_model):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(**path_or_model)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in ids}
        bytes_ = [model.get_score(i) for i in range(model.get_piece_size()) if model.is_byte(i)]
        # A byte is worse than any two pieces together, so that bytes are the last resort.
        self.byte_score = min([0.0, *bytes_, *(s for s in self.scores.values() if s > -1e8)]) * 2 - 1
        self._build()

    def _build(self) -> None:
        """States are the prefixes of pieces. ``ends[state]``: (length, score) of the pieces that end there, longest first."""
        self.steps: dict[int, int] = {}
        own: list[tuple[int, float] | None] = [None]
        order: list[list[tuple[int, int, int]]] = []  # by depth: parent, character, state
        for piece, score in self.scores.items():
            state = 0
            for depth, char in enumerate(piece):
                key = state << 21 | ord(char)
                below = self.steps.get(key)
                if below is None:
                    below = self.steps[key] = len(own)
                    own.append(None)
                    while len(order) <= depth:
                        order.append([])
                    order[depth].append((state, ord(char), below))
                state = below
            own[state] = (len(piece), score)
        self.link = [0] * len(own)
        self.ends: list[tuple[tuple[int, float], ...]] = [()] * len(own)
        for level in order:
            for parent, char, state in level:
                self.link[state] = self._fall(self.link[parent], char) if parent else 0
                self.ends[state] = ((own[state],) if own[state] else ()) + self.ends[self.link[state]]
        self.moves = dict(self.steps)

    def _fall(self, state: int, char: int) -> int:
        """The state of the longest suffix of a state's string and a character."""
        while (to := self.steps.get(state << 21 | char)) is None:
            if not state:
                return 0
            state = self.link[state]
        return to

    def move(self, state: int, char: int) -> int:
        """``_fall``, remembered: states times characters met in them, a bounded part of it at a time."""
        key = state << 21 | char
        to = self.moves.get(key)
        if to is None:
            if len(self.moves) > MAX_NODES:
                self.moves = dict(self.steps)
            to = self.moves[key] = self._fall(state, char)
        return to


class Trie:
    """Prefixes of pre-tokens; node n has the best score and count of its prefix in ``score[n]`` and ``count[n]``. The step from a
    node by a character is one entry of one dictionary, keyed by both."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.steps: dict[int, int] = {}
        self.score, self.count, self.state = [0.0], [0], [0]
        self.ends: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        """Insert pre-tokens, in order, and work out every node that is new."""
        if len(self.score) > MAX_NODES:
            self.clear()
        for word in sorted(w for w in words if w not in self.ends):
            self.ends[word] = self._insert(word)

    def _insert(self, word: str) -> int:
        unknown, move, ends = self.pieces.byte_score, self.pieces.move, self.pieces.ends
        steps, score, count, states = self.steps, self.score, self.count, self.state
        keep = len(word) <= LONG_PIECE
        best, pieces = [0.0], [0]  # of each prefix
        node = state = 0
        for end, char in enumerate(map(ord, word), 1):
            below = steps.get(node << 21 | char) if node >= 0 else None
            if below is not None:
                node = below
                best.append(score[node])
                pieces.append(count[node])
                state = states[node]
                continue
            width = 1 if char < 0x80 else 2 if char < 0x800 else 3 if char < 0x10000 else 4
            top, least = best[-1] + unknown * width, pieces[-1] + width
            state = move(state, char)
            for length, own in ends[state]:
                total = best[end - length] + own
                if total > top or total == top and pieces[end - length] + 1 < least:
                    top, least = total, pieces[end - length] + 1
            best.append(top)
            pieces.append(least)
            if keep:
                steps[node << 21 | char] = len(score)
                node = len(score)
                score.append(top)
                count.append(least)
                states.append(state)
            else:
                node = -1
        return pieces[-1]


_loaded: dict[bytes, Trie] = {}


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text. No shuffle."""
    with open(model_path, "rb") as file:  # a file of fixed size, about half a megabyte for 32 thousand pieces
        raw = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = hashlib.sha256(raw.value).digest()
        if key not in _loaded:
            _loaded[key] = Trie(Pieces({"model_proto": raw.value}))
        trie = _loaded[key]
        gc.disable()  # the trie grows by many small objects and no cycles
        try:
            for column in columns:
                out = count_texts([data.decode("utf-8", "replace") for data in column.to_pylist()], trie)
                yield pa.StructArray.from_arrays([pa.array(out, pa.int64())], names=[into])
        finally:  # the worker waits for other tasks with its memory free
            trie.clear()
            gc.enable()
            release_memory()

    return with_fields(docs, F.arrow_udf(run, f"struct<{into}: bigint>")(utf8(text)), (into,))


def pre_tokens(text: str) -> list[str]:
    return PRE_TOKENS.findall(MARK + text.replace(" ", MARK)) if text else []


def count_texts(texts: list[str], trie: Trie) -> list[int]:
    """Number of tokens of each text; the pre-tokens of ``TEXTS`` texts are learnt together, in order."""
    out = []
    for at in range(0, len(texts), TEXTS):
        words = [Counter(pre_tokens(text)) for text in texts[at:at + TEXTS]]
        trie.learn(set().union(*words))
        ends = trie.ends
        out += [sum([n * ends[w] for w, n in own.items()]) for own in words]
    return out
