"""Language-model scoring by subword lattices.

A text is a sequence of words and an end; a word is spelled by vocabulary pieces, the first with a word mark. The model is a unigram
distribution over pieces (and the end). The probability of a word is the sum over all its segmentations of the product of piece
probabilities, by a forward recursion in log space; that of a text is the product over its words and the end.

The piece probabilities start from the scores of an existing vocabulary file. A score of a merge vocabulary is minus the piece's rank, and
frequencies fall about as one over the rank, so the starting weight is 1 / (rank + offset). Under these weights, the expected
number of uses of every piece in the training texts is worked out by forward-backward over each distinct word, weighted with
the word's count; the counts, smoothed with the starting weights, are the weights of the next round, and in the end the model's probabilities. Single characters outside the vocabulary
are spelled by byte pieces, so every text has a probability above zero.

All counts come from all training rows: tasks count the words of their texts, Spark adds the counts up, and everything per word is
done once per distinct word of the corpus. Only sums per piece (as many as the vocabulary has) reach the driver. Scores of
words go back to the documents in two ways: the ``FREQUENT`` most common words that are at most ``SHORT`` bytes long are broadcast, a table of proven
size, and used while the texts are read; the other words of each document go through a join, in which no word is hot.

Defined cases: a null or empty text is the end alone. Words of any length are scored whole. Repeated rows each get their row. An empty table gives an
empty result; with no training rows the starting weights are the model, N and V are 0. Input columns named like an output are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.columns import bind
from sluiceway.llm.common import utf8
from sluiceway.llm.matrix_bpe import NO_RANK, PairTable
from sluiceway.session import cut

MARK = "▁"
FIRST_BYTE, FIRST_PIECE = 1, 257  # places of the byte pieces and of the others; place 0 is the end
CELLS = 400_000  # characters of one matrix
FREQUENT = 200_000
SHORT = 40
RANK_OFFSET = 10.0
ROUNDS = 2  # of expected counts; the second gains about 3 % on held-out words, a third 1 %
PRIOR_WORDS = 1000.0  # weight of the starting distribution against the expected counts
HELD_COUNTS = 400_000  # words a task counts before it passes sums on
OUTPUTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


class Lattice:
    """Segmentations of many words at once. Words of one length make a matrix of characters; all pieces that start anywhere in
    them are found by walking a trie of the vocabulary from every position together, and the recursions then go from
    position to position, for all words of the matrix."""

    def __init__(self, pieces: list[str], log_p: np.ndarray):
        self.log_p = log_p
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for number, piece in enumerate(pieces[FIRST_PIECE:], FIRST_PIECE):
            node = 0
            for char in piece:
                node = nodes.setdefault((node, ord(char)), len(nodes) + 1)
            ends[node] = number
        left, right = np.array(list(nodes), np.int64).reshape(-1, 2).T
        self.steps = PairTable(left, right, np.array(list(nodes.values()), np.int64))
        self.piece_of = np.full(len(nodes) + 1, -1, np.int32)
        self.piece_of[list(ends)] = list(ends.values())

    def _matrices(self, words: list[str]):
        """(places, characters as a matrix) of words of equal length, marked in front."""
        by_length: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            by_length.setdefault(len(word) + 1, []).append(at)
        for width, places in by_length.items():
            step = max(1, CELLS // width)
            for start in range(0, len(places), step):
                part = places[start:start + step]
                text = "".join([MARK + words[at] for at in part]).encode("utf-32-le", "surrogatepass")
                yield np.array(part), np.frombuffer(text, np.uint32).astype(np.int64).reshape(len(part), width)

    def _arcs(self, chars: np.ndarray):
        """Arcs by (start, length): lists of (start, length, rows, pieces), by start; then the bytes of each character."""
        n, width = chars.shape
        flat = chars.reshape(-1)
        at, node = np.arange(n * width), np.zeros(n * width, np.int64)
        found = []
        for length in range(1, width + 1):
            inside = at % width + length <= width
            at, node = at[inside], node[inside]
            node = self.steps.ranks(node, flat[at + length - 1]).astype(np.int64)
            there = node != NO_RANK
            at, node = at[there], node[there]
            if not len(at):
                break
            piece = self.piece_of[node]
            whole = piece >= 0
            found.append((at[whole], np.full(int(whole.sum()), length), piece[whole]))
        at, length, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        start = at % width
        order = np.lexsort((length, start))
        at, start, length, piece = at[order], start[order], length[order], piece[order]
        cuts = np.flatnonzero(np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])]) if len(at) else []
        groups: list[list] = [[] for _ in range(width)]
        for a, b in zip(cuts, [*cuts[1:], len(at)]):
            groups[start[a]].append((int(length[a]), at[a:b] // width, piece[a:b]))
        kinds, which = np.unique(chars, return_inverse=True)
        spelled = [[FIRST_BYTE + x for x in chr(c).encode("utf-8", "surrogatepass")] for c in kinds.tolist()]
        weights = np.array([self.log_p[x].sum() for x in spelled])
        return groups, spelled, which.reshape(n, width), weights

    def _forward(self, shape, groups, which, weights) -> np.ndarray:
        n, width = shape
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0.0
        for start in range(width):
            alpha[:, start + 1] = np.logaddexp(alpha[:, start + 1], alpha[:, start] + weights[which[:, start]])
            for length, rows, piece in groups[start]:
                alpha[rows, start + length] = np.logaddexp(alpha[rows, start + length], alpha[rows, start] + self.log_p[piece])
        return alpha

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log of the sum over all segmentations, for each word."""
        out = np.zeros(len(words))
        for places, chars in self._matrices(words):
            groups, _, which, weights = self._arcs(chars)
            out[places] = self._forward(chars.shape, groups, which, weights)[:, -1]
        return out

    def expected_uses(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece when each word is spelled ``counts`` times."""
        uses = np.zeros(len(self.log_p))
        for places, chars in self._matrices(words):
            groups, spelled, which, weights = self._arcs(chars)
            alpha = self._forward(chars.shape, groups, which, weights)
            beta = np.full(alpha.shape, -np.inf)
            beta[:, -1] = np.log(counts[places]) - alpha[:, -1]
            by_char = np.zeros(len(weights))
            for start in range(chars.shape[1] - 1, -1, -1):
                char = which[:, start]
                term = weights[char] + beta[:, start + 1]
                beta[:, start] = term
                by_char += np.bincount(char, np.exp(alpha[:, start] + term), len(weights))
                for length, rows, piece in groups[start]:
                    term = self.log_p[piece] + beta[rows, start + length]
                    beta[rows, start] = np.logaddexp(beta[rows, start], term)
                    uses += np.bincount(piece, np.exp(alpha[rows, start] + term), len(uses)) if len(piece) > 4096 else _few(uses, piece, np.exp(alpha[rows, start] + term))
            for codes, share in zip(spelled, by_char):
                np.add.at(uses, codes, share)
        return uses


def _few(uses: np.ndarray, piece: np.ndarray, share: np.ndarray) -> float:
    """Add a few shares in place; nothing is left to add."""
    np.add.at(uses, piece, share)
    return 0.0


def vocabulary(model_path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a vocabulary file and their starting probabilities. Place 0 is the end, places 1 to 256 are the bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    plain = [i for i in plain if model.id_to_piece(i).count(MARK) == model.id_to_piece(i).startswith(MARK)]
    ranks = np.array([max(0.0, -model.get_score(i)) for i in plain])
    rarest = float(ranks[ranks < 1e8].max(initial=1.0))
    weights = 1.0 / (np.concatenate(([0.0], np.full(256, rarest), np.minimum(ranks, rarest))) + RANK_OFFSET)
    return ["\n", *[f"<{b}>\n" for b in range(256)], *map(model.id_to_piece, plain)], weights / weights.sum()


def word_counts(docs: DataFrame, learns: Column, text: str = "text") -> DataFrame:
    """(word, count): every word of every text, A-Z lower-cased, and its count in the rows that ``learns`` names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        others: set[bytes] = set()

        def flush():
            words = [*counts, *(others := others_left())]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([*counts.values(), *([0] * len(others))], pa.int64())], names=["word", "count"])

        def others_left():
            return [w for w in others if w not in counts]

        for batch in batches:
            for data, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if train:
                    counts.update(data.lower().split())
                else:
                    others.update(data.lower().split())
                if len(counts) + len(others) > HELD_COUNTS:
                    yield flush()
                    counts, others = Counter(), set()
        yield flush()

    rows = docs.select(utf8(text).alias("data"), F.coalesce(learns, F.lit(False)).alias("learns"))
    return rows.mapInArrow(run, "word binary, count bigint").groupBy("word").agg(F.sum("count").alias("count"))


def train(counts: DataFrame, n_texts: int, model_path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Pieces and their log probabilities, from the words and counts of the training texts. ``n_texts``: their number, each with one end.
    Each round works out the expected uses under the probabilities of the round before."""
    pieces, start = vocabulary(model_path)
    trained, log_p = counts.where("count > 0").select("word", "count"), np.log(start)

    def uses_under(log_p: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, uses = Lattice(pieces, log_p), np.zeros(len(pieces))
            for batch in batches:
                words = [word.decode("utf-8", "replace") for word in batch.column(0).to_pylist()]
                uses += lattice.expected_uses(words, batch.column(1).to_numpy().astype(np.float64))
            used = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(uses[used])], names=["piece", "uses"])

        return run

    for _ in range(rounds):
        sums = trained.mapInArrow(uses_under(log_p), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        expected = np.zeros(len(pieces))
        for piece, uses in sums.collect():  # at most one row per piece of the vocabulary
            expected[piece] = uses
        expected[0] += n_texts
        log_p = np.log((expected + PRIOR_WORDS * start) / (expected.sum() + PRIOR_WORDS))
    return pieces, log_p


_loaded: dict[tuple[int, float], dict] = {}


def _words(raw: bytes, base: float) -> dict[bytes, tuple[int, float, float]]:
    """The broadcast words as a dictionary, built once per Python worker."""
    key = (hash(raw), base)
    if key not in _loaded:
        _loaded.clear()
        table = pa.ipc.open_stream(raw).read_all()
        _loaded[key] = {w: (c, math.log10(c + 0.5) + base, x) for w, c, x in zip(*(table.column(k).to_pylist() for k in range(3)))}
    return _loaded[key]


def score(docs: DataFrame, learns: Column, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, learns, n_tokens, n_known, train_tokens, base_score, score) for every row. base_score: log10 probability under
    add-a-half word counts; score: log10 probability under the lattice model; both end included."""
    counts = cut(word_counts(docs, learns, text))
    texts = docs.where(F.coalesce(learns, F.lit(False))).count()
    total = counts.agg(F.sum("count"), F.count(F.when(F.col("count") > 0, 1))).first()
    n, v = (total[0] or 0) + texts, total[1] + bool(texts)
    pieces, log_p = train(counts, texts, model_path)
    base = -math.log10(n + 0.5 * (v + 1))
    shared = docs.sparkSession.sparkContext.broadcast((pieces, log_p))  # the vocabulary, of fixed size
    tens = math.log(10.0)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            logs = lattice.log_probabilities([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]) / tens
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logs)], names=["word", "count", "log"])

    marked = cut(counts.mapInArrow(mark, "word binary, count bigint, log double"))
    # The most common words: those above a count that at most FREQUENT short words reach. Counts are summed up in bins, an eighth
    # of a doubling each, so a few hundred rows tell that count. The table is FREQUENT rows of SHORT bytes and two numbers at most.
    short = marked.where((F.col("count") > 0) & (F.length("word") <= SHORT)).withColumn("bin", F.floor(F.log2("count") * 8).cast("int"))
    least, there = 0, 0
    for row in sorted(short.groupBy("bin").count().collect(), reverse=True):
        there += row["count"]
        if there > FREQUENT:
            least = row.bin + 1
            break
    table = short.where(F.col("bin") >= least).select("word", "count", "log").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    frequent = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    ends = (math.log10(texts + 0.5) + base, float(log_p[0]) / tens, int(texts > 0))

    def read(column: pa.Array) -> pa.Array:
        known_words = _words(frequent.value, base)
        sums, cold, times_of, ends_at = [], [], [], [0]
        for data in column.to_pylist():
            words = Counter(data.lower().split())
            seen, b, s = ends[2], ends[0], ends[1]
            for word, times in words.items():
                hit = known_words.get(word)
                if hit is None:
                    cold.append(word)
                    times_of.append(times)
                else:
                    seen += times
                    b += times * hit[1]
                    s += times * hit[2]
            sums.append((sum(words.values()) + 1, seen, b, s))
            ends_at.append(len(cold))
        columns = [pa.array(c, t) for c, t in zip(zip(*sums), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))] if sums else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
        rest = pa.StructArray.from_arrays([pa.array(cold, pa.binary()), pa.array(times_of, pa.int64())], names=["word", "times"])
        return pa.StructArray.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), rest)], names=["tokens", "known", "base", "log", "rest"])

    kind = "struct<tokens: bigint, known: bigint, base: double, log: double, rest: array<struct<word: binary, times: bigint>>>"
    # Rows of one key and text are one unit while scores are gathered, and rows again at the end. A unit's own sums travel as one more
    # row, under a word that no text has and no other unit shares.
    rows = bind(docs.select(F.col(key).alias("_key"), F.coalesce(learns, F.lit(False)).alias("_learns"), F.xxhash64(text).alias("_hash"), utf8(text).alias("_data")),
                "own", F.arrow_udf(read, kind)(F.col("_data"))).drop("_data")
    empty = F.lit(None).cast("bigint")
    head = F.array(F.struct(F.encode(F.concat_ws(" ", F.lit(""), F.coalesce(F.col("_key").cast("string"), F.lit("")), F.col("_hash")), "UTF-8").alias("word"), empty.alias("times")))
    parts = rows.select("_key", "_learns", "_hash", F.struct("own.tokens", "own.known", "own.base", "own.log").alias("head"), F.explode(F.concat(head, F.col("own.rest"))).alias("w"))
    parts = parts.select("_key", "_learns", "_hash", "w.word", "w.times", F.when(F.col("w.times").isNull(), F.col("head")).alias("head"))
    scored = parts.join(marked, "word", "left").select(
        "_key", "_learns", "_hash", F.coalesce("head.tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("head.known"), F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.coalesce(F.col("head.base"), F.col("times") * (F.log10(F.col("count") + 0.5) + base)).alias("base"),
        F.coalesce(F.col("head.log"), F.col("times") * F.col("log")).alias("log"), F.col("times").isNull().cast("int").alias("rows"))
    sums = scored.groupBy("_key", "_learns", "_hash").agg(*[F.sum(c).alias(c) for c in ("tokens", "known", "base", "log", "rows")])
    each = sums.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_n"))
    per_row = lambda c: F.col(c) / F.col("rows")
    return each.select(
        F.col("_key").alias(key), F.col("_learns").alias("learns"), per_row("tokens").cast("long").alias("n_tokens"), per_row("known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), per_row("base").alias("base_score"), per_row("log").alias("score"))
