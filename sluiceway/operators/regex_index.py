"""A table of regular expressions joined with texts through the literal factors that each expression requires.

Every match of an expression contains its factors, strings that follow from its parsed form: runs of plain characters, and, for
alternatives, one of a set of runs. A text that lacks one of the expression's longest factors is no candidate. A factor's rarest-looking gram of ``GRAM`` characters is what it is found by. Where an
expression fixes that two factors stand in neighbouring tokens (runs of ASCII letters and digits), it is found by the pair of their grams: long texts hold most
grams, but few pairs. Grams and pairs of patterns and of texts meet in an equality join; the expression itself runs on candidates only. Expressions without a factor are tested against all texts, a block of them at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.policy import parse_pattern

GRAM = 4  # bytes; factors are ASCII
SETS = 3  # of factors that a text must have to be a candidate
SLOTS = 1 << 16  # flags of the filter over grams
PAIR_SLOTS = (1 << 16) - 15  # flags of the filter over pairs; a prime, as the low half of a pair is one gram
WAYS = 64  # pairs of one set
BLOCK = 100  # expressions without a factor that are tested in one pass
# Characters from common to rare, as English texts have them; others count as rarer still. Only the choice of grams depends on it.
COMMON = " etaoinshrdlucmfwypvbgkjqxz"
# Characters that may match an ASCII letter when case is ignored, and that letter.
CASES = {chr(c): chr(c + 32) for c in range(65, 91)} | {"K": "k", "ſ": "s", "İ": "i", "ı": "i"}
FOLD = str.maketrans(CASES)


def _plain(items) -> str | None:
    """The string that a sequence of plain ASCII characters stands for, if it is one."""
    out = ""
    for op, value in items:
        if str(op) == "LITERAL" and chr(value).translate(FOLD).isascii():
            out += chr(value).translate(FOLD)
        elif str(op) == "SUBPATTERN" and (inner := _plain(value[3])) is not None:
            out += inner
        else:
            return None
    return out


def _worth(strings: set[str]) -> tuple[int, int]:
    """How selective a set of strings is: the length of its shortest one, then its size."""
    return min(map(len, strings)), -len(strings)


def _required(items) -> list[set[str]]:
    """Sets of strings; every match of a parsed sequence contains one string of each set."""
    out: list[set[str]] = []
    run = ""

    def end_run() -> None:
        nonlocal run
        if run:
            out.append({run})
        run = ""

    for op, value in items:
        name, plain = str(op), _plain([(op, value)])
        if plain is not None:
            run += plain
            continue
        if name in ("AT", "ASSERT", "ASSERT_NOT"):  # no width: what stands around it touches
            continue
        inside: list[set[str]] = []
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            once = _plain(value[2])
            if once is None:
                inside = _required(value[2])
            elif value[0] == value[1] and len(once) * value[0] <= 1000:
                run += once * value[0]
                continue
            else:
                run += once
        elif name == "SUBPATTERN":
            inside = _required(value[3])
        elif name == "ATOMIC_GROUP":
            inside = _required(value)
        elif name == "BRANCH":
            ways = [_required(way) for way in value[1]]
            inside = [set().union(*(max(way, key=_worth) for way in ways))] if all(ways) else []
        end_run()
        out += inside
    end_run()
    return out


def required(pattern: str) -> list[set[str]]:
    """Sets of strings, with case folded, of which every match of ``pattern`` contains one each."""
    return _required(parse_pattern(pattern))


def factors(pattern: str) -> list[set[str]]:
    """The most selective ``SETS`` sets of strings, with case folded, of which every match of ``pattern`` contains one each; none if no strings of ``GRAM``
    characters follow from it."""
    found = {frozenset(s) for s in required(pattern) if min(map(len, s)) >= GRAM}
    return [set(s) for s in sorted(found, key=lambda s: (_worth(s), sorted(s)), reverse=True)[:SETS]]


def grams(pattern: str) -> list[set[str]]:
    """One gram for each factor, in the sets of ``factors``."""
    return [set(map(_gram, own)) for own in factors(pattern)]


def _gram(factor: str) -> str:
    """The rarest-looking gram of a factor."""
    rare = lambda g: sum(COMMON.find(c) if c in COMMON else len(COMMON) for c in g)
    return max((factor[i:i + GRAM] for i in range(len(factor) - GRAM + 1)), key=rare)


def _alnum(text: str) -> bool:
    return text.isascii() and text.isalnum()


def _kind(items) -> str | None:
    """Whether a class or a character stands for ASCII letters and digits (``letter``) or for other ASCII characters (``gap``) only."""
    if len(items) != 1:
        return None
    name, value = str(items[0][0]), items[0][1]
    spans = []
    for op, v in value if name == "IN" else [(name, value)]:
        if str(op) == "LITERAL":
            spans.append((v, v))
        elif str(op) == "RANGE":
            spans.append(v)
        else:
            return None
    if not spans or any(high > 127 for _, high in spans):
        return None
    kinds = {_alnum(chr(c)) for low, high in spans for c in range(low, high + 1)}
    return {True: "letter", False: "gap"}[kinds.pop()] if len(kinds) == 1 else None


def _parts(items):
    """A parsed sequence as strings of letters and digits (one of a set), other letters (``letter``), what parts tokens (``gap``), and the rest (None)."""
    for op, value in items:
        name = str(op)
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if name == "SUBPATTERN" and not value[1] and not value[2]:
            yield from _parts(value[3])
            continue
        ways = [_plain(way) for way in value[1]] if name == "BRANCH" else [_plain([(op, value)])]
        if all(w is not None and (w == "" or _alnum(w)) for w in ways):
            yield "string", set(ways)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            kind = _kind(value[2])
            yield None if kind == "gap" and value[0] < 1 else kind, None
        else:
            yield _kind([(op, value)]), None


def _chains(items) -> list[list[list[set[str]]]]:
    """Chains of neighbouring tokens in every match of a parsed sequence. Of each token: sets of strings, one of each of which it holds."""
    chains, tokens, strings, last = [], [[]], {""}, None
    for kind, ways in (*_parts(items), (None, None)):
        if kind == "string" and len(strings) * len(ways) <= WAYS:
            strings = {s + w for s in strings for w in ways}
        else:
            if strings != {""}:
                tokens[-1].append(strings)
            strings = ways or {""}
            if kind == "gap" and last != "gap":
                tokens.append([])
            elif kind is None:
                chains.append(tokens)
                tokens = [[]]
        last = kind
    return chains


def pairs(pattern: str) -> list[set[tuple[str, str]]]:
    """At most ``SETS`` sets of pairs of grams; every match of ``pattern`` holds a pair of each set in two neighbouring tokens."""
    found = []
    for tokens in _chains(parse_pattern(pattern)):
        best = [max((own for own in token if min(map(len, own)) >= GRAM), key=lambda own: (_worth(own), sorted(own)), default=None) for token in tokens]
        for left, right in zip(best, best[1:]):
            if left and right and len(left) * len(right) <= WAYS:
                found.append({(_gram(one), _gram(other)) for one in left for other in right})
    return sorted(found, key=lambda own: (len(own), sorted(own)))[:SETS]


def gram_number(gram: str) -> int:
    return int.from_bytes(gram.encode(), "little")


def sought(pattern: str) -> list[list[int]]:
    """Sets of numbers by which ``pattern`` is found: of pairs of grams, or, where it gives none, of grams. A pair's number is its left gram's times 2**32 plus its right one's."""
    found = [{gram_number(left) << 32 | gram_number(right) for left, right in own} for own in pairs(pattern)]
    return [sorted(own) for own in found or [set(map(gram_number, own)) for own in grams(pattern)]]


class Wanted:
    """Tables of flags over the numbers that patterns are found by; their size does not grow with the patterns."""

    SLOTS = {"gram": SLOTS, "left": SLOTS, "right": SLOTS, "pair": PAIR_SLOTS}

    def __init__(self, slots: list[tuple[str, int]]):
        self.flags = {name: np.zeros(size, bool) for name, size in self.SLOTS.items()}
        for name, slot in slots:
            self.flags[name][slot] = True

    @staticmethod
    def slots(number: Column) -> Column:
        """Array of (table, slot) of a number."""
        at = lambda name, value: F.struct(F.lit(name).alias("name"), F.pmod(value, F.lit(Wanted.SLOTS[name])).cast("int").alias("slot"))
        left, right = F.shiftright(number, 32), number.bitwiseAND(F.lit((1 << 32) - 1))
        return F.when(left == 0, F.array(at("gram", number))).otherwise(F.array(at("left", left), at("right", right), at("pair", number)))

    def of(self, name: str, numbers: np.ndarray) -> np.ndarray:
        return self.flags[name][numbers % self.SLOTS[name]]


def _pair_numbers(data: np.ndarray, grams_: np.ndarray, wanted: Wanted) -> np.ndarray:
    """Numbers of the wanted pairs of grams in neighbouring tokens of one text in small letters."""
    inside = (data >= 97) & (data <= 122) | (data >= 48) & (data <= 57)
    token = np.cumsum(inside & ~np.concatenate(([False], inside[:-1])))
    whole = inside[:-3] & inside[1:-2] & inside[2:-1] & inside[3:]
    left, right = (np.flatnonzero(whole & wanted.of(side, grams_)) for side in ("left", "right"))
    first, last = (np.searchsorted(token[right], token[left] + 1, side) for side in ("left", "right"))
    count = last - first
    other = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    numbers = np.repeat(grams_[left].astype(np.int64), count) << 32 | grams_[right[other]].astype(np.int64)
    return numbers[wanted.of("pair", numbers)]


def text_grams(texts: Column, wanted: Wanted) -> Column:
    """Distinct numbers of a text's grams, and of the pairs of grams in neighbouring tokens, that may be among the wanted ones."""
    letters = bytes(range(65, 91))
    lower = bytes.maketrans(letters, letters.lower())
    others = [(c.encode(), to.encode()) for c, to in CASES.items() if not c.isascii()]
    paired = wanted.flags["pair"].any()

    def run(column: pa.Array) -> pa.Array:
        out = []
        for scalar in column:
            data = (scalar.as_py() or b"").translate(lower)
            if not data.isascii():
                for char, to in others:
                    data = data.replace(char, to)
            data = np.frombuffer(data, np.uint8).astype(np.uint32)
            if len(data) < GRAM:
                out.append(None)
                continue
            grams_ = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
            found = [np.unique(grams_[wanted.of("gram", grams_)]).astype(np.int64)]
            if paired:
                found.append(np.unique(_pair_numbers(data, grams_, wanted)))
            out.append(np.concatenate(found))
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>")(texts.cast("binary"))


def java(pattern: Column) -> Column:
    return F.concat(F.lit("(?isU)"), pattern)


def regex_join(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern_key: str, pattern: str, block: int = BLOCK) -> DataFrame:
    """(pattern_key, key): the distinct pairs of a pattern and a text that it matches somewhere, case ignored.

    Null texts and patterns match nothing. Patterns must be such that Spark and ``policy.pattern_is_safe`` read them.
    """
    find = F.arrow_udf(lambda column: pa.array([sought(p) for p in column.to_pylist()], pa.list_(pa.list_(pa.int64()))),
                       "array<array<bigint>>")
    listed = patterns.where(F.col(pattern).isNotNull()).select(F.col(pattern_key), F.col(pattern).alias("_pattern")).distinct()
    listed = listed.withColumn("_grams", find("_pattern"))
    sets = listed.select(pattern_key, "_pattern", F.size("_grams").alias("_sets"), F.posexplode("_grams").alias("_set", "_grams"))
    indexed = sets.select(pattern_key, "_pattern", "_sets", "_set", F.explode("_grams").alias("_gram"))
    # Most grams of a text belong to no pattern. Tables of flags tell so inside the task.
    wanted = Wanted([tuple(r) for r in indexed.select(F.explode(Wanted.slots(F.col("_gram"))).alias("s")).select("s.*").distinct().collect()])
    spread = texts.where(F.col(text).isNotNull()).select(key, F.explode(text_grams(F.col(text), wanted)).alias("_gram"))
    met = spread.join(indexed, "_gram").groupBy(key, pattern_key, "_pattern", "_sets").agg(F.bit_or(F.pow(F.lit(2), F.col("_set")).cast("int")).alias("_met"))
    candidates = met.where(F.bit_count("_met") == F.col("_sets")).select(key, pattern_key, "_pattern")
    found = candidates.join(texts.select(key, F.col(text).alias("_text")), key).where(F.regexp_like("_text", java(F.col("_pattern"))))
    found = found.select(pattern_key, key)

    waiting = []
    rest = listed.where(F.size("_grams") == 0).select(pattern_key, "_pattern").toLocalIterator()
    for row in rest:
        waiting.append(row)
        if len(waiting) == block:
            found, waiting = found.unionByName(_tested(texts, key, text, waiting, pattern_key, patterns)), []
    return (found.unionByName(_tested(texts, key, text, waiting, pattern_key, patterns)) if waiting else found).distinct()


def _tested(texts: DataFrame, key: str, text: str, rows: list, pattern_key: str, patterns: DataFrame) -> DataFrame:
    """Pairs of all texts with a few patterns. A text that matches none costs one alternation, unless a pattern refers to its groups."""
    kind = patterns.schema[pattern_key].dataType
    subject = F.col(text)
    tests = [F.when(subject.rlike(f"(?isU){row[1]}"), F.lit(row[0]).cast(kind)) for row in rows]
    alone = [r[1] for r in rows if "\\" in r[1]]  # may refer to its own groups
    joined = [f"(?:{r[1]})" for r in rows if "\\" not in r[1]]
    ways = [f"(?isU){p}" for p in alone] + (["(?isU)" + "|".join(joined)] if joined else [])
    any_of = reduce(lambda a, b: a | b, [subject.rlike(way) for way in ways])
    hits = texts.where(subject.isNotNull() & any_of).select(key, F.explode(F.array_compact(F.array(*tests))).alias(pattern_key))
    return hits.select(pattern_key, key)
