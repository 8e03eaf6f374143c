"""Quality rules as a short-circuit cascade.

Every rule either rejects a document or passes it on, and the first rejection ends the work on that document. The order of
the rules is chosen from measurements: a bounded sample is put through all rules, each rule's time and the combinations of
rules that reject together are summed up, and rules are taken greedily by rejections among the sample's survivors per second.
The order decides only how much work is done: a document is kept exactly if no rule rejects it, whatever the order.

Defined cases: a null text has no words, so the base rules reject it; empty texts likewise. Texts are measured whole. Repeated
rows are judged row by row. An empty table gives an empty result (rules then stay in their given order). Input columns named
like an output column are replaced; all others are passed through.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import utf8, with_fields

SAMPLE_ROWS = 2000  # rows the order is estimated on, whatever the size of the table
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that stand in a window of ``size`` words found twice or more, the first finding included."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = bytearray(len(words))
    for at, window in enumerate(windows):
        if window in often:
            covered[at:at + size] = b"\1" * size
    return sum(covered)


class Measures:
    """Measures of one text, each worked out when a rule first asks for it."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if line.strip()]

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def word_chars(self) -> int:
        return len(self.data.translate(None, SPACE).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        return self.n_lines - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_capitals(self) -> int:
        """Words with a capital and no small letter of A-Z."""
        return sum(map(bytes.isupper, self.words))

    @cached_property
    def n_shouts(self) -> int:
        return self.data.count(b"!")

    @cached_property
    def n_bullets(self) -> int:
        return sum(line.lstrip(SPACE).startswith((b"-", b"*", "•".encode())) for line in self.lines)

    @cached_property
    def n_trailing_off(self) -> int:
        return sum(line.rstrip(SPACE).endswith((b"...", "…".encode())) for line in self.lines)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the measures of one text."""

    name: str
    rejects: Callable[[Measures], bool]


RULES = (
    Rule("unbroken", lambda m: m.word_chars > 100 * m.n_words),
    Rule("capitals", lambda m: 10 * m.n_capitals > 3 * m.n_words),
    Rule("bullets", lambda m: 10 * m.n_bullets > 9 * m.n_lines),
    Rule("trailing_off", lambda m: 10 * m.n_trailing_off > 3 * m.n_lines),
    Rule("repeated_lines", lambda m: 5 * m.n_dup_lines > 2 * m.n_lines),
    Rule("shouts", lambda m: 10 * m.n_shouts > 3 * m.n_words),
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
)


def _trial(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, together = [0] * len(rules), Counter()
        for batch in batches:
            for data in batch.column(0).to_pylist():
                if Measures(data).base_failed:
                    continue
                mask = 0
                for k, rule in enumerate(rules):
                    fresh = Measures(data)  # each rule pays for what it needs itself
                    start = time.perf_counter_ns()
                    mask |= bool(rule.rejects(fresh)) << k
                    spent[k] += time.perf_counter_ns() - start
                together[mask] += 1
        rows = [(k, -1, ns) for k, ns in enumerate(spent)] + [(-1, mask, n) for mask, n in together.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["rule", "mask", "value"])

    return run


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS,
             seed: int = 42) -> list[tuple[str, float, float]]:
    """(rule, seconds per document, share of the documents still there that it rejects), in the order chosen.

    Only sums leave the executors: one row per rule and per combination of rejecting rules.
    """
    fraction = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(utf8(text).alias("data")).sample(fraction=fraction, seed=seed)
    sums = sample.mapInArrow(_trial(rules), "rule long, mask long, value long").groupBy("rule", "mask").agg(F.sum("value").alias("value"))
    spent, together = [0] * len(rules), Counter()
    for rule, mask, value in sums.collect():
        if rule >= 0:
            spent[rule] = value
        else:
            together[mask] = value
    return greedy_order([r.name for r in rules], spent, together)


def greedy_order(names: list[str], spent: list[int], together: dict[int, int]) -> list[tuple[str, float, float]]:
    """Take the rule with most rejections among the survivors per second, again and again. Ties: the earlier rule."""
    total = max(1, sum(together.values()))
    left, order = dict(together), []
    todo = list(range(len(names)))
    while todo:
        there = max(1, sum(left.values()))
        rejected = {k: sum(n for mask, n in left.items() if mask >> k & 1) for k in todo}
        best = max(todo, key=lambda k: ((rejected[k] + 0.5) / (spent[k] + 1), -k))
        order.append((names[best], spent[best] / total / 1e9, rejected[best] / there))
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
        todo.remove(best)
    return order


def _judge(rules: tuple[Rule, ...]):
    def run(column: pa.Array) -> pa.Array:
        out = {name: [] for name in (*BASE, "base_failed", "kept")}
        for data in column.to_pylist():
            m = Measures(data)
            for name in BASE:
                out[name].append(getattr(m, name))
            out["base_failed"].append(m.base_failed)
            out["kept"].append(not m.base_failed and not any(rule.rejects(m) for rule in rules))
        kinds = [pa.int64()] * len(BASE) + [pa.bool_()] * 2
        return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return run


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the base measures, ``base_failed`` and ``kept``: one row in, one row out, no shuffle."""
    by_name = {r.name: r for r in rules}
    ordered = tuple(by_name[name] for name, _, _ in estimate(docs, rules, text, sample_rows))
    names = (*BASE, "base_failed", "kept")
    kind = "struct<" + ", ".join([f"{n}: bigint" for n in BASE] + ["base_failed: boolean", "kept: boolean"]) + ">"
    return with_fields(docs, F.arrow_udf(_judge(ordered), kind)(utf8(text)), names)
