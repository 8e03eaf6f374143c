"""Classifier verdicts: adapters, parsing, the blocked subset and the request verdict."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.columns import let
from sluiceway.policy import Policy

# Line breaks, code format, what the one built-in family answers, families known by
# name for which no adapter exists.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
CODE = r"s\d{1,2}"
EXPECTED = '"safe" or "unsafe" followed by S-codes on the next line (e.g. "unsafe\\nS1,S4")'
KNOWN_WITHOUT_ADAPTER = "(?i)shield|guardian|wildguard"
UNSPECIFIED = "UNSPECIFIED"
ALWAYS_BLOCKED = (UNSPECIFIED, "UNPARSEABLE_VERDICT")

OK, UNAVAILABLE, UNPARSEABLE, NO_ADAPTER = "ok", "guard_unavailable", "guard_verdict_unparseable", "guard_no_adapter"


def parse_two_lines(raw: Column) -> Column:
    """``struct<status, unsafe, codes>`` of a safe / unsafe answer with codes on later lines.

    A missing or blank answer is ``guard_unavailable``; anything but an exact first line is
    unparseable. Neither ever reads as safe.
    """
    lines = F.filter(
        F.transform(F.split(F.lower(raw), LINE_BREAKS), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", "")),
        lambda line: line != "",
    )
    none = F.array().cast("array<string>")

    def verdict(status: str, unsafe: Column, found: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), unsafe.alias("unsafe"), found.alias("codes"))

    def read(lines: Column) -> Column:
        first = F.get(lines, F.lit(0))
        later = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), " ")
        codes = F.transform(F.regexp_extract_all(later, F.lit(CODE), F.lit(0)), lambda c: F.upper(c))
        named = let(codes, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(UNSPECIFIED))))
        unknown = F.lit(None).cast("boolean")
        return (
            F.when(lines.isNull() | (F.size(lines) == 0), verdict(UNAVAILABLE, unknown, none))
            .when(first == "safe", verdict(OK, F.lit(False), none))
            .when(first == "unsafe", verdict(OK, F.lit(True), named))
            .otherwise(verdict(UNPARSEABLE, unknown, none))
        )

    return let(lines, read)


@dataclass(frozen=True)
class Adapter:
    """How the answers of one classifier family are read."""

    name: str
    match: str
    expected: str
    parse: Callable[[Column], Column]


ADAPTERS = (Adapter("llama_guard", "(?i)llama-?guard", EXPECTED, parse_two_lines),)


def adapter_name(model: Column, adapters: tuple[Adapter, ...] = ADAPTERS) -> Column:
    """Adapter of a model by its name; NULL means its verdicts are refused."""
    return F.coalesce(*[F.when(model.rlike(a.match), F.lit(a.name)) for a in adapters])


def family_note(model: Column) -> Column:
    return F.when(
        model.rlike(KNOWN_WITHOUT_ADAPTER), F.lit("recognised safety family without an adapter yet")
    ).otherwise(F.lit("unknown model family"))


def parse(model: Column, raw: Column, adapters: tuple[Adapter, ...] = ADAPTERS) -> Column:
    """Verdict by the model's adapter; ``guard_no_adapter`` when it has none."""
    refused = F.struct(
        F.lit(NO_ADAPTER).alias("status"), F.lit(None).cast("boolean").alias("unsafe"),
        F.array().cast("array<string>").alias("codes"),
    )
    expr = refused
    for adapter in reversed(adapters):
        expr = F.when(model.rlike(adapter.match), adapter.parse(raw)).otherwise(expr)
    return expr


def blocked_subset(codes: Column, policy: Policy) -> Column:
    blocked = [*policy.blocked, *ALWAYS_BLOCKED]
    return F.filter(codes, lambda code: code.isin(blocked))


def outcome(verdict: Column, policy: Policy) -> Column:
    """``struct<rank, reason, codes>`` of one verdict: blocked (0) before error (1) before pass (2).

    Unsafe with only unblocked codes passes; a NULL verdict is an error.
    """
    none = F.array().cast("array<string>")

    def row(rank: int, reason: Column, codes: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), reason.alias("reason"), codes.alias("codes"))

    hit = blocked_subset(F.coalesce(verdict["codes"], none), policy)
    status = F.coalesce(verdict["status"], F.lit(UNAVAILABLE))
    return (
        F.when(status != OK, row(1, status, none))
        .when(F.coalesce(verdict["unsafe"], F.lit(True)) & (F.size(hit) > 0), row(0, F.lit("classifier"), hit))
        .otherwise(row(2, F.lit(None).cast("string"), none))
    )


def request_verdict(calls: DataFrame, key: str, order: str, verdict: str, policy: Policy) -> DataFrame:
    """One verdict per request over all its classifier calls: any blocked call refuses, then any
    failed call refuses, ties by lowest call index. Combined map-side."""
    best = F.min(F.struct(F.col("o.rank").alias("rank"), F.col(order).alias("at"), F.col("o.reason").alias("reason"), F.col("o.codes").alias("codes")))
    return (
        calls.withColumn("o", outcome(F.col(verdict), policy))
        .groupBy(key)
        .agg(best.alias("best"), F.count(F.lit(1)).alias("calls"))
        .select(key, "calls", F.col("best.at").alias("decided_by"), (F.col("best.rank") < 2).alias("refused"), "best.reason", "best.codes")
    )


def score(chunks: DataFrame, scorer: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """Verdict texts of chunks by a pluggable scorer (``chunks -> key columns + model + raw``).

    A scorer may be a table lookup or a ``mapInPandas`` job over an external classifier. Chunks it
    does not answer keep a NULL verdict, which later refuses.
    """
    return chunks.join(scorer(chunks).select(*key, "model", "raw"), key, "left")
