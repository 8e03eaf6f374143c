"""Filter interaction audit over relations of failing ids.

Every filter has one stored table of the rows that fail it. A prefix of a filter order is the set of filters before a step, so the
steps of all orders share 2^n prefixes. Their survivors are one relation (row, prefix): the failing rows times the prefixes, from
which a left-anti join with each filter's table takes the rows of the prefixes that hold the filter. What a filter removes after
a prefix is the left-semi join of that prefix's survivors with the filter's table; what fails it but is gone already is redundant.
Rows that fail no filter survive every prefix and are counted once.

All joins are on the row's key, so rows are shuffled narrow (key, part, two flags), never texts. Counts per part and prefix are pre-aggregated. The
orders are spread over the counts at the end: n! * n rows a part, as asked for.

Defined cases: a null text counts as an empty one. A null key is no copy of anything, carries no label, and its row counts like any other; rows equal in key and
text are judged alike and each is counted. Null parts count as the empty string. A row labelled twice counts once. An empty table
gives an empty result. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.columns import bind
from sluiceway.llm.common import utf8
from sluiceway.session import cut

FILTERS = "ABCDE"
KEY = ["_id", "_hash"]
SYMBOLS, CAPITALS = b"#$%&*|", bytes(range(65, 91))
TAILS = bytes(range(0x80, 0xC0))  # bytes that continue a code point


def _facts(column: pa.Array) -> pa.Array:
    """Names of the text's own failed filters, and 128 bits of its digest."""
    fails, first, second = [], [], []
    for scalar in column:
        text = scalar.as_buffer().to_pybytes()
        words = text.split()
        capitals = len(text) - len(text.translate(None, CAPITALS))
        points = len(text) - (0 if text.isascii() else len(text) - len(text.translate(None, TAILS)))
        fails.append([name for name, failed in (
            ("A", len(words) < 200),
            ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * capitals > 2 * points),
            ("D", len(text.translate(None, SYMBOLS)) < len(text)),
        ) if failed])
        digest = hashlib.blake2b(text, digest_size=16).digest()
        first.append(int.from_bytes(digest[:8], "little", signed=True))
        second.append(int.from_bytes(digest[8:], "little", signed=True))
    return pa.StructArray.from_arrays([pa.array(fails, pa.list_(pa.string())), pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["fails", "h1", "h2"])


def facts(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(key, part, _id, _hash, h1, h2, fails), one row per document, written once. A row's key is its id and its text's digest."""
    own = bind(docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), utf8(text).alias("text")), "f", F.arrow_udf(_facts, "struct<fails: array<string>, h1: bigint, h2: bigint>")("text"))
    return cut(own.select("key", "part", F.coalesce("key", F.lit(0)).alias("_id"), F.when(F.col("key").isNull(), F.bitwise_not("f.h1")).otherwise(F.col("f.h1")).alias("_hash"),
                          F.col("f.h1").alias("h1"), F.col("f.h2").alias("h2"), F.col("f.fails").alias("fails")))


def failing(known: DataFrame) -> dict[str, DataFrame]:
    """One stored table of distinct failing row keys per filter. Copies (E) are found by the least key of each text."""
    least = known.groupBy("h1", "h2").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").drop("most")
    copies = known.join(least, ["h1", "h2"]).where("key > least").select(*KEY)
    own = {name: known.where(F.array_contains("fails", name)).select(*KEY) for name in FILTERS[:4]}
    return {name: cut(ids.distinct()) for name, ids in (own | {"E": copies}).items()}


def _bit(name: str, names: str) -> int:
    return 1 << names.index(name)


def _holds(prefix: str | Column, name: str, names: str) -> Column:
    return F.col(prefix).bitwiseAND(F.lit(_bit(name, names))) != 0


def survivors(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(row, prefix): every row under every prefix that it survives. ``prefix`` is a bit set of filters, in the order of ``tables``."""
    names = "".join(tables)
    left = rows.withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(names) - 1))))
    for name, ids in tables.items():
        a, b = left.alias("a"), ids.alias("b")
        same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY]
        left = a.join(b, same[0] & same[1] & _holds("a.prefix", name, names), "left_anti")
    return left


def audit(known: DataFrame, tables: dict[str, DataFrame], losses: dict[str, DataFrame]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <loss>_lost ..., shapley) for every part, order and step.

    ``known``: key, part and the row key ``KEY``; ``tables``: failing row keys per filter; ``losses``: per name the keys
    whose removal is to be counted.
    """
    names, sums = "".join(tables), [f"{loss}_lost" for loss in losses]
    anything = None
    for ids in tables.values():
        anything = ids if anything is None else anything.unionAll(ids)
    anything = anything.distinct()
    rows = known.select("key", "part", *KEY)
    clean = rows.join(anything, KEY, "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("clean"))
    marked = rows.join(anything, KEY, "left_semi")
    for loss, keys in losses.items():
        marked = marked.join(keys.select(F.col(keys.columns[0]).alias("key")).distinct().withColumn(f"{loss}_lost", F.lit(1)), "key", "left")
    # Rows that share key, part and flags are one row with a weight.
    weights = marked.groupBy(*KEY, "part").agg(F.count(F.lit(1)).alias("weight"), *[F.count(s).alias(s) for s in sums])
    alive = cut(survivors(weights, tables))

    kept = alive.groupBy("part", "prefix").agg(F.sum("weight").alias("alive"))
    removed = None
    for name, ids in tables.items():
        here = alive.where(~_holds("prefix", name, names)).join(ids, KEY, "left_semi")
        here = here.groupBy("part", "prefix").agg(F.sum("weight").alias("removed"), *[F.sum(s).alias(s) for s in sums]).withColumn("filter", F.lit(name))
        removed = here if removed is None else removed.unionByName(here)
    removed = cut(removed)

    # Everything from here on has at most 2^n * n rows a part.
    after = F.col("prefix") + F.element_at(F.create_map(*[x for n in names for x in (F.lit(n), F.lit(_bit(n, names)))]), F.col("filter"))
    spots = F.array(*[F.struct(F.lit(n).alias("filter"), F.lit(s).alias("prefix")) for n in names for s in range(2 ** len(names)) if not s & _bit(n, names)])
    dense = rows.select("part").distinct().withColumn("spot", F.explode(spots)).select("part", "spot.*").withColumn("after", after)
    table = dense.join(removed, ["part", "prefix", "filter"], "left").join(clean, "part", "left")
    table = table.join(kept.withColumnRenamed("prefix", "after"), ["part", "after"], "left").na.fill(0)
    size = F.bit_count("prefix")
    orders = F.element_at(F.array(*[F.lit(factorial(s) * factorial(len(names) - 1 - s)) for s in range(len(names))]), (size + 1).cast("int"))
    whole = table.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("prefix") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(size == len(names) - 1, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * orders).alias("shapley"))
    table = table.join(whole, ["part", "filter"]).withColumn("steps", F.struct(
        (F.col("clean") + F.col("alive")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *sums, "shapley"))
    steps = [(o, k + 1, o[k], sum(_bit(n, names) for n in o[:k])) for o in map("".join, permutations(names)) for k in range(len(o))]
    plan = known.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, prefix int")  # n! * n rows, fixed by the filters
    return table.join(F.broadcast(plan), ["filter", "prefix"]).select("part", "filter_order", "step", "steps.*")
