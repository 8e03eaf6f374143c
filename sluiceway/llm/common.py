"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.columns import bind

# Words of a text: runs of anything but ASCII white space. ``bytes.split()`` gives the same words in Python.
WORD = r"[^\x20\x09-\x0D]+"


def utf8(text: Column | str) -> Column:
    """A text's bytes; a null text counts as an empty one."""
    return F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")).cast("binary")


def count_words(text: Column | str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def without(df: DataFrame, names) -> DataFrame:
    """``df`` without the columns that an operator is about to add, compared as Spark compares names."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def with_fields(df: DataFrame, value: Column, names) -> DataFrame:
    """Add the named fields of a struct that is worked out once per row. Columns of ``df`` that have one of these names
    are replaced."""
    bound = bind(without(df, [*names, "_fields"]), "_fields", value)
    return bound.select(*[F.col(f"`{c}`") for c in bound.columns if c != "_fields"], *[F.col(f"_fields.{n}").alias(n) for n in names])


def release_memory() -> None:
    """Give what a finished task held back to the system: Python workers wait for other tasks, of other stages too, with their memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc only
        trim(0)
