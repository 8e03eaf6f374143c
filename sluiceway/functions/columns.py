"""Helpers on whole columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is worked out once per row, however often later steps use it.

    The optimizer copies a projected expression into every filter it pushes below the projection,
    which repeats costly text work. It does not push through a generator, and a one-element
    array neither adds nor drops rows.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value worked out once: inside a lambda it is a variable, not a copied
    expression. For costly values that an expression uses several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hidden(value: str | bytes) -> Column:
    """A constant that stands in no plan, and so in no explain output, event log or UI: it travels as the one row of a table
    that a scalar subquery reads. For keys. Bind it to a column before use inside a lambda."""
    return SparkSession.active().sql("SELECT v FROM VALUES (:v) AS t(v)", {"v": value}).scalar()
