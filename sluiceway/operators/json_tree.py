"""Nested JSON documents as long tables of their members, level by level, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.session import cut

NESTED = "^(ARRAY|OBJECT)"


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _step(name: Column, position: Column) -> Column:
    """What a member adds to its parent's path. Names other than plain words are quoted, so no two paths are alike."""
    quoted = F.concat(F.lit('."'), F.regexp_replace(F.regexp_replace(name, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    plain = F.when(name.rlike(r"\A[A-Za-z0-9_]+\z"), F.concat(F.lit("."), name)).otherwise(quoted)
    return F.coalesce(plain, F.concat(F.lit("["), position.cast("string"), F.lit("]")))


def members(rows: DataFrame, key: str, document: str) -> DataFrame:
    """``(key, path, at, name, text)``: every object member and every string of JSON documents given as text.

    ``name`` is the member's key (NULL for array elements and for a document that is a bare string), ``text`` its string value
    (NULL for other values, whose key is still a row). ``at`` puts a document's rows in order: depth first, members of one
    object by name, since a VARIANT holds them so. Documents that are NULL or no readable JSON (duplicate keys included) give one row whose
    ``path`` is NULL; callers refuse them. Empty objects and arrays give no row beyond their own key.

    Each level is one lateral ``variant_explode`` over what is still nested, which alone is stored and carried on; the number of
    rounds is the depth of the deepest document, and no document is gathered in one row.
    """
    level = rows.select(key, F.lit("$").alias("path"), F.array().cast("array<int>").alias("at"), F.lit(None).cast("string").alias("name"),
                        F.try_parse_json(document).alias("v"))
    unread = level.where("v IS NULL")
    found = [unread.select(key, F.lit(None).cast("string").alias("path"), "at", "name", F.lit(None).cast("string").alias("text"))]
    level = level.where("v IS NOT NULL")
    while True:
        level = cut(level.withColumn("kind", _kind(F.col("v"))))
        text = F.when(F.col("kind") == "STRING", F.try_variant_get("v", "$", "string"))
        found.append(level.where("name IS NOT NULL OR kind = 'STRING'").select(key, "path", "at", "name", text.alias("text")))
        nested = level.where(F.col("kind").rlike(NESTED)).select(key, "path", "at", F.col("v").alias("_parent"))
        if nested.isEmpty():
            break
        inside = nested.sparkSession.tvf.variant_explode(F.col("_parent").outer()).toDF("_pos", "_key", "_value")
        child = nested.lateralJoin(inside)
        level = child.select(key, F.concat("path", _step(F.col("_key"), F.col("_pos"))).alias("path"),
                             F.concat("at", F.array("_pos")).alias("at"), F.col("_key").alias("name"), F.col("_value").alias("v"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
