"""Tamper-evident evidence: canonical bodies, hash chains, verification, expiry, export.

A hash chain is sequential by nature, a cluster is not. Chains are cut into segments of bounded
length by position; each segment is folded on its own, and the last hashes of the segments are
sealed as a chain one level up, which goes on from its stored end. With one segment this is the plain chain. Verification needs no
order at all: every record carries its predecessor's hash, so it is an equality join.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sluiceway.functions.columns import bind, hidden
from sluiceway.functions.text import category_codes
from sluiceway.operators.ordering import number_rows
from sluiceway.policy import CATEGORY_NAMES

GENESIS = "GENESIS"
SEGMENT_ROWS = 10_000

SEALED = StructType([
    StructField("chain_id", StringType()), StructField("segment", LongType()), StructField("seq", LongType()),
    StructField("segment_start", LongType()), StructField("id", StringType()), StructField("ts", StringType()),
    StructField("body_json", StringType()), StructField("prev_hash", StringType()), StructField("hash", StringType()),
])


@F.pandas_udf(StringType())
def _canonical(values: pd.Series) -> pd.Series:
    return values.map(lambda v: json.dumps(json.loads(v), sort_keys=True, ensure_ascii=False), na_action="ignore")


def canonical_json(body: Column) -> Column:
    """JSON text of a struct with sorted keys, a blank after separators and NULL fields kept."""
    return _canonical(F.to_json(body, {"ignoreNullFields": "false"}))


def categories_of(detail: Column, names: dict[str, str] = CATEGORY_NAMES) -> Column:
    """``[{code, name}]`` of the codes in a detail text."""
    dimension = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform(category_codes(detail), lambda c: F.struct(c.alias("code"), F.coalesce(F.try_element_at(dimension, c), F.lit("")).alias("name")))


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("seq")
    previous, links = group["start_hash"].iloc[0], []
    for body in group["body_json"]:
        digest = hashlib.sha256((previous + body).encode()).hexdigest()
        links.append((previous, digest))
        previous = digest
    group["prev_hash"], group["hash"] = zip(*links)
    return group.drop(columns="start_hash")


def seal(bodies: DataFrame, segment_rows: int | None = SEGMENT_ROWS, after: DataFrame | None = None) -> DataFrame:
    """Chained records of ``(chain_id, id, ts, body_json)`` in ``(ts, id)`` order per chain.

    ``after`` has the last stored record of each chain (``tails``); the new ones continue its numbers and start segments of
    their own. No fold sees more than ``segment_rows`` records. With None the chain is one segment that goes on from the
    stored hash: for chains of heads, which are short.
    """
    numbered = number_rows(bodies.select("chain_id", "id", "ts", "body_json"), "chain_id", ["ts", "id"])
    if after is not None:
        last = after.select("chain_id", F.col("seq").alias("_seq"), F.col("segment").alias("_segment"), F.col("hash").alias("_hash"))
        numbered = numbered.join(last, "chain_id", "left")
    else:
        numbered = numbered.withColumns({"_seq": F.lit(None).cast("bigint"), "_segment": F.lit(None).cast("bigint"), "_hash": F.lit(None).cast("string")})
    first = F.coalesce(F.col("_seq") + 1, F.lit(0))
    if segment_rows is None:
        where = {"segment": F.lit(0).cast("bigint"), "segment_start": F.lit(0).cast("bigint"), "start_hash": F.coalesce("_hash", F.lit(GENESIS))}
    else:
        part = F.floor(F.col("seq") / segment_rows)
        where = {"segment": F.coalesce(F.col("_segment") + 1, F.lit(0)) + part, "segment_start": first + part * segment_rows, "start_hash": F.lit(GENESIS)}
    placed = numbered.withColumns(where).withColumn("seq", first + F.col("seq")).select(
        "chain_id", "segment", "seq", "segment_start", "id", "ts", "body_json", "start_hash"
    )
    return placed.groupBy("chain_id", "segment").applyInPandas(_fold, SEALED)


def tails(sealed: DataFrame) -> DataFrame:
    """The last record of each chain, which the next batch continues from."""
    last = F.max(F.struct("seq", "segment", "hash"))
    return sealed.groupBy("chain_id").agg(last.alias("t")).select("chain_id", "t.seq", "t.segment", "t.hash")


def heads(sealed: DataFrame) -> DataFrame:
    """Bodies of the next level: one per segment, committing to its last hash, its last number and its length."""
    last = sealed.groupBy("chain_id", "segment").agg(
        F.max_by("hash", "seq").alias("head"), F.count(F.lit(1)).alias("rows"), F.max("seq").alias("last"), F.max("ts").alias("ts")
    )
    body = canonical_json(F.struct("chain_id", "segment", "head", "rows", "last"))
    return last.select("chain_id", F.format_string("%012d", "segment").alias("id"), "ts", body.alias("body_json"))


def index_of(sealed: DataFrame) -> DataFrame:
    """Metadata-only index: no body text, so listing never reads content."""
    body = F.from_json("body_json", "stage string, reason string, key_alias string, categories array<struct<code:string>>")
    held = bind(sealed, "_b", body)
    return held.select("chain_id", "segment", "seq", "segment_start", "id", "ts", "_b.stage", "_b.reason", F.col("_b.categories.code").alias("categories"), "_b.key_alias", "hash")


def verify(index: DataFrame, records: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Per index entry: is its record present, unedited and linked to its predecessor?

    Both joins use the unique key (chain_id, seq), so they spread evenly whatever the chain sizes
    and share one shuffle of the records. ``anchors`` is ``(chain_id, seq, hash)`` of the last
    expired record of a chain. Whole segments missing from index and records are seen by ``verify_heads``.
    """
    key = ["chain_id", "seq"]
    # Re-hashing needs no other row, so bodies are read once where they lie and never shuffled.
    own = F.coalesce(F.sha2(F.concat("prev_hash", "body_json"), 256) == F.col("hash"), F.lit(False))
    found = records.select(*key, "prev_hash", F.col("hash").alias("record_hash"), own.alias("own_ok"))
    before = records.select("chain_id", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("before_hash"))
    if anchors is not None:
        before = before.unionByName(anchors.select("chain_id", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("before_hash")))
    joined = index.join(found, key, "left").join(before, key, "left")
    expected = F.when(F.col("seq") == F.col("segment_start"), F.lit(GENESIS)).otherwise(F.col("before_hash"))
    hash_ok = F.coalesce(F.col("own_ok") & (F.col("record_hash") == F.col("hash")), F.lit(False))
    link_ok = F.coalesce(F.col("prev_hash") == expected, F.lit(False))
    present = F.col("record_hash").isNotNull()
    return joined.select(*key, "id", present.alias("present"), hash_ok.alias("hash_ok"), link_ok.alias("link_ok")).withColumn(
        "verified", F.col("hash_ok") & F.col("link_ok")
    )


def verify_heads(stored: DataFrame, records: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Per sealed head: does its segment still have all its records and end in the head's hash, and is the chain of heads whole?
    Segments that expired in part need only what is after the anchor; those that expired wholly need nothing."""
    links = verify(stored.select("chain_id", "seq", "segment_start", "id", "hash"), stored).select("chain_id", "seq", "verified")
    held = stored.select("chain_id", "seq", F.from_json("body_json", "segment bigint, head string, rows bigint, last bigint").alias("h")).select("chain_id", "seq", "h.*")
    there = records.groupBy("chain_id", "segment").agg(F.count(F.lit(1)).alias("found"), F.max_by("hash", "seq").alias("end"))
    joined = held.join(there, ["chain_id", "segment"], "left").join(links, ["chain_id", "seq"])
    gone = F.lit(-1)
    if anchors is not None:
        joined = joined.join(anchors.select("chain_id", F.col("seq").alias("_gone")), "chain_id", "left")
        gone = F.coalesce("_gone", F.lit(-1))
    wanted = F.greatest(F.lit(0), F.least(F.col("rows"), F.col("last") - gone))
    whole = (F.coalesce("found", F.lit(0)) == wanted) & ((wanted == 0) | F.coalesce(F.col("end") == F.col("head"), F.lit(False)))
    return joined.select("chain_id", "segment", "rows", F.coalesce("found", F.lit(0)).alias("found"), (whole & F.col("verified")).alias("intact"))


def summary(verified: DataFrame) -> DataFrame:
    return verified.groupBy("chain_id").agg(
        F.bool_and("verified").alias("intact"), F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("verified")).alias("verified"), F.count_if(~F.col("present")).alias("missing"),
    )


def expire(records: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(kept records, anchors): records older than the cutoff go, the last expired hash of each
    chain stays as the anchor that later verification starts from."""
    # A record without a readable time has no age, so it stays.
    old = F.coalesce(F.try_to_timestamp("ts") < cutoff, F.lit(False))
    anchors = records.where(old).groupBy("chain_id").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
    return records.where(~old), anchors


def manifest(records: DataFrame) -> DataFrame:
    """Export manifest: file name and sha256 of each exported record."""
    return records.select(F.concat("id", F.lit(".json")).alias("file"), F.sha2("body_json", 256).alias("sha256"))


def encrypt(body: Column, key: str) -> Column:
    """Authenticated encryption under a key derived from a passphrase. The key stands in no plan."""
    return F.aes_encrypt(body, hidden(hashlib.sha256(key.encode()).digest()), F.lit("GCM"))


def decrypt(sealed: Column, key: str) -> Column:
    """The body, or NULL for a wrong key or altered ciphertext."""
    return F.try_aes_decrypt(sealed, hidden(hashlib.sha256(key.encode()).digest()), F.lit("GCM")).cast("string")


def handoff(record: DataFrame, key: str, fresh_key: str) -> DataFrame:
    """Records re-encrypted under a fresh key, with the chain hash to check them against."""
    return record.select(
        "id", encrypt(decrypt(F.col("ciphertext"), key), fresh_key).alias("ciphertext"), "prev_hash", F.col("hash").alias("chain_hash")
    )


def open_handoff(bundle: DataFrame, fresh_key: str) -> DataFrame:
    """Decrypted handoff records and whether they still match the chain hash."""
    opened = bundle.withColumn("body_json", decrypt(F.col("ciphertext"), fresh_key))
    ok = F.sha2(F.concat("prev_hash", "body_json"), 256) == F.col("chain_hash")
    return opened.select("id", "body_json", F.coalesce(ok, F.lit(False)).alias("verified"))
