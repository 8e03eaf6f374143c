"""Sinks: append-only logs, versioned rewrites, evidence store and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators import evidence
from sluiceway.session import cut

# Rows per file: keeps log files near the size at which logs used to be rotated.
ROWS_PER_FILE = 200_000
NO_DAY = "1970-01-01"


def append_log(records: DataFrame, path: str, fmt: str = "json") -> None:
    """Append records to a log partitioned by day. Rows go to a day's file in parallel, so one busy
    day is not written by one task. Records without a readable time go to the day ``NO_DAY``."""
    dated = records.withColumn("dt", F.coalesce(F.to_date(F.try_to_timestamp("ts")), F.lit(NO_DAY).cast("date")))
    dated.write.mode("append").partitionBy("dt").option("maxRecordsPerFile", ROWS_PER_FILE).format(fmt).save(path)


def rewrite(rows: DataFrame, root: str, version: str, fmt: str = "parquet") -> str:
    """Write a new version beside the old one and point to it last; the path being read is never
    overwritten, and a job that dies half-way leaves the old version in force."""
    target = f"{root}/v={version}"
    rows.write.mode("error").format(fmt).save(target)
    spark = rows.sparkSession
    number = _pointers(spark, root).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1 if exists(spark, f"{root}/_current") else 1
    spark.createDataFrame([(number, version, target)], POINTER).coalesce(1).write.mode("append").json(f"{root}/_current")
    return target


POINTER = "number bigint, version string, path string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(POINTER).json(f"{root}/_current")


def current(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """The version last pointed to: the one of the highest number, whatever its name."""
    pointer = _pointers(spark, root).orderBy(F.col("number").desc()).first()
    return spark.read.format(fmt).load(pointer["path"])


def append_evidence(bodies: DataFrame, root: str, key: str, segment_rows: int = evidence.SEGMENT_ROWS) -> None:
    """Seal a batch of bodies behind what the store has, and store records, index and heads. The batch is sealed once."""
    spark, there = bodies.sparkSession, exists(bodies.sparkSession, f"{root}/heads")
    stored = spark.read.schema(evidence.SEALED).parquet(f"{root}/heads") if there else None
    after = evidence.tails(spark.read.parquet(f"{root}/index")) if there else None
    sealed = cut(evidence.seal(bodies, segment_rows, after))
    write_evidence(sealed, root, key)
    # Chains of heads are short: a row for each segment ever appended.
    heads = cut(evidence.seal(evidence.heads(sealed), None, evidence.tails(stored) if there else None))
    heads.write.mode("append").parquet(f"{root}/heads")


def read_heads(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(evidence.SEALED).parquet(f"{root}/heads")


def write_evidence(sealed: DataFrame, root: str, key: str) -> None:
    """Encrypted bodies, and an index without content."""
    rows = sealed.withColumn("ciphertext", evidence.encrypt(F.col("body_json"), key)).drop("body_json")
    rows.write.mode("append").partitionBy("chain_id").parquet(f"{root}/records")
    evidence.index_of(sealed).write.mode("append").partitionBy("chain_id").parquet(f"{root}/index")


def read_evidence(spark: SparkSession, root: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(index, records): bodies are decrypted, an altered ciphertext gives a NULL body."""
    records = spark.read.parquet(f"{root}/records").withColumn("body_json", evidence.decrypt(F.col("ciphertext"), key))
    return spark.read.parquet(f"{root}/index"), records


def export(records: DataFrame, verified: DataFrame, path: str) -> None:
    """Records with their check result, the per-chain summary and a checksum manifest."""
    checked = records.join(verified.select("chain_id", "seq", "verified"), ["chain_id", "seq"], "left")
    checked.write.mode("error").json(f"{path}/records")
    evidence.summary(verified).write.mode("error").json(f"{path}/summary")
    evidence.manifest(records).write.mode("error").json(f"{path}/manifest")
