"""Session settings, table loading and durable lineage cuts shared by every job."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Runtime SQL settings every job relies on. Skewed join partitions are split by AQE even when
# the join feeds an aggregate on the same key (force...), so one hot key never pins one task.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch of long texts is held several times over, in the JVM and in the Python worker; this bounds each copy.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session the caller owns; idempotent."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The durable folder of the cluster (``spark.checkpoint.dir``).

    A local-mode session without the setting (tests, a laptop) gets a temporary one. On a
    cluster a machine-local folder would lose data with its machine, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later stages neither recompute it nor see
    it change after an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def epoch_us(ts) -> "F.Column":
    """Timestamp column (with or without zone, session zone UTC) to integer microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


def iso_text(ts) -> "F.Column":
    """ISO-8601 UTC text, the form log records carry."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all slots when the scan gives fewer splits than there are.

    Text work is heavy per row, and a small table of few row groups would keep most slots idle. A
    large table has more splits than slots and is left alone: no shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
