"""Starting streams: file sources, checkpointed sinks, policy reload."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sluiceway.policy import Policy, make_policy, read_policy
from sluiceway.session import configure, shared_folder
from sluiceway.sources.writers import exists

FILES_PER_TRIGGER = 1000


def follow_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """New JSON files of a log folder. The checkpoint is the cursor; overload slows the stream
    down, no record is dropped."""
    return configure(spark).readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def follow_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A shared table, one file or a folder of files, read as a stream of its files."""
    schema = configure(spark).read.parquet(f"{sf_dir}/{table}.parquet").schema
    # A stream's path must be a folder, or a pattern: this one matches the table's name alone, be it a file or a folder.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.[p]arquet")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available into Parquet files, then stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch, overwritten when a batch is retried: nothing is doubled."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def new_root(spark: SparkSession) -> str:
    """A folder of its own for one run."""
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def run(spark: SparkSession, start: Callable[[str, str], StreamingQuery], schema: StructType, finish: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over what is available, then ``finish``, and give its output table back."""
    root = new_root(spark)
    query = start(f"{root}/out", f"{root}/checkpoint")
    query.awaitTermination()
    if finish:
        finish()
    if not exists(spark, f"{root}/out"):  # a stream without files runs no batch
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/out")


class PolicyWatch:
    """The policy in force for each micro-batch: re-read at its start, the last good one kept."""

    def __init__(self, spark: SparkSession, path: str | None = None, policy: Policy | None = None):
        self._spark, self._path, self._policy = spark, path, policy or make_policy()

    def current(self) -> Policy:
        if self._path:
            self._policy = read_policy(self._spark, self._path, self._policy)
        return self._policy
