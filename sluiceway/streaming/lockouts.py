"""Lockouts over a stream of attempts, judged in the order of event time.

Files may come in any order, so attempts are kept in a table until their time is closed: until the newest attempt seen is
``delay_us`` later, or the stream is ended by ``close``. Closed attempts of a micro-batch are judged together with the state that the
batch before left: for each account the times of its recent failures, at most ``limit`` of them, dropped once they are
out of the window. Outcomes, state and open attempts are folders named by batch, overwritten when a batch is retried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPTS = "account STRING, ts_us BIGINT, outcome STRING"
OPEN = "account STRING, ts_us BIGINT, failed BOOLEAN"
STATE = "account STRING, failures ARRAY<BIGINT>"
JUDGED = f"{ATTEMPTS}, failures ARRAY<BIGINT>"


def judge(attempts: DataFrame, limit: int, seconds: int, state: DataFrame | None = None, clear_on_success: bool = True) -> DataFrame:
    """(account, ts_us, outcome, failures) of attempts ``(account, ts_us, failed)``: refused while locked (and then not counted as a
    failure), failed, or ok. The row without an outcome ends an account and has the failures that still count.

    Attempts at one time: failures first. Each outcome depends on the one before, so an account is one ordered pass; rows are
    streamed through it, a few timestamps are all that is held.
    """
    span = seconds * 1_000_000

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, failures = None, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.account != account:
                    if account is not None:
                        out.append((account, None, None, failures))
                    account, failures = row.account, []
                if row.kind == 0:
                    failures = [int(t) for t in row.held]
                    continue
                failures = [t for t in failures if row.ts_us - t < span]
                if len(failures) >= limit:
                    outcome = "refused"
                elif row.failed:
                    failures.append(int(row.ts_us))
                    outcome = "failed"
                else:
                    failures = [] if clear_on_success else failures
                    outcome = "ok"
                out.append((account, int(row.ts_us), outcome, None))
            yield _frame(out)
        if account is not None:
            yield _frame([(account, None, None, failures)])

    rows = attempts.select("account", F.lit(1).alias("kind"), "ts_us", "failed", F.lit(None).cast("array<bigint>").alias("held"))
    if state is not None:
        rows = rows.unionByName(state.select("account", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("ts_us"), F.lit(False).alias("failed"), F.col("failures").alias("held")))
    ordered = rows.repartition("account").sortWithinPartitions("account", "kind", "ts_us", F.desc("failed"))
    return ordered.mapInPandas(walk, JUDGED)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["account", "ts_us", "outcome", "failures"])
    frame["ts_us"] = frame["ts_us"].astype("Int64")
    return frame


class LockoutJob:
    """Micro-batches of attempts in, outcomes out. Use ``handle`` with ``runner.each_batch`` and ``close`` at the end of the stream."""

    def __init__(self, spark: SparkSession, root: str, out: str, limit: int, seconds: int, delay_us: int, clear_on_success: bool = True):
        self._spark, self._root, self._out = spark, root, out
        self._rule, self._delay, self._span, self._clear = (limit, seconds), delay_us, seconds * 1_000_000, clear_on_success
        self._last = -1

    def _read(self, name: str, batch_id: int, schema: str) -> DataFrame:
        if batch_id < 0:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(f"{self._root}/{name}/batch={batch_id}")

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        waiting = self._read("open", batch_id - 1, OPEN).unionByName(batch.select("account", "ts_us", "failed"))
        newest = waiting.agg(F.max("ts_us")).first()[0]
        self._step(waiting, batch_id, None if newest is None else newest - self._delay)

    def close(self) -> None:
        """Judge what is still open."""
        self._step(self._read("open", self._last, OPEN), self._last + 1, None, everything=True)

    def _step(self, waiting: DataFrame, batch_id: int, until: int | None, everything: bool = False) -> None:
        closed = F.lit(everything) if until is None else F.col("ts_us") <= until
        waiting.where(~closed).write.mode("overwrite").parquet(f"{self._root}/open/batch={batch_id}")
        judged = judge(waiting.where(closed), *self._rule, self._read("state", batch_id - 1, STATE), self._clear)
        judged.write.mode("overwrite").parquet(f"{self._root}/judged/batch={batch_id}")
        judged = self._spark.read.schema(JUDGED).parquet(f"{self._root}/judged/batch={batch_id}")
        judged.where("outcome IS NOT NULL").drop("failures").write.mode("overwrite").parquet(f"{self._out}/batch={batch_id}")
        left = judged.where("outcome IS NULL").select("account", F.filter("failures", lambda t: F.lit(until is None) | (t > (until or 0) - self._span)).alias("failures"))
        left.where(F.size("failures") > 0).write.mode("overwrite").parquet(f"{self._root}/state/batch={batch_id}")
        self._last = batch_id
