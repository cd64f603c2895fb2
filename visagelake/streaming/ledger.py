"""Live job counts with state and timers: a job counts under its last status, and a failure until it has been kept long enough."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

KEPT_MS = 24 * 3600 * 1000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "job_id string, status string, change long"


class Ledger(StatefulProcessor):
    """The last (status, at, seq) of a job; a timer takes a failure out of the counts."""

    def __init__(self, kept_ms: int):
        self.kept_ms = kept_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at long, seq long")

    def changed(self, key, *changes: tuple[str, int]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *c) for c in changes], columns=["job_id", "status", "change"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.last.get()) if self.last.exists() else None
        now = before
        for batch in rows:
            for status, at, seq in zip(batch["status"], batch["at_ms"], batch["seq"], strict=True):
                if now is None or (at, seq) > now[1:]:
                    now = (status, int(at), int(seq))
        if now == before:  # older than what is known
            return
        if before and before[0] == "failed":
            self.handle.deleteTimer(before[1] + self.kept_ms)
        if now[0] == "failed":
            self.handle.registerTimer(now[1] + self.kept_ms)
        self.last.update(now)
        if before is None:
            yield self.changed(key, (now[0], 1))
        elif before[0] != now[0]:
            yield self.changed(key, (before[0], -1), (now[0], 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] == "failed":
            self.last.clear()
            yield self.changed(key, ("failed", -1))

    def close(self) -> None:
        pass


def changes(results: DataFrame, kept_ms: int = KEPT_MS, delay: str = "0 seconds") -> DataFrame:
    """Changes (job_id, status, change) of the counts by status that a stream of results (job_id, status, at, seq) makes.

    A result moves its job to its status: one less where it was, one more where it is; a result that is not later than the
    known one, by (at, seq), changes nothing. A failure that no result replaces is counted down and forgotten once the
    watermark (latest time less delay) is kept_ms past it. Rows without a job, status or time are left out; a null seq is
    below any other; rows behind the watermark are late and dropped by Spark. The state is a row for each job that has
    not expired, on the executors' disks and in the checkpoint: the session must set PROVIDER to ROCKS_DB.
    """
    known = results.where("job_id is not null and status is not null and at is not null")
    known = known.withWatermark("at", delay).select("job_id", "status", "at", F.unix_millis("at").alias("at_ms"), F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))).alias("seq"))
    return known.groupBy("job_id").transformWithStateInPandas(Ledger(kept_ms), CHANGES, "Update", "EventTime")


def live_counts(changes: DataFrame) -> DataFrame:
    """(status, jobs) of changes that have been written; statuses that no job has any more are left out."""
    return changes.groupBy("status").agg(F.sum("change").alias("jobs")).where("jobs <> 0")


def run(changes: DataFrame, target: str, checkpoint: str) -> None:
    """Write the changes of all that is there to Parquet below target, a folder a batch, so that a batch that is run again replaces its own."""
    spark = changes.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        written = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        query = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(written).start()
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()
