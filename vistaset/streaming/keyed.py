"""The newest state of each key as keyed streaming state.

A key's state is its last order values and whether it is deleted, not its row, so state grows with the keys and
batches are not joined with the whole table. Rows that change nothing are dropped where they arrive. Deleted keys
are remembered until the watermark has passed the deletion by ``keep`` milliseconds, so that late older rows do not
bring them back; then their state ends. Of rows with equal order values one counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .refresh import newest_by_window


def taking_effect(stream: DataFrame, key: str, at: str, order: str, deleted: str, keep: int, delay: str = "1 day") -> DataFrame:
    """The rows of a stream of changes that are newer than all before of their key, by (at, order).

    ``at`` is a timestamp, ``order`` a whole number that orders rows of one time, ``deleted`` a boolean. Rows that
    come later than ``delay`` are dropped by the watermark: deletions older than that may be forgotten.
    """
    state_schema = StructType([StructField("at", LongType()), StructField("order", LongType()), StructField("deleted", BooleanType())])

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, best = (state.get[:2] if state.exists else None), None
        for f in frames:
            last = int(np.lexsort((f[order], f["_us"]))[-1])
            this = (int(f["_us"].iloc[last]), int(f[order].iloc[last]))
            if known is None or this > known:
                known, best = this, f.iloc[[last]]
        if best is not None:
            gone = bool(best[deleted].iloc[0])
            state.update((*known, gone))
            if gone:
                state.setTimeoutTimestamp(max(known[0] // 1000 + keep, state.getCurrentWatermarkMs() + 1))
            yield best.drop(columns=["_at", "_us"])
        elif state.exists and state.get[2]:
            # a late row of a deleted key does not end its time-out
            state.setTimeoutTimestamp(max(known[0] // 1000 + keep, state.getCurrentWatermarkMs() + 1))

    when = F.col(at).cast("timestamp")
    timed = stream.withColumn("_at", when).withColumn("_us", F.unix_micros(when)).withWatermark("_at", delay)
    return timed.groupBy(key).applyInPandasWithState(step, stream.schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def log(changes: DataFrame, folder: str, checkpoint: str, before: Callable[[int], None] | None = None):
    """Start a query that writes each batch's changes as a table of its own; a repeated batch replaces its table.

    ``before`` is called with each batch's number, for tests of failures.
    """

    def step(batch: DataFrame, number: int) -> None:
        if before:
            before(number)
        batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return changes.writeStream.foreachBatch(step).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, folder: str, key: str, order: list[str], deleted: str) -> DataFrame:
    """The live rows of a log: the last change of each key, if it is no deletion."""
    return newest_by_window(spark.read.parquet(folder).drop("batch"), key, order).where(~F.col(deleted)).drop(deleted)
