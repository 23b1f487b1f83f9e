"""A library that follows a stream of changes: the newest state of each path wins, deletions remove it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(feed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key. A combining aggregate: no key's history meets in one task."""
    rest = [c for c in feed.columns if c != key]
    last = feed.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return last.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def newest_by_window(feed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The same for rows with columns that have no order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return feed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def apply_changes(state: DataFrame, batch: DataFrame, key: str, order: list[str], deleted: str) -> DataFrame:
    """The state after a batch of rows; rows whose ``deleted`` column is true remove their key.

    A state that has the ``deleted`` column keeps such rows as tombstones, so an older row that comes late
    does not bring its key back; ``live`` leaves them out. A state without it forgets deletions.
    """
    cols = state.columns if deleted in state.columns else [*state.columns, deleted]
    both = state.withColumn(deleted, F.col(deleted) if deleted in state.columns else F.lit(False)).select(*cols).unionByName(batch.select(*cols))
    last = newest(both, key, order)
    return last.select(*cols) if deleted in state.columns else last.where(~F.col(deleted)).select(*state.columns)


def live(state: DataFrame, deleted: str) -> DataFrame:
    """The rows of a state with tombstones that are not deleted."""
    return state.where(~F.col(deleted)).drop(deleted)


def follow(stream: DataFrame, load: Callable[[], DataFrame | None], save: Callable[[DataFrame, int], None], key: str, order: list[str], deleted: str, checkpoint: str):
    """Start a query that applies each micro-batch to the state and saves the new snapshot.

    ``save`` gets the batch's number, so that a repeated batch can be recognised; ``load`` returns the
    last snapshot, or none. Snapshots hold tombstones: read them through ``live``. The query's own checkpoint makes it resume where it stopped.
    """

    def step(batch: DataFrame, number: int) -> None:
        state = load()
        if state is None:
            state = batch.limit(0)
        save(apply_changes(state, batch, key, order, deleted), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
