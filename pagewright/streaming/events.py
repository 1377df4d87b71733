"""The event log of jobs: replay, ring buffer, latest state per key, time to live. Batch and stream share the expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RING, LOGS, TTL_HOURS = 900, 400, 24


def replay(events: DataFrame, after: int, most: int | None = None, order: str = "event_id") -> DataFrame:
    """Events that a late subscriber has not seen, in order."""
    rows = events.where(F.col(order) > after).orderBy(order)
    return rows if most is None else rows.limit(most)


def ring(events: DataFrame, keys: list[str], order: str, most: int = RING) -> DataFrame:
    """The last ``most`` events of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return events.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def numbered(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Events with ``event_id``, from 1 in each job."""
    return events.withColumn("event_id", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def resumed(events: DataFrame, results: DataFrame, keys: list[str], after: int) -> DataFrame:
    """What a subscriber gets who comes back: the events after the last it saw, and of ended jobs (keys, result) the result as ``reopen``."""
    missed = replay(events, after).select(*keys, "event_id", "kind", F.lit(None).cast("string").alias("result"))
    ended = results.select(*keys, F.lit(None).cast("long").alias("event_id"), F.lit("reopen").alias("kind"), "result")
    return missed.unionByName(ended)


def latest(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key, as a struct maximum that combines before the shuffle."""
    others = [c for c in events.columns if c not in keys and c != order]
    return events.groupBy(*keys).agg(F.max_by(F.struct(order, *others), order).alias("r")).select(*keys, "r.*")


def alive(rows: DataFrame, at: str, hours: int = TTL_HOURS, now: DataFrame | None = None) -> DataFrame:
    """Rows younger than their time to live, against the clock or a one-row table ``now``."""
    age = F.expr(f"INTERVAL {hours} HOURS")
    if now is None:
        return rows.where(F.col(at) > F.current_timestamp() - age)
    return rows.join(F.broadcast(now.select(F.col("now").alias("_now"))), F.col(at) > F.col("_now") - age).drop("_now")


def upsert_into(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps the newest row per key as versions of a table.

    Each batch writes a new version from the one before it, so that a batch that is run again gives the same version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id > 0:
            rows = spark.read.parquet(f"{path}/version={batch_id - 1}").unionByName(batch)
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return write


def upsert_stream(events: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    return (
        events.writeStream.foreachBatch(upsert_into(path, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def deduplicated(events: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Events of a stream without repeats of a key inside the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
