"""Streams of catalog events: latest decisions, a protected merge, and windowed counts with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..sources import catalog

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def latest(events: DataFrame, key: str = "user_id", at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last event of each key, as one aggregation (partial on the map side, so a hot key costs no task)."""
    rest = [c for c in events.columns if c != key]
    row = F.max_by(F.struct(*rest), F.struct(at, tie))
    return events.groupBy(key).agg(row.alias("row_")).select(key, *(F.col(f"row_.{c}").alias(c) for c in rest))


def protected_merge(state: DataFrame, updates: DataFrame, key: str = "path", status: str = "review_status") -> DataFrame:
    """updates over state, except where the state is confirmed by a human and the update isn't."""
    mine = updates.select(key, *(F.col(c).alias(f"new_{c}") for c in updates.columns if c != key), F.lit(True).alias("found_"))
    both = state.withColumn("known_", F.lit(True)).join(mine, key, "full_outer")
    take = F.col("found_") & (F.col("known_").isNull() | (F.coalesce(F.col(status), F.lit("")) != V.CONFIRMED) | (F.coalesce(F.col(f"new_{status}"), F.lit("")) == V.CONFIRMED))
    return both.select(key, *(F.when(F.coalesce(take, F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in updates.columns else F.col(c) for c in state.columns if c != key))


def merge_stream(updates: DataFrame, table: str, checkpoint: str, key: str = "path", every: str | None = None):
    """Upserts each micro-batch into a catalog table, once for what there is or every so often; within a batch the last row of a key counts (column ``seq``)."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in (key, "seq")]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("row_")).select(key, *(F.col(f"row_.{c}").alias(c) for c in rest))
        spark = batch.sparkSession
        while True:
            seen = catalog.current(spark, table)
            new = last
            if seen is not None:
                known = catalog.load(spark, table, seen).select(*last.columns).join(last.select(key), key, "left_semi")  # only rows that the batch touches are written
                new = protected_merge(known, last, key)
            if catalog.save(spark, new, table, after=seen) is not None:
                return  # else someone has committed since: a decision of theirs must be seen before it is written over

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def _marked(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark, which needs a time with zone; a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value by window and type; works on a stream (with a watermark) and on a table."""
    own = _marked(events, late)
    return own.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by overlapping windows and type; on a stream and on a table."""
    own = _marked(events, late)
    return own.groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    own = _marked(events, late)
    return own.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def progress(events: DataFrame, done: Column) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("done"))
