"""Human decisions as keyed state of a stream: what a human has confirmed outranks every later suggestion.

State of a key: the decision that stands (a value) and the ids of events seen (a
list, read once a key and micro-batch, so that a repeated event counts once). A human's event replaces whatever stands, unless a
later human's event is there; any other event replaces only what no human has said.
"Later" is by event time, then event id, so the result doesn't depend on how events
are cut into micro-batches. A timer evicts the ids, and keys without a human's decision, once the watermark is
``keep`` past their last event; a human's decision stays.

Needs the RocksDB state store (``with_state_store`` sets it for the session that starts the stream).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Events of a key that are held while the ids seen are read.
HELD = 100_000

EVENT = "key string, at timestamp, event_id long, human boolean, status string, note string"
STANDS = "human boolean, at_us long, event_id long, status string, note string, n_events long, last_us long"
OUTPUT = "key string, human boolean, at timestamp, event_id long, status string, note string, n_events long"


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Protection(StatefulProcessor):
    """Emits the decision that stands for each key that a micro-batch touches."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stands = handle.getValueState("stands", STANDS)
        self.seen = handle.getListState("seen", "event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.stands.get()
        count, best, last, changed = (now[5] if now else 0), (tuple(now[:5]) if now else None), (now[6] if now else None), False
        for events in self._unique(rows):
            if now or changed:
                for (event,) in self.seen.get():
                    events.pop(event, None)
            if not events:
                continue
            self.seen.appendList([(event,) for event in events])
            newest = max(own[1] for own in events.values())
            if last is None:  # a key has one timer, which moves on when it fires, so that no event has to ask for timers
                self.handle.registerTimer(newest // 1000 + self.keep_ms)
            count, changed, last = count + len(events), True, newest if last is None else max(last, newest)
            for own in events.values():
                if best is None or own[:3] > tuple(best[:3]):
                    best = own
        if not changed:
            return
        self.stands.update((*best, count, last))
        yield self._row(key[0], best, count)

    @staticmethod
    def _unique(rows: Iterator[pd.DataFrame]) -> Iterator[dict[int, tuple]]:
        """Events by id, HELD of them or so at once. Each question to the state is a round trip, so ids seen are read once for all of these."""
        held: dict[int, tuple] = {}
        for batch in rows:
            times = batch["at"].to_numpy().astype("datetime64[us]").astype("int64")
            for at, event, human, status, note in zip(times.tolist(), batch["event_id"].tolist(), batch["human"].tolist(), batch["status"].tolist(), batch["note"].tolist()):
                held.setdefault(event, (bool(human), at, event, status, note))
            if len(held) >= HELD:
                yield held
                held = {}
        if held:
            yield held

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.stands.get()
        until = now[6] // 1000 + self.keep_ms if now and now[6] is not None else 0
        if until > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(until)
            return iter([])
        self.seen.clear()
        if now and now[0]:
            self.stands.update((*now[:6], None))
        else:
            self.stands.clear()
        return iter([])

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, best, count) -> pd.DataFrame:
        return pd.DataFrame({"key": [key], "human": [best[0]], "at": [pd.Timestamp(best[1], unit="us")], "event_id": [best[2]], "status": [best[3]], "note": [best[4]], "n_events": [count]})


def decided(events: DataFrame, late: str = "7 days", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """The decisions that stand after each micro-batch, of the keys it touches (EVENT in, OUTPUT out; update mode)."""
    own = events.withWatermark("at", late)
    return own.groupBy("key").transformWithStateInPandas(Protection(keep_ms), OUTPUT, "Update", "EventTime")


def run(events: DataFrame, folder: str, checkpoint: str, late: str = "7 days", keep_ms: int = 30 * 86_400_000) -> None:
    """Runs the stream over all there is. A micro-batch writes one folder named by its number, so a batch that is run again after a failure replaces what it had written."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/batch={number:012d}")

    spark = events.sparkSession
    with with_state_store(spark):
        query = decided(events, late, keep_ms).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def standing(spark: SparkSession, folder: str) -> DataFrame:
    """The decision of each key after all micro-batches."""
    rows = spark.read.option("recursiveFileLookup", True).schema(f"{OUTPUT}, batch long").parquet(folder)
    row = F.max_by(F.struct("human", "at", "event_id", "status", "note", "n_events"), "batch")
    return rows.groupBy("key").agg(row.alias("r")).select("key", "r.*")


def rule(events: DataFrame) -> DataFrame:
    """The same of a table (EVENT), as one aggregation."""
    order: Column = F.struct("human", "at", "event_id")
    once = events.dropDuplicates(["key", "event_id"])
    row = F.max_by(F.struct("human", "at", "event_id", "status", "note"), order)
    return once.groupBy("key").agg(row.alias("r"), F.count(F.lit(1)).alias("n_events")).select("key", "r.*", "n_events")
