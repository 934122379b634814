"""A writer that gathers single operations into batches: a bound on their number, a timer from the first of them, and the last write of a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Operations of a batch at most, and milliseconds that the first of them waits.
MOST, WINDOW = 64, 10
OUT = "lane int, batch long, ops int, key string, at long, payload string"


class Batches(StatefulProcessor):
    """Holds a lane's operations until there are ``most`` of them or the first has waited ``window`` milliseconds."""

    def __init__(self, most: int, window: int):
        self.most, self.window = most, window

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "key string", "at long, payload string")
        self.counts = handle.getValueState("counts", "ops int, batch long, timer long")

    def held(self) -> tuple[int, int, int]:
        return tuple(self.counts.get()) if self.counts.exists() else (0, 0, 0)

    def written(self, lane: int, ops: int, batch: int) -> pd.DataFrame:
        rows = [(lane, batch, ops, k[0], v[0], v[1]) for k, v in self.pending.iterator()]
        self.pending.clear()
        return pd.DataFrame(sorted(rows, key=lambda r: r[3]), columns=["lane", "batch", "ops", "key", "at", "payload"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ops, batch, timer = self.held()
        frame = pd.concat(list(rows)).sort_values(["at", "key"], kind="stable")
        for k, at, payload in frame[["key", "at", "payload"]].itertuples(index=False):
            if not ops:
                timer = timerValues.getCurrentProcessingTimeInMs() + self.window
                self.handle.registerTimer(timer)
            have = self.pending.getValue((k,)) if self.pending.containsKey((k,)) else None
            if have is None or have[0] <= at:
                self.pending.updateValue((k,), (int(at), payload))
            ops += 1
            if ops == self.most:
                self.handle.deleteTimer(timer)
                yield self.written(key[0], ops, batch)
                ops, batch, timer = 0, batch + 1, 0
        self.counts.update((ops, batch, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ops, batch, timer = self.held()
        if ops and expiredTimerInfo.getExpiryTimeInMs() == timer:
            yield self.written(key[0], ops, batch)
            self.counts.update((0, batch + 1, 0))

    def close(self) -> None:
        pass


def coalesced(changes: DataFrame, lanes: int = 32, most: int = MOST, window: int = WINDOW) -> DataFrame:
    """lane, batch, ops, key, at and payload of the last write of each key in a batch, from a stream of operations (key, at, payload).

    Keys are dealt to ``lanes`` by hash, as the original has a queue for each store; a lane is one task's work. A lane's
    micro-batch is held by its task, so bound what a trigger reads. State survives restarts; what a stopped stream still
    holds comes with its next start. Timers follow the clock, so a micro-batch that is repeated may cut its batches
    elsewhere: write them by key and order (``tables.apply`` without a batch's number), which repeats can't harm.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    dealt = changes.select(F.pmod(F.xxhash64("key"), F.lit(lanes)).cast("int").alias("lane"), F.col("key").cast("string").alias("key"), F.col("at").cast("long").alias("at"), F.col("payload").cast("string").alias("payload"))
    return dealt.groupBy("lane").transformWithStateInPandas(Batches(most, window), OUT, "append", "processingTime")
