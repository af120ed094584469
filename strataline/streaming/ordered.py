"""Per-key decisions in event-time order, whatever the order in which rows arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Times of one key (seconds, sorted) and what is remembered of it -> a decision for each, what to remember, and when (seconds) that can be forgotten.
Fold = Callable[[list[float], list[float]], tuple[list[bool], list[float], float]]

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers and map states need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class InEventOrder(StatefulProcessor):
    """Rows wait in slots of ``grain`` seconds until the watermark has passed their slot, and are then decided in order.

    The state's key is a bucket of keys, so its cost follows the rows and not
    the keys. A bucket holds a list of row packets per slot, one per batch of
    rows that had some for it, so a packet is written once and nothing is read
    before its slot is due; a task holds one slot of one bucket. An event-time
    timer at the end of a slot decides it. Timers of a bucket fire in order of
    time. What a decision remembers of its key goes once all slots that it can
    reach are decided, so keys that fall silent leave no state.
    """

    def __init__(self, fold: Fold, grain: float):
        self.fold, self.grain = fold, max(1, round(grain * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "slot long, packet int", "keys binary, times binary, rows binary")
        self.packets = handle.getMapState("packets", "slot long", "n int")
        self.memory = handle.getValueState("memory", "keys binary, sizes binary, untils binary, times binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf[pdf["known"]]  # other rows only move the watermark
            keys, micros, ids = (pdf[c].to_numpy(np.int64) for c in ("key", "us", "row"))
            slots = micros // (self.grain * 1000)
            for slot in np.unique(slots).tolist():
                mine = slots == slot
                known = self.packets.getValue((slot,))
                n = known[0] if known else 0
                self.rows.updateValue((slot, n), (keys[mine].tobytes(), micros[mine].tobytes(), ids[mine].tobytes()))
                self.packets.updateValue((slot,), (n + 1,))
                if not n:
                    self.handle.registerTimer((slot + 1) * self.grain)
        return iter(())

    def remembered(self) -> dict[int, tuple[list[float], float]]:
        held = self.memory.get()
        if not held:
            return {}
        keys, sizes, untils, times = (np.frombuffer(b, t) for b, t in zip(held, (np.int64, np.int32, np.float64, np.float64)))
        ends, times = np.cumsum(sizes).tolist(), times.tolist()
        return {k: (times[end - n:end], until) for k, n, until, end in zip(keys.tolist(), sizes.tolist(), untils.tolist(), ends)}

    def remember(self, memory: dict[int, tuple[list[float], float]]) -> None:
        if memory:
            self.memory.update((np.array(list(memory), np.int64).tobytes(), np.array([len(t) for t, _ in memory.values()], np.int32).tobytes(),
                                np.array([u for _, u in memory.values()], np.float64).tobytes(), np.array([x for t, _ in memory.values() for x in t], np.float64).tobytes()))
        else:
            self.memory.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        slot = now // self.grain - 1
        waiting = self.packets.getValue((slot,)) if now % self.grain == 0 else None
        memory = self.remembered()
        if waiting:
            packets = []
            for n in range(waiting[0]):
                packets.append(self.rows.getValue((slot, n)))
                self.rows.removeKey((slot, n))
            self.packets.removeKey((slot,))
            keys, micros, ids = (np.concatenate([np.frombuffer(p[c], np.int64) for p in packets]) for c in range(3))
            by = np.lexsort((ids, micros, keys))
            keys, seconds = keys[by], (micros[by] / 1e6).tolist()
            starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)).tolist()
            decided = []
            for k, a, b in zip(keys[starts].tolist(), starts, [*starts[1:], len(keys)]):
                yes, times, until = self.fold(seconds[a:b], memory[k][0] if k in memory else [])
                decided += yes
                memory[k] = times, until
            yield pd.DataFrame({"key": keys, "row": ids[by], "decided": decided})
        # All slots that end by now are decided, so what ends before this one's end is outdated.
        end = now // self.grain * self.grain
        memory = {k: m for k, m in memory.items() if m[1] * 1000 >= end}
        self.remember(memory)
        if memory:
            self.handle.registerTimer((int(max(u for _, u in memory.values()) * 1000) // self.grain + 1) * self.grain + 1)


def decisions(events: DataFrame, key: str, row: str, ts: str, fold: Fold, name: str, delay: str, grain: float, buckets: int) -> DataFrame:
    """(key, row, ``name``) of every row of a stream that is not later than ``delay``, once the watermark has passed its slot of ``grain`` seconds.

    Rows of a key are decided by event time, then ``row``, so the result does
    not depend on how rows are spread over files and micro-batches. A null key
    is not decided, but its time counts for the watermark; rows with a null
    time or ``row`` are left out. Keys are dealt to ``buckets``, which must
    stay the same for a checkpoint; a task holds one bucket's rows of one slot.
    Start the stream inside :func:`rocksdb`.
    """
    s = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    k, r, us = F.col(key).cast("long"), F.col(row).cast("long"), F.unix_micros(ts)
    full = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    s = s.select(F.pmod(F.xxhash64(k), F.lit(buckets)).cast("long").alias("bucket"), full(k).alias("key"), full(r).alias("row"), ts, full(us).alias("us"),
                 (k.isNotNull() & r.isNotNull() & us.isNotNull()).alias("known"))
    out = s.groupBy("bucket").transformWithStateInPandas(InEventOrder(fold, grain), "key long, row long, decided boolean", "Append", "EventTime")
    return out.withColumnRenamed("decided", name)
