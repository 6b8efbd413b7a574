"""The queue of recordings as keyed state: what waits, what is out, what is sent again; nothing is lost over restarts.

A queue's state lives in the state store of the stream (RocksDB), so that a restart from the checkpoint goes on where the
last committed batch ended. Time is event time: the watermark tells how late it is, so that a replay decides alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACTIONS = "queue string, shard int, recording string, action string, attempt int, at timestamp"
#: Order of events that share a time: slots become free before they are given away.
RANK = {"done": 0, "received": 1, "item": 2}


def use_store(spark: SparkSession) -> None:
    """Keep streams' state in RocksDB, which keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Queue(StatefulProcessor):
    """One shard of a queue. Its waiting items are numbered, so that taking the oldest one touches one entry."""

    def __init__(self, throttle: int, wait_ms: int, retries: int):
        self.throttle, self.wait_ms, self.retries = throttle, wait_ms, retries

    def init(self, handle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "head long, tail long, clock long")
        self.waiting = handle.getMapState("waiting", "number long", "recording string")
        self.out = handle.getMapState("out", "recording string", "updated long, attempt int, received boolean")

    def _counters(self) -> list[int]:
        return list(self.counters.get()) if self.counters.exists() else [0, 0, 0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head, tail, clock = self._counters()
        events = pd.concat(list(rows))
        clock = max(clock, int(events.ts.max().timestamp() * 1000))
        events = events[events.event.isin(list(RANK)) & events.recording.notna()]
        events = events.assign(ms=events.ts.astype("datetime64[ms]").astype("int64"), rank=events.event.map(RANK)).sort_values(["ms", "rank", "recording"])
        for event, recording, ms in zip(events.event, events.recording, events.ms.tolist()):
            if event == "item":
                self.waiting.updateValue((tail,), (recording,))
                tail += 1
            elif self.out.containsKey((recording,)):
                if event == "done":
                    self.out.removeKey((recording,))
                else:
                    self.out.updateValue((recording,), (ms, self.out.getValue((recording,))[1], True))
        self.counters.update((head, tail, clock))
        yield self._pass(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._pass(key, timerValues)

    def _pass(self, key, timerValues) -> pd.DataFrame:
        """At most one item is sent again; then as many waiting ones go out as there is room for."""
        head, tail, clock = self._counters()
        now = timerValues.getCurrentWatermarkInMs()
        held = {k[0]: tuple(v) for k, v in self.out.iterator()}
        actions = []
        for recording, (updated, attempt, _) in sorted(held.items(), key=lambda x: (x[1][0], x[0])):
            if updated + self.wait_ms > now:
                break
            if attempt > self.retries:
                self.out.removeKey((recording,))
                del held[recording]
                actions.append((recording, "give_up", attempt))
                continue
            held[recording] = (max(now, clock), attempt + 1, False)
            self.out.updateValue((recording,), held[recording])
            actions.append((recording, "retry", attempt + 1))
            break
        while len(held) < self.throttle and head < tail:
            (recording,) = self.waiting.getValue((head,))
            self.waiting.removeKey((head,))
            head += 1
            if recording in held:  # sent twice: it is out already
                continue
            held[recording] = (clock, 1, False)
            self.out.updateValue((recording,), held[recording])
            actions.append((recording, "send", 1))
        self.counters.update((head, tail, clock))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if held:
            self.handle.registerTimer(max(now + 1, min(v[0] for v in held.values()) + self.wait_ms))
        at = pd.Timestamp(max(now, clock), unit="ms")
        names = [c.split()[0] for c in ACTIONS.split(", ")]
        return pd.DataFrame([(key[0], key[1], *a, at) for a in actions], columns=names).astype({"shard": "int32", "attempt": "int32", "at": "datetime64[us]"})


def admissions(events: DataFrame, *, throttle: int = 25, retry_wait: str = "2 hours", retries: int = 1, lateness: str = "10 minutes", shards: int = 1) -> DataFrame:
    """What to do with the recordings of a queue, as a stream: (queue, shard, recording, action, attempt, at).

    events: a stream of (queue, recording, event, ts). event: item (a recording to work on), received (its job has begun),
    done (it has ended). An item waits until fewer than `throttle` recordings of its queue are out, then action send tells to
    dispatch it; it is out until it is done. Items go in the order of arrival, those of one batch by (ts, recording).

    A recording that was neither received nor done for longer than retry_wait is sent once more (action retry, attempt 2,
    3, ...), at most one in each pass over the queue; after so many retries it is given up (action give_up) and its slot is free. An item
    for a recording that is out changes nothing. Every action comes out once, whatever batches the events come in; a restart from the checkpoint loses and
    repeats nothing.

    Null queues are a queue of their own; events of null recordings or times, or of other kinds, are left out. It is as late as the
    watermark tells (the latest event less lateness): where events may fall silent, union a stream of heartbeats for each
    queue (another event name moves the time on and is otherwise left out). One shard decides for its recordings alone: with
    `shards`, each has its share of the throttle (at least 1), so that large queues spread over tasks.
    """
    use_store(events.sparkSession)
    e = events.select("queue", F.pmod(F.xxhash64("recording"), F.lit(shards)).cast("int").alias("shard"), "recording", "event", F.col("ts").cast("timestamp").alias("ts"))
    # heartbeats are left out by the state's owner: a filter here would go below the watermark, which they have to move
    e = e.where("ts is not null").withWatermark("ts", lateness)
    wait = int(pd.Timedelta(retry_wait).total_seconds() * 1000)
    return e.groupBy("queue", "shard").transformWithStateInPandas(_Queue(max(1, throttle // shards), wait, retries), ACTIONS, "Append", "EventTime")
