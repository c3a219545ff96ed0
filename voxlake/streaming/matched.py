"""Streams with event-time or processing-time state: messages of three topics matched by time, and batches by count or time-out."""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Microseconds of a bucket in which messages wait for their partners.
BUCKET = 60_000_000


def nearest_within(t: np.ndarray, other_t: np.ndarray, other_id: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """For each time the id of the other message nearest to it, at most ``slop`` away, and the gap; of equal gaps the smallest id. -1 is the gap of none."""
    order = np.lexsort((other_id, other_t))
    ot, oid = other_t[order], other_id[order]
    first = np.concatenate([[True], ot[1:] != ot[:-1]]) if len(ot) else np.zeros(0, bool)
    ot, oid = ot[first], oid[first]  # of equal times the smallest id
    found, gap = np.zeros(len(t), np.int64), np.full(len(t), -1)
    for side in (0, 1):
        at = np.searchsorted(ot, t, side="right") - 1 if side == 0 else np.searchsorted(ot, t, side="left")
        ok = (at >= 0) & (at < len(ot))
        i = np.flatnonzero(ok)
        g = np.abs(ot[at[i]] - t[i])
        better = (g <= slop) & ((gap[i] < 0) | (g < gap[i]) | ((g == gap[i]) & (oid[at[i]] < found[i])))
        i, g = i[better], g[better]
        found[i], gap[i] = oid[at[i]], g
    return found, gap


class Matching(StatefulProcessor):
    """Messages of a bucket of time wait until the watermark has passed all that they could match; then each leading message gets its partners, and the state goes."""

    def __init__(self, slop: int, bucket: int):
        self.slop, self.bucket = slop, bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = [handle.getListState(f"topic{n}", "id long, t long") for n in range(3)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for n, part in pdf.groupby("topic"):
                self.held[n].appendList([(int(i), int(t)) for i, t in zip(part["id"], part["t"], strict=True)])
        due = ((key[-1] + 1) * self.bucket + self.slop) // 1000 + 1
        if due not in set(self.handle.listTimers()):
            self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids, times = zip(*(np.array([*state.get()] or np.zeros((0, 2)), np.int64).reshape(-1, 2).T for state in self.held), strict=True)
        for state in self.held:
            state.clear()
        one, gap1 = nearest_within(times[0], times[1], ids[1], self.slop)
        two, gap2 = nearest_within(times[0], times[2], ids[2], self.slop)
        both = (gap1 >= 0) & (gap2 >= 0)
        yield pd.DataFrame({"source": key[0], "id": ids[0][both], "t": times[0][both], "first_id": one[both], "second_id": two[both], "gap": (gap1 + gap2)[both]})

    def close(self) -> None:
        pass


def in_threes(messages: DataFrame, slop: int, late: str = "1 minute", bucket: int = BUCKET) -> DataFrame:
    """(source, id, t, first_id, second_id, gap): one match for each message of topic 0 that has one of topic 1 and one of topic 2 within ``slop`` microseconds.

    ``messages``: source, topic (0, 1, 2), id, ts. Of several the nearest are taken, so that the gaps add up to the least; of equal gaps those with the smallest ids. Sources don't mix. A
    partner may serve several. Messages are dealt by source and bucket of time, partners near a border to both sides, so state is bounded by what falls into ``late`` and a bucket. A
    match comes out when the watermark is past its bucket; messages that are ``late`` behind it, or with a null, are dropped. Rows of another or no topic move the watermark
    only: beats that a source sends while it has no messages.
    """
    micros = F.unix_micros("ts")
    m = messages.select("source", F.col("topic").cast("int").alias("topic"), F.col("id").cast("long").alias("id"), "ts", micros.alias("t")).withWatermark("ts", late)
    own = F.floor(F.col("t") / bucket)
    near = F.array_distinct(F.array(F.floor((F.col("t") - slop) / bucket), own, F.floor((F.col("t") + slop) / bucket)))
    is_message = F.col("topic").isin(0, 1, 2) & F.col("source").isNotNull() & F.col("id").isNotNull() & F.col("t").isNotNull()
    # beats end here, behind the watermark: an explode is not moved before it, as a filter would be
    dealt = m.withColumn("bucket", F.explode(F.when(is_message & (F.col("topic") == 0), F.array(own)).when(is_message, near)))
    schema = f"source {messages.schema['source'].dataType.simpleString()}, id long, t long, first_id long, second_id long, gap long"
    return dealt.groupBy("source", "bucket").transformWithStateInPandas(Matching(slop, bucket), schema, "Append", "EventTime")


class Batches(StatefulProcessor):
    """Rows of a source wait until there are ``count`` of them, or until ``timeout_ms`` after the last that went or the first that came."""

    def __init__(self, count: int, timeout_ms: int):
        self.count, self.timeout_ms = count, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long")
        self.number = handle.getValueState("number", "n long")

    def _rest(self) -> list[int]:
        return [r[0] for r in self.waiting.get()]

    def _out(self, key, ids: list[int], number: int) -> pd.DataFrame:
        return pd.DataFrame({"source": key[0], "number": number, "place": range(len(ids)), "id": ids}).astype({"number": "int64", "place": "int32", "id": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._rest()
        number = self.number.get()[0] if self.number.exists() else 0
        went = False
        for pdf in rows:
            held += pdf["id"].tolist()
            while len(held) >= self.count:
                yield self._out(key, held[: self.count], number)
                held, number, went = held[self.count :], number + 1, True
        self.number.update((number,))
        self.waiting.clear()
        timers = [*self.handle.listTimers()]
        if went or not held:
            for t in timers:
                self.handle.deleteTimer(t)
            timers = []
        if held:
            self.waiting.put([(i,) for i in held])
            if not timers:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids = self._rest()
        if ids:
            number = self.number.get()[0]
            self.waiting.clear()
            self.number.update((number + 1,))
            yield self._out(key, ids, number)

    def close(self) -> None:
        pass


def by_count_or_timeout(frames: DataFrame, count: int = 4, timeout_ms: int = 250) -> DataFrame:
    """(source, number, place, id): rows of ``frames`` (source, id) in batches of ``count``, numbered by source; a batch that isn't full goes ``timeout_ms`` after it began to wait.

    Rows keep the order in which they come. State is less than a batch for each source. Rows with a null are dropped.
    """
    kind = frames.schema["source"].dataType.simpleString()
    rows = frames.select("source", F.col("id").cast("long").alias("id")).dropna()
    return rows.groupBy("source").transformWithStateInPandas(Batches(count, timeout_ms), f"source {kind}, number long, place int, id long", "Append", "ProcessingTime")


def settle(query: StreamingQuery, timeout_ms: int) -> None:
    """Stop a stream with time-outs once a batch without rows has ended that began after the last rows' time-out. (Such streams run batches without end.)"""
    due = time.time()
    while query.isActive:
        p = query.lastProgress
        if p and p["numInputRows"]:
            due = time.time() + timeout_ms / 1000
        elif p and datetime.fromisoformat(p["timestamp"]).timestamp() > due:
            query.stop()
        time.sleep(0.05)
    if query.exception():
        raise query.exception()
