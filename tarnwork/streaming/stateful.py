"""Runs and queues with state of their own: what is due again by timers, and what a bounded queue lets in.

*Due runs.* Each run's last event, attempts and source are its state. While a run has failed in a way that may be tried
again, a timer of its own comes due at every interval and hands the run out; its next event takes the timer away. From
the runs that one batch hands out, as many as a tick may take are chosen, newest or oldest first, and given to a callback
that appends their events; the others come again with their next timer. Nothing is read twice to find them.

*Queues.* Each queue's depth (runs let in and not yet finished) and its runs are its state. A request is let in while there
is room; what a queue has seen is known. Requests of a batch are taken in the order of their times; finished runs first.

State lives in RocksDB in the checkpoint, so a stream that is started again goes on where it was.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import runs

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Requests that a queue holds at most.
QUEUE = 1000
#: Runs of a chunk of a queue's state, about.
TOGETHER = 32
RUN = "sequence bigint, state string, updated_at bigint, error_code string, source string, attempts bigint"
DUE = f"kind string, run_id string, {RUN}"
ADMISSION = "queue string, run_id string, at bigint, outcome string, depth bigint"


@contextmanager
def _rocks(spark: SparkSession):
    """A query takes the session's store when it starts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _plain(x):
    return None if x is None or x is pd.NaT or x != x else x


class _Run(StatefulProcessor):
    def __init__(self, every: int, manual: bool, most: int):
        self.every, self.manual, self.most = every, manual, most

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN)

    def _due(self, state: str, error: str | None, source: str | None, attempts: int) -> bool:
        again = error in runs.RETRYABLE or (self.manual and source == "manual" and error in runs.MANUAL_RETRYABLE)
        return state == "failed" and again and attempts < self.most

    def _row(self, kind: str, key, row: tuple) -> pd.DataFrame:
        return pd.DataFrame([(kind, key[0], *row)], columns=[x.split()[0] for x in DUE.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.run.get()) if self.run.exists() else (-1, "", 0, None, None, 0)
        for part in rows:
            last = (*last[:5], last[5] + int((part["state"] == "preparing").sum()))
            r = part.iloc[part["sequence"].to_numpy().argmax()]
            if r["sequence"] > last[0]:
                source = _plain(r["source"]) or last[4]
                last = (int(r["sequence"]), r["state"], int(r["updated_at"]), _plain(r["error_code"]), source, last[5])
            elif last[4] is None:
                last = (*last[:4], _plain(r["source"]), last[5])
        self.run.update(last)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self._due(last[1], last[3], last[4], last[5]):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every)
        yield self._row("state", key, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = tuple(self.run.get())
        if self._due(last[1], last[3], last[4], last[5]):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every)
            yield self._row("due", key, last)

    def close(self) -> None:
        pass


def reconcile(events: DataFrame, checkpoint: str, requeue: Callable[[DataFrame], None], batch: int, newest_first: bool = True, every: float = 300.0, manual: bool | None = None, most: int = runs.MAX_ATTEMPTS, tick: str = "1 second"):
    """Start handing due runs to requeue, a DataFrame of `batch` at most, ordered by their last event.

    events: a stream of run_id, sequence, state, updated_at (microseconds), error_code, source (each event's, or its run's
    first alone). every: seconds that a run waits, and between two times that it is handed out. manual: whether what only
    manual runs may try again is due; as newest_first, if not said. requeue may be called again with the same runs after a
    failure, so it should append by key (see ``sinks``)."""
    spark = events.sparkSession
    processor = _Run(int(every * 1000), newest_first if manual is None else manual, most)
    states = events.groupBy("run_id").transformWithStateInPandas(processor, DUE, "Update", "ProcessingTime")

    def hand(rows: DataFrame, number: int) -> None:
        due = rows.filter("kind = 'due'")
        order = [c.desc() if newest_first else c.asc() for c in (F.col("updated_at"), F.col("run_id"))]
        chosen = due.orderBy(*order).limit(batch)
        if not chosen.isEmpty():
            requeue(chosen)

    with _rocks(spark):
        return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=tick).foreachBatch(hand).start()


def _place(run: str, chunks: int) -> int:
    """A run's chunk; of twice as many, the same or that many further."""
    return zlib.crc32(run.encode()) % chunks


class _Queue(StatefulProcessor):
    """Runs are kept some together in chunks by their hash, so that a call to the state reads or writes a chunk; a queue that
    fills its chunks gets twice as many, each from one before. A queue's first batch reads none."""

    def __init__(self, room: int):
        self.room = room

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "depth bigint, seen bigint, chunks bigint")
        self.runs = handle.getMapState("runs", "chunk bigint", "run_ids array<string>, done array<boolean>")

    def _read(self, i: int) -> dict[str, bool]:
        got = self.runs.getValue((i,)) if self.runs.containsKey((i,)) else ((), ())
        return dict(zip(*got))

    def _write(self, i: int, chunk: dict[str, bool]) -> None:
        self.runs.updateValue((i,), (list(chunk), list(chunk.values())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        depth, seen, chunks = self.held.get() if self.held.exists() else (0, 0, 1)
        before, known, changed, out = seen, {}, set(), []
        for at, kind, run in sorted((r["at"], r["kind"], r["run_id"]) for r in rows):  # "finished" before "request"
            i = _place(run, chunks)
            if i not in known:
                known[i] = self._read(i) if before else {}
            chunk = known[i]
            if kind == "finished":
                if chunk.get(run, True):
                    continue
                chunk[run], depth, outcome = True, depth - 1, "finished"
                changed.add(i)
            elif depth >= self.room:
                outcome = "full"
            elif run in chunk:
                outcome = "known"
            else:
                chunk[run], depth, seen, outcome = False, depth + 1, seen + 1, "admitted"
                changed.add(i)
            out.append(Row(queue=key[0], run_id=run, at=int(at), outcome=outcome, depth=depth))
        more = chunks
        while seen > TOGETHER * more:
            more *= 2
        if more == chunks:
            for i in changed:
                self._write(i, known[i])
        else:
            for i in range(chunks):
                parts: dict[int, dict[str, bool]] = {i: {}}
                for run, done in (known[i] if i in known else self._read(i) if before else {}).items():
                    parts.setdefault(_place(run, more), {})[run] = done
                for j, part in parts.items():
                    self._write(j, part)
        self.held.update((depth, seen, more))
        yield from out

    def close(self) -> None:
        pass


def admitted(requests: DataFrame, room: int = QUEUE) -> DataFrame:
    """ADMISSION of a stream of queue, run_id, kind (request or finished) and at (microseconds): what becomes of each.

    One queue is one key, and a batch of it is taken in order by one task: bound a batch by the source's options. A full
    queue says so to every request; one that is let in again later is new, as it left no trace. Start it by start_admission."""
    return requests.groupBy("queue").transformWithState(_Queue(room), ADMISSION, "Append", "None")


def start_admission(requests: DataFrame, room: int, checkpoint: str, write: Callable[[DataFrame, int], None], **trigger):
    """Start it; write(rows, number) gets each batch's rows, and may get a batch again after a failure."""
    with _rocks(requests.sparkSession):
        return admitted(requests, room).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
