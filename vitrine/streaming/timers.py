"""Keyed state that ends: flags and leases cleared by event-time timers, stored results that live for a while.

Unlike the machines of ``vitrine.streaming.state``, which remember every key for good, these hold a key only as
long as it matters, so state does not grow with the keys ever seen. They need the RocksDB state store, which
:func:`worked_through` sets for the query it starts. Event time is in seconds, 0 or more; rows of a key are worked through in its order
within a batch. A row that comes later than ``delay`` behind the newest one is dropped by the watermark.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitrine.streaming import intake

@contextmanager
def rocks_db(spark: SparkSession, timers: bool = True) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; others of the session are not changed.

    Without ``timers`` no batch runs that has no rows: by the clock there would always be another one.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": str(timers).lower()}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def worked_through(stream: DataFrame, name: str, folder: str | None = None, timers: bool = True) -> DataFrame:
    """All that is there now, as :func:`vitrine.streaming.intake.available_now` in append mode; machines that go by the clock have no ``timers``."""
    with rocks_db(stream.sparkSession, timers):
        return intake.available_now(stream, name, "append", folder)


def _ms(at: int) -> int:
    """A time in milliseconds as timers take it, a second on: a stream's watermark begins at 0, and rows of that time would be late."""
    return (at + 1) * 1000


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_seconds(F.col("at") + 1)).withWatermark("event_time", delay)


class _Flag(StatefulProcessor):
    """A request raises a flag that refuses others until it runs out; a timer takes it down."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        known = self.until.get()
        before = until = known[0] if known else None
        for at in sorted(r["at"] for r in rows):
            if until is None or at >= until:
                until = at + self.seconds
                yield Row(key=key[0], at=at)
        if until != before:  # each call on the state is a round trip: the last flag alone is written, not every one of the batch
            if before is not None:
                self.handle.deleteTimer(_ms(before))
            self.handle.registerTimer(_ms(until))
            self.until.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        known = self.until.get()
        if known and _ms(known[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def requests_once(requests: DataFrame, minutes: int = 12, delay: str = "0 seconds") -> DataFrame:
    """(key, at): of requests (key, at) those let through, one in ``minutes``; the flag of a key is gone once the watermark has passed its end."""
    rows = _timed(requests.select("key", "at"), delay)
    return rows.groupBy("key").transformWithState(_Flag(minutes * 60), "key string, at long", "append", "EventTime")


class _Once(StatefulProcessor):
    """The first operation of a key runs; those that come while its result is kept get the result."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.result = handle.getValueState("result", "id long, result string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.result.get() if self.result.exists() else None
        for r in sorted(rows, key=lambda r: r["id"]):
            repeated = known is not None
            if not repeated:
                known = (r["id"], r["result"])
                self.result.update(known)
            yield Row(idempotency_key=key[0], id=known[0], result=known[1], repeated=repeated)

    def close(self) -> None:
        pass


def executed_once(operations: DataFrame, keep_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """(idempotency_key, id, result, repeated) as :func:`vitrine.streaming.state.executed_once`, but a result is kept for ``keep_ms`` from when it was stored, by the clock."""
    return operations.select("idempotency_key", "id", "result").groupBy("idempotency_key").transformWithState(
        _Once(keep_ms), "idempotency_key string, id long, result string, repeated boolean", "append", "ProcessingTime")


class _Lease(StatefulProcessor):
    """One job of a key at a time: others wait in line, and a timer at the end of a lease sends the next."""

    def __init__(self, expires: int) -> None:
        self.expires = expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")
        self.line = handle.getListState("line", "id long, at long, seconds long")

    def _granted(self, key, job, at: int) -> Row:
        self.end = at + min(job[2], self.expires)
        return Row(key=key[0], id=job[0], asked_at=job[1], granted_at=at, released_at=self.end, busy=at > job[1])

    def _open(self) -> tuple[deque, int | None]:
        self.end = self.until.get()[0] if self.until.exists() else None
        return deque(tuple(x) for x in self.line.get()), self.end

    def _close(self, line: deque, held: int, before: int | None) -> None:
        """Write the state back: the line only if it changed, the timer only if the lease did."""
        if line:
            self.line.put(list(line))
        elif held:
            self.line.clear()
        if self.end != before:
            if before is not None:
                self.handle.deleteTimer(_ms(before))
            if self.end is None:
                self.until.clear()
            else:
                self.until.update((self.end,))
                self.handle.registerTimer(_ms(self.end))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        line, before = self._open()
        held = len(line)
        for at, id_, seconds in sorted((r["at"], r["id"], r["seconds"]) for r in rows):
            while line and self.end <= at:
                yield self._granted(key, line.popleft(), self.end)
            job = (id_, at, seconds)
            if self.end is None or self.end <= at:
                yield self._granted(key, job, at)
            else:
                line.append(job)
        self._close(line, held, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        line, before = self._open()
        held, now = len(line), timerValues.getCurrentWatermarkInMs() // 1000 - 1
        while line and self.end <= now:
            yield self._granted(key, line.popleft(), self.end)
        if self.end is not None and self.end <= now:
            self.end = None
        self._close(line, held, before)

    def close(self) -> None:
        pass


def leases(jobs: DataFrame, expires: int = 600, delay: str = "0 seconds") -> DataFrame:
    """(key, id, asked_at, granted_at, released_at, busy) of jobs (key, id, at, seconds), one of a key at a time, in order of ``at`` and id.

    A job takes ``seconds``, or loses its lease after ``expires``. One that finds its key busy waits in line and is sent when the lease
    before it ends: as soon as a later row of the key shows that time has passed, or else when the watermark does. Jobs still in line
    are in the state, not in the result.
    """
    rows = _timed(jobs.select("key", "id", "at", "seconds"), delay)
    return rows.groupBy("key").transformWithState(
        _Lease(expires), "key string, id long, asked_at long, granted_at long, released_at long, busy boolean", "append", "EventTime")
