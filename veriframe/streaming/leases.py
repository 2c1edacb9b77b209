"""Leases on a stream of job events: keyed state with event-time timers.

A running job whose last event is lease_seconds old has lost its lease: it fails as interrupted at that moment, be it seen because a later event of
the job comes or because the watermark passes. What happens depends on the events' own times alone, not on how they are cut into batches, as long
as a job's events come in order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import STATE, Job

#: Timers and typed state need this store.
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COUNTS = ("status", "attempts", "runtime_attempts", "negative_attempts", "ignored")


class LeasedJobs(StatefulProcessor):
    """One job's state: its few numbers and the time of its last event in milliseconds."""

    def __init__(self, key: str, order: tuple[str, ...], lease_seconds: int, max_attempts: int, negative_limit: int):
        self.key, self.order, self.lease = key, order, 1000 * lease_seconds
        self.limits = max_attempts, negative_limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", f"{STATE}, last long")

    def _read(self) -> tuple[Job, int | None]:
        if not self.state.exists():
            return Job(), None
        *own, last = self.state.get()
        return Job(*own), last

    def _expire(self, job: Job) -> None:
        if job.status == "running":
            job.apply("fail", "interrupted", False, None, *self.limits)

    def _write(self, key: tuple, job: Job, last: int) -> Iterator[Row]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job.status == "running":
            self.handle.registerTimer(last + self.lease)
        own = tuple(getattr(job, c) for c in _COUNTS)
        self.state.update((*own, last))
        yield Row(**dict(zip((self.key, *_COUNTS), (key[0], *own))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        job, last = self._read()
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            moment = row["ms__"]
            if last is not None and moment >= last + self.lease:
                self._expire(job)
            job.apply(row["action"], row["failure_class"], bool(row["negative"]), row["type"], *self.limits)
            last = moment if last is None else max(last, moment)
        yield from self._write(key, job, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        job, last = self._read()
        if last is not None and job.status == "running" and expiredTimerInfo.getExpiryTimeInMs() >= last + self.lease:
            self._expire(job)
            yield from self._write(key, job, last)

    def close(self) -> None:
        pass


def leased_status_stream(events: DataFrame, lease_seconds: int = 900, delay: str = "10 minutes", key: str = "job_id", order: tuple[str, ...] = ("ts", "seq"), max_attempts: int = 5, negative_limit: int = 3) -> DataFrame:
    """events (key, ts, action and what fold_events reads; order's columns aren't null) as an update stream of each job's state with leases. Events
    older than the watermark (delay behind the newest ts) still count, in the order of their coming."""
    have = set(events.columns)
    fill = {"failure_class": "string", "negative": "boolean", "type": "string"}
    rows = events.select(*dict.fromkeys((key, "ts", *order)), F.unix_millis("ts").alias("ms__"), "action", *(F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in fill.items())).withWatermark("ts", delay)
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).transformWithState(LeasedJobs(key, order, lease_seconds, max_attempts, negative_limit), f"{key} {kind}, {STATE}", "Update", "EventTime")


def with_timers(spark: SparkSession) -> None:
    """Sets the state store that timers need, where the session names none of its own."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, _PROVIDER)
