"""The job state machine over a stream of events: the same transitions as operators.ledger, kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import STATE, Job
from .leases import leased_status_stream, with_timers


def job_status_stream(events: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("ts", "seq"), max_attempts: int = 5, negative_limit: int = 3, lease_seconds: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """events (key, ts, action and what fold_events reads) as an update stream of each job's state.

    Events of a batch are taken in order; what comes in a later batch comes later. With lease_seconds, a running job without an event
    for so long fails as interrupted (leases). Only jobs' few numbers are kept as state."""
    if lease_seconds is not None:
        return leased_status_stream(events, lease_seconds, delay, key, order, max_attempts, negative_limit)
    have = set(events.columns)
    fill = {"failure_class": "string", "negative": "boolean", "type": "string"}
    rows = events.select(key, *order, "action", *(F.col(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in fill.items()))
    kind = dict(rows.dtypes)[key]

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = Job(*state.get) if state.exists else Job()
        batch = pd.concat(list(parts)).sort_values(list(order), kind="stable")
        for action, failure, negative, type_ in zip(batch["action"], batch["failure_class"], batch["negative"], batch["type"]):
            none = lambda x: None if pd.isna(x) else x
            job.apply(none(action), none(failure), bool(none(negative)), none(type_), max_attempts, negative_limit)
        row = (job.status, job.attempts, job.runtime_attempts, job.negative_attempts, job.ignored)
        state.update(row)
        yield pd.DataFrame([(*name, *row)], columns=[key, "status", "attempts", "runtime_attempts", "negative_attempts", "ignored"])

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def first_receipts(receipts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Receipts (job_id, attempt, payload, received_at) of a stream, the first of each identical group within delay; what differs passes on."""
    return receipts.withColumn("identity", F.sha2("payload", 256)).withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["job_id", "attempt", "identity"])


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "update") -> None:
    """Runs a stream over what is there into an in-memory table; for tests and small reports."""
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, key: str = "job_id") -> None:
    """Writes each batch's states as a folder of its own; doing a batch again replaces its folder, so readers count each once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    with_timers(stream.sparkSession)
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_states(rows: DataFrame, key: str = "job_id") -> DataFrame:
    """The last state of each job among the batches written by upsert_latest."""
    from ..operators.ranking import latest

    return latest(rows, [key], ["batch"])
