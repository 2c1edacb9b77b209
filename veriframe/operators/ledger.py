"""The job ledger as an append-only event log: state machine, leases, receipts, recovery."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RETRYABLE_FAILURES

STATE = "status string, attempts int, runtime_attempts int, negative_attempts int, ignored int"


@dataclass
class Job:
    """State of one job. An action that its state doesn't allow is counted in ignored and changes nothing.

    kind bug_validate spends failures of class execution, output and interrupted from a budget of its own, and a negative result is
    repeated until negative_limit of them are there."""

    status: str = "queued"
    attempts: int = 0
    runtime_attempts: int = 0
    negative_attempts: int = 0
    ignored: int = 0

    def apply(self, action: str, failure: str | None, negative: bool, kind: str | None, max_attempts: int, negative_limit: int) -> None:
        probe = kind == "bug_validate"
        if action == "start" and self.status == "queued":
            self.status, self.attempts = "running", self.attempts + 1
        elif action == "complete" and self.status == "running":
            if probe and negative:
                self.negative_attempts += 1
                self.status = "retryable" if self.negative_attempts < negative_limit else "succeeded"
            else:
                self.status = "succeeded"
        elif action == "fail" and self.status in ("queued", "running"):
            again = failure in RETRYABLE_FAILURES
            if probe and again:
                self.runtime_attempts += 1
                again = self.runtime_attempts < max_attempts
            else:
                again = again and self.attempts < max_attempts
            self.status = "retryable" if again else "failed"
        elif action == "retry" and self.status == "retryable":
            self.status = "queued"
        elif action is not None:
            self.ignored += 1


STATUSES = ("queued", "running", "retryable", "succeeded", "failed")
_ACTIONS = ("start", "complete", "fail", "retry", "other")
_COUNTERS = ("attempts", "runtime_attempts", "negative_attempts", "ignored")


class Transitions:
    """What events do to every state at once.

    A job's future depends on its status and on three counters only up to their limits, so there are few states: a run of events is a table
    of where each state ends and what its counters gain, runs are composed in order, and a run may be folded without those before it."""

    def __init__(self, max_attempts: int, negative_limit: int):
        self.limits = (max_attempts, max_attempts, negative_limit)
        self.sizes = (len(STATUSES), *(k + 1 for k in self.limits))
        self.n = math.prod(self.sizes)
        self.step: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def number(self, job: Job) -> int:
        counts = (job.attempts, job.runtime_attempts, job.negative_attempts)
        return int(np.ravel_multi_index((STATUSES.index(job.status), *(min(c, k) for c, k in zip(counts, self.limits))), self.sizes))

    def of(self, action: str, failure: str | None, negative: bool, kind: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Where an event takes each state, and what it adds to the counters."""
        event = (action if action in _ACTIONS else "other", failure in RETRYABLE_FAILURES, negative, kind == "bug_validate")
        if event not in self.step:
            to, gain = np.empty(self.n, np.int32), np.zeros((self.n, 4), np.int32)
            for k in range(self.n):
                status, *counts = (int(x) for x in np.unravel_index(k, self.sizes))
                job = Job(STATUSES[status], *counts, 0)
                job.apply(action, failure, negative, kind, self.limits[0], self.limits[2])
                to[k] = self.number(job)
                gain[k] = [getattr(job, c) - before for c, before in zip(_COUNTERS, (*counts, 0))]
            self.step[event] = to, gain
        return self.step[event]

    def none(self) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(self.n, dtype=np.int32), np.zeros((self.n, 4), np.int32)

    def then(self, run: tuple[np.ndarray, np.ndarray], event: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return event[0][run[0]], run[1] + event[1][run[0]]

    def applied(self, job: Job, run: tuple[np.ndarray, np.ndarray]) -> Job:
        k = self.number(job)
        status = STATUSES[int(np.unravel_index(int(run[0][k]), self.sizes)[0])]
        return Job(status, *(getattr(job, c) + int(g) for c, g in zip(_COUNTERS, run[1][k])))


def fold_events(events: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("ts", "seq"), max_attempts: int = 5, negative_limit: int = 3) -> DataFrame:
    """State of each job after its events (action; optionally failure_class, negative, type) in order.

    Events are sorted by job and order over ranges, so a job with very many lies in several. A range folds the jobs that begin in
    it; what its first job may have had before is unknown, so the range folds that one for all states (Transitions). Runs of a job
    are then put together in order, a row each."""
    have = set(events.columns)
    columns = {key: F.col(key), **{o: F.col(o) for o in order}, "action": F.col("action")}
    columns["failure_class"] = F.col("failure_class") if "failure_class" in have else F.lit(None).cast("string")
    columns["negative"] = F.coalesce(F.col("negative"), F.lit(False)) if "negative" in have else F.lit(False)
    columns["type"] = F.col("type") if "type" in have else F.lit(None).cast("string")
    rows = events.select(*(c.alias(n) for n, c in columns.items()))
    kind = dict(rows.dtypes)[key]
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    types = [pa.string(), *[pa.int32()] * 4]
    names = ("status", *_COUNTERS)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a job: its state, or for the range's first job the table of its run."""
        moves = Transitions(max_attempts, negative_limit)
        now, job, run, begun, part = None, Job(), moves.none(), False, None

        def row() -> tuple:
            if run is not None:
                return now, part, *(None,) * 5, run[0].astype("<i4").tobytes() + run[1].astype("<i4").tobytes()
            return now, part, *(getattr(job, n) for n in names), None

        def out(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            own = [pa.array([d[0] for d in done], schema.field(key).type), pa.array([d[1] for d in done], pa.int32())]
            rest = [pa.array([d[k + 2] for d in done], t) for k, t in enumerate([*types, pa.binary()])]
            return pa.RecordBatch.from_arrays([*own, *rest], names=[key, "p__", *names, "run__"])

        schema = None
        for batch in batches:
            schema, done = batch.schema, []
            for k, p, action, failure, negative, type_ in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, "p__", "action", "failure_class", "negative", "type"))):
                if not begun or k != now:
                    if begun:
                        done.append(row())
                        job, run = Job(), None
                    now, part, begun = k, p, True
                if run is None:
                    job.apply(action, failure, bool(negative), type_, max_attempts, negative_limit)
                elif action is not None:
                    run = moves.then(run, moves.of(action, failure, bool(negative), type_))
            if done:
                yield out(done, schema)
        if begun:
            yield out([row()], schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state of each job from its rows, in order of range."""
        moves = Transitions(max_attempts, negative_limit)
        now, job, begun = None, Job(), False

        def out(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], schema.field(key).type), *(pa.array([getattr(j, n) for _, j in done], t) for n, t in zip(names, types))], names=[key, *names])

        schema = None
        for batch in batches:
            schema, done = batch.schema, []
            for k, *state, run in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, *names, "run__"))):
                if not begun or k != now:
                    if begun:
                        done.append((now, job))
                    now, job, begun = k, Job(), True
                if run is None:
                    job = Job(*state)
                else:
                    flat = np.frombuffer(run, "<i4")
                    job = moves.applied(job, (flat[: moves.n], flat[moves.n :].reshape(-1, 4)))
            if done:
                yield out(done, schema)
        if begun:
            yield out([(now, job)], schema)

    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("p__", F.spark_partition_id())
    parts = placed.mapInArrow(chunks, f"{key} {kind}, p__ int, {STATE}, run__ binary")
    return parts.repartition(F.col(key)).sortWithinPartitions(key, "p__").mapInArrow(joined, f"{key} {kind}, {STATE}")


def expired_leases(leases: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease has expired: job_id, attempt; they go back to the queue and the attempt counts as expired."""
    return leases.where(F.col("expires_at") <= now).join(jobs.where("status = 'running'").select("job_id"), "job_id", "left_semi").select("job_id", "attempt")


def lease_expiry(started: Column, seconds: int = 900) -> Column:
    return started + F.make_dt_interval(secs=F.lit(seconds))


def accepted_receipts(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """receipts (job_id, attempt, input_hash, artifact_hash, payload): one row per job and attempt whose copies all agree; and
    the (job_id, attempt) that were sent with different contents."""
    identity = F.sha2(F.to_json(F.struct("input_hash", "artifact_hash", "payload"), {"ignoreNullFields": "false"}), 256)
    per = receipts.withColumn("identity", identity).groupBy("job_id", "attempt").agg(F.min("identity").alias("identity"), F.max("identity").alias("other__"), F.count(F.lit(1)).alias("copies"))
    return per.where("identity = other__").drop("other__"), per.where("identity <> other__").select("job_id", "attempt", "copies")


def current_receipts(receipts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Receipts of the jobs' present attempt and input; stale ones go."""
    now = jobs.select("job_id", F.col("attempt").alias("attempt"), F.col("input_hash").alias("input_hash"))
    return receipts.join(now, ["job_id", "attempt", "input_hash"], "left_semi")


def partial_batches(jobs: DataFrame, invalid: DataFrame) -> DataFrame:
    """jobs (job_id, artifacts) with completed (valid artifacts, sorted) and remaining (the others in order); invalid: job_id, artifact."""
    bad = invalid.groupBy("job_id").agg(F.collect_set("artifact").alias("bad__"))
    joined = jobs.join(bad, "job_id", "left").withColumn("bad__", F.coalesce("bad__", F.array().cast("array<string>")))
    return joined.withColumns({"completed": F.array_sort(F.array_except("artifacts", "bad__")), "remaining": F.filter("artifacts", lambda a: F.array_contains(F.col("bad__"), a))}).drop("bad__")


def recover(jobs: DataFrame, receipts: DataFrame, max_attempts: int = 5) -> DataFrame:
    """Running jobs after a crash: with a receipt of their attempt they have succeeded, else they're retryable while attempts are left."""
    has = receipts.select("job_id", "attempt").distinct().withColumn("has__", F.lit(True))
    status = F.when(F.col("has__"), "succeeded").when(F.col("attempt") < max_attempts, "retryable").otherwise("failed")
    return jobs.where("status = 'running'").join(has, ["job_id", "attempt"], "left").withColumn("recovered", status).drop("has__")


def activated_probes(verifications: DataFrame, jobs: DataFrame, phase: str) -> DataFrame:
    """Functions with a mismatch that have no bug_validate job yet, once the phase is bug_validation (else none)."""
    have = jobs.where("type = 'bug_validate'").select(F.explode("artifacts").alias("function_id"))
    return verifications.where((F.col("verdict") == "MISMATCH") & F.lit(phase == "bug_validation")).select("function_id").distinct().join(have, "function_id", "left_anti")


def lock_takeover(status: Column, acquired: Column, now: Column, ttl: Column, grace: Column, lease: Column) -> Column:
    """Whether a coordinator's lock may be taken: its run has ended, or it is older than min(ttl, max(grace, lease))."""
    from ..functions.scalars import age_seconds, lease_seconds

    return status.isin("succeeded", "failed", "cancelled") | (age_seconds(acquired, now) > lease_seconds(ttl, grace, lease))


def probe_action(status: Column, has_contract: Column, has_result: Column, by_agent: Column, finalized: Column) -> Column:
    """What a bug-validation job needs next; by_agent: the worker itself runs the reproduction, so its result is submitted as it is."""
    running = (
        F.when(~has_contract, "prepare")
        .when(~has_result & by_agent, "execute")
        .when(~has_result, "run_dynamic")
        .when(by_agent, "submit_execution")
        .when(~finalized, "finalize")
        .otherwise("submit_finalization")
    )
    return F.when(status == "queued", "start").when(status == "retryable", "retry").when(status == "running", running).otherwise("terminal")


def stop_decision(active: Column, phase: Column, barrier: Column) -> Column:
    """Whether a coordinator may stop: nothing active, the last phase is done, or the phase failed; else it has to go on."""
    return F.when(active.isNull() | (active != "running"), "approve").when(barrier == "phase_failed", "approve").when((phase == "finalize") & (barrier == "converged"), "approve").otherwise("block")
