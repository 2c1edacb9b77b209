"""Aggregations: rollups, receipts, coverage and gates, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CONTRACT_BASES, JOB_STATUSES, TYPE_CAPS, VERDICTS
from .documents import document_digests


def _name(value: str) -> str:
    return value.lower()


def job_rollup(jobs: DataFrame, *keys: str) -> DataFrame:
    """Rows of each key and status."""
    return jobs.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("jobs"))


def convergence(jobs: DataFrame, *keys: str) -> DataFrame:
    """pending (queued, running, retryable), failed, and converged: nothing pending and nothing failed."""
    out = jobs.groupBy(*keys).agg(F.count_if(F.col("status").isin("queued", "running", "retryable")).alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.withColumn("converged", (F.col("pending") == 0) & (F.col("failed") == 0))


def zero_filled(column: str, domain: tuple[str, ...], prefix: str = "n_") -> list[Column]:
    """A count for each value of a domain, 0 where it doesn't occur."""
    return [F.count_if(F.col(column) == v).alias(f"{prefix}{_name(v)}") for v in domain]


def escalation_reason() -> Column:
    """Why a job (status, verdict, escalation) is escalated, the worst reason first; null if it isn't."""
    bad = F.col("verdict").isin("ERROR", "INCONCLUSIVE", "DEPENDENCY_RISK")
    return F.when(F.col("status").isin("failed", "retryable"), F.col("status")).when(bad, F.col("verdict")).when(F.col("escalation").isNotNull(), F.col("escalation"))


def phase_receipt(jobs: DataFrame, *keys: str) -> DataFrame:
    """Counts of all statuses and verdicts by key, and of the escalations; escalations() has these themselves."""
    return jobs.groupBy(*keys).agg(*zero_filled("status", JOB_STATUSES), *zero_filled("verdict", VERDICTS), F.count(escalation_reason()).alias("n_escalations"))


def escalations(jobs: DataFrame, *keys: str) -> DataFrame:
    """keys, job_id and reason of the jobs that are escalated, a row each; documents.write_lines and document_parts put a key's in order."""
    return jobs.withColumn("reason", escalation_reason()).where("reason is not null").select(*keys, "job_id", "reason")


def coverage(functions: DataFrame, *keys: str) -> DataFrame:
    """functions (verdict, basis): totals, zero-filled counts, conclusive (MATCH and MISMATCH) and its ratio."""
    out = functions.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *zero_filled("verdict", VERDICTS), *zero_filled("basis", CONTRACT_BASES, "b_"))
    out = out.withColumn("conclusive", F.col("n_match") + F.col("n_mismatch"))
    return out.withColumn("conclusive_ratio", F.coalesce(F.try_divide(F.col("conclusive").cast("double"), F.col("total").cast("double")), F.lit(0.0)))


def coverage_gate(covered: DataFrame) -> DataFrame:
    """Adds required (half of all, rounded up), ready and reason: the first rule that fails."""
    required = F.floor((F.col("total") + 1) / 2)
    independent = F.col("b_normative") + F.col("b_inferred")
    reason = (
        F.when(F.col("total") == 0, "insufficient_specification")
        .when(independent < required, "insufficient_specification")
        .when(F.col("n_error") > 0, "verification_incomplete")
        .when(F.col("conclusive") < required, "insufficient_specification")
        .otherwise("")
    )
    return covered.withColumns({"required": required.cast("bigint"), "reason": reason}).withColumn("ready", F.col("reason") == "")


def earliest_incomplete(jobs: DataFrame, phases: tuple[str, ...], current: str, *keys: str) -> DataFrame:
    """First phase in declared order that has jobs and not all succeeded; current if there is none."""
    from ..functions.scalars import ordinal

    per = jobs.groupBy(*keys, "phase").agg(F.sum(F.when(F.col("status") != "succeeded", 1).otherwise(0)).alias("open__"))
    place = ordinal(phases, F.col("phase"))
    return per.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(F.col("open__") > 0, F.col("phase")), F.when(F.col("open__") > 0, place)), F.lit(current)).alias("phase"))


def first_incomplete(states: DataFrame, phases: tuple[str, ...], *keys: str) -> DataFrame:
    """states (phase, status): the first declared phase that hasn't succeeded, be it recorded or not; finalize if all have."""
    done = states.groupBy(*keys).agg(F.collect_set(F.when(F.col("status") == "succeeded", F.col("phase"))).alias("done__"))
    rest = F.filter(F.array(*map(F.lit, phases)), lambda p: ~F.array_contains(F.col("done__"), p))
    return done.select(*keys, F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit("finalize")).alias("phase"))


def capacity(jobs: DataFrame, types: tuple[str, ...] = tuple(TYPE_CAPS)) -> DataFrame:
    """One row: running jobs, all and of each type."""
    running = F.col("status") == "running"
    return jobs.agg(F.count_if(running).alias("running"), *(F.count_if(running & (F.col("type") == t)).alias(f"running_{t}") for t in types))


def historical_seconds(attempts: DataFrame, *keys: str) -> DataFrame:
    """Mean seconds of succeeded attempts that ended, 0 at least and where there are none."""
    spent = (F.col("completed_at").cast("double") - F.col("started_at").cast("double"))
    return attempts.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.coalesce(F.avg(F.when(F.col("status") == "succeeded", spent)), F.lit(0.0))).alias("seconds"))


def bug_summary(reports: DataFrame, *keys: str) -> DataFrame:
    status = F.col("confirmation_status")
    return reports.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"), *(F.count_if(status == s).alias(s) for s in ("confirmed", "rejected", "inconclusive")))


def summary_differences(stored: DataFrame, reports: DataFrame, *keys: str) -> DataFrame:
    """Stored summaries that don't equal the recomputed ones, or lack one."""
    names = ("candidates", "confirmed", "rejected", "inconclusive")
    own = bug_summary(reports, *keys).select(*keys, *(F.col(n).alias(f"{n}__") for n in names))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}__"))
    return stored.join(own, list(keys), "full").where(~same)


def merge_edges(edges: DataFrame, order: str = "ord") -> DataFrame:
    """edges (schema extra_edge and an order) by caller name, its call-site names and callee name; lists united, first seen first.

    Elements are united before they are put together: of each its first place (order, then position) is kept by an aggregate that
    combines before the shuffle, so a list is as long as its distinct elements, however many edges name them. A null list counts as
    empty; an element that is null stands once."""
    keys = ["caller", "callsite_names", "callee"]
    rows = edges.select(order, F.col("caller.fqn").alias("caller"), F.col("caller.callsite_names").alias("callsite_names"), F.col("callee.fqn").alias("callee"), F.col("callee.info_names").alias("info_names"), "evidence")
    named = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(c).alias("which"), x.alias("element"), i.alias("i")))
    listed = F.concat(named("info_names"), named("evidence"))
    each = rows.select(*keys, order, F.explode_outer(listed).alias("e")).select(*keys, "e.which", "e.element", F.struct(F.col(order).alias("o"), F.col("e.i").alias("i")).alias("place"))
    first = each.groupBy(*keys, "which", "element").agg(F.min("place").alias("place"))
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("which") == c, F.struct("place", "element")))), lambda s: s["element"]).alias(c)
    return first.groupBy(*keys).agg(of("info_names"), of("evidence"))


def barrier(jobs: DataFrame, *keys: str) -> DataFrame:
    """Counts by status, and what to do: phase_failed before wait before converged."""
    out = jobs.groupBy(*keys).agg(*zero_filled("status", JOB_STATUSES))
    return out.withColumn("action", F.when(F.col("n_failed") > 0, "phase_failed").when(F.col("n_queued") + F.col("n_running") + F.col("n_retryable") > 0, "wait").otherwise("converged"))


def batch_totals(items: DataFrame, *keys: str) -> DataFrame:
    """Items, tokens and bytes of each batch."""
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))


def batch_items(items: DataFrame, item: str, *keys: str) -> DataFrame:
    """batch_totals and the batch's items in order (names); for batches of greedy_batches, whose items are bounded."""
    return items.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("names"), F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))


def layer_summary(layers: DataFrame) -> DataFrame:
    return layers.groupBy("phase").agg(F.countDistinct("layer").alias("layers"), F.count(F.lit(1)).alias("functions"))


def present(rows: DataFrame, column: str) -> DataFrame:
    """One row: the sorted distinct values of a column of small domain (languages, extensions)."""
    return rows.agg(F.array_sort(F.collect_set(column)).alias(f"{column}s"))


def composite_identity(inventory: DataFrame, *keys: str) -> DataFrame:
    """Digest of each group's files: (path, sha256, size) in order, a line each; lines stream through it, so a group has any number of files."""
    line = F.concat_ws("\t", "path", "sha256", F.col("size").cast("string"))
    return document_digests(inventory.select(*keys, line.alias("line")), list(keys), ["line"]).select(*keys, F.col("sha256").alias("identity"))


def selection_summary(decisions: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: functions included and excluded, and removed ones (a table of their own)."""
    own = decisions.agg(F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("excluded"))
    return own.join(removed.agg(F.count(F.lit(1)).alias("removed")))
