"""Modes, gates and views of a run, as expressions and joins over its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import first_failure
from ..functions.scalars import ordinal


def mode_decision(baseline_valid: Column, changes: Column) -> Column:
    """full without a valid baseline; noop if no supported file differs from it; else incremental."""
    return F.when(~F.coalesce(baseline_valid, F.lit(False)), "full").when(changes == 0, "noop").otherwise("incremental")


def baseline_check(has_plan: Column, fingerprint: Column, saved_fingerprint: Column, commit: Column, known_commit: Column, head_commit: Column, functions: Column, results_ok: Column, layers_ok: Column, completed: Column) -> Column:
    """struct(ok, reason) of a saved baseline."""
    return first_failure(
        (~has_plan, "no phase plan"),
        (~saved_fingerprint.eqNullSafe(fingerprint), "other range or configuration"),
        (commit.isNull(), "no baseline commit"),
        (~known_commit, "baseline commit is gone"),
        (~head_commit.eqNullSafe(commit), "baseline reference differs"),
        (functions == 0, "no functions in scope"),
        (~results_ok, "results incomplete"),
        (~layers_ok, "layers incomplete"),
        (completed.isNull(), "no time of completion"),
    )


def phase_gate(*violations: DataFrame) -> DataFrame:
    """One row: ok, the reason of the least rule that is violated, and the class ready, insufficient_specification or invalid. Each table
    has rule_no and reason, and is empty if its check holds."""
    out = violations[0].select("rule_no", "reason")
    for v in violations[1:]:
        out = out.unionByName(v.select("rule_no", "reason"))
    kind = F.when(F.col("reason").isNull(), "ready").when(F.col("reason").startswith("insufficient_specification"), "insufficient_specification").otherwise("invalid")
    return out.agg(F.min_by("reason", F.struct("rule_no", "reason")).alias("reason")).select(F.col("reason").isNull().alias("ok"), F.coalesce("reason", F.lit("")).alias("reason"), kind.alias("class"))


def order_violations(states: DataFrame, phases: tuple[str, ...], starting: str) -> DataFrame:
    """Earlier phases (states: phase, status) that haven't succeeded, recorded or not: while there are any, starting can't start."""
    spark = states.sparkSession
    before = spark.createDataFrame([(p, k) for k, p in enumerate(phases[: phases.index(starting)], 1)], "phase string, rule_no int")
    done = states.where("status = 'succeeded'").select("phase")
    return before.join(done, "phase", "left_anti").select("rule_no", F.concat(F.lit("unfinished: "), "phase").alias("reason"))


def can_complete(current: Column, phase: Column) -> Column:
    return current.eqNullSafe(phase)


def failure_message(explicit: Column, job_failures: Column, receipt_reason: Column) -> Column:
    """The message given, else the first eight failures (array of text, sorted), else the receipt's reason, else a default."""
    listed = F.array_join(F.slice(F.array_sort(job_failures), 1, 8), "; ")
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), F.when(F.size(job_failures) > 0, listed), F.nullif(receipt_reason, F.lit("")), F.lit("phase failed"))


def probe_gate(mismatches: DataFrame, reports: DataFrame, require_dynamic: bool = False) -> DataFrame:
    """Violations (rule_no, reason) of bug validation: with require_dynamic, mismatches without a report; reports without a mismatch always."""
    from ..operators.joins import set_differences

    sides = set_differences(mismatches, reports, "function_id")
    side = F.col("side") == "extra" if not require_dynamic else F.lit(True)
    return sides.where(side).select(F.when(F.col("side") == "missing", 1).otherwise(2).alias("rule_no"), F.concat("side", F.lit(": "), "function_id").alias("reason"))


def diagnosis(runs: DataFrame, receipts: DataFrame, checkpoints: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row a run: its state, last checkpoint, jobs by status and the latest receipt's reason."""
    from ..operators.aggregates import zero_filled
    from ..schemas import JOB_STATUSES

    last = checkpoints.groupBy("run_id").agg(F.max_by("checkpoint_id", "ordinal").alias("checkpoint_id"), F.max_by("status", "ordinal").alias("checkpoint_status"))
    counts = jobs.groupBy("run_id").agg(*zero_filled("status", JOB_STATUSES))
    said = receipts.groupBy("run_id").agg(F.max_by("reason", "received_at").alias("receipt_reason"))
    return runs.join(last, "run_id", "left").join(counts, "run_id", "left").join(said, "run_id", "left")


def phase_number(phases: tuple[str, ...], phase: Column) -> Column:
    return ordinal(phases, phase)


def terminal_report(verifications: DataFrame, dynamic: DataFrame, *keys: str) -> DataFrame:
    """Counts of verdicts, candidates, confirmed and static findings by key; terminal_findings has the findings themselves.

    verifications: keys, function_id, verdict; dynamic: function_id, confirmation_status."""
    kind = _finding(verifications, dynamic)
    return kind.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "MISMATCH").alias("mismatches"),
        F.count_if(F.col("finding") == "static").alias("static_findings"), F.count_if(F.col("finding") == "confirmed").alias("confirmed"),
    )


def terminal_findings(verifications: DataFrame, dynamic: DataFrame, official: Column, *keys: str) -> DataFrame:
    """keys, finding (static or confirmed) and function_id of the findings of keys that are official, once each; a key's come in order by
    operators.documents, however many there are."""
    found = _finding(verifications, dynamic).where(official & F.col("finding").isNotNull())
    return found.select(*keys, "finding", "function_id").distinct()


def _finding(verifications: DataFrame, dynamic: DataFrame) -> DataFrame:
    found = verifications.join(dynamic.select("function_id", "confirmation_status"), "function_id", "left")
    mismatch = F.col("verdict") == "MISMATCH"
    return found.withColumn("finding", F.when(mismatch & F.col("confirmation_status").isNull(), "static").when(mismatch & (F.col("confirmation_status") == "confirmed"), "confirmed"))
