"""More registered queries: validators, folds and walks that no other query shows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import inventory as D
from ..operators import joins as J
from ..operators import ledger as L
from ..operators import ranking as R
from ..schemas import TYPE_CAPS
from ..session import table
from . import views as V
from .queries import ORACLE, query


def _pick(column, values):
    """The value whose place is column % number of values."""
    return F.element_at(F.array(*(v if not isinstance(v, (str, int)) else F.lit(v) for v in values)), (column % len(values) + 1).cast("int"))


@query(
    """WITH p AS (SELECT p_brand AS plan, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS position FROM part),
    c AS (SELECT plan, position, CASE WHEN p_size % 17 = 0 THEN 'not normalized' WHEN p_partkey % 29 = 0 OR p_partkey % 31 = 0 THEN 'invalid production source' WHEN p_size = 3 OR p_size = 7 THEN 'invalid module sources'
      WHEN p_size % 5 = 0 THEN 'invalid dependencies' END AS reason FROM p)
    SELECT plan, position, reason FROM c WHERE reason IS NOT NULL"""
)
def phase_plan_form(spark, d):
    """a plan a brand, a phase a part. Some are numbered wrongly, name a test or a file that isn't there, have a module without
    sources (the second one), or depend on themselves."""
    from pyspark.sql import Window

    key, size = F.col("p_partkey"), F.col("p_size")
    parts = table(spark, d, "part").select("p_brand", "p_partkey", "p_size", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("position"))
    path = F.concat(F.when(key % 29 == 0, "tests/").otherwise("src/"), F.lit("m"), key.cast("string"), F.lit(".py"))
    second = F.when(size == 3, F.array().cast("array<string>")).when(size != 7, F.array(F.lit("src/common.py")))
    modules = F.array(F.struct(F.array(path).alias("source_files")), F.struct(second.alias("source_files")))
    before = F.when(F.col("position") > 1, F.array(F.col("position") - 1)).otherwise(F.array().cast("array<int>"))
    phases = parts.select(
        F.col("p_brand").alias("plan"), "position", F.when(size % 17 == 0, F.col("position") + 1).otherwise(F.col("position")).alias("phase"), modules.alias("modules"),
        F.when(size % 5 == 0, F.array("position")).otherwise(before).alias("depends_on"),
    )
    sources = parts.where(key % 31 != 0).select(path.alias("path")).unionByName(spark.createDataFrame([("src/common.py",)], "path string"))
    return J.plan_form_violations(phases, sources).select("plan", F.col("position").cast("long").alias("position"), "reason")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'a/x.h,b/z.HPP' WHEN 1 THEN 'm' || p_partkey || '.inl' ELSE '' END AS interfaces FROM part")
def public_interface_paths(spark, d):
    """P18."""
    name = F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    paths = _pick(F.col("p_size"), [F.array(F.lit("a/x.h"), F.lit("a/x.c"), F.lit("b/z.HPP")), F.array(F.concat(name, F.lit(".inl")), F.concat(name, F.lit(".h.txt"))), F.array(F.concat(name, F.lit(".py")))])
    return table(spark, d, "part").select("p_partkey", F.array_join(S.public_interfaces(paths), ",").alias("interfaces"))


@query(
    """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'schema version' WHEN 1 THEN 'function identity' WHEN 2 THEN 'snapshot' WHEN 3 THEN 'verdict' WHEN 4 THEN 'no contract to settle by' WHEN 7 THEN 'error blank or with gaps'
      WHEN 8 THEN 'affected callees unknown or own' ELSE '' END AS reason FROM events"""
)
def verification_validation(spark, d):
    """each result fails in another place or is good."""
    k = F.col("event_id") % 9
    own = F.col("user_id").cast("string")
    verdict = _pick(F.col("event_id"), ["MATCH", "MATCH", "MATCH", "OTHER", "MATCH", "MATCH", "INCONCLUSIVE", "ERROR", "DEPENDENCY_RISK"])
    text = F.lit(None).cast("string")
    reasoning = F.when(verdict == "MATCH", F.struct(F.lit("a").alias("actual_postcondition"), F.lit("post").alias("spec_postcondition"), text.alias("counterexample"), text.alias("offending_statements"), F.lit("r").alias("reason")))
    texts = F.lit(None).cast("array<string>")
    gaps = F.when(k == 6, F.struct(F.array(F.lit("e")).alias("missing_evidence"), texts.alias("affected_callee_ids"), F.lit("r").alias("reason"))).when(k == 8, F.struct(texts.alias("missing_evidence"), F.array(own).alias("affected_callee_ids"), F.lit("r").alias("reason")))
    result = {
        "schema_version": F.when(k == 0, 1).otherwise(2), "function_id": F.when(k == 1, "other").otherwise(own), "snapshot_commit": F.when(k == 2, "t").otherwise("s"), "verdict": verdict,
        "reasoning": reasoning, "gaps": gaps, "error": F.when(k == 7, " "),
    }
    check = P.verification_check(result, own, F.lit("s"), F.lit("post"), F.when(k == 4, "unavailable").otherwise("normative"), F.lit("source"), F.array(own))
    return table(spark, d, "events").select("event_id", check["reason"].alias("reason"))


@query("SELECT event_id, event_id % 5 IN (0, 2) AS valid FROM events")
def command_evidence(spark, d):
    """below the folder, beside it, none where unsupported, none where completed, too long a command."""
    one = lambda command, cwd: F.array(F.struct(command.alias("command"), F.lit(cwd).alias("cwd"), F.lit("out").alias("output")))
    run = F.lit("run")
    none = F.filter(one(run, "a"), lambda c: F.lit(False))
    commands = _pick(F.col("event_id"), [one(run, "p/a1/x"), one(run, "p/a10"), none, none, one(F.repeat(run, 2000), "p/a1")])
    state = F.when(F.col("event_id") % 5 == 2, "unsupported").otherwise("completed")
    return table(spark, d, "events").select("event_id", P.commands_check(commands, F.lit("p/a1"), state).alias("valid"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'keys' WHEN 2 THEN 'ecosystem' ELSE 'timeout' END AS reason, event_id % 4 IN (0, 3) AS legal FROM events")
def reproduction_contracts(spark, d):
    """F17."""
    document = _pick(F.col("event_id"), [f'{{"ecosystem": "{e}", "timeout_seconds": {t}{more}}}' for e, t, more in (("pip", 120, ""), ("pip", 5, ', "z": 1'), ("cargo", 5, ""), ("go", 0, ""), ("go", '"soon"', ""))])
    check = P.contract_check(document, ("ecosystem", "timeout_seconds"), F.array(F.lit("pip"), F.lit("go")))
    state, classification = _pick(F.col("event_id"), ["completed", "completed", "unsupported", "failed"]), _pick(F.col("event_id"), ["confirmed", "other", "confirmed", "inconclusive"])
    return table(spark, d, "events").select("event_id", check["reason"].alias("reason"), P.reproduction_check(state, classification).alias("legal"))


@query("SELECT 'c' || max(event_id) AS checkpoint_id, max(event_id) AS ordinal FROM events WHERE event_type = 'purchase' AND event_id < (SELECT max(event_id) FROM events)")
def last_complete_before(spark, d):
    """A chain of as many checkpoints as there are events."""
    text = lambda c: F.concat(F.lit("c"), c.cast("string"))
    events = table(spark, d, "events")
    rows = events.select(text(F.col("event_id")).alias("checkpoint_id"), text(F.col("event_id") - 1).alias("previous_checkpoint_id"), F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "purchase", "complete").otherwise("committing").alias("status"))
    newest = events.agg(F.max("event_id").alias("n")).first()["n"]
    return R.last_complete(rows, f"c{newest}").select("checkpoint_id", "ordinal")


@query(
    """WITH e AS (SELECT job_id, action, event_id % 3 = 0 AS negative, CASE WHEN event_id % 4 = 0 THEN 'semantic' ELSE 'execution' END AS class, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM log),
    r AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS rn, 'queued' AS status, 0 AS attempts, 0 AS spent, 0 AS negatives FROM e
      UNION ALL SELECT r.job_id, e.rn,
        CASE WHEN action = 'start' AND status = 'queued' THEN 'running' WHEN action = 'complete' AND status = 'running' THEN CASE WHEN negative AND negatives + 1 < 3 THEN 'retryable' ELSE 'succeeded' END
          WHEN action = 'fail' AND status IN ('queued', 'running') THEN CASE WHEN class = 'execution' AND spent + 1 < 5 THEN 'retryable' ELSE 'failed' END WHEN action = 'retry' AND status = 'retryable' THEN 'queued' ELSE status END,
        CASE WHEN action = 'start' AND status = 'queued' THEN attempts + 1 ELSE attempts END,
        CASE WHEN action = 'fail' AND status IN ('queued', 'running') AND class = 'execution' THEN spent + 1 ELSE spent END,
        CASE WHEN action = 'complete' AND status = 'running' AND negative THEN negatives + 1 ELSE negatives END
      FROM r JOIN e ON e.job_id = r.job_id AND e.rn = r.rn + 1)
    SELECT job_id, arg_max(status, rn) AS status, arg_max(attempts, rn) AS attempts, arg_max(spent, rn) AS runtime_attempts, arg_max(negatives, rn) AS negative_attempts FROM r GROUP BY job_id""",
    "log",
    True,
)
def probe_state_machine(spark, d):
    """T4 T5: jobs that validate bugs spend failures from a budget of their own and repeat negative results."""
    k = F.col("event_id")
    events = V.log(spark, d).withColumns({"failure_class": F.when(k % 4 == 0, "semantic").otherwise("execution"), "negative": k % 3 == 0, "type": F.lit("bug_validate")})
    return L.fold_events(events, order=("ts", "event_id")).select("job_id", "status", "attempts", "runtime_attempts", "negative_attempts")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'blank or non-text field' ELSE 'not a JSON object' END AS reason FROM events")
def repair_split(spark, d):
    """Members of a batch that pass are kept, the others go to repair with the reason."""
    good = '{"signature": "%s", "pre_condition": "x", "post_condition": "y"}'
    items = table(spark, d, "events").select("event_id", _pick(F.col("event_id"), [good % "f", good % " ", "[1]"]).alias("document"))
    kept, repair = D.split_valid(items, P.spec_check(F.col("document")))
    return kept.select("event_id", F.lit("").alias("reason")).unionByName(repair.select("event_id", "reason"))


@query(
    f"WITH j AS (SELECT status, [{', '.join(repr(t) for t in TYPE_CAPS)}][job_id % {len(TYPE_CAPS)} + 1] AS type FROM log) SELECT count(*) FILTER (WHERE status = 'running') AS running, "
    + ", ".join(f"count(*) FILTER (WHERE status = 'running' AND type = '{t}') AS running_{t}" for t in TYPE_CAPS)
    + " FROM j",
    "log",
)
def running_capacity(spark, d):
    """A6."""
    return A.capacity(V.log(spark, d).select("status", _pick(F.col("job_id"), list(TYPE_CAPS)).alias("type")))


#: The stream ends with the states that the batch fold gives.
ORACLE["stream_job_status"] = ORACLE["job_state_machine"]
