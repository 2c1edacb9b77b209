"""Predicates over paths, names and documents. Checks with reasons give struct(ok, reason): the first rule that fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BUG_ATTEMPT_CLASSIFICATIONS, VERDICTS

# Fixed values.
TEST_FOLDERS = ("fixtures", "test", "testing", "tests")
ORACLE_MARKERS = r"(?i)(\bBUG\s*:|\bFIXME\s*:|\bTODO\s*:|\bseeded[ -]bug\b|\bknown defect\b|\bintentionally (broken|defective)\b)"
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"
SPEC_FIELDS = ("post_condition", "pre_condition", "signature")
CALLEE_FIELDS = ("name", "post_condition", "pre_condition", "signature")
REPORT_KEYS = ("classification", "counts", "escalation", "job_id", "outputs", "plan_path", "status", "summary", "verdict")
MOST_REPORT_BYTES, MOST_SUMMARY, MOST_TEXT, MOST_EVIDENCE = 8192, 500, 8000, 2000


def first_failure(*rules: tuple[Column, Column | str]) -> Column:
    """struct(ok, reason) of the first rule (fails, reason) that fails; an unknown outcome doesn't fail."""
    reason = F.lit(None).cast("string")
    for fails, said in reversed(rules):
        reason = F.when(fails, F.lit(said) if isinstance(said, str) else said).otherwise(reason)
    return F.struct(reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def is_test_path(path: Column) -> Column:
    """A folder named as tests are, or a file that begins with test_ or test-, or has _test. or _tests. in its name."""
    parts = F.split(F.lower(path), "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    return F.exists(folders, lambda p: p.isin(*TEST_FOLDERS)) | name.startswith("test_") | name.startswith("test-") | name.contains("_test.") | name.contains("_tests.")


def has_folder(path: Column, names: tuple[str, ...]) -> Column:
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*names))


def is_supported_source(path: Column, extensions: tuple[str, ...], generated: tuple[str, ...]) -> Column:
    from .scalars import suffix

    return suffix(path).isin(*extensions) & ~has_folder(path, generated) & ~is_test_path(path)


def in_scope(path: Column, scopes: Column) -> Column:
    """No scope takes all; else the path is one of them or lies below. Leading dots and slashes of a scope don't count."""
    clean = F.transform(scopes, lambda s: F.regexp_replace(F.regexp_replace(s, r"^[./]+", ""), r"/+$", ""))
    return (F.size(scopes) == 0) | F.exists(clean, lambda s: (path == s) | path.startswith(F.concat(s, F.lit("/"))))


def has_oracle_marker(text: Column) -> Column:
    return text.rlike(ORACLE_MARKERS)


def is_safe_path(path: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """Relative, no .. component, and below one of the prefixes if there are any."""
    safe = ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & (path != "")
    return safe & F.exists(F.array(*map(F.lit, prefixes)), lambda p: path.startswith(p)) if prefixes else safe


def is_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(IDENTIFIER), F.lit(False))


def _keys(document: Column) -> Column:
    return F.array_sort(F.json_object_keys(document))


def _named(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def has_exact_keys(document: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(_keys(document) == _named(tuple(sorted(keys))), F.lit(False))


def spec_check(document: Column) -> Column:
    """A specification document: exactly its three fields, none blank, and no markers of known defects in the contract."""
    from .scalars import json_string

    keys = F.json_object_keys(document)
    missing, extra = F.array_sort(F.array_except(_named(SPEC_FIELDS), keys)), F.array_sort(F.array_except(keys, _named(SPEC_FIELDS)))
    details = F.concat_ws("; ", F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", "))), F.when(F.size(extra) > 0, F.concat(F.lit("unsupported fields: "), F.array_join(extra, ", "))))
    field = lambda k: F.get_json_object(document, f"$.{k}")
    full = [json_string(document, k) & (F.trim(field(k)) != "") for k in SPEC_FIELDS]
    return first_failure(
        (keys.isNull(), "not a JSON object"),
        (F.size(missing) + F.size(extra) > 0, F.concat(F.lit("fields differ: "), details)),
        (~(full[0] & full[1] & full[2]), "blank or non-text field"),
        (has_oracle_marker(F.concat_ws("\n", field("pre_condition"), field("post_condition"))), "oracle marker in the contract"),
    )


def info_check(document: Column) -> Column:
    """A callee document: callees only, and each of them with exactly its four text fields."""
    from .scalars import json_string

    items = F.from_json(F.get_json_object(document, "$.callees"), "array<string>")
    each = F.forall(items, lambda c: has_exact_keys(c, CALLEE_FIELDS) & json_string(c, "name") & json_string(c, "signature") & json_string(c, "pre_condition") & json_string(c, "post_condition"))
    return has_exact_keys(document, ("callees",)) & F.coalesce(each, F.lit(False))


def _text(value: Column, most: int = MOST_TEXT) -> Column:
    return F.coalesce((F.trim(value) != "") & (F.length(value) <= most), F.lit(False))


def reasoning_check(reasoning: Column, post_condition: Column, source: Column, mismatch: Column) -> Column:
    """Post-condition reasoning: the specification's own words, and for a mismatch an exact quote of the source."""
    r = reasoning
    return first_failure(
        (r.isNull(), "no structured reasoning"),
        (~_text(r["actual_postcondition"]) | ~r["spec_postcondition"].eqNullSafe(post_condition), "post-conditions missing or changed"),
        (r["reason"].isNull() | (F.length(r["reason"]) > MOST_TEXT), "reason missing or too long"),
        (mismatch & ~(_text(r["counterexample"]) & _text(r["offending_statements"]) & _text(r["reason"])), "mismatch without counterexample, statements and reason"),
        (mismatch & ~F.coalesce(source.contains(r["offending_statements"]), F.lit(False)), "statements are no quote of the source"),
        (~mismatch & (r["counterexample"].isNotNull() | r["offending_statements"].isNotNull()), "match with a counterexample or statements"),
    )


def verification_check(v: dict[str, Column], function_id: Column, snapshot: Column, post_condition: Column, basis: Column, source: Column, known_ids: Column) -> Column:
    """A verification result (columns of schema verification in v) against its function, specification and source.

    known_ids: the ids among the result's affected callees that exist (joined beforehand; the whole index isn't sent along)."""
    verdict, gaps = v["verdict"], v["gaps"]
    settled = verdict.isin("MATCH", "MISMATCH")
    callees, missing = gaps["affected_callee_ids"], gaps["missing_evidence"]
    sub = reasoning_check(v["reasoning"], post_condition, source, verdict == "MISMATCH")
    return first_failure(
        (~v["schema_version"].eqNullSafe(F.lit(2)), "schema version"),
        (~v["function_id"].eqNullSafe(function_id), "function identity"),
        (~v["snapshot_commit"].eqNullSafe(snapshot), "snapshot"),
        (~F.coalesce(verdict.isin(*VERDICTS), F.lit(False)), "verdict"),
        (settled & ~F.coalesce(basis.isin("normative", "inferred"), F.lit(False)), "no contract to settle by"),
        (settled & (gaps.isNotNull() | v["error"].isNotNull()), "settled verdict with gaps or error"),
        (settled & ~sub["ok"], sub["reason"]),
        (~settled & v["reasoning"].isNotNull(), "unsettled verdict with reasoning"),
        ((verdict == "INCONCLUSIVE") & (v["error"].isNotNull() | gaps.isNull() | callees.isNotNull()), "inconclusive needs missing evidence and reason only"),
        ((verdict == "INCONCLUSIVE") & ~F.coalesce((F.size(missing) > 0) & (F.size(missing) <= 50) & F.forall(missing, lambda x: _text(x, MOST_EVIDENCE)) & _text(gaps["reason"]), F.lit(False)), "missing evidence blank"),
        ((verdict == "DEPENDENCY_RISK") & (v["error"].isNotNull() | gaps.isNull() | missing.isNotNull()), "risk needs affected callees and reason only"),
        ((verdict == "DEPENDENCY_RISK") & ~dependency_check(callees, function_id, known_ids), "affected callees unknown or own"),
        ((verdict == "DEPENDENCY_RISK") & ~_text(gaps["reason"]), "affected callees unknown or own"),
        ((verdict == "ERROR") & (gaps.isNotNull() | ~_text(v["error"])), "error blank or with gaps"),
    )


def dependency_check(callees: Column, own: Column, known: Column) -> Column:
    """1 to 100 callee ids, all known, none the function itself."""
    return F.coalesce((F.size(callees) > 0) & (F.size(callees) <= 100) & ~F.array_contains(callees, own) & (F.size(F.array_except(callees, known)) == 0), F.lit(False))


def dynamic_attempt_check(classification: Column, path: Column, result_snapshot: Column, result_state: Column, result_class: Column, snapshot: Column, folder: str = "probes/") -> Column:
    """A dynamic attempt against the reproduction result that it names."""
    open_ended = classification == "inconclusive"
    return first_failure(
        (~F.coalesce(classification.isin(*BUG_ATTEMPT_CLASSIFICATIONS), F.lit(False)), "classification"),
        (~F.coalesce(is_safe_path(path) & path.contains(folder), F.lit(False)), "evidence path"),
        (~result_snapshot.eqNullSafe(snapshot), "result missing or of another snapshot"),
        (open_ended & ~F.coalesce((result_class == "inconclusive") & result_state.isin("completed", "unsupported"), F.lit(False)), "inconclusive without matching result"),
        (~open_ended & ~F.coalesce((result_state == "completed") & (result_class == classification), F.lit(False)), "classification differs from the result's"),
    )


def receipt_check(document: Column, job_id: Column, job_type: Column, required: Column, folder: str = "worker_reports/") -> Column:
    """A worker's report (JSON) against its job; folder: where plans are written."""
    from .scalars import json_string

    field = lambda k: F.get_json_object(document, f"$.{k}")
    keys = F.json_object_keys(document)
    outputs = F.from_json(field("outputs"), "array<string>")
    extra = F.array_sort(F.array_except(keys, _named(REPORT_KEYS)))
    has = lambda k: F.array_contains(keys, k)
    return first_failure(
        (keys.isNull(), "not a JSON object"),
        (F.octet_length(document) > MOST_REPORT_BYTES, "too large"),
        (F.size(extra) > 0, F.concat(F.lit("unsupported keys: "), F.array_join(extra, ", "))),
        (~field("job_id").eqNullSafe(job_id), "job id"),
        (~(json_string(document, "status") & (F.trim(field("status")) != "")), "status"),
        (has("outputs") & ~outputs.eqNullSafe(required), "outputs differ from the required ones"),
        (job_type.isin("domain_context", "spec_batch", "verify_function", "verify_batch") & ~outputs.eqNullSafe(required), "outputs missing"),
        (has("verdict") & ~F.coalesce(field("verdict").isin(*VERDICTS), F.lit(False)), "verdict"),
        (has("summary") & ~F.coalesce(json_string(document, "summary") & (F.length(field("summary")) <= MOST_SUMMARY), F.lit(False)), "summary"),
        ((job_type == "bug_validate") & ~F.coalesce(field("classification").isin(*BUG_ATTEMPT_CLASSIFICATIONS), F.lit(False)), "classification"),
        ((job_type == "incremental_spec_plan") & ~field("plan_path").eqNullSafe(F.concat(F.lit(folder), job_id, F.lit(".json"))), "plan path"),
    )


def commands_check(commands: Column, folder: Column, state: Column) -> Column:
    """Command evidence (array of struct command, cwd, output): run below the attempt's folder, bounded, and some unless unsupported."""
    each = F.forall(commands, lambda c: (F.length(c["command"]) <= 4096) & (F.trim(c["command"]) != "") & (F.length(c["output"]) <= MOST_TEXT) & ((c["cwd"] == folder) | c["cwd"].startswith(F.concat(folder, F.lit("/")))))
    return F.coalesce(each & ((F.size(commands) > 0) | (state == "unsupported")), F.lit(False))


def reproduction_check(state: Column, classification: Column) -> Column:
    """Legal pairs of state and classification of a reproduction."""
    return F.coalesce(((state == "completed") & classification.isin("confirmed", "not_reproduced", "inconclusive")) | (state.isin("unsupported", "failed") & (classification == "inconclusive")), F.lit(False))


def contract_check(document: Column, keys: tuple[str, ...], ecosystems: Column) -> Column:
    """A reproduction contract: exact keys, an ecosystem that its language allows, and a timeout of 1 to 120 seconds."""
    timeout = F.get_json_object(document, "$.timeout_seconds").try_cast("int")
    return first_failure(
        (~has_exact_keys(document, keys), "keys"),
        (~F.coalesce(F.array_contains(ecosystems, F.get_json_object(document, "$.ecosystem")), F.lit(False)), "ecosystem"),
        (~F.coalesce(timeout.between(1, 120), F.lit(False)), "timeout"),
    )
