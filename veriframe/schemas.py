"""Declared schemas of the engine's logical tables, and its enumerated domains."""

from __future__ import annotations

#: DDL by logical table.
SCHEMAS = {
    "source_file": "snapshot_id string, path string, text string",
    "language_profile": "ord int, key string, display_name string, extensions array<string>, codegraph_languages array<string>, treesitter_languages array<string>, span_extractor string, public_entry_strategy string, probe_extension string, build_detectors array<string>, requires_build_metadata boolean, build_adapter string, dynamic_adapter string, agent_execution_ecosystems array<string>, dependency_hydration struct<install_dir:string, lockfiles:array<string>>, support_level string",
    "manifest": "artifact string, source_path string, name string, function_id string, line_start int, line_end int, extraction_backend string",
    "function_index": "id string, path string, artifact string, line_start int, line_end int, language string, scope array<string>",
    "phase_plan": "phase int, name string, description string, modules array<struct<name:string, description:string, source_files:array<string>>>, depends_on_phases array<int>",
    "graph_node": "node_id string, name string, qualified_name string, path string, language string, line_start int, line_end int",
    "graph_edge_raw": "source string, target string, kind string",
    "graph_edge": "caller string, callee string, kind string, evidence string, backend string, precision string",
    "extra_edge": "caller struct<fqn:string, callsite_names:array<string>>, callee struct<fqn:string, info_names:array<string>>, evidence array<string>, source string",
    "layer": "phase int, function_id string, layer int, artifact string, source_file string",
    "spec": "artifact string, signature string, pre_condition string, post_condition string",
    "callee_info": "artifact string, callees array<struct<name:string, signature:string, pre_condition:string, post_condition:string>>",
    "verification": "schema_version int, function_id string, snapshot_commit string, verdict string, reasoning struct<actual_postcondition:string, spec_postcondition:string, counterexample:string, offending_statements:string, reason:string>, gaps struct<missing_evidence:array<string>, affected_callee_ids:array<string>, reason:string>, error string",
    "job": "job_id string, run_id string, phase string, type string, status string, attempt int, max_attempts int, depends_on array<string>, required_outputs array<string>, artifacts array<string>, input_hash string",
    "job_event": "job_id string, seq bigint, ts timestamp, action string, failure_class string, receipt_hash string",
    "lease": "job_id string, attempt int, owner string, acquired_at timestamp, heartbeat_at timestamp, expires_at timestamp",
    "attempt": "job_id string, attempt int, input_hash string, status string, artifact_hash string, started_at timestamp, completed_at timestamp, message string",
    "receipt": "job_id string, attempt int, input_hash string, artifact_hash string, payload string, received_at timestamp",
    "checkpoint": "checkpoint_id string, phase string, ordinal int, snapshot string, fingerprint string, status string, semantic_status string, previous_checkpoint_id string, created_at timestamp, completed_at timestamp",
    "inventory": "checkpoint_id string, path string, sha256 string, size bigint",
    "bug_report": "function_id string, snapshot_commit string, confirmation_status string, attempts array<struct<ordinal:int, classification:string>>",
    "reproduction_result": "bug_id string, attempt int, snapshot_commit string, state string, classification string, reason string, returncode int, stdout string, stderr string",
    "incremental_decision": "function_id string, included boolean, reason string",
}

# Fixed values.
VERDICTS = ("DEPENDENCY_RISK", "ERROR", "INCONCLUSIVE", "MATCH", "MISMATCH")
CONTRACT_BASES = ("inferred", "normative", "unavailable")
JOB_STATUSES = ("failed", "queued", "retryable", "running", "succeeded")
JOB_TYPES = (
    "bug_validate", "domain_context", "incremental_spec_plan", "phase_plan", "phase_refine", "reconcile_caller_info",
    "resolve_agent_static_edges", "select_relevant_files", "select_relevant_modules", "spec_batch", "verify_batch", "verify_function",
)
RETRYABLE_FAILURES = ("execution", "interrupted", "output")
FAILURE_CLASSES = (*RETRYABLE_FAILURES, "cancelled", "input", "semantic")
BUG_ATTEMPT_CLASSIFICATIONS = ("confirmed", "inconclusive", "not_reproduced")
BUG_FINAL_STATUSES = ("confirmed", "inconclusive", "rejected")
FULL_PHASES = ("preflight", "project_understanding", "phase_cleanup", "extraction", "call_graph", "specification", "verification", "bug_validation", "finalize")
INCREMENTAL_PHASES = ("validate_baseline", "refresh_plan", "preserve_specs", "diff", "rebuild_graph", "select_scope", "update_specs", "verify_affected", "bug_validation", "finalize")
#: Caps of concurrently running jobs: all, and by type (types without one have the global cap only).
GLOBAL_CAP = 16
TYPE_CAPS = {"spec_batch": 8, "verify_function": 12, "verify_batch": 12, "bug_validate": 4, "incremental_spec_plan": 4}
