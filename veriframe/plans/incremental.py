"""The incremental run as one plan: inventory delta, changed units, closure over the call graph, coverage of what is affected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import coverage, coverage_gate
from ..operators.graph import impact_closure
from ..operators.inventory import inventory_delta


def affected(previous: DataFrame, current: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """units (id, path) with included and reason: those of produced or changed files, and all connected with them by edges."""
    changed = inventory_delta(previous, current).where("change in ('produced', 'changed')")
    seeds = units.join(changed.select("path"), "path", "left_semi").select("id")
    closure = impact_closure(edges, seeds)
    return units.join(closure, "id", "left").select("id", "path", F.col("reason").isNotNull().alias("included"), F.coalesce("reason", F.lit("unaffected")).alias("reason"))


def affected_coverage(decisions: DataFrame, verdicts: DataFrame, *keys: str) -> DataFrame:
    """Coverage and gate of the included units by keys; verdicts: id, verdict, basis (missing: unverified)."""
    own = decisions.where("included").join(verdicts, "id", "left")
    return coverage_gate(coverage(own, *keys))
