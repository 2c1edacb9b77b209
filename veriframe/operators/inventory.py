"""Inventories and set operations. An inventory has path, sha256 and size; snapshots are compared by one full outer join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventory_delta(previous: DataFrame, current: DataFrame, key: str = "path", hash_: str = "sha256") -> DataFrame:
    """key and change: produced (new), changed (another hash), preserved, or removed (a tombstone)."""
    a, b = previous.select(key, F.col(hash_).alias("was__"), F.lit(True).alias("a__")), current.select(key, F.col(hash_).alias("is__"), F.lit(True).alias("b__"))
    change = F.when(F.col("b__").isNull(), "removed").when(F.col("a__").isNull(), "produced").when(F.col("was__").eqNullSafe(F.col("is__")), "preserved").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def artifact_diff(previous: DataFrame, current: DataFrame, key: str = "artifact", file: str = "path", hash_: str = "sha256") -> DataFrame:
    """key, change (added, removed, modified) of artifacts that aren't the same, and file_changed: any artifact of the file isn't."""
    a = previous.select(key, F.col(file).alias("f1__"), F.col(hash_).alias("was__"), F.lit(True).alias("a__"))
    b = current.select(key, F.col(file).alias("f2__"), F.col(hash_).alias("is__"), F.lit(True).alias("b__"))
    change = F.when(F.col("b__").isNull(), "removed").when(F.col("a__").isNull(), "added").when(~F.col("was__").eqNullSafe(F.col("is__")), "modified")
    both = a.join(b, key, "full").select(key, F.coalesce("f2__", "f1__").alias(file), change.alias("change"))
    files = both.groupBy(file).agg(F.max(F.col("change").isNotNull()).alias("file_changed"))
    return both.join(files, file).select(key, file, "change", "file_changed").where("change is not null or file_changed")


def stale(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row: how many keys of actual weren't expected, and the least of them."""
    return actual.select(key).distinct().join(expected.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("stale"), F.min(key).alias("first"))


def selection_merge(decisions: DataFrame, known: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """decisions (key, included, reason) merged: one inclusion overrides any exclusion; and decisions on unknown keys."""
    merged = decisions.groupBy(key).agg(F.max("included").alias("included"), F.min_by("reason", F.struct(~F.col("included"), "reason")).alias("reason"))
    return merged.join(known.select(key), key, "left_semi"), decisions.join(known.select(key), key, "left_anti")


def coverage_violations(assigned: DataFrame, index: DataFrame, key: str = "function_id", phase: str = "phase") -> DataFrame:
    """key and reason where assigned (key, phase) doesn't cover index (key, phase) exactly once and in the right phase."""
    a = assigned.groupBy(key).agg(F.count(F.lit(1)).alias("n__"), F.min(phase).alias("p__"))
    both = a.join(index.select(key, F.col(phase).alias("q__"), F.lit(True).alias("i__")), key, "full")
    reason = F.when(F.col("n__").isNull(), "missing").when(F.col("i__").isNull(), "unknown").when(F.col("n__") > 1, "repeated").when(~F.col("p__").eqNullSafe(F.col("q__")), "other phase")
    return both.select(key, reason.alias("reason")).where("reason is not null")


def applied_union(prior: DataFrame, more: DataFrame, key: str = "artifact") -> DataFrame:
    return prior.select(key).union(more.select(key)).distinct()


def preserved_sidecars(pairs: DataFrame, changed: DataFrame) -> DataFrame:
    """pairs (artifact, path, ...) of files that haven't changed (path)."""
    return pairs.join(changed.select("path"), "path", "left_anti")


def restored_sidecars(kept: DataFrame, current: DataFrame) -> DataFrame:
    """Preserved pairs whose artifact still exists."""
    return kept.join(current.select("artifact"), "artifact", "left_semi")


def version_differences(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field, was and now of fields (as text) that differ between records of one key that both have."""
    long = lambda df, name: df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in columns))).alias("s")).select(key, "s.*")
    return long(left, "was").join(long(right, "now"), [key, "field"]).where(~F.col("was").eqNullSafe(F.col("now")))


def resume_differences(saved: dict, current: dict):
    """Column: names of identity fields (columns by name) that differ."""
    return F.array_compact(F.array(*(F.when(~saved[k].eqNullSafe(current[k]), F.lit(k)) for k in saved)))


def inventory_problems(inventory: DataFrame, mirror: DataFrame, objects: DataFrame) -> DataFrame:
    """path and problem: object missing or corrupt (objects: sha256, size), mirror missing, differing, or extra (mirror: path, sha256)."""
    store = objects.select(F.col("sha256").alias("o__"), F.col("size").alias("s__"))
    held = inventory.select("path", "sha256", "size").join(store, F.col("sha256") == F.col("o__"), "left")
    bad = held.select("path", F.when(F.col("o__").isNull(), "object missing").when(F.col("size") != F.col("s__"), "object corrupt").alias("problem"))
    both = inventory.select("path", F.col("sha256").alias("h__")).join(mirror.select("path", F.col("sha256").alias("m__")), "path", "full")
    seen = both.select("path", F.when(F.col("h__").isNull(), "unexpected").when(F.col("m__").isNull(), "mirror missing").when(F.col("h__") != F.col("m__"), "mirror differs").alias("problem"))
    return bad.unionByName(seen).where("problem is not null")


def split_valid(items: DataFrame, check) -> tuple[DataFrame, DataFrame]:
    """Items that pass a check with reason, and those that don't with the reason."""
    tested = items.withColumn("check__", check)
    return tested.where("check__.ok").drop("check__"), tested.where("not check__.ok").withColumn("reason", F.col("check__.reason")).drop("check__")


def apply_plan(current: DataFrame, updates: DataFrame, violations: DataFrame, key: str = "artifact") -> DataFrame:
    """current with updates laid over it by key, or current unchanged if there is any violation."""
    any_ = violations.agg((F.count(F.lit(1)) > 0).alias("bad__"))
    good = updates.join(any_, F.lit(True)).where("not bad__").drop("bad__")
    return current.join(good.select(key), key, "left_anti").unionByName(good)
