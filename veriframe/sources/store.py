"""Sinks: documents, the content-addressed object store, checkpoints with a head, logs and reports.

Writing a checkpoint goes objects, mirror, manifest, record (committing), head (a claim), outcome (complete). Rows are replaced by a pointer and
the small files are created once (shared), so a crash between any two steps leaves the former head in force, and of two publishers
that follow the same head one gets the place behind it. Doing a step again is harmless."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import joined_text
from .shared import Crash, add_files, content_of, create_once, deleted, folders_like, names_in, replace_rows, replaced_rows

POINTS = ("after_objects", "after_current", "after_manifest", "after_db", "after_head")
_RECORD = "checkpoint_id string, phase string, ordinal int, snapshot string, status string, previous_checkpoint_id string"


class CorruptObject(RuntimeError):
    """An object's content doesn't have its digest, or a restored file doesn't have its inventory's."""


class Conflict(RuntimeError):
    """Another publisher has claimed the place behind the head."""


def write_documents(df: DataFrame, path: str) -> None:
    """Replaces the documents at path; who reads them with documents() gets all the old or all the new ones."""
    replace_rows(df, path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents that write_documents wrote last."""
    return replaced_rows(spark, path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def put_objects(df: DataFrame, store: str) -> DataFrame:
    """Appends contents (text) that the store lacks, once each, by digest; returns the inventory rows (path, sha256, size).

    A stored object of that digest with another content or size is an error. Two writers may append the same object; readers
    take one of each digest (objects)."""
    rows = df.select("path", "text", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))
    new = rows.select("sha256", "size", "text").dropDuplicates(["sha256"])
    spark = df.sparkSession
    if any(n.startswith("shard=") for n in names_in(spark, store)):
        held = spark.read.parquet(store)
        bad = held.join(new.select("sha256"), "sha256", "left_semi").where((F.sha2("text", 256) != F.col("sha256")) | (F.octet_length("text") != F.col("size")))
        if first := bad.select("sha256").first():
            raise CorruptObject(first["sha256"])
        new = new.join(held.select("sha256"), "sha256", "left_anti")
    add_files(new.withColumn("shard", F.substring("sha256", 1, 2)), store, "shard")
    return rows.drop("text")


def objects(spark: SparkSession, store: str) -> DataFrame:
    """sha256, size and text of the store, once each."""
    return spark.read.parquet(store).select("sha256", "size", "text").dropDuplicates(["sha256"])


def corrupt_objects(spark: SparkSession, store: str) -> DataFrame:
    """Objects whose content doesn't have the recorded digest or size."""
    return spark.read.parquet(store).where((F.sha2("text", 256) != F.col("sha256")) | (F.octet_length("text") != F.col("size"))).select("sha256")


def claims(spark: SparkSession, root: str) -> list[tuple[int, str, str | None, str | None]]:
    """Number, checkpoint, its previous one and outcome (complete, abandoned, or None while committing) of all claims, in order."""
    out = []
    for name in names_in(spark, f"{root}/heads"):
        own = json.loads(content_of(spark, f"{root}/heads/{name}"))
        out.append((int(name), own["checkpoint_id"], own["previous"], content_of(spark, f"{root}/outcomes/{name}")))
    return out


def head(spark: SparkSession, root: str) -> str | None:
    """The last complete checkpoint; a claim that is still committing is passed over."""
    for name in reversed(names_in(spark, f"{root}/heads")):
        if content_of(spark, f"{root}/outcomes/{name}") == "complete":
            return json.loads(content_of(spark, f"{root}/heads/{name}"))["checkpoint_id"]
    return None


def records(spark: SparkSession, root: str) -> DataFrame:
    """A row for each checkpoint that was recorded, with its status (committing, complete, abandoned)."""
    place = {c: (previous, outcome or "committing") for _, c, previous, outcome in claims(spark, root)}
    rows = []
    for name in names_in(spark, f"{root}/records"):
        own = json.loads(content_of(spark, f"{root}/records/{name}"))
        previous, status = place.get(name, (None, "committing"))
        rows.append((name, own["phase"], own["ordinal"], own["snapshot"], status, previous))
    return spark.createDataFrame(rows, _RECORD)


def publish(files: DataFrame, root: str, checkpoint_id: str, phase: str, ordinal: int, snapshot: str, crash: str | None = None, take_over: bool = False) -> None:
    """Publishes files (path, text) as a checkpoint behind the head; crash: the point after which to raise Crash.

    The place behind the last claim goes to the publisher that creates it; another one gets Conflict. So does one that finds a claim
    which is still committing, unless take_over says that its publisher is gone: then the claim's outcome is set to abandoned, which
    only one of it and complete can be. A publisher that comes back to a claim of its own goes on with it."""
    spark = files.sparkSession

    def reached(point: str) -> None:
        if crash == point:
            raise Crash(point)

    before = claims(spark, root)
    own = next((c for c in before if c[1] == checkpoint_id and c[3] != "abandoned"), None)
    if own and own[3] == "complete":
        return
    inventory = put_objects(files, f"{root}/objects").withColumn("checkpoint_id", F.lit(checkpoint_id))
    reached("after_objects")
    write_documents(files.select("path", F.sha2("text", 256).alias("sha256")), f"{root}/mirror/{checkpoint_id}")
    reached("after_current")
    write_documents(inventory, f"{root}/manifests/{checkpoint_id}")
    reached("after_manifest")
    create_once(spark, f"{root}/records/{checkpoint_id}", json.dumps({"phase": phase, "ordinal": ordinal, "snapshot": snapshot}))
    reached("after_db")
    if own is None:
        if before and before[-1][3] is None:
            number = before[-1][0]
            if not take_over or not (create_once(spark, f"{root}/outcomes/{number:012d}", "abandoned") or content_of(spark, f"{root}/outcomes/{number:012d}") == "abandoned"):
                raise Conflict(before[-1][1])
        previous = next((c[1] for c in reversed(before) if c[3] == "complete"), None)
        own = ((before[-1][0] if before else 0) + 1, checkpoint_id, previous, None)
        if not create_once(spark, f"{root}/heads/{own[0]:012d}", json.dumps({"checkpoint_id": checkpoint_id, "previous": previous})):
            raise Conflict(f"{root}/heads/{own[0]:012d}")
    reached("after_head")
    if not create_once(spark, f"{root}/outcomes/{own[0]:012d}", "complete") and content_of(spark, f"{root}/outcomes/{own[0]:012d}") != "complete":
        raise Conflict(f"{checkpoint_id} was abandoned")


def complete(spark: SparkSession, root: str, checkpoint_id: str) -> bool:
    return any(c[1] == checkpoint_id and c[3] == "complete" for c in claims(spark, root))


def restore(spark: SparkSession, root: str, checkpoint_id: str | None = None) -> DataFrame:
    """path and text of a checkpoint (the head's): exactly its inventory, so removed files can't come back. A checkpoint that isn't
    complete, a missing object, and content without its digest are errors."""
    own = checkpoint_id or head(spark, root)
    if own is None:
        raise ValueError("no checkpoint has been published")
    if not complete(spark, root, own):
        raise ValueError(f"checkpoint {own} isn't complete")
    manifest = documents(spark, f"{root}/manifests/{own}")
    files = manifest.select("path", "sha256", "size").join(objects(spark, f"{root}/objects").withColumnRenamed("size", "held"), "sha256", "left")
    wrong = files.where(F.col("text").isNull() | (F.sha2("text", 256) != F.col("sha256")) | (F.octet_length("text") != F.col("size")))
    if first := wrong.select("path").first():
        raise CorruptObject(first["path"])
    return files.select("path", "text")


def problems(spark: SparkSession, root: str, checkpoint_id: str) -> DataFrame:
    from ..operators.inventory import inventory_problems

    return inventory_problems(documents(spark, f"{root}/manifests/{checkpoint_id}"), documents(spark, f"{root}/mirror/{checkpoint_id}"), spark.read.parquet(f"{root}/objects").select("sha256", "size"))


def progress(jobs: DataFrame, path: str) -> None:
    """Writes a summary of a run's jobs for display; nothing reads it back."""
    from ..operators.aggregates import job_rollup

    write_documents(job_rollup(jobs, "phase"), path)


def intent_lines(commits: DataFrame, changes: DataFrame, note: str) -> DataFrame:
    """section, place, text and line of a Markdown report of commits (ord, id, subject) and changed paths (path, change), in this order a
    row each. documents.write_lines makes files of them, document_digests a digest, joined_text one value."""
    spark = commits.sparkSession
    fixed = spark.createDataFrame([(0, "# Intent\n\n## Commits"), (4, f"\n## Note\n{note}\n")], "section int, line string").select("section", F.lit(0).cast("long").alias("place"), F.lit("").alias("text"), "line")
    log = commits.select(F.lit(1).alias("section"), F.col("ord").cast("long").alias("place"), F.concat(F.lit("- "), "id", F.lit(" "), "subject").alias("line")).withColumn("text", F.col("line"))
    count = changes.agg(F.count(F.lit(1)).alias("n")).select(F.lit(2).alias("section"), F.lit(0).cast("long").alias("place"), F.lit("").alias("text"), F.concat(F.lit("\n## Changes ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    paths = changes.select(F.lit(3).alias("section"), F.lit(0).cast("long").alias("place"), F.concat(F.lit("- "), "change", F.lit(" "), "path").alias("line")).withColumn("text", F.col("line"))
    return fixed.unionByName(log).unionByName(count).unionByName(paths)


def intent_report(commits: DataFrame, changes: DataFrame, note: str) -> DataFrame:
    """One row: the report of intent_lines as one value."""
    return joined_text(intent_lines(commits, changes, note), [], ["section", "place", "text"]).select(F.col("text").alias("report"))


def reset(spark: SparkSession, root: str, names: tuple[str, ...]) -> list[str]:
    """Deletes derived folders below root that the names or patterns (*, ?, {a,b}) name, and returns their paths; all others stay."""
    gone = [path for name in names for path in folders_like(spark, f"{root}/{name}")]
    for path in gone:
        deleted(spark, path)
    return gone
