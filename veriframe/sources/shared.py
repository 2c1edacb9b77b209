"""What the sinks need of a shared file system: small files that are created once and whole, and folders of rows that are replaced by a pointer.

create_once is the only step that decides between writers. On a local file system it links a finished file to its name; elsewhere it
renames one without overwriting, which a file system with an atomic rename (HDFS) does for exactly one of several callers. Object
stores whose rename copies don't give that."""

from __future__ import annotations

import os
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Crash(RuntimeError):
    """Raised at a crash point that a test asks for."""


def _place(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _local(place, fs) -> Path | None:
    return Path(place.toUri().getPath()) if fs.getUri().getScheme() == "file" else None


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Whether this call created the file: nothing was there, and now its whole content is. Of several callers one gets True."""
    place, fs = _place(spark, path)
    if own := _local(place, fs):
        own.parent.mkdir(parents=True, exist_ok=True)
        draft = own.parent / f".{own.name}.{uuid.uuid4().hex}"
        draft.write_text(content, encoding="utf-8")
        try:
            os.link(draft, own)
        except FileExistsError:
            return False
        finally:
            draft.unlink()
        return True
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(content.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, place, options)
    except Exception:  # there already, or a failure: a file that isn't there afterwards is one
        fs.delete(draft, False)
        if not fs.exists(place):
            raise
        return False
    return True


def content_of(spark: SparkSession, path: str) -> str | None:
    """A small file's content, or None where there is none."""
    place, fs = _place(spark, path)
    if own := _local(place, fs):
        return own.read_text(encoding="utf-8") if own.is_file() else None
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder but drafts, sorted; none where it isn't there."""
    place, fs = _place(spark, folder)
    return sorted(n for s in fs.listStatus(place) if not (n := s.getPath().getName()).startswith(".")) if fs.exists(place) else []


def deleted(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return fs.delete(place, True)


def folders_like(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern names."""
    place, fs = _place(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(place) or [])


def replace_rows(df: DataFrame, path: str, crash: str | None = None) -> int:
    """Replaces the rows at path by those of df, and returns their number among the versions.

    The rows are written to a folder of their own; then the next pointer is created, which names it. A reader follows the newest pointer, so
    it sees the former rows until then and these afterwards, whatever becomes of the writer in between. Of two writers at one
    time both get a pointer, one after the other. crash: a point (after_rows, after_pointer) after which to raise Crash."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{version}")
    if crash == "after_rows":
        raise Crash(crash)
    number = _newest(spark, path) + 1
    while not create_once(spark, f"{path}/pointers/{number:012d}", version):
        number += 1
    if crash == "after_pointer":
        raise Crash(crash)
    return number


def _newest(spark: SparkSession, path: str) -> int:
    return int((names_in(spark, f"{path}/pointers") or ["0"])[-1])


def replaced_rows(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The rows that replace_rows wrote last."""
    number = _newest(spark, path)
    if not number:
        raise FileNotFoundError(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/versions/{content_of(spark, f'{path}/pointers/{number:012d}')}")


def drop_old_rows(spark: SparkSession, path: str, keep: int = 1, older_than: float = 7 * 86_400) -> list[str]:
    """Deletes versions that none of the newest keep pointers names and that are older than so many seconds (a younger one may be
    a write that has no pointer yet, or be read), then the other pointers. Returns the versions."""
    pointers = names_in(spark, f"{path}/pointers")
    kept = {content_of(spark, f"{path}/pointers/{n}") for n in pointers[-keep:]}
    gone = []
    for version in names_in(spark, f"{path}/versions"):
        place, fs = _place(spark, f"{path}/versions/{version}")
        if version not in kept and time.time() - fs.getFileStatus(place).getModificationTime() / 1000 >= older_than:
            fs.delete(place, True)
            gone.append(version)
    there = set(names_in(spark, f"{path}/versions"))
    for n in pointers[:-keep]:
        if content_of(spark, f"{path}/pointers/{n}") not in there:
            deleted(spark, f"{path}/pointers/{n}")
    return gone


def add_files(df: DataFrame, path: str, *partition_by: str) -> None:
    """Adds df's rows to the Parquet files at path, where several writers may add at one time.

    Each writes a folder of its own, which readers of path pass over, and moves its files over when all are there; names of files are
    unique. A writer that is lost while it moves has added some files, so this is for rows that may be added again (objects by digest)."""
    spark = df.sparkSession
    draft = f"{path}/_drafts/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(draft)
    top, fs = _place(spark, draft)
    begin = len(fs.makeQualified(top).toString()) + 1
    files = fs.listFiles(top, True)
    while files.hasNext():
        own = files.next().getPath()
        name = own.toString()[begin:]
        if not own.getName().startswith(("_", ".")):
            to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            fs.mkdirs(to.getParent())
            if not fs.rename(own, to):
                raise OSError(f"{name} could not be added to {path}")
    fs.delete(top, True)
