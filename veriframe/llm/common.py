"""What the operators share: Arrow blocks of texts as flat bytes, and folders that the cluster shares."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a Python worker handles at once; one longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Batches that go to Python workers get a bound in bytes, unless the session has one of its own: very long texts would else fill
    a worker's memory by the thousand."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(2 * BLOCK_BYTES))


def narrowed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, as doc_id and text (null text: empty)."""
    bounded(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array one after the other, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets - (offsets[0] if len(column) else 0)


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches with a column text into blocks of whole rows of about size bytes: rows, bytes, offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = flat(batch.column(batch.schema.get_field_index("text")))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
            yield batch.slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop
    released()


def released() -> None:
    """Gives a worker's free memory back when a task ends: workers are used again, and others on the machine need it meanwhile."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def per_block(df: DataFrame, function: Callable[..., pa.RecordBatch], schema: str, size: int = BLOCK_BYTES) -> DataFrame:
    """function(rows, bytes, offsets) over all blocks of df; it returns one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, size):
            yield function(*block)

    return df.mapInArrow(run, schema)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all runs, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def strings(data: np.ndarray, starts: np.ndarray, end: int) -> pa.Array:
    """The parts of data between neighbouring starts (the last one to end), without a copy."""
    offsets = np.append(starts, end).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir; where that is unset on a local master (tests), the setting is made first.

    On a cluster there is no folder to choose that all executors are known to share, so the setting is asked for. Paths are
    fresh, so two runs never share one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        top = spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file:///tmp/veriframe-checkpoints"
        spark.sparkContext.setCheckpointDir(top)
    return f"{top}/veriframe-{uuid.uuid4().hex}"


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to path has ended."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as Parquet to the shared folder and read again: later reads need no executor to have survived.

    The folder is deleted when the session's JVM ends, if the file system allows it."""
    return appended([df], df.sparkSession, df.schema, name)


def appended(parts: Iterable[DataFrame], spark: SparkSession, schema: StructType | str, name: str = "step") -> DataFrame:
    """The rows of all parts, written one part after the other into one table as by written()."""
    path = f"{shared_folder(spark)}/{name}"
    for df in parts:
        df.write.mode("append").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Bits of the filters of maybe_in, which go to every task: 2 ** 18 rows at most, about 10 MB in memory.
FILTER_BITS = 1 << 24


def maybe_in(df: DataFrame, column: str, other_rows: DataFrame, other: bool = False) -> DataFrame:
    """Rows of df whose column (a hash, long, not null) may be in other_rows' column of that name; with other, the rest, which is surely not.

    The filter has FILTER_BITS bits whatever the size of either side, so it is broadcast; it only spares rows a shuffle. With many
    more keys than bits it lets all rows pass, and the join behind it decides alone."""
    bit = F.pmod(F.col(column), F.lit(FILTER_BITS))
    word, mask = free_name(df, "word"), free_name(df, "mask")
    bits = other_rows.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias(mask))
    own = df.withColumn(word, F.shiftright(bit, 6)).join(F.broadcast(bits), word, "left")
    there = F.coalesce(F.getbit(F.col(mask), bit.bitwiseAND(F.lit(63)).cast("int")), F.lit(0)) == 1
    return own.where(~there if other else there).drop(word, mask)


def free_name(df: DataFrame, name: str) -> str:
    """name with so many underscores that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
