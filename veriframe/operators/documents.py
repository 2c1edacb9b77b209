"""Documents of many rows: a key's lines in order, as bounded parts, as files or as a digest. No array or string grows with the data
but the one that a caller asks for by name (joined_text)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a part, about; one longer line is a part of its own.
PART = 1 << 20


def _ordered(rows: DataFrame, keys: list[str], order: list[str], more: list[str]) -> DataFrame:
    """rows' columns sorted by keys and order over ranges, so that a key with very many rows lies in several tasks."""
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    own = rows.select(*dict.fromkeys((*keys, *order, *more)))
    return own.repartitionByRange(*by).sortWithinPartitions(*by) if by else own.coalesce(1)


def document_parts(rows: DataFrame, keys: list[str], order: list[str], line: str = "line", separator: str = "\n", size: int = PART) -> DataFrame:
    """keys, part and text: each key's lines (not null) in order, put together to parts of about size characters. A document is its parts' texts in
    order of part, joined by separator. Parts are made where the rows lie after the sort, so none of a key's tasks sees more than its range."""
    named = _ordered(rows.where(F.col(line).isNotNull()), keys, order, [line]).withColumn("p__", F.spark_partition_id())
    kinds = ", ".join(f"`{c}` {dict(named.dtypes)[c]}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, length, number = None, [], 0, 0

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [pa.array([v], batch.schema.field(c).type) for c, v in zip(keys, now[:-1])]
            return pa.RecordBatch.from_arrays([*own, pa.array([(now[-1] << 32) + number], pa.int64()), pa.array([separator.join(held)], pa.string()), pa.array([len(held)], pa.int64())], names=[*keys, "part", "text", "lines"])

        last = None
        for batch in batches:
            last = batch
            for *own, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, "p__", line))):
                if held and (own != now or length >= size):
                    yield out(batch)
                    held, length, number = [], 0, number + 1
                now = own
                held.append(text)
                length += len(text)
        if held:
            yield out(last)

    return named.mapInArrow(run, ", ".join(filter(None, [kinds, "part long, text string, lines long"])))


def document_digests(rows: DataFrame, keys: list[str], order: list[str], line: str = "line", separator: str = "\n") -> DataFrame:
    """keys, lines, bytes and sha256 of each key's document (UTF-8). The state is one digest: parts stream through it in order."""
    parts = document_parts(rows, keys, order, line, separator)
    named = parts.repartition(*map(F.col, keys)) if keys else parts.coalesce(1)
    named = named.sortWithinPartitions(*keys, "part")
    kinds = ", ".join(f"`{c}` {dict(named.dtypes)[c]}" for c in keys)
    glue = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, lines, size = None, None, 0, 0

        def out(schema: pa.Schema) -> pa.RecordBatch:
            own = [pa.array([v], schema.field(c).type) for c, v in zip(keys, now)]
            return pa.RecordBatch.from_arrays([*own, pa.array([lines], pa.int64()), pa.array([size], pa.int64()), pa.array([state.hexdigest()])], names=[*keys, "lines", "bytes", "sha256"])

        schema = None
        for batch in batches:
            schema = batch.schema
            for *own, text, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, "text", "lines"))):
                if state is None or own != now:
                    if state is not None:
                        yield out(schema)
                    now, state, lines, size = own, hashlib.sha256(), 0, 0
                else:
                    state.update(glue)
                    size += len(glue)
                raw = text.encode()
                state.update(raw)
                lines, size = lines + n, size + len(raw)
        if state is not None:
            yield out(schema)

    return named.mapInArrow(run, ", ".join(filter(None, [kinds, "lines long, bytes long, sha256 string"])))


def joined_text(rows: DataFrame, keys: list[str], order: list[str], line: str = "line", separator: str = "\n") -> DataFrame:
    """keys and text: each key's document as one value, for readers that want it so; it has to fit into one."""
    parts = document_parts(rows, keys, order, line, separator)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"])
    return parts.groupBy(*keys).agg(F.array_join(texts, separator).alias("text"))


def write_lines(rows: DataFrame, path: str, keys: list[str], order: list[str], line: str = "line") -> None:
    """Writes each key's lines in order to files of its own folder (key=value); files' names are in order too, so a document is its files one
    behind the other. Lines stream from the sort to the file. Without keys the files lie in path."""
    named = _ordered(rows.where(F.col(line).isNotNull()), keys, order, [line]).select(*keys, F.col(line).alias("value"))
    named.write.partitionBy(*keys).text(path)
