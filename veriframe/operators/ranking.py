"""Order-dependent operators: admission, greedy batches, numbering, latest and first-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import GLOBAL_CAP, TYPE_CAPS


def capped_admission(ready: DataFrame, running: DataFrame | None = None, cap: int = GLOBAL_CAP, type_caps: dict[str, int] = TYPE_CAPS, order: str = "job_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """Ready jobs (type, and order) that may start: of the first max(4 * cap, 16), each while its type and all together have room.

    A job whose type is full is passed over; running: (keys, type, n) of jobs that run already. The candidates are the first few
    in order, so ranking them is bounded by the cap, whatever the table's size."""
    prefix = max(4 * cap, 16)
    if keys:
        near = ready.withColumn("p__", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("p__") <= prefix).drop("p__")
    else:
        near = ready.orderBy(order).limit(prefix)
    used_all, used = F.lit(0), F.lit(0)
    if running is not None:
        own = running.select(*keys, "type", F.col("n").alias("used__"))
        total = running.groupBy(*keys).agg(F.sum("n").alias("all__"))
        near = near.join(own, [*keys, "type"], "left")
        near = near.join(total, list(keys), "left") if keys else near.join(total, F.lit(True), "left")
        used_all, used = F.coalesce("all__", F.lit(0)), F.coalesce("used__", F.lit(0))
    room = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in type_caps.items() for x in kv)), F.col("type")), F.lit(cap))
    by = [F.col(k) for k in keys] or [F.lit(0)]
    own_rank = F.row_number().over(Window.partitionBy(*by, "type").orderBy(order))
    out = near.withColumn("r__", own_rank).where(F.col("r__") <= room - used)
    out = out.withColumn("g__", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("g__") <= F.lit(cap) - used_all)
    return out.select(*ready.columns)


def greedy_batches(items: DataFrame, key: str, order: str, most_items: int = 20, target_tokens: int = 12_000, most_bytes: int = 262_144) -> DataFrame:
    """items (key, order, tokens, bytes) with batch: numbers from 1 within each key. In order, a batch closes before an item with
    which it would have too many items, tokens or bytes; an item of target_tokens or more also closes its own batch.

    A fold in one pass over each key's rows, in order, by Arrow batches: the state is a few numbers, so a key of any size streams."""
    import numpy as np
    import pyarrow as pa

    columns = [key, order, "tokens", "bytes"]

    def run(batches):
        last, number, n, tokens, bytes_ = object(), 0, 0, 0, 0
        for rows in batches:
            out = np.empty(rows.num_rows, np.int64)
            for i, (k, t, b) in enumerate(zip(*(rows.column(c).to_pylist() for c in (key, "tokens", "bytes")))):
                t, b = t or 0, b or 0
                if k != last:
                    last, number, n, tokens, bytes_ = k, 1, 0, 0, 0
                elif n and (n >= most_items or tokens + t > target_tokens or bytes_ + b > most_bytes):
                    number, n, tokens, bytes_ = number + 1, 0, 0, 0
                out[i] = number
                n, tokens, bytes_ = n + 1, tokens + t, bytes_ + b
                if t >= target_tokens:  # the next item finds the batch full
                    n = most_items
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out)], names=[*rows.schema.names, "batch"])

    schema = items.select(*columns).schema.add("batch", "long")
    return items.select(*columns).repartition(F.col(key)).sortWithinPartitions(key, order).mapInArrow(run, schema)


def reshape_batches(batches: DataFrame, least: int = 3, order: str = "batch", keys: tuple[str, ...] = ()) -> DataFrame:
    """batches (keys, batch, items array): those of fewer than least items become one batch an item, in front of the others; numbered
    from 1 within keys (a phase, say)."""
    small = batches.where(F.size("items") < least).select(*keys, F.lit(0).alias("late__"), order, F.posexplode("items").alias("pos__", "i")).select(*keys, "late__", order, "pos__", F.array("i").alias("items"))
    large = batches.where(F.size("items") >= least).select(*keys, F.lit(1).alias("late__"), order, F.lit(0).alias("pos__"), "items")
    place = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("late__", order, "pos__"))  # as many rows as one phase has batches
    return small.unionByName(large).withColumn("ordinal", place).select(*keys, "ordinal", "items")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in order; partial maxima are built before the shuffle."""
    top = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*keys).agg(top.alias("r__")).select("r__.*")


def latest_in(attempts: Column) -> Column:
    return F.try_element_at(attempts, F.lit(-1))


def page(rows: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(order).offset(offset).limit(limit)


def first_n(rows: DataFrame, key: str, column: str, n: int) -> DataFrame:
    """key and first: its n least distinct values as a sorted array. Ranks are cut to n before the shuffle, so none gathers more."""
    few = rows.where(F.col(column).isNotNull()).select(key, column).distinct().withColumn("r__", F.row_number().over(Window.partitionBy(key).orderBy(column))).where(F.col("r__") <= n)
    kept = few.groupBy(key).agg(F.array_sort(F.collect_list(column)).alias("first"))
    return rows.select(key).distinct().join(kept, key, "left").select(key, F.coalesce("first", F.array().cast(kept.schema["first"].dataType)).alias("first"))


def chain(rows: DataFrame, start: str | None, key: str = "checkpoint_id", previous: str = "previous_checkpoint_id", until: str | None = None) -> DataFrame:
    """rows on the chain of previous keys from start on, with depth from 0, to its end or to where it meets itself; with until (a
    condition on rows), at least to the first row behind start that meets it, and at most to its end.

    Pointers double each round, so a chain of n rows takes as many rounds as n has binary digits."""
    from .graph import Found, stored

    jump, step = stored(rows.where(F.col(previous).isNotNull()).select(F.col(key).alias("id"), F.col(previous).alias("to"))), 1
    found = Found(stored(rows.where(F.col(key) == start).select(F.col(key).alias("id")).distinct().withColumn("depth", F.lit(0))))
    while True:
        on = found.all()
        more = on.join(jump, "id").groupBy(F.col("to").alias("id")).agg((F.min("depth") + step).alias("depth"))
        more = stored(more.join(on.select("id"), "id", "left_anti"))
        if more.isEmpty():
            break
        found.add(more)
        if until is not None and not rows.where(until).select(F.col(key).alias("id")).join(more, "id", "left_semi").isEmpty():
            break
        jump, step = stored(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").select("id", F.col("further").alias("to")), instead=jump), 2 * step
    return rows.join(found.all().withColumnRenamed("id", key), key)


def latest_complete_by_phase(rows: DataFrame, head: str) -> DataFrame:
    """Of the chain from head, for each phase the first complete checkpoint."""
    on = chain(rows, head).where("status = 'complete'")
    return on.groupBy("phase").agg(F.min_by("checkpoint_id", "depth").alias("checkpoint_id"))


def last_complete(rows: DataFrame, before: str | None) -> DataFrame:
    """The first complete checkpoint on the chain behind before; without before, or where that has none, the newest complete one."""
    if before is not None:
        found = chain(rows, before, until="status = 'complete'").where("status = 'complete' and depth > 0").orderBy("depth").limit(1).drop("depth")
        if not found.isEmpty():
            return found
    return rows.where("status = 'complete'").orderBy(F.desc("ordinal")).limit(1)
