"""Suffix-array dedup: removes every byte covered by a string of WINDOW bytes that also starts anywhere else.

The column-wise multi-document construction inserts one symbol per string each round, from the right, and updates the order
of all suffixes (the collection's Burrows-Wheeler transform is the column of symbols in that order) and the common prefixes of
neighbours: equal symbols keep their order, and their new common prefix is one more than the least of those between them.
A suffix whose common prefix with a neighbour is at least WINDOW starts a repeated string.

Inserted into one transform, all texts would cost as many passes over it as the longest text has bytes. So the strings that
go in are aligned first: each window of WINDOW bytes names its least gram (of GRAM bytes, by hash, the leftmost of equals), and
windows of neighbouring starts with one such gram form a segment. Equal windows name equal grams at equal distances, so segments
lined up by their gram have equal windows in the same column, and only suffixes of one column need an order: a round costs
the number of strings, and the rounds are WINDOW + WINDOW - GRAM. Segments whose gram occurs once in the whole collection have
no partner and stay out; equal segments go in twice at most. Columns of a large batch lie in a file that is read once from
its start. A gram with more than MOST_STRINGS different segments is split: windows in four classes of distance have three
quarters of their bytes in common, and that core's hash joins the key. A gram with more than MOST_SPLIT, such as that of a notice with
as many different neighbours, is split down to single windows, which need no order: equal windows meet by a 128-bit hash in an
aggregate that combines before the shuffle, so no task holds all strings of a gram.

The same construction over words (32-bit hashes of them as symbols, windows of REPEAT_WORDS words) finds passages that are short in
bytes: n_repeat_words counts a document's words in runs of more than 50 that also stand anywhere else.

Defined results: null text counts as empty; texts shorter than WINDOW lose nothing; repeated rows are documents of their own
(so their text occurs elsewhere); null doc_ids are allowed; other columns are not read.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, maybe_in, narrowed, per_block, ragged, released, strings, written
from .quality import _SPACE

@dataclass(frozen=True)
class Shape:
    """What is compared: windows of so many symbols, routed by grams of so many (a power of two); bits of a symbol."""

    window: int
    gram: int
    bits: int

    @property
    def span(self) -> int:
        """Largest distance of a window's gram from its start."""
        return self.window - self.gram

    @property
    def quarter(self) -> int:
        return (self.span + 4) // 4


WINDOW, REPEAT_WORDS = 400, 51
BYTES, WORDS = Shape(WINDOW, 64, 8), Shape(REPEAT_WORDS, 16, 32)
MOST_STRINGS, MOST_SPLIT = 4096, 32_768
#: Strings that are built together, about; columns above COLUMN_BYTES go to a file.
BATCH, COLUMN_BYTES = 16_384, 64 << 20
QUARTER = BYTES.quarter
#: Bytes of text whose segments are found at once: arrays of eight times as many should stay in a cache.
PROFILE_BYTES = 1 << 20
#: Base of the hashes of grams and words, polynomials modulo 2 ** 64; odd, so that it has an inverse.
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, tuple[np.ndarray, ...]] = {}
_TABLE = np.random.default_rng(7).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeat_words long"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2 ** 64; those of a usual block are kept."""
    kept = _POWERS.get("kept")
    if kept is None or len(kept[0]) < n:
        kept = tuple(np.full(n, x, np.uint64) for x in (BASE, pow(BASE, -1, 2**64)))
        for x in kept:
            x[:1] = 1
            np.cumprod(x, out=x)
        if n <= 2 * PROFILE_BYTES:
            _POWERS["kept"] = kept
    return kept[0][:n], kept[1][:n]


def _mixed(code: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        code ^= code >> np.uint64(shift)
        code *= np.uint64(factor)
    code ^= code >> np.uint64(32)
    return code


def symbols(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts, one text after the other, and n + 1 offsets: their bytes, or hashes of their words."""
    if shape.bits == 8:
        return data, offsets
    space = _SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = ~space[first]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    up, down = powers(len(data))
    code = _TABLE[data]
    code *= up
    code[space] = 0
    return (_mixed(np.add.reduceat(code, at) * down[at]) >> np.uint64(32)).astype(np.uint32), np.searchsorted(at, offsets)


def gram_hashes(code: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram from each place on, as a difference of running sums; code: hashes of the symbols."""
    up, down = powers(len(code))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * up, out=total[1:])
    out = total[gram:] - total[:-gram]
    out *= down[: len(out)]
    return _mixed(out)


def segments(data: np.ndarray, offsets: np.ndarray, shape: Shape = BYTES) -> tuple[np.ndarray, ...]:
    """start, windows, distance of the gram from start, hash of the gram, for all segments of a block; n + 1 offsets of the texts."""
    count = np.maximum(0, np.diff(offsets) - shape.window + 1)
    if not count.sum():
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    code = gram_hashes(_TABLE[data] if shape.bits == 8 else (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), shape.gram)
    least = (code & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(code), dtype=np.uint64)
    width = 1
    while 2 * width <= shape.span + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if rest := shape.span + 1 - width:
        least = np.minimum(least[:-rest], least[rest:])
    end = offsets[:-1] + count  # of each text's windows; those behind it reach into the next text
    of = lambda place: np.searchsorted(offsets, place, "right") - 1
    new = np.flatnonzero(least[1:] != least[:-1]) + 1
    start = np.union1d(new[new < end[of(new)]], offsets[:-1][count > 0])
    windows = np.minimum(np.append(start[1:], len(least)), end[of(start)]) - start
    gram = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return start, windows, gram - start, code[gram], np.searchsorted(start, offsets)


def repeated(rows: list[tuple[int, int, int, bytes]], shape: Shape = BYTES) -> list[np.ndarray]:
    """rows: (key, windows, distance of the gram from the first window, bytes), by key. Of each, which windows start elsewhere too.

    Column 0 is the gram's place; a string covers columns -distance to windows - 1 - distance + shape.window - 1."""
    n = len(rows)
    key = np.array([r[0] for r in rows], np.int64)
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
    windows, left = np.array([r[1] for r in rows], np.int64), -np.array([r[2] for r in rows], np.int64)
    kind = np.dtype(f"<u{shape.bits // 8}")
    size = np.array([len(r[3]) for r in rows], np.int64) // kind.itemsize
    low, high = int(left.min()), int((left + size).max())
    raw = np.frombuffer(b"".join(r[3] for r in rows), kind)
    table = (high - low, n)
    out = np.zeros((n, int(windows.max())), bool)
    with contextlib.ExitStack() as held_open:
        if table[0] * n * kind.itemsize > COLUMN_BYTES:
            file = held_open.enter_context(tempfile.TemporaryFile())  # scratch of this task alone, made again if it is run again
            file.truncate(table[0] * n * kind.itemsize)
            columns = np.memmap(file, kind, "r+", shape=table)
        else:
            columns = np.zeros(table, kind)
        at = np.concatenate([[0], np.cumsum(size)])
        for i in range(n):  # rounds go from the last column to the first: the file holds them in this order
            stop = high - 1 - int(left[i])
            columns[stop - int(size[i]) + 1 : stop + 1, i] = raw[at[i] : at[i + 1]][::-1]
        enters, leaves = left + size - 1, left - 1
        by_enter = np.argsort(-enters, kind="stable")
        sorted_enter = -enters[by_enter]
        order, common, place = np.empty(0, np.int64), np.empty(0, np.int64), 0
        leaving = np.zeros(high - low + 2, bool)
        leaving[leaves - low + 1] = True
        for column in range(high - 1, low - 1, -1):
            if leaving[column - low + 1] and len(order):
                stay = np.flatnonzero(leaves[order] != column)
                if len(stay) < len(order):
                    common = _least_between(common, np.concatenate([[-1], stay[:-1]]), stay) if len(stay) else common[:0]
                    order = order[stay]
            more = int(np.searchsorted(sorted_enter, -column, "right"))
            new = by_enter[place:more]
            place = more
            held = np.concatenate([new, order])
            if not len(held):
                continue
            symbol = columns[high - 1 - column][held]
            own = group[held] << shape.bits | symbol
            if len(own) > 1 and (own[1:] < own[:-1]).any():
                turn = np.argsort(own, kind="stable")
                own = own[turn]
            else:
                turn = np.arange(len(own))
            old = turn - len(new)  # place in the former order; negative: just entered
            prefix = np.zeros(len(own), np.int64)
            same = np.flatnonzero(own[1:] == own[:-1]) + 1
            a, b = old[same - 1], old[same]
            prefix[same] = 1
            go_on = (a >= 0) & (b >= 0)
            prefix[same[go_on]] += _least_between(common, a[go_on], b[go_on])
            order, common = held[turn], prefix
            hit = common >= shape.window
            if hit.any():
                hit[:-1] |= hit[1:].copy()
                own = order[hit]
                window = column - left[own]
                inside = window < windows[own]
                out[own[inside], window[inside]] = True
    return [out[i, : windows[i]] for i in range(n)]


def _least_between(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(common[a + 1 .. b]) for pairs a < b."""
    out = common[b].copy()
    far = np.flatnonzero(b > a + 1)
    if len(far):
        cuts = np.empty(2 * len(far), np.int64)
        cuts[::2], cuts[1::2] = a[far] + 1, b[far]
        out[far] = np.minimum(out[far], np.minimum.reduceat(common, cuts)[::2])
    return out


def _profiles(docs: DataFrame, shape: Shape) -> DataFrame:
    """One row a document: doc_id, fp, and of its segments start, windows, dist, gram, body (hash of the bytes)."""

    def block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        data, offsets = symbols(data, offsets, shape)
        start, windows, dist, gram, at = segments(data, offsets, shape)
        raw, unit = memoryview(np.ascontiguousarray(data).view(np.uint8)), shape.bits // 8
        ends = start + windows + shape.window - 1
        body = np.array([xxhash.xxh3_64_intdigest(raw[a:b], seed=d) for a, b, d in zip((start * unit).tolist(), (ends * unit).tolist(), dist.tolist())], np.uint64)
        start = start - np.repeat(offsets[:-1], np.diff(at))
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (start, windows.astype(np.int32), dist.astype(np.int32), gram.view(np.int64), body.view(np.int64))]
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), *lists], names=["doc_id", "fp", "start", "windows", "dist", "gram", "body"])

    return per_block(docs, block, "doc_id long, fp long, start array<long>, windows array<int>, dist array<int>, gram array<long>, body array<long>", PROFILE_BYTES)


def _fetched(docs: DataFrame, shape: Shape) -> DataFrame:
    """docs: want (list of segments), text. The strings of the segments by key; of grams with more than MOST_SPLIT strings windows'
    hashes instead (windows is 0)."""

    unit, window, quarter = shape.bits // 8, shape.window, shape.quarter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for want, text in zip(batch.column(0), batch.column(1).to_pylist()):
                text, out = text.encode(), []
                if unit > 1:
                    text = symbols(np.frombuffer(text, np.uint8), np.array([0, len(text)]), shape)[0].tobytes()
                for w in want.as_py():
                    part = lambda a, b: text[(w["start"] + a) * unit : (w["start"] + b) * unit]  # noqa: B023, E731
                    if xxhash.xxh3_64_intdigest(part(0, w["windows"] - 1 + window), seed=w["dist"]) != w["body"] & (2**64 - 1):
                        continue  # another text with this hash
                    if w["strings"] > MOST_SPLIT:
                        for i in range(w["windows"]):
                            digest = xxhash.xxh3_128_digest(part(i, i + window), seed=w["dist"] - i)
                            out.append((w["gram"], w["gram"], w["body"], w["copies"], i, 0, 0, digest))
                        continue
                    if w["strings"] <= MOST_STRINGS:
                        parts = [(w["gram"], 0, w["windows"])]
                    else:
                        parts = []
                        for q in range(4):  # windows whose gram is q * quarter to (q + 1) * quarter - 1 behind their start
                            first, stop = max(0, w["dist"] - (q + 1) * quarter + 1), min(w["windows"], w["dist"] - q * quarter + 1)
                            if first < stop:
                                core = w["dist"] - q * quarter
                                key = xxhash.xxh3_64_intdigest(part(max(0, core), core - quarter + 1 + window), seed=(w["gram"] + q) & (2**64 - 1))
                                parts.append((key - 2**64 if key >= 2**63 else key, first, stop))
                    for key, first, stop in parts:
                        out.append((key, w["gram"], w["body"], w["copies"], first, stop - first, w["dist"] - first, part(first, stop - 1 + window)))
                kinds = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.binary()]
                columns = zip(*out) if out else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "gram", "body", "copies", "first", "windows", "dist", "bytes"])

    return docs.mapInArrow(run, "key long, gram long, body long, copies int, first int, windows int, dist int, bytes binary")


def _built(strings_: DataFrame, shape: Shape) -> DataFrame:
    """gram, body, first and stop window: stretches of windows that also start elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def build() -> pa.RecordBatch:
            rows = [r for r in held for _ in range(r[3])]
            out = []
            for r, hit in zip(rows, repeated([(r[0], r[5], r[6], r[7]) for r in rows], shape)):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
                out += [(r[1], r[2], r[4] + int(a), r[4] + int(b)) for a, b in zip(edge[::2], edge[1::2])]
            out = list(dict.fromkeys(out))
            columns = zip(*out) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 2)], names=["gram", "body", "first", "stop"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if len(held) >= BATCH and held[-1][0] != row[0]:
                    yield build()
                    held = []
                held.append(row)
        if held:
            yield build()
        released()

    return strings_.mapInArrow(run, "gram long, body long, first int, stop int")


def repeated_spans(docs: DataFrame, shape: Shape = BYTES) -> DataFrame:
    """docs: doc_id, text (not null), fp, rk (hash of both). These but text, and spans (array of struct from, till: symbols), of documents
    that repeat something."""
    profile = written(_profiles(docs.select("doc_id", "text", "fp"), shape), "segments")
    zipped = F.arrays_zip("start", "windows", "dist", "gram", "body")
    each = profile.select("doc_id", "fp", F.explode(zipped).alias("s")).select("doc_id", "fp", "s.*")
    classes = each.groupBy("gram", "body").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("doc_id", "fp").alias("rk"), "start", "windows", "dist")).alias("at"))
    # Sums by gram come by an aggregate and go back by a join, which Spark may split where a gram is hot; a window would hold its rows in one task.
    grams = classes.groupBy("gram").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("strings")).where("all > 1")
    classes = classes.join(grams, "gram")
    classes = written(classes.select("gram", "body", F.least("n", F.lit(2)).cast("int").alias("copies"), "strings", "at.*"), "classes")
    want = classes.groupBy("rk").agg(F.collect_list(F.struct("gram", "body", "copies", "strings", "start", "windows", "dist")).alias("want"))  # of one document each
    texts = maybe_in(docs.select("rk", "text"), "rk", classes.select("rk"))
    bodies = written(_fetched(want.join(texts, "rk").dropDuplicates(["rk"]).select("want", "text"), shape), "strings")
    built = _built(bodies.where("windows > 0").repartition("key").sortWithinPartitions("key", "gram", "body", "first"), shape)
    single = bodies.where("windows = 0").select("gram", "body", "copies", "first", "bytes")
    again = single.groupBy("bytes").agg(F.sum("copies").alias("all")).where("all > 1").select("bytes")
    single = single.join(again, "bytes").select("gram", "body", "first", (F.col("first") + 1).alias("stop"))
    found = written(built.unionByName(single), "repeats")
    dropped(bodies)
    hits = each.select("doc_id", "fp", "start", "gram", "body").join(found, ["gram", "body"])
    span = F.struct((F.col("start") + F.col("first")).alias("from"), (F.col("start") + F.col("stop") - 1 + shape.window).alias("till"))
    return hits.groupBy("doc_id", "fp").agg(F.collect_set(span).alias("spans")).withColumn("rk", F.xxhash64("doc_id", "fp"))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted union of spans; those that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: bytes, bytes removed, maximal runs removed, digest of the bytes that are left; words in runs of
    REPEAT_WORDS words that stand elsewhere, too."""
    docs = narrowed(df, id_col, text_col).withColumn("fp", F.xxhash64("text")).withColumn("rk", F.xxhash64("doc_id", "fp"))
    none = F.lit(None)
    own = [F.col("doc_id").alias("doc"), F.col("fp").alias("own")]
    found, of_words = repeated_spans(docs, BYTES), repeated_spans(docs, WORDS)
    kind = found.schema["spans"].dataType
    found = found.select("rk", *own, "spans", none.cast(kind).alias("words")).unionByName(of_words.select("rk", *own, none.cast(kind).alias("spans"), F.col("spans").alias("words")))
    spans = written(found.groupBy("rk", "doc", "own").agg(F.first("spans", ignorenulls=True).alias("spans"), F.first("words", ignorenulls=True).alias("words")), "spans")
    # Documents that surely repeat nothing aren't shuffled.
    inside = maybe_in(docs, "rk", spans)
    inside = inside.join(spans, (inside["rk"] == spans["rk"]) & inside["doc_id"].eqNullSafe(spans["doc"]) & (inside["fp"] == spans["own"]), "left").select("doc_id", "text", "spans", "words")
    joined = maybe_in(docs, "rk", spans, other=True).select("doc_id", "text", none.cast(kind).alias("spans"), none.cast(kind).alias("words")).unionByName(inside)

    def block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        raw, out = data.tobytes(), []
        for i, own in enumerate(rows.column(2)):
            text = raw[offsets[i] : offsets[i + 1]]
            runs = united([(s["from"], s["till"]) for s in own.as_py() or []])
            digest, last = hashlib.sha256(), 0
            for a, b in runs:
                digest.update(text[last:a])
                last = b
            digest.update(text[last:])
            words = united([(s["from"], s["till"]) for s in rows.column(3)[i].as_py() or []])
            out.append((len(text), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), sum(b - a for a, b in words)))
        return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 3 + [pa.string(), pa.int64()]))], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return per_block(joined, block, _SCHEMA)
