"""Phrase collocations by passes over phrase lengths, with PCY / DHP bucket counts and Apriori pruning.

Pass k counts phrases of k words exactly, and counts phrases of k + 1 words into BUCKETS buckets. A bucket that reaches the least count
sets its bit; the bits go to all tasks of the next pass, with the bits of a second table that the frequent phrases of k words set by their
hash. A phrase of k + 1 words is counted exactly only if its bucket's bit and those of its first and last k words are set
(and it is put into the next pass's buckets only if both its parts of k + 1 words were). Both tables have a fixed number of bits, so what is
broadcast doesn't grow; they let too many phrases pass, never too few, and the count decides.

A task counts its buckets in one array of bytes that stop at the least count: a bucket's sum reaches it if and only if the sum of
these does. Words and phrases are counted over a task's blocks before they are shuffled, by language and phrase.

Defined results: null text counts as empty, null lang as "und"; repeated rows count each time; equal scores go by count, then by
phrase in UTF-8 order; a language without phrases has no rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, bounded, dropped, ragged, strings, written

LEAST = 100
LONGEST = 5
FIRST = 2000
#: Buckets of a pass and bits of the table of frequent phrases; 2 MB each where they are sent to all tasks.
BUCKETS = 1 << 24
#: Buckets of a row in which a task's counts are shuffled, 65,536 at most, and rows of a batch.
SLICE = 1 << 16
SLICES = 32
#: Rows of counts that a task keeps before it lets them go.
MOST_ROWS = 400_000
#: Parts of a language's phrases that are ranked apart before the rest.
PARTS = 64
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)  # characters that end a piece
_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_BREAKS = _ENDS.copy()
_BREAKS[[9, 32]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_KIND = "lang string, phrase string, slice int, n long, counts binary"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: distinct words, which one stands at each place, the number of its piece, the text it is in."""
    data = _LOWER[data]
    breaks = _BREAKS[data]
    opens = np.zeros(len(data), bool)
    opens[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.append(True, breaks[:-1])[: len(data)] | opens
    starts = np.flatnonzero(~breaks & before)
    after = np.append(breaks[1:] | opens[1:], True)[: len(data)]
    stops = np.flatnonzero(~breaks & after) + 1
    lengths = stops - starts
    ends = np.cumsum(lengths)
    words = strings(data[ragged(starts, lengths)], ends - lengths, int(ends[-1]) if len(ends) else 0).dictionary_encode()
    piece = np.cumsum(_ENDS[data] | opens)
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece[starts], np.searchsorted(offsets, starts, "right") - 1


def text_hashes(values: pa.Array) -> np.ndarray:
    """A hash of 64 bits of each value, the same in all processes."""
    return pd.util.hash_array(np.array(values.to_pylist(), object), categorize=False) if len(values) else np.zeros(0, np.uint64)


def mixed(start: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hash of a language's phrases from the hashes of the language and of its words, by place."""
    out = start.copy()
    for own in words:
        out = (out ^ own) * _FACTOR
        out ^= out >> np.uint64(29)
    return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes & np.uint64(buckets - 1)).astype(np.int64)


def _set(bits: np.ndarray | None, places: np.ndarray) -> np.ndarray:
    """Whether the places' bits are set; without a table they all are."""
    return np.ones(len(places), bool) if bits is None else (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _distinct(parts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples of numbers at one place of each part, which aren't empty, and how often each comes. A tuple is one number of
    62 bits; where that isn't enough, the numbers so far are made dense, so nothing is hashed."""
    key, most = parts[0], int(parts[0].max()) + 1
    for own in parts[1:]:
        wide = int(own.max()) + 1
        if most * wide > 1 << 62:
            made, key = np.unique(key, return_inverse=True)
            most = len(made)
        key, most = key * wide + own, most * wide
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return [p[first] for p in parts], count


class _Counts:
    """Counts by language and phrase of a task's blocks, summed up before they leave it."""

    def __init__(self, most: int = MOST_ROWS):
        self.tables, self.rows, self.most = [], 0, most

    def add(self, langs: pa.Array, phrases: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.tables.append(pa.table({"lang": langs, "phrase": phrases, "n": pa.array(n, pa.int64())}))
        self.rows += len(n)
        if self.rows > self.most:
            whole = self.summed()
            self.tables, self.rows = [whole], whole.num_rows
            if self.rows > self.most // 2:
                yield from self.left()

    def summed(self) -> pa.Table:
        return pa.concat_tables(self.tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])

    def left(self) -> Iterator[pa.RecordBatch]:
        for batch in self.summed().to_batches(max_chunksize=50_000) if self.tables else ():
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), none.cast(pa.int32()), batch.column(2), none.cast(pa.binary())], names=[x.split()[0] for x in _KIND.split(", ")])
        self.tables, self.rows = [], 0


def _scan(batches: Iterator[pa.RecordBatch], length: int, buckets: int, least: int, more: bool, frequent: np.ndarray | None, hot: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Pass length over texts: counts of its phrases that may be frequent, and if more the bucket counts of the next pass's.

    In pass 1 a row without a phrase has each language's words."""
    counts, next_ = _Counts(), np.zeros(buckets if more else 0, np.uint8)
    for rows, data, offsets in blocks(batches):
        names = rows.column(rows.schema.get_field_index("lang")).dictionary_encode()
        words, which, piece, text = words_of(data, offsets)
        lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
        own, seeds = text_hashes(words), text_hashes(names.dictionary)
        places = len(which)

        def hashes(k: int, at: np.ndarray) -> np.ndarray:
            return mixed(seeds[lang[at]], [own[which[at + j]] for j in range(k)])

        at = np.flatnonzero(piece[: places - length + 1] == piece[length - 1 :]) if places >= length else np.zeros(0, np.int64)
        if length > 1:
            if length == 2:  # a word's own bit is looked up once a distinct word of a language
                shorter = _set(frequent, _bucket(mixed(seeds[lang], [own[which]]), buckets))
            else:
                shorter = np.zeros(places, bool)
                part = np.flatnonzero(piece[: places - length + 2] == piece[length - 2 :]) if places >= length - 1 else at
                shorter[part] = _set(frequent, _bucket(hashes(length - 1, part), buckets))
            at = at[shorter[at] & shorter[at + 1]]
            at = at[_set(hot, _bucket(hashes(length, at), buckets))]
        if more and len(at):
            whole = np.zeros(places + 1, bool)
            whole[at] = True
            longer = at[whole[at + 1]]
            longer = longer[longer + length < places]
            longer = longer[piece[longer] == piece[longer + length]]
            found, n = np.unique(_bucket(hashes(length + 1, longer), buckets), return_counts=True)
            next_[found] = np.minimum(next_[found] + n, least)
        if len(at):
            parts, n = _distinct([lang[at], *(which[at + j] for j in range(length))])
            texts = [words.take(pa.array(p)) for p in parts[1:]]
            phrases = texts[0] if length == 1 else pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.binary()))
            yield from counts.add(names.dictionary.take(pa.array(parts[0])), phrases.cast(pa.string()), n)
        if length == 1 and places:
            n = np.bincount(lang, minlength=len(names.dictionary))
            yield from counts.add(names.dictionary, pa.nulls(len(n), pa.string()), n)
    yield from counts.left()
    for slices, packed in _packed(next_):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(slices), pa.string()), pa.nulls(len(slices), pa.string()), slices, pa.array(np.zeros(len(slices), np.int64)), packed], names=[x.split()[0] for x in _KIND.split(", ")])


def _packed(counts: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Numbers and bytes of the slices of counts that aren't all zero: where a quarter of a slice's buckets or more have a count, all
    counts (behind a 0), else the buckets that have one and their counts (behind a 1)."""
    found = np.flatnonzero(counts)
    wide = min(SLICE, max(1, len(counts)))
    which, first = np.unique(found // wide, return_index=True)
    ends = np.append(first[1:], len(found))
    for k in range(0, len(which), SLICES):
        out = []
        for number, a, b in zip(which[k : k + SLICES], first[k : k + SLICES], ends[k : k + SLICES]):
            if 4 * (b - a) >= wide:
                out.append(b"\0" + counts[number * wide : (number + 1) * wide].tobytes())
            else:
                out.append(b"\1" + (found[a:b] % wide).astype("<u2").tobytes() + counts[found[a:b]].tobytes())
        yield pa.array(which[k : k + SLICES], pa.int32()), pa.array(out, pa.binary())


def _add(sums: np.ndarray, raw: bytes) -> None:
    """Adds a slice's counts of one task to sums."""
    if raw[0] == 0:
        sums += np.frombuffer(raw, np.uint8, offset=1)
    else:
        n = (len(raw) - 1) // 3
        sums[np.frombuffer(raw, "<u2", n, 1)] += np.frombuffer(raw, np.uint8, n, 1 + 2 * n)


def _bits(rows: DataFrame, buckets: int, least: int) -> np.ndarray:
    """Bits of the buckets whose counts of all tasks reach least; buckets / 8 bytes on the driver."""
    wide = min(SLICE, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(k: int, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

        now, sums = None, None
        for batch in batches:
            for k, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != now:
                    if sums is not None:
                        yield out(now, sums)
                    now, sums = k, np.zeros(wide, np.int64)
                _add(sums, own)
        if sums is not None:
            yield out(now, sums)

    table = np.zeros(-(-buckets // 8), np.uint8)
    for row in rows.where("slice is not null").select("slice", "counts").repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "slice int, bits binary").collect():  # buckets / 8 bytes
        own = np.frombuffer(row["bits"], np.uint8)
        table[row["slice"] * wide // 8 : row["slice"] * wide // 8 + len(own)] = own
    return table


def _marked(phrases: DataFrame, buckets: int) -> np.ndarray:
    """Bits that phrases (lang, phrase) set by their hash in a table of buckets bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(buckets, np.uint8)
        for batch in batches:
            split = pc.split_pattern(batch.column(1), " ")
            length = pc.list_value_length(split).to_numpy(zero_copy_only=False)
            flat, ends = text_hashes(split.flatten().cast(pa.binary())), np.cumsum(length)
            seeds = text_hashes(batch.column(0))
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                table[_bucket(mixed(seeds[own], [flat[(ends - length)[own] + j] for j in range(k)]), buckets)] = 1
        for slices, packed in _packed(table):
            yield pa.RecordBatch.from_arrays([slices, packed], names=["slice", "counts"])

    return _bits(phrases.mapInArrow(run, "slice int, counts binary"), buckets, 1)


def frequent_phrases(df: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words and n (count) of all phrases of up to longest words that occur least times or more; and lang and n of each
    language's words. buckets: a power of two, 8 at least; least: 255 at most, as counts of buckets are bytes."""
    assert 0 < least < 256 and buckets >= 8 and not buckets & (buckets - 1)
    spark = df.sparkSession
    bounded(spark)
    docs = df.select(F.coalesce(df[lang_col].cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    found, totals, frequent, hot = [], None, None, None
    for length in range(1, longest + 1):
        sent = [None if b is None else spark.sparkContext.broadcast(b) for b in (frequent, hot)]

        def run(batches, length=length, sent=tuple(sent)):
            yield from _scan(batches, length, buckets, least, length < longest, *(b and b.value for b in sent))

        rows = written(docs.mapInArrow(run, _KIND), f"pass{length}")
        summed = rows.where("slice is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        own = written(summed.where(f"phrase is null or n >= {least}").withColumn("words", F.lit(length)), f"phrases{length}")
        if length == 1:
            totals = own.where("phrase is null").select("lang", "n")
        found.append(own.where("phrase is not null"))
        if length < longest:
            frequent, hot = _marked(found[-1].select("lang", "phrase"), buckets), _bits(rows, buckets, least)
        dropped(rows)
        for b in sent:
            if b is not None:
                b.destroy()
    return reduce(DataFrame.unionByName, found), totals


def collocations(df: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, buckets: int = BUCKETS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first phrases of 2 words and more by score: lang, rank, phrase, a, l, r, n, score.

    A phrase of count a cut into parts of counts l and r scores floor(1000 * a * n / (l * r)), n being the language's words; the cut
    with the least score counts, the first of equal ones. Phrases that stand in a longer one of equal count are left out: if any is, one
    of one word more is, as counts only fall with length. All numbers are decimals of 38 digits until they are divided."""
    counts, totals = frequent_phrases(df, least, longest, buckets, lang_col, text_col)
    longer = counts.where("words > 1")
    word = F.split("phrase", " ")
    size = F.size(word)
    inner = longer.where("words > 2").select("lang", F.col("n").alias("over"), F.explode(F.array(F.array_join(F.slice(word, F.lit(1), size - 1), " "), F.array_join(F.slice(word, F.lit(2), size - 1), " "))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    kept = longer.join(covered, ["lang", "phrase"], "left").where("over is null or over < n").select("lang", "phrase", F.col("n").alias("a"))
    cut = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumn("left", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice(word, F.col("k") + 1, size), " "))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    sides = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(14,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = sides.withColumn("score", score.cast("long")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score")
    # A language may have very many phrases: its first ones are among the first of each of PARTS parts of them.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(f"rank <= {first}")
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(f"rank <= {first}")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
