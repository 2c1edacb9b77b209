"""Benchmark decontamination: n-gram seeds join documents to test items, Smith-Waterman alignment scores them.

Words are runs of letters and digits in lower case. Seeds are the items' runs of SEED_WORDS words, all of them: a passage
that many documents share has common seeds only, so no seed is left out for its count. One pass finds the seeds in each
document, opens a window of the item's length and a margin about each, joins overlapping ones, and aligns the item with the
window (match MATCH, mismatch and gap -LOSS; every row of the table for many windows at once). The score is the best local
alignment's value over that of the item against itself; from LEAST_SCORE on the document holds the item.

Common seeds open many windows. Those that can't reach LEAST_SCORE are found without a table: words of the item count
MATCH, others -LOSS, and no alignment is worth more than the best stretch of that. Neither does an alignment that reaches
it span more than SPAN words a word of the item, so long windows are cut into overlapping ones that hold each such span.

The join goes by the benchmark's size, which is measured: items of BLOCK_BYTES of text together at most are broadcast, with
seeds and words, to one pass over the documents. A larger benchmark goes two ways, both with all seeds, so nothing is lost. The documents'
seeds are counted; items whose seeds all lie in COMMON documents at most are joined by shuffled seeds, in at most COMMON rows a seed
of an item. An item with a more common seed would be paired with most documents; such items are broadcast, about PASS_BYTES of text at
a time, each time to one pass over the documents, as a small benchmark is. So their passes grow with their bytes, and memory doesn't.

Defined results: null and empty texts and items match nothing, as do items of fewer words than a seed unless the document
holds just these words in a row; repeated rows each give their rows; null ids stay null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, blocks, bounded, dropped, flat, free_name, maybe_in, narrowed, per_block, ragged, strings, written

SEED_WORDS = 3
MARGIN = 8
MATCH, LOSS = 2, 1
LEAST_SCORE = 0.5
BLOCK_BYTES = 4 << 20
#: Items with a seed of more than COMMON documents aren't joined by seeds but broadcast, about PASS_BYTES of text in each pass.
COMMON, PASS_BYTES = 10_000, 4 << 20
#: Rows of one seed that a task should get; the busiest seed's count by this gives the number of salts, MOST_SALTS at most.
SALT_ROWS, MOST_SALTS = 100_000, 256
#: Cells of alignment tables that are held at once.
MOST_CELLS = 4_000_000
#: Windows that are opened at once, but for those of one text.
MOST_WINDOWS = 1_000_000
#: An alignment of m matches over s words is worth at most MATCH * m - LOSS * (s - m), and m is the item's length at most.
SPAN = (MATCH + LOSS - MATCH * LEAST_SCORE) / LOSS
SCHEMA = "doc_id long, item_id long, score double, start_word long, end_word long"
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of lower-cased texts, and the n + 1 word offsets of the texts."""
    data, offsets = flat(pc.utf8_lower(texts.cast(pa.large_string())))
    word = _WORD[data]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = word[first]
    at = np.flatnonzero(starts)
    kept = np.cumsum(word) - word
    return strings(data[word], kept[at], int(word.sum())).dictionary_encode(), np.searchsorted(at, offsets)


class Items:
    """Test items: vocabulary, words and seeds."""

    def __init__(self, ids: list, texts: list[str]):
        coded, at = words_of(pa.array(texts, pa.string()))
        full = np.diff(at) > 0
        self.ids = [i for i, f in zip(ids, full) if f]
        self.vocabulary = coded.dictionary
        self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.append(at[:-1][full], at[-1])
        self.length = np.diff(self.at)
        # An item of one or two words is a seed of its own length.
        self.seeds = {}
        for n in range(1, SEED_WORDS + 1):
            code, place = self.codes(self.words, n)
            item = np.searchsorted(self.at, place, "right") - 1
            fits = place + n <= self.at[item + 1] if len(item) else np.empty(0, bool)
            fits &= (self.length[item] == n) if n < SEED_WORDS else (self.length[item] >= n)
            code, place, item = code[fits], place[fits], item[fits]
            order = np.argsort(code, kind="stable")
            self.seeds[n] = (code[order], item[order], (place - self.at[item])[order])
        self.keys = {n: np.unique(s[0]) for n, s in self.seeds.items()}
        self.members = np.unique(np.repeat(np.arange(len(self.ids)), self.length) * len(self.vocabulary) + self.words)

    def codes(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all runs of n known words, and where they start."""
        size = len(words) - n + 1
        if size <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        code, known = np.zeros(size, np.int64), np.ones(size, bool)
        for k in range(n):
            own = words[k : k + size]
            code = code * (len(self.vocabulary) + 1) + own
            known &= own >= 0
        at = np.flatnonzero(known)
        return code[at], at

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of texts (-1: in no item), and word offsets."""
        coded, at = words_of(texts)
        own = pc.index_in(coded.dictionary, self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.empty(0, np.int64), at

    def hits(self, words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the seed in keys[n], place and text of each seed that stands in the texts."""
        code, place = self.codes(words, n)
        if not len(code) or not len(self.keys[n]):
            return (np.empty(0, np.int64),) * 3
        which = np.minimum(np.searchsorted(self.keys[n], code), len(self.keys[n]) - 1)
        found = self.keys[n][which] == code
        which, place = which[found], place[found]
        text = np.searchsorted(at, place, "right") - 1
        fits = place + n <= at[text + 1]
        return which[fits], place[fits], text[fits]

    def windows(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """text, item, first and last word (end exclusive) of the stretches to align, by groups of texts."""
        hits = [(np.full(len(x[0]), n), *x) for n in self.seeds for x in [self.hits(words, at, n)]]
        length, which, place, text = (np.concatenate(x) for x in zip(*hits))
        low, many = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
        for n, (code, _, _) in self.seeds.items():
            own, keys = length == n, self.keys[n][which[length == n]]
            low[own] = np.searchsorted(code, keys)
            many[own] = np.searchsorted(code, keys, "right") - low[own]
        order = np.argsort(text, kind="stable")
        length, place, text, low, many = (x[order] for x in (length, place, text, low, many))
        total = np.concatenate([[0], np.cumsum(many)])
        first = 0
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(total, total[first] + MOST_WINDOWS, "right")) - 1)
            if last < len(text):  # whole texts only
                last = int(np.searchsorted(text, text[last])) if text[last] != text[first] else int(np.searchsorted(text, text[first], "right"))
            own = slice(first, last)
            yield self.joined(at, length[own], place[own], text[own], low[own], many[own])
            first = last

    def joined(self, at: np.ndarray, length: np.ndarray, place: np.ndarray, text: np.ndarray, low: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows of hits of seeds; overlapping ones of a text and an item are one."""
        found = []
        for n, (_, item, offset) in self.seeds.items():
            own = length == n
            seed, hit = ragged(low[own], many[own]), np.repeat(np.flatnonzero(own), many[own])
            found.append((text[hit], item[seed], place[hit] - offset[seed]))
        text, item, start = (np.concatenate(x) for x in zip(*found))
        stop = np.minimum(at[text + 1], start + self.length[item] + MARGIN)
        start = np.maximum(at[text], start - MARGIN)
        order = np.lexsort((start, item, text))
        text, item, start, stop = text[order], item[order], start[order], stop[order]
        group = np.cumsum(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
        reach = np.maximum.accumulate(stop + group * (at[-1] + 1)) - group * (at[-1] + 1)
        new = np.ones(len(text), bool)
        new[1:] = (group[1:] != group[:-1]) | (start[1:] > reach[:-1])
        first = np.flatnonzero(new)
        return text[first], item[first], start[first], np.maximum.reduceat(stop, first)

    def cut(self, text: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows of more than two spans cut into ones of two spans, a span apart."""
        span = np.ceil(SPAN * self.length[item]).astype(np.int64)
        parts = np.maximum(1, -(-(stop - start) // span) - 1)
        own = np.repeat(np.arange(len(text)), parts)
        begin = start[own] + ragged(np.zeros(len(parts), np.int64), parts) * span[own]
        return text[own], item[own], begin, np.minimum(stop[own], begin + 2 * span[own])

    def hopeful(self, words: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether windows can hold an alignment of LEAST_SCORE by the words of the item that stand in them."""
        size, out = stop - start, np.zeros(len(item), bool)
        total = np.concatenate([[0], np.cumsum(size)])
        k = 0
        while k < len(item):
            last = max(k + 1, int(np.searchsorted(total, total[k] + MOST_CELLS, "right")) - 1)
            own = slice(k, last)
            word = words[ragged(start[own], size[own])]
            code = np.repeat(item[own], size[own]) * len(self.vocabulary) + word
            where = np.minimum(np.searchsorted(self.members, code), len(self.members) - 1)
            run = np.cumsum(np.where((word >= 0) & (self.members[where] == code), MATCH, -LOSS))
            before = np.concatenate([[0], run[:-1]])
            # Running minima within windows: each window lies below all earlier ones.
            fall = np.repeat(np.arange(last - k), size[own]) * (2 * (MATCH + LOSS) * (len(run) + 1))
            lowest = np.minimum.accumulate(before - fall) + fall
            best = np.maximum.reduceat(run - lowest, total[k:last] - total[k])
            out[own] = best >= LEAST_SCORE * MATCH * self.length[item[own]]
            k = last
        return out


def align(query: np.ndarray, query_len: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment value of each row's query and target (padded with -2 and -1), and the column it ends in.

    Within a row of the table a gap's running maximum stands for the left neighbour: max over k of H[k] - LOSS * (j - k)."""
    rows, width = target.shape
    lean = LOSS * np.arange(width, dtype=np.int32)
    last, best, end = np.zeros((rows, width), np.int32), np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for i in range(query.shape[1]):
        score = np.where(target == query[:, i, None], MATCH, -LOSS)
        now = last - LOSS
        now[:, 1:] = np.maximum(now[:, 1:], last[:, :-1] + score[:, 1:])
        now[:, 0] = np.maximum(now[:, 0], score[:, 0])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + lean, axis=1) - lean
        at = now.argmax(1)
        value = np.where(i < query_len, now[np.arange(rows), at], 0)
        better = value > best
        best, end = np.where(better, value, best), np.where(better, at, end)
        last = now
    return best, end


def aligned(items: Items, words: np.ndarray, text: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of each window from 0 to 1, and the word in which the alignment ends."""
    size, need = stop - start, items.length[item]
    score, end = np.zeros(len(text)), np.zeros(len(text), np.int64)
    order = np.lexsort((need, size))
    k = 0
    while k < len(order):
        step = max(1, MOST_CELLS // max(1, int(size[order[k]]) * 2))
        own = order[k : k + step]
        own = own[size[own] <= max(2 * size[own[0]], 64)]
        k += len(own)
        target, query = np.full((len(own), int(size[own].max())), -1, np.int64), np.full((len(own), int(need[own].max())), -2, np.int64)
        columns = np.arange(target.shape[1])
        inside = columns < size[own][:, None]
        target[inside] = words[(start[own][:, None] + columns)[inside]]
        columns = np.arange(query.shape[1])
        inside = columns < need[own][:, None]
        query[inside] = items.words[(items.at[item[own]][:, None] + columns)[inside]]
        value, last = align(query, need[own], target)
        score[own], end[own] = value / (MATCH * need[own]), start[own] + last + 1
    return score, end


def found_in(items: Items, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """text, item, score, start and end word of the items that texts hold; the best place of each."""
    words, at = items.numbered(texts)
    found = [(np.empty(0, np.int64),) * 2 + (np.empty(0),) + (np.empty(0, np.int64),) * 2]
    for stretches in items.windows(words, at):
        text, item, start, stop = items.cut(*stretches)
        keep = items.hopeful(words, item, start, stop)
        text, item, start, stop = text[keep], item[keep], start[keep], stop[keep]
        score, end = aligned(items, words, text, item, start, stop)
        keep = score >= LEAST_SCORE
        found.append((text[keep], item[keep], score[keep], start[keep], end[keep]))
    text, item, score, start, end = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, -score, item, text))
    text, item, score, start, end = text[order], item[order], score[order], start[order], end[order]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    text, item, score, start, end = text[keep], item[keep], score[keep], start[keep], end[keep]
    return text, item, score, start - at[text], end - at[text]


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(benchmark[item_col].cast("long").alias("item_id"), F.coalesce(benchmark[item_text_col].cast("string"), F.lit("")).alias("text"))


def _seeds(rows: DataFrame) -> DataFrame:
    """rk and seed of rows rk, text: distinct runs of SEED_WORDS words, and the whole of texts of fewer words (whole); one- and
    two-word runs too where short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            column = batch[0]
            coded, at = words_of(column.column(1))
            names = coded.dictionary.to_pylist()
            own = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)[coded.indices.to_numpy(zero_copy_only=False)] if names else np.empty(0, np.uint64)
            length, owners, codes, sizes = np.diff(at), [], [], []
            for n in range(1, SEED_WORDS + 1):
                many = np.maximum(0, length - n + 1)
                start = ragged(at[:-1], many)
                code = np.full(len(start), n, np.uint64)
                for k in range(n):
                    code = (code ^ own[start + k]) * np.uint64(0x9E3779B97F4A7C15)
                    code ^= code >> np.uint64(29)
                owners.append(np.repeat(np.arange(len(length)), many))
                codes.append(code)
                sizes.append(np.full(len(code), n, np.int32))
            owner, code, size = np.concatenate(owners), np.concatenate(codes), np.concatenate(sizes)
            order = np.lexsort((code, owner))
            owner, code, size = owner[order], code[order], size[order]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
            owner, code, size = owner[new], code[new], size[new]
            yield pa.RecordBatch.from_arrays([column.column(0).take(pa.array(owner)), pa.array(code.view(np.int64)), pa.array(size), pa.array(length[owner].astype(np.int32))], names=["rk", "seed", "size", "words"])

    return rows.select("rk", "text").mapInArrow(run, "rk long, seed long, size int, words int")


def _joined_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Leaks whatever the benchmark's size: one pass over the documents gives those seeds (as hashes) that pass a filter of the items'
    seeds, a salted join by all seeds of items without a common one gives pairs of document and item, and these are joined with both
    texts and aligned. Items with a common seed are broadcast in passes."""
    own = F.xxhash64("id", F.xxhash64("text")).alias("rk")
    items = written(items.select(F.col("item_id").alias("id"), "text").select(own, F.col("id").alias("item_id"), "text"), "items")
    seeds = _seeds(items.select("rk", "text").dropDuplicates(["rk"])).where(F.col("size") == F.least(F.col("words"), F.lit(SEED_WORDS)))
    seeds = written(seeds.select("seed", F.col("rk").alias("item")), "seeds")
    docs = docs.select(F.col("doc_id").alias("id"), "text").select(own, F.col("id").alias("doc_id"), "text")
    hits = written(maybe_in(_seeds(docs), "seed", seeds).select("rk", "seed"), "hits")
    counts = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    known = seeds.join(counts, "seed")
    usual = written(known.where(F.col("n") > COMMON).select(F.col("item").alias("rk")).distinct(), "usual")
    rare = written(known.join(usual.withColumnRenamed("rk", "item"), "item", "left_anti"), "rare")
    salts = max(1, min(MOST_SALTS, -(-(rare.agg(F.max("n")).first()[0] or 0) // SALT_ROWS)))
    salted = rare.select("seed", "item", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    found = hits.withColumn("salt", F.pmod(F.xxhash64("rk"), F.lit(salts)).cast("int")).join(salted, ["seed", "salt"]).select("rk", "item").distinct()
    pairs = written(found, "pairs")
    dropped(hits)
    rows = maybe_in(docs, "rk", pairs).join(pairs, "rk").select("item", "doc_id", "text")
    names = items.select(F.col("rk").alias("item"), "item_id", F.col("text").alias("item_text"))
    both = rows.join(names, "item").select("item", "item_id", "item_text", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column(0).to_numpy(zero_copy_only=False)
            for key in np.unique(which).tolist():  # a sorted partition has few items a batch
                mine = batch.filter(pa.array(which == key))
                item = Items([mine.column(1)[0].as_py()], [mine.column(2)[0].as_py()])
                for part, _, _ in blocks(iter([mine])) if item.ids else ():
                    text, _, score, start, end = found_in(item, part.column(4))
                    yield pa.RecordBatch.from_arrays([part.column(3).take(pa.array(text)), part.column(1).take(pa.array(text)), *map(pa.array, (score, start, end))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    found = both.sortWithinPartitions("item").mapInArrow(run, SCHEMA)
    return found if usual.isEmpty() else found.unionByName(_passes(docs.select("doc_id", "text"), items.join(usual, "rk", "left_semi")))


def _passes(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Leaks of items (rk, item_id, text) by a pass over docs for each PASS_BYTES or so of them; the driver holds those of one pass."""
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0]
    passes = -(-size // PASS_BYTES)
    items = written(items.select("item_id", "text", F.pmod(F.xxhash64("rk", F.lit(1)), F.lit(passes)).cast("int").alias("pass")), "passes")

    def parts() -> Iterator[DataFrame]:
        for k in range(passes):
            found, shared = _against(docs, _collected(items.where(F.col("pass") == k)))
            yield found
            shared.destroy()

    return appended(parts(), docs.sparkSession, SCHEMA, "leaks")


def _against(docs: DataFrame, own: Items) -> tuple[DataFrame, Broadcast]:
    """Leaks of docs by a pass with all items in every task, and the broadcast that the pass reads."""
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        text, item, score, start, end = found_in(shared.value, rows.column(1))
        ids = pa.array(shared.value.ids, pa.int64()).take(pa.array(item))
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(text)), ids, *map(pa.array, (score, start, end))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return per_block(docs, block, SCHEMA), shared


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of df and item that it holds: ids, score, where the best alignment's window starts and it ends (words)."""
    docs, items = narrowed(df, id_col, text_col), _items(benchmark, item_col, item_text_col)
    if (own := _small(items)) is None:
        return _joined_leaks(docs, items)
    return _against(docs, own)[0]


def _small(items: DataFrame) -> Items | None:
    """All items, if their texts have BLOCK_BYTES together at most."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    if size > BLOCK_BYTES:
        return None
    return _collected(items)


def _collected(items: DataFrame) -> Items:
    rows = items.orderBy("item_id", "text").collect()
    return Items([r["item_id"] for r in rows], [r["text"] for r in rows])


def without_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of df that hold no item, with all their columns."""
    bounded(df.sparkSession)
    at, items = df.columns.index(text_col), _items(benchmark, item_col, item_text_col)
    if (own := _small(items)) is None:  # texts are told apart by their hash
        fp = free_name(df, "fp")
        rows = df.withColumn(fp, F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))))
        texts = rows.select(F.col(fp).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).dropDuplicates(["doc_id"])
        gone = written(_joined_leaks(texts, items).select(F.col("doc_id").alias(fp)).distinct(), "leaks")
        stay = maybe_in(rows, fp, gone).join(gone, fp, "left_anti")
        return maybe_in(rows, fp, gone, other=True).unionByName(stay).select(*df.columns)
    shared = df.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            done = 0
            for rows, _, _ in blocks(iter([texts])):
                keep = np.ones(rows.num_rows, bool)
                keep[found_in(shared.value, rows.column(0))[0]] = False
                yield batch.slice(done, rows.num_rows).filter(pa.array(keep))
                done += rows.num_rows

    return df.mapInArrow(run, df.schema)
