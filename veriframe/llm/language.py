"""Language identification by prediction by partial matching: exact code lengths under frozen context trees.

Each language has a byte context tree of order ORDER: counts of the next byte behind each context of up to ORDER bytes.
The probability of a byte follows method C: in a context with n bytes seen, d of them distinct, a byte seen c times has
c / (n + d), and the escape d / (n + d) goes on to the context one byte shorter, down to 1 / 256 for each byte; a context
that was never seen passes on at no cost. The counts are frozen after training, so the code length of a byte depends on it
and the ORDER bytes before it alone. Lengths of all grams seen in training are laid out in hash tables, one row a gram with a
column a language; a gram not found takes its context's escape cost and the next shorter gram's row, which is the same sum.
A text's language is that with the least code length, and score is its share of the probabilities 2 ** -length of all.

Training takes a bounded sample: of each language the documents with the least hash of doc_id, about SAMPLE_DOCS of them, and of each of
these SAMPLE_DOC_CHARS characters at most, so a language that has long documents only is learned too.
Everything else covers all rows and whole texts.

Defined results: und and score 0 for null, empty and letterless texts and where there is nothing to learn from; on equal
lengths the first language in alphabetical order; null doc_id is neither learned from nor held out (false); rows repeat.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, per_block

ORDER = 3
SAMPLE_DOCS, SAMPLE_DOC_CHARS = 300, 1 << 15
#: Distinct values of lang that can be learned; more is an error.
MOST_LANGUAGES = 200
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


class _Table:
    """Rows of numbers by 32-bit gram, in open addressing."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(6, int(math.ceil(math.log2(max(1, len(keys))))) + 1)
        size = 1 << self.bits
        self.key, self.row = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            free = todo[self.key[slot[todo]] < 0]
            self.key[slot[free]] = keys[free]
            placed = self.key[slot[todo]] == keys[todo]
            self.row[slot[todo[placed]]] = todo[placed]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & (size - 1)
            self.probes += 1
        self.rows = np.ascontiguousarray(rows)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (((keys * 0x9E3779B1) & 0xFFFFFFFF) >> max(0, 32 - self.bits)).astype(np.int64) if self.bits <= 32 else keys

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, or -1."""
        slot = self._slot(keys)
        there = self.key[slot]
        out = np.where(there == keys, self.row[slot], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        slot = slot[todo]
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.key[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.row[slot[hit]]
            go_on = ~hit & (there >= 0)
            todo, slot = todo[go_on], slot[go_on]
        return out


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte the code of it and the order bytes before it; a context that starts before its text is cut (see used)."""
    code = data.astype(np.int64)
    for k in range(1, order + 1):
        code[k:] |= data[:-k].astype(np.int64) << (8 * k)
    return code


def used(offsets: np.ndarray, n: int, order: int) -> np.ndarray:
    """How many bytes of context each byte has, order at most."""
    since = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    return np.minimum(since, order)


class Trees:
    """Frozen trees of some languages. Keys of order k are k + 1 bytes; contexts of order k are k bytes."""

    def __init__(self, by_language: dict[str, list[bytes]], order: int = ORDER):
        self.languages, self.order = sorted(by_language), order
        counts = []
        for name in self.languages:
            texts = [t for t in by_language[name] if t]
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            have = used(offsets, len(data), order)
            counts.append([np.unique(grams(data, offsets, k)[have >= k], return_counts=True) for k in range(order + 1)])
        n_lang = len(self.languages)
        self.grams: list[_Table] = []
        self.escapes: list[_Table] = []
        for k in range(order + 1):
            keys = np.unique(np.concatenate([c[k][0] for c in counts])) if counts else np.empty(0, np.int64)
            contexts = np.unique(keys >> 8)
            cost, escape = np.zeros((len(keys), n_lang)), np.zeros((len(contexts), n_lang))
            shorter = self._lengths(keys & ((1 << (8 * k)) - 1), k - 1) if len(keys) else cost
            for i, c in enumerate(counts):
                own, times = c[k]
                place = np.searchsorted(contexts, own >> 8)
                total = np.bincount(place, times, len(contexts))
                distinct = np.bincount(place, minlength=len(contexts))
                seen = total > 0
                escape[seen, i] = np.log2((total[seen] + distinct[seen]) / distinct[seen])
                cost[:, i] = escape[np.searchsorted(contexts, keys >> 8), i] + shorter[:, i]
                cost[np.searchsorted(keys, own), i] = np.log2((total + distinct)[place] / times)
            self.grams.append(_Table(keys, cost.astype(np.float32)))
            self.escapes.append(_Table(contexts, escape.astype(np.float32)))

    def _lengths(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of last bytes behind k bytes of context, a column a language."""
        if k < 0:
            return np.full((len(codes), len(self.languages)), 8.0, np.float32)
        row = self.grams[k].find(codes)
        out = self.grams[k].rows[row] if len(self.grams[k].rows) else np.zeros((len(codes), len(self.languages)), np.float32)
        lost = np.flatnonzero(row < 0)
        if len(lost):
            rest = self._lengths(codes[lost] & ((1 << (8 * k)) - 1), k - 1)
            context = self.escapes[k].find(codes[lost] >> 8)
            if len(self.escapes[k].rows):
                rest = rest + np.where((context >= 0)[:, None], self.escapes[k].rows[context], np.float32(0))
            out[lost] = rest
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths in bits, one row a text and a column a language."""
        n, n_texts = len(data), len(offsets) - 1
        total = np.zeros((n_texts, len(self.languages)))
        if not n:
            return total
        codes = grams(data, offsets, self.order)
        have = used(offsets, n, self.order)
        each = self._lengths(codes, self.order)
        for k in range(self.order):
            at = np.flatnonzero(have == k)
            each[at] = self._lengths(codes[at] & ((1 << (8 * (k + 1))) - 1), k)
        full = offsets[:-1] < offsets[1:]
        total[full] = np.add.reduceat(each, offsets[:-1][full], axis=0, dtype=np.float64)
        return total


def learned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, order: int = ORDER) -> Trees:
    """Trees of a bounded sample of df: of each language about sample_docs documents, those with the least hashes of id_col.

    The sample's texts go to the driver; counting languages reads no texts."""
    doc = F.xxhash64(df[id_col].cast("long"))
    use = df.where(df[id_col].isNotNull() & df[lang_col].isNotNull() & df[text_col].isNotNull())
    sizes = use.groupBy(df[lang_col].alias("lang")).count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    wanted = F.lit(False)
    for r in sizes:
        share = min(1.0, sample_docs / r["count"])
        wanted = wanted | ((df[lang_col] == r["lang"]) & (F.pmod(doc, F.lit(1_000_003)) < int(math.ceil(share * 1_000_003))))
    rows = use.where(wanted).select(df[lang_col].alias("lang"), F.left(df[text_col], F.lit(SAMPLE_DOC_CHARS)).alias("text"), doc.alias("h")).orderBy("h", "lang", "text").limit(2 * sample_docs * max(1, len(sizes))).collect()
    texts: dict[str, list[bytes]] = {}
    for r in rows:
        if len(own := texts.setdefault(r["lang"], [])) < sample_docs:
            own.append(r["text"].encode())
    return Trees(texts, order)


def identify(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score, one row per row of df."""
    return _identified(df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), F.lit(None).cast("boolean").alias("held_out")), trees).select("doc_id", "lang_pred", "score")


def _identified(df: DataFrame, trees: Trees) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    def block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        own = shared.value
        names = [*own.languages, "und"]
        bits, raw = own.lengths(data, offsets), data.tobytes()
        letters = np.bincount(np.searchsorted(offsets, np.flatnonzero(((data | 32) >= 97) & ((data | 32) <= 122)), "right") - 1, minlength=rows.num_rows) > 0
        for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)).tolist():
            letters[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace"))
        best, score = np.full(rows.num_rows, len(names) - 1), np.zeros(rows.num_rows)
        if own.languages:
            at = np.flatnonzero(letters)
            best[at] = bits[at].argmin(1)
            score[at] = 1 / np.exp2(np.maximum(-1000, bits[at].min(1)[:, None] - bits[at])).sum(1)
        held = rows.column(rows.schema.get_field_index("held_out"))
        return pa.RecordBatch.from_arrays([rows.column(0), held, pa.array(names).take(pa.array(best)), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return per_block(df, block, SCHEMA, 4 << 20)


def language_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """Learns from the documents whose crc32(doc_id as text) isn't divisible by folds and predicts all rows."""
    held = F.coalesce(F.crc32(df[id_col].cast("string").cast("binary")) % folds == 0, F.lit(False))
    trees = learned(df.where(~held), id_col, text_col, lang_col)
    bounded(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    return _identified(rows, trees)
