"""Quality rules from suffix arrays: repeated substrings of each document, their covered fraction and the longest.

Words (runs of characters other than ASCII white space) of a block of documents become numbers; a suffix array over
all of them is built by prefix doubling in which only suffixes that still tie are sorted again. The document stands
first in the key, so that suffixes of two documents never tie and every interval lies within one document. Common
prefixes of neighbours come from the ranks of all rounds, by powers of two. A suffix's deepest interval has the larger
of its two common prefixes as its length; the union of these stretches is the union of all maximal repeats' spans.

Defined results: null text counts as empty, has no words and fails (fewer than 50); repeated rows each give a row; a
null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, bounded, narrowed, per_block, strings

#: Repeats of fewer words don't count for the method's verdict.
LEAST_REPEAT = 8
#: A document goes if more than this share of its words lies in repeats, or if a repeat has more words than that.
MOST_COVERED_PERCENT, LONGEST_REPEAT = 30, 100
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of a block, and the document number of each."""
    space = _SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    if len(data):
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[first] = ~space[first]
    at = np.flatnonzero(starts)
    letters = np.cumsum(~space) - ~space  # bytes of words before each place
    words = strings(data[~space], letters[at], int((~space).sum()))
    return words, np.searchsorted(offsets, at, "right") - 1


def suffix_ranks(ids: np.ndarray, doc: np.ndarray, last: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(h, rank of the first h words of each suffix within its document) for h = 1, 2, 4, ... until no two tie.

    last: one past the last word of the suffix's document. A level takes 4 bytes a word; there are as many as the longest repeat's
    length has binary digits."""
    n = len(ids)
    key = doc.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key)
    active, base, h, levels = order, None, 1, []
    sorted_key, rank = key[order], np.zeros(n, np.int64)
    while True:
        new = np.empty(len(active), bool)
        new[:1] = True
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        place = np.arange(len(active)) if base is None else base
        rank = rank.copy()
        rank[active] = np.maximum.accumulate(np.where(new, place, 0))
        levels.append((h, rank.astype(np.int32)))
        tied = ~new
        tied[:-1] |= ~new[1:]
        active, place = active[tied], place[tied]
        if not len(active):
            return levels
        after = active + h
        second = np.where(after < last[active], rank[np.minimum(after, n - 1)] + 1, 0)
        sorted_key = rank[active] * (n + 1) + second
        order = np.argsort(sorted_key)  # groups keep their places, as their ranks lead the key
        active, sorted_key, base, h = active[order], sorted_key[order], place, 2 * h


def repeat_lengths(ids: np.ndarray, doc: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each suffix, the words of its longest prefix that also starts elsewhere in its document."""
    n = len(ids)
    if not n:
        return np.empty(0, np.int64)
    levels = suffix_ranks(ids, doc, last)
    order = np.empty(n, np.int64)
    order[levels[-1][1]] = np.arange(n)
    near = np.flatnonzero(levels[0][1][order[1:]] == levels[0][1][order[:-1]])  # others share no word
    a, b, lcp = order[near], order[near + 1], np.zeros(len(near), np.int64)
    for h, rank in reversed(levels):
        x, y = a + lcp, b + lcp
        inside = (x + h <= last[a]) & (y + h <= last[b])
        lcp += h * (inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]))
    out = np.zeros(n, np.int64)
    out[a] = lcp
    out[b] = np.maximum(out[b], lcp)
    return out


def covered(length: np.ndarray) -> np.ndarray:
    """Whether each place lies in a stretch [i, i + length[i])."""
    n = len(length)
    at = np.flatnonzero(length)
    change = np.bincount(at, minlength=n + 1) - np.bincount(at + length[at], minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n_docs = len(offsets) - 1
    words, doc = words_of(data, offsets)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(words) else np.empty(0, np.int64)
    n_words = np.bincount(doc, minlength=n_docs)
    last = np.cumsum(n_words)[doc]
    length = repeat_lengths(ids, doc, last)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, doc, length)
    per_doc = lambda mask, at: np.bincount(at[mask], minlength=n_docs)
    byte_sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    three = covered(np.where(length >= 3, 3, 0))
    own = covered(np.where(length >= LEAST_REPEAT, length, 0))
    out = {"n_words": n_words, "word_chars": byte_sums(~_SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": byte_sums(_SYMBOL[data]), "n_dup_lines": _dup_lines(data, offsets)}
    out["n_repeat_words"] = per_doc(three, doc)
    out["base_failed"] = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    out["n_covered_words"], out["longest_repeat"] = per_doc(own, doc), longest
    out["kept"] = ~out["base_failed"] & (100 * out["n_covered_words"] <= MOST_COVERED_PERCENT * n_words) & (longest <= LONGEST_REPEAT)
    return out


def _dup_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n_docs, newline = len(offsets) - 1, data == 10
    starts = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], np.flatnonzero(newline[:-1]) + 1]))  # a newline's next byte begins a line, be it another document's
    if not len(starts):
        return np.zeros(n_docs, np.int64)
    kept = np.cumsum(~newline) - ~newline
    lines = strings(data[~newline], kept[starts], int((~newline).sum()))
    ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    sums = np.concatenate([[0], np.cumsum(~_SPACE[data])])
    has_word = np.diff(sums[np.append(starts, len(data))]) > 0
    key = doc[has_word] * (int(ids.max()) + 1) + ids[has_word]
    key.sort()
    again = key[1:][key[1:] == key[:-1]]
    return np.bincount(again // (int(ids.max()) + 1), minlength=n_docs)


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the base's counts, both verdicts, words covered by repeats and the longest repeat."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        found = measures(data, offsets)
        return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(found[k] if found[k].dtype == bool else found[k].astype(np.int64)) for k in names[1:])], names=names)

    return per_block(narrowed(df, id_col, text_col), block, SCHEMA)


def quality_filter(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that are kept, with all their columns."""
    bounded(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            done = 0
            for rows, data, offsets in blocks(iter([texts])):
                yield batch.slice(done, rows.num_rows).filter(pa.array(measures(data, offsets)["kept"]))
                done += rows.num_rows

    return df.mapInArrow(run, df.schema)

