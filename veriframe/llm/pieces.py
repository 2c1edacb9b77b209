"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A block of texts is cut into words at places that no piece of the vocabulary spans; equal words are encoded once. All
distinct words lie in one flat array of symbols. Each round finds the least pair rank of every word (segmented minimum),
merges the leftmost pairs of that rank in all words at once, and compacts the array; words without a mergeable pair leave
it. Pairs of one rank in one word merge together only where the merged piece can't start a merge of an earlier or equal
rank; else the leftmost one alone does. That keeps the library's order (best score, then leftmost) exactly.

Defined results: null text counts as empty and has no ids; repeated rows each give a row; a null doc_id stays null;
characters outside the vocabulary become byte pieces; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat, narrowed, per_block, ragged, strings

#: Bytes of text of a block whose tokens' texts are laid out, which take several times as much.
DIGEST_BYTES = 2 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NONE = np.int32(2**31 - 1)
_SPACE = "▁"


class PieceModel:
    """Tables of a BPE model with byte fallback, no normalisation, and a space put before each text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(n)]
        score = np.array([model.get_score(i) for i in range(n)], np.float32)
        self.n, self.byte_id = n, np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[int(names[i][3:5], 16)] = i
        by_name = {p: i for i, p in enumerate(names) if not special[i]}
        chars = sorted({c for p in by_name for c in p} - set(by_name))
        symbol = by_name | {c: n + k for k, c in enumerate(chars)}  # characters that only longer pieces hold
        self.first_unknown = n + len(chars)
        rank = np.full(self.first_unknown, _NONE, np.int64)
        own = np.fromiter(by_name.values(), np.int64)
        ranks, rank[own], counts = np.unique(-score[own], return_inverse=True, return_counts=True)
        alone = np.zeros(self.first_unknown, bool)  # merge one at a time
        alone[own] = counts[rank[own]] > 1
        pairs = {}
        for p, i in by_name.items():
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
                for x in (left, right):
                    if x is not None and rank[i] <= rank[x]:
                        alone[x] = True
        self.alone, self.rank = alone, rank
        keys = np.fromiter(pairs.keys(), np.uint64)
        merged = np.fromiter(pairs.values(), np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 2)
        self.keys, self.merged = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.zeros(1 << self.bits, np.int64)
        self.probes, todo = 0, np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):  # linear probing: of those that want a free slot, the last one written keeps it
            free = todo[self.keys[slot[todo]] == 2**64 - 1]
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot[todo]] == keys[todo]
            self.merged[slot[todo[placed]]] = merged[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        self.of_char = np.full(0x110000, -1, np.int64)
        for p, i in symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[32] = self.of_char[ord(_SPACE)]
        surface = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if special[i] else names[i].replace(_SPACE, " ").encode() for i in range(n)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(x) for x in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.decimal = pa.array([f",{i}" for i in range(n)], pa.binary())
        # Where words may be cut: before a space after another character, if no piece has a space later than at its start;
        # around ASCII characters that no longer piece holds.
        longer = {c for p in by_name if len(p) > 1 for c in p}
        self.cut_spaces = not any(_SPACE in p.lstrip(_SPACE) for p in by_name)
        self.apart = np.zeros(256, bool)
        self.apart[[c for c in range(128) if c != 32 and chr(c) not in longer]] = True
        runs = {len(p): score[i] for p, i in by_name.items() if len(p) > 1 and not p.strip(_SPACE)}
        mixed = any(p.startswith(_SPACE * 2) and p.strip(_SPACE) for p in by_name)
        self.run = max(runs, default=0)  # long runs of spaces merge into pieces of this many from the left
        if mixed or set(runs) != set(range(2, self.run + 1)) or len({*runs.values(), score[own].min()}) != 1:
            self.run = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges into, or -1."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot, out = self._slot(key), np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.merged[slot[hit]]
            go_on = ~hit & (there != 2**64 - 1)
            if not go_on.any():
                break
            todo, slot = todo[go_on], (slot[go_on] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of words that lie one after the other, and the words' new lengths."""
        word = np.arange(len(lengths))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ends = np.cumsum(lengths)
        made = np.full(len(symbols), -1, np.int64)
        inner = np.ones(len(symbols), bool)
        inner[ends[lengths > 0] - 1] = False
        at = np.flatnonzero(inner)
        made[at] = self.pair(symbols[at], symbols[at + 1])
        while len(word):
            ends = np.cumsum(lengths)
            starts = ends - lengths
            rank = np.where(made >= 0, self.rank[made], _NONE)
            least = np.minimum.reduceat(rank, starts)
            live = least < _NONE
            if not live.all():
                gone = ~live
                done.append((word[gone], lengths[gone], symbols[np.repeat(gone, lengths)]))
                stay = np.repeat(live, lengths)
                symbols, made, rank = symbols[stay], made[stay], rank[stay]
                word, lengths, least = word[live], lengths[live], least[live]
                if not len(word):
                    break
                ends = np.cumsum(lengths)
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            of = np.searchsorted(ends, hit, "right")
            # In a row of neighbouring hits of a word, every other one from the left; only the word's first where it must stand alone.
            first = np.ones(len(hit), bool)
            first[1:] = of[1:] != of[:-1]
            opens = first.copy()
            opens[1:] |= hit[1:] != hit[:-1] + 1
            count = np.arange(len(hit))
            odd = (count - np.maximum.accumulate(np.where(opens, count, 0))) & 1
            alone = self.alone[made[hit]]
            alone = np.repeat(np.bitwise_or.reduceat(alone, np.flatnonzero(first)), np.diff(np.append(np.flatnonzero(first), len(hit))))
            hit = hit[np.where(alone, first, odd == 0)]
            symbols[hit] = made[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            lengths = lengths - np.bincount(np.searchsorted(ends, hit, "right"), minlength=len(lengths))
            symbols, made = symbols[keep], made[keep]
            ends = np.cumsum(lengths)
            now = hit - np.arange(len(hit))  # places of the merged symbols
            changed = np.zeros(len(symbols), bool)
            changed[now] = True
            changed[now[now > 0] - 1] = True
            final = ends - 1
            made[final[changed[final]]] = -1
            changed[final] = False
            at = np.flatnonzero(changed)
            made[at] = self.pair(symbols[at], symbols[at + 1])
        words, lengths, symbols = (np.concatenate([d[k] for d in done]) for k in range(3)) if done else (word, lengths, symbols)
        order = np.argsort(words)
        return symbols[ragged((np.cumsum(lengths) - lengths)[order], lengths[order])], lengths[order]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (not empty; UTF-8 with plain spaces), one word after the other, and how many each has."""
        raw, offsets = flat(words)
        lead = (raw & 0xC0) != 0x80
        chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        counts = np.diff(np.concatenate([[0], np.cumsum(lead)])[offsets])
        symbols = self.of_char[chars]
        symbols = np.where(symbols < 0, self.first_unknown + chars, symbols)
        known = symbols.copy()
        known[symbols >= self.first_unknown] = self.first_unknown  # no pair has it
        # The characters themselves are needed once more for byte pieces: they never merge, so their order stays.
        ids, lengths = self.merge(known, counts)
        bare = np.flatnonzero(ids >= self.n)
        if len(bare):
            lost = np.where(known == self.first_unknown, chars, -1)
            only = {self.of_char[c]: c for c in np.unique(chars[(known >= self.n) & (known < self.first_unknown)]).tolist()}
            code = np.array([only.get(i, -1) for i in ids[bare].tolist()], np.int64)
            code[ids[bare] == self.first_unknown] = lost[lost >= 0]
            parts = [chr(c).encode() for c in code.tolist()]
            width = np.ones(len(ids), np.int64)
            width[bare] = [len(p) for p in parts]
            out = np.repeat(ids, width)
            out[np.repeat(ids >= self.n, width)] = self.byte_id[np.frombuffer(b"".join(parts), np.uint8)]
            lengths = np.diff(np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(lengths)])])
            ids = out
        return ids, lengths

    def decode_words(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """Surfaces of words' ids, as byte strings."""
        width = self.surface_len[ids]
        data = self.surface[ragged(self.surface_at[ids], width)]
        ends = np.cumsum(width)
        total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
        return strings(data, total[:-1], int(total[-1]))

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Words of a block in which each text that isn't empty has got its space in front; n + 1 word offsets of the texts."""
        if len(data) > 2 and (mark := (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)).any():
            size = np.ones(len(data), np.int64)  # the mark and the space are one symbol
            at = np.flatnonzero(mark)
            data = data.copy()
            data[at] = 32
            size[at + 1] = size[at + 2] = 0
            offsets = np.concatenate([[0], np.cumsum(size)])[offsets]
            data = data[size > 0]
        full = offsets[:-1] < offsets[1:]
        data = np.insert(data, offsets[:-1][full], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        starts = np.zeros(len(data) + 1, bool)
        starts[offsets[:-1][full]] = True
        space = data == 32
        if self.cut_spaces:
            starts[1:-1] |= space[1:] & ~space[:-1]
        apart = self.apart[data]
        starts[:-1] |= apart
        starts[1:] |= apart
        if self.run and len(data) > self.run:
            index = np.arange(len(data))
            opens = space.copy()
            opens[1:] &= ~space[:-1] | starts[1:-1]
            opens[0] = space[0]
            since = index - np.maximum.accumulate(np.where(opens, index, 0))
            starts[:-1] |= space & (since > 0) & (since % self.run == 0)
        at = np.flatnonzero(starts[:-1])
        return strings(data, at, len(data)), np.searchsorted(at, offsets)


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The model of a file, read once per Python process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_block(model: PieceModel, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: distinct words' ids, how many each has, which word stands where, word offsets of the texts; the words."""
    words, texts = model.cut(data, offsets)
    coded = words.dictionary_encode()
    ids, lengths = model.encode_words(coded.dictionary)
    return ids, lengths, coded.indices.to_numpy(zero_copy_only=False), texts, coded.dictionary


def piece_encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int), one row per row of df."""

    def block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        ids, lengths, which, texts, _ = encode_block(piece_model(model_path), data, offsets)
        starts, each = (np.cumsum(lengths) - lengths)[which], lengths[which]
        ends = np.concatenate([[0], np.cumsum(each)])[texts]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[ragged(starts, each)], pa.int32()))], names=["doc_id", "ids"])

    return per_block(narrowed(df, id_col, text_col), block, "doc_id long, ids array<int>")


def piece_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with ids; null ids give null, bytes that aren't UTF-8 become U+FFFD, null elements and ids that the
    model doesn't have are left out."""

    def run(batches):
        model = piece_model(model_path)
        for batch in batches:
            out = []
            for own in batch.column(1).to_pylist():
                ids = np.array([i for i in own or [] if i is not None and 0 <= i < model.n], np.int64)
                raw = model.surface[ragged(model.surface_at[ids], model.surface_len[ids])].tobytes()
                out.append(None if own is None else raw.removeprefix(b" ").decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def piece_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: number of ids, digests of the ids and of the text decoded from them."""

    def block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        model = piece_model(model_path)
        ids, lengths, which, texts, _ = encode_block(model, data, offsets)
        counts = np.concatenate([[0], np.cumsum(lengths[which])])[texts]
        listed = _joined(model.decimal.take(pa.array(ids)), lengths, which, texts)
        decoded = _joined(model.decode_words(ids, lengths), None, which, texts)
        digest = lambda parts: pa.array([hashlib.sha256(x[1:]).hexdigest() for x in parts], pa.string())  # noqa: E731  the first comma; the space put in front
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(counts)), digest(listed), digest(decoded)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return per_block(narrowed(df, id_col, text_col), block, SCHEMA, DIGEST_BYTES)


def _joined(parts: pa.Array, lengths: np.ndarray | None, which: np.ndarray, texts: np.ndarray) -> list[memoryview]:
    """For each text the bytes of its words; parts are words' bytes, or with lengths those of their tokens."""
    if lengths is not None:
        ends = np.frombuffer(parts.buffers()[1], np.int32)[: len(parts) + 1][np.concatenate([[0], np.cumsum(lengths)])]
        parts = strings(np.frombuffer(parts.buffers()[2] or b"", np.uint8), ends[:-1], int(ends[-1]))
    taken = parts.cast(pa.large_binary()).take(pa.array(which))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1][texts]
    raw = memoryview(taken.buffers()[2] or b"")
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
