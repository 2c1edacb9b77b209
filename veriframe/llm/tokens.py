"""Token ids in a binary format: a static range asymmetric numeral system with independent interleaved blocks.

Texts are cut at white space where the tokenizer's own splitting must cut too, and each distinct part of a block is
encoded once by the tokenizers library. The ids are kept in a packed table until they are written; their counts over all
documents give one frequency table (of 2**20 slots) that all blocks share. Documents are dealt by ranges of doc_id
(and of a hash, should one doc_id have very many rows) and sorted, and each range is written as blocks of about BLOCK_TOKENS ids of whole documents. Within a block, id t belongs to lane t % lanes;
all lanes' states advance together. A block holds its documents' ids and lengths, the lanes' states at its start and at
every CHECKPOINT_STEPS steps with the place in the stream, a CRC-32 of the ids of each part between two of these, and one of
the block itself. Reading decodes a block part by part, each from its own states, and compares its checksum. Blocks are binary values of Parquet files, so Spark's commit protocol guards the writing.

A folder holds blocks/ (part, block, n_tokens, payload) and table/ (frequencies with their CRC-32).

Defined results: null text counts as empty and has the end id only; documents stand in ascending doc_id order, null first,
rows of one doc_id in the order of a hash of their ids; an empty table gives an empty folder and no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, narrowed, per_block, ragged, shared_folder, strings, written

TABLE_BITS = 20
BLOCK_TOKENS = 1 << 20
CHECKPOINT_STEPS = 256
MOST_LANES = 2048
#: Ids of one output part, about; beyond MOST_PARTS parts they grow instead (a part streams through its task).
PART_TOKENS = 8 << 20
MOST_PARTS = 20_000
#: Vocabularies up to this size are taken; the frequency table is sent to every task.
MOST_IDS = 1 << 19
_MAGIC = b"VFTOKEN2"
_HEAD = struct.Struct("<8sIQIIII")  # magic, documents, ids, lanes, checkpoints, words, block number
_LOW = np.uint64(1 << 31)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LETTERS, _SIGNS = np.zeros(256, bool), np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_SIGNS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def cut(data: np.ndarray, offsets: np.ndarray, whole: tuple[bytes, ...] = ()) -> tuple[pa.Array, np.ndarray]:
    """Parts that the tokenizer encodes by themselves as within the text, and the n + 1 part offsets of the texts.

    Its expression never takes a character that isn't white space together with white space behind it, nor a letter with
    punctuation behind it, so a text may be cut there; and behind a single line feed between two others. White space beyond
    ASCII is left alone. whole: strings (special tokens) that aren't cut."""
    n = len(data)
    starts = np.zeros(n + 1, bool)
    starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    if n > 1:
        plain = (data > 32) & (data < 127)
        solid = plain.copy()  # last byte of a character that is surely not white space
        solid[1:] |= (data[1:] >= 128) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        if n > 2:
            solid[2:] |= (data[2:] >= 128) & (data[:-2] >= 0xE4) & (data[:-2] < 0xF0)
        starts[1:-1] |= _SPACES[data[1:]] & solid[:-1]
        if n > 2:
            starts[2:-1] |= (data[1:-1] == 10) & solid[:-2] & plain[2:]
        letter = _LETTERS[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # Latin letters of two bytes, no signs
        starts[1:-1] |= letter[:-1] & _SIGNS[data[1:]]
        raw = data.tobytes() if whole else b""
        for string in whole:
            place = raw.find(string)
            while place >= 0:
                starts[place + 1 : place + len(string)] = False
                place = raw.find(string, place + 1)
        starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    at = np.flatnonzero(starts[:-1])
    return strings(data, at, n), np.searchsorted(at, offsets)


#: Distinct parts that a Python worker remembers; then those of the block at hand stay.
MOST_KNOWN = 800_000
#: Parts that go to the library in one call.
STEP = 16_384


class Encoder:
    """The tokenizers library over distinct parts; those of earlier blocks are remembered, at most MOST_KNOWN."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = tuple(x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)

    def forget(self, but: list[bytes]) -> None:
        """Keeps those of the parts in but that are known, and no others."""
        kept = [x for x in but if x in self.known]
        which = np.fromiter(map(self.known.__getitem__, kept), np.int64, len(kept))
        starts, lengths = self.at[which], self.at[which + 1] - self.at[which]
        self.ids, self.at = self.ids[ragged(starts, lengths)], np.concatenate([[0], np.cumsum(lengths)])
        self.known = dict(zip(kept, range(len(kept))))

    def parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Starts in self.ids and numbers of ids of distinct parts."""
        if len(self.known) + len(parts) > MOST_KNOWN:
            self.forget(parts)
        which = np.fromiter(map(self.known.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        lost = np.flatnonzero(which < 0)
        new = [parts[k] for k in lost.tolist()]
        which[lost] = np.arange(len(self.known), len(self.known) + len(new))
        for k in range(0, len(new), STEP):
            step, n = new[k : k + STEP], len(self.known)
            own = [x.ids for x in self.tokenizer.encode_batch_fast([x.decode() for x in step], add_special_tokens=False)]
            self.known.update(zip(step, range(n, n + len(step))))
            ends = self.at[n] + np.cumsum([len(x) for x in own])
            self.ids, self.at = _room(self.ids, int(ends[-1])), _room(self.at, n + len(step) + 1)
            self.ids[self.at[n] : ends[-1]] = np.fromiter(itertools.chain.from_iterable(own), np.uint32, int(ends[-1] - self.at[n]))
            self.at[n + 1 : n + len(step) + 1] = ends
        return self.at[which], self.at[which + 1] - self.at[which]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.append(array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype))


_ENCODERS: dict[str, Encoder] = {}


def encode_block(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and n + 1 offsets."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    own = _ENCODERS[path]
    parts, texts = cut(data, offsets, own.whole)
    coded = parts.dictionary_encode()
    starts, lengths = own.parts(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    which = coded.indices.to_numpy(zero_copy_only=False)
    each = lengths[which]
    return own.ids[ragged(starts[which], each)], np.concatenate([[0], np.cumsum(each)])[texts]


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**TABLE_BITS, at least 1 where the count isn't 0."""
    total, slots = int(counts.sum()), 1 << TABLE_BITS
    if not total:
        return np.zeros(len(counts), np.int64)
    assert np.count_nonzero(counts) <= slots // 2, "too many distinct ids for the table"
    out = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) / total * slots).astype(np.int64)), 0)
    order = np.argsort(-out, kind="stable")
    k = 0
    while (left := slots - int(out.sum())) != 0:  # the largest pay or get the rest
        i = order[k % len(order)]
        step = left if left > 0 else -min(-left, max(0, int(out[i]) // 2))
        out[i] += step
        k += 1
    return out


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.limit = self.freq << np.uint64(63 - TABLE_BITS)

    def encode(self, ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, number: int) -> bytes:
        n = len(ids)
        lanes = int(min(MOST_LANES, max(1, n // 64)))
        steps = -(-n // lanes)
        state, words, kept = np.full(lanes, _LOW, np.uint64), [], []
        bits, mask, shift = np.uint64(TABLE_BITS), np.uint64(0xFFFFFFFF), np.uint64(32)
        n_words = 0
        for step in range(steps - 1, -1, -1):
            if (step + 1) % CHECKPOINT_STEPS == 0 and step + 1 < steps:
                kept.append((step + 1, n_words, state.copy()))
            own = ids[step * lanes : (step + 1) * lanes]
            x = state[: len(own)]
            over = x >= self.limit[own]
            if over.any():
                words.append((x[over] & mask).astype(np.uint32))
                n_words += len(words[-1])
                x = np.where(over, x >> shift, x)
            f = self.freq[own]
            q = x // f
            state[: len(own)] = (q << bits) + (x - q * f) + self.start[own]
        head = _HEAD.pack(_MAGIC, len(lengths), n, lanes, len(kept), n_words, number)
        cuts = [0, *(step * lanes for step, _, _ in reversed(kept)), n]
        sums = np.array([zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(cuts, cuts[1:])], "<u4")
        parts = [head, sums.tobytes(), doc_ids.astype("<i8").tobytes(), np.packbits(nulls).tobytes(), lengths.astype("<u4").tobytes(), state.astype("<u8").tobytes()]
        for step, later, states in reversed(kept):
            parts += [struct.pack("<II", step, n_words - later), states.astype("<u8").tobytes()]
        parts += [w.astype("<u4").tobytes() for w in reversed(words)]
        raw = b"".join(parts)
        return raw + struct.pack("<I", zlib.crc32(raw))

    def decode(self, raw: bytes, part: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, doc_ids, nulls, lengths; with part, the ids from that checkpoint (0: the block's start) to the next only. Parts need nothing
        of one another."""
        if zlib.crc32(memoryview(raw)[:-4]) != struct.unpack("<I", raw[-4:])[0] or raw[:8] != _MAGIC:
            raise ValueError("a token block is damaged")
        _, n_docs, n, lanes, n_kept, n_words, _ = _HEAD.unpack_from(raw)
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        sums = take("<u4", n_kept + 1)
        doc_ids, nulls = take("<i8", n_docs), np.unpackbits(take("u1", -(-n_docs // 8)), count=n_docs).astype(bool)
        lengths, state = take("<u4", n_docs), take("<u8", lanes)
        points = [(0, 0, state)]
        for _ in range(n_kept):
            step, word = struct.unpack_from("<II", raw, at)
            at += 8
            points.append((step, word, take("<u8", lanes)))
        words = take("<u4", n_words).astype(np.uint64)
        points.append((-(-n // lanes), n_words, state))
        wanted = range(n_kept + 1) if part is None else [part]
        out = [self._part(points[k], points[k + 1][0], n, lanes, words) for k in wanted]
        if any(zlib.crc32(own.astype("<u4")) != sums[k] for k, own in zip(wanted, out)):
            raise ValueError("a part's ids don't match their checksum")
        return np.concatenate(out), doc_ids, nulls, lengths

    def _part(self, point: tuple[int, int, np.ndarray], stop: int, n: int, lanes: int, words: np.ndarray) -> np.ndarray:
        """Ids from a checkpoint (step, place in words, states) up to the step stop."""
        first, word, state = point
        state, out = state.copy(), np.empty(min(n, stop * lanes) - first * lanes, np.uint32)
        bits, slots, shift = np.uint64(TABLE_BITS), np.uint64((1 << TABLE_BITS) - 1), np.uint64(32)
        for step in range(first, stop):
            count = min(lanes, n - step * lanes)
            x = state[:count]
            slot = x & slots
            own = self.symbol[slot]
            x = self.freq[own] * (x >> bits) + slot - self.start[own]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                x[low] = x[low] << shift | words[word : word + len(low)]
                word += len(low)
            state[:count] = x
            out[(step - first) * lanes : (step - first) * lanes + count] = own
        return out


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n and ids (packed) of each text, and on one row a block the counts of the block's ids."""

    def block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        ids, at = encode_block(tokenizer, data, offsets)
        ids = np.insert(ids, at[1:], end_id).astype("<u4")
        at = at + np.arange(len(at))
        packed = pa.array([pack(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
        counts = np.bincount(ids)
        seen = np.flatnonzero(counts)
        tally = seen.astype("<u4").tobytes() + counts[seen].astype("<u8").tobytes()
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), packed, pa.array([tally, *[None] * (rows.num_rows - 1)], pa.binary())], names=["doc_id", "n", "ids", "tally"])

    return per_block(docs, block, "doc_id long, n long, ids binary, tally binary")


def pack(ids: np.ndarray) -> bytes:
    """Ids for the way to their block: lower and upper bytes apart, deflated; wide ids take four planes."""
    planes = 2 if int(ids.max(initial=0)) < 1 << 16 else 4
    return bytes([planes]) + zlib.compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u4").ravel()


def _counts(tokenized: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents; as long as the vocabulary, however large the corpus is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                k = len(raw) // 12
                seen, counts = np.frombuffer(raw, "<u4", k), np.frombuffer(raw, "<u8", k, 4 * k)
                if int(seen.max(initial=0)) >= len(total):
                    total = np.append(total, np.zeros(int(seen.max()) + 1 - len(total), np.int64))
                total[seen] += counts.astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = tokenized.where("tally is not null").select("tally").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).limit(MOST_IDS + 1).collect()
    if len(rows) > MOST_IDS:
        raise ValueError("the vocabulary has too many ids")
    out = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of df's texts, each followed by end_id, to the folder path (it must not exist)."""
    spark = df.sparkSession
    tokenized = written(_tokenized(narrowed(df, id_col, text_col), tokenizer, end_id), "ids")
    counts = _counts(tokenized)
    freq = quantised(counts)
    raw = freq.astype("<u4").tobytes()
    spark.createDataFrame([(TABLE_BITS, bytearray(raw), zlib.crc32(raw))], "bits int, frequencies binary, crc long").coalesce(1).write.parquet(f"{path}/table")
    parts = min(MOST_PARTS, max(1, -(-int(counts.sum()) // PART_TOKENS), min(spark.sparkContext.defaultParallelism * 2, int(counts.sum()) // BLOCK_TOKENS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = Coder(freq), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def full() -> pa.RecordBatch:
            nonlocal docs, held, size, number
            payload = coder.encode(np.concatenate(held), np.array([d or 0 for d in docs], np.int64), np.array([d is None for d in docs]), np.array([len(h) for h in held]), number)
            out = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([size]), pa.array([payload], pa.binary())], names=["part", "block", "n_tokens", "payload"])
            docs, held, size, number = [], [], 0, number + 1
            return out

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = unpack(ids)
                if held and size + len(ids) > BLOCK_TOKENS:
                    yield full()
                docs.append(doc)
                held.append(ids)
                size += len(ids)
        if held:
            yield full()

    rows = tokenized.select("doc_id", "ids", F.xxhash64("ids").alias("h")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").drop("h")
    rows.mapInArrow(run, "part long, block long, n_tokens long, payload binary").write.parquet(f"{path}/blocks")
    dropped(tokenized)


def _coder(spark: SparkSession, path: str) -> np.ndarray:
    bits, raw, crc = spark.read.schema("bits int, frequencies binary, crc long").parquet(f"{path}/table").first()
    if bits != TABLE_BITS or zlib.crc32(bytes(raw)) != crc:
        raise ValueError("the frequency table is damaged")
    return np.frombuffer(bytes(raw), "<u4").astype(np.int64)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids (32-bit little-endian, binary) of a folder's documents.

    Each block is decoded by itself; starts come from the sums of blocks by part, one row a block, never one a document."""
    freq = _coder(spark, path)
    found = spark.read.schema("part long, block long, n_tokens long, payload binary").parquet(f"{path}/blocks")
    # Sums by part: two numbers each, MOST_PARTS at most.
    sums = found.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, total = {}, 0
    for r in sums:
        starts[r["part"]] = total
        total += r["n"]

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for part, start, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids, docs, nulls, lengths = coder.decode(payload)
                ends = np.cumsum(lengths, dtype=np.int64)
                at = starts[part] + start + ends - lengths
                wide = strings(ids.astype("<u4").view(np.uint8), (ends - lengths) * 4, len(ids) * 4)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=nulls), pa.array(at.astype(np.int64)), pa.array(lengths.astype(np.int64)), wide], names=["doc_id", "start", "n_tokens", "ids"])

    own = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lead = found.select("part", "block", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("lead"))
    return found.join(lead, ["part", "block"]).select("part", "lead", "payload").mapInArrow(before, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes df's ids to a fresh shared folder and returns, from the files read back, doc_id, start, n_tokens, ids_crc32."""
    path = f"{shared_folder(df.sparkSession)}/tokens"
    write_tokens(df, path, tokenizer, end_id, id_col, text_col)
    return read_tokens(df.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
