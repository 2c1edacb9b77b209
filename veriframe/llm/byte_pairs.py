"""Byte-level BPE by a rank file: encoding with offsets, and decoding.

The tokenizers library encodes. Its model is made from the ranks: bytes are mapped to printable characters by the usual
rule, and each token of several bytes gets one merge. Which one is derived: until a token is whole, merges within its
bytes don't depend on what stands around it (a merge across its edge would keep it from becoming one), so the two parts
that it comes from are always those left when its bytes alone are merged lowest rank first. Merging by rank any pair
whose bytes are a token, leftmost first, is therefore the same as merging by these pairs; a token that its own bytes don't
reach stands for a whole match of the pattern only.

Texts are cut into parts where the pattern must cut too (tokens.cut), and each distinct part is encoded once a process.
Decoding reverses the byte table and joins bytes before they are read as UTF-8, so characters that tokens split come out whole;
bytes that are no UTF-8 become U+FFFD in text, and stay as they are in bytes.

Defined results: null text counts as empty and has no ids; rows stand for themselves, so repeated rows and null ids of documents
give a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrowed, per_block, ragged
from .tokens import Encoder, cut

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens' bytes and ranks of a file with a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def parents(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that token comes from, or None where its own bytes don't get there."""
    parts = [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        least, at = min(((ranks.get(a + b, len(ranks) << 1), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
        if least >= len(ranks) << 1:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def rank_tokenizer(path: str, pattern: str):
    """The tokenizers library's tokenizer for a rank file and the pattern whose matches are merged apart."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, characters = read_ranks(path), byte_characters()
    shown = lambda token: "".join(characters[b] for b in token)
    ordered = sorted(ranks, key=ranks.__getitem__)
    merges = [(shown(two[0]), shown(two[1])) for token in ordered if len(token) > 1 and (two := parents(token, ranks))]
    made = Tokenizer(models.BPE(vocab={shown(t): k for t, k in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


class ByteModel(Encoder):
    """Encoder of a rank file, and its ids' bytes (surface, at and length by id; ids that don't exist have no bytes)."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer = rank_tokenizer(path, pattern)  # the rest as in Encoder, which reads a tokenizer's own file
        self.known, self.ids, self.at = {}, np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)
        back = {c: b for b, c in enumerate(byte_characters())}
        tokens = {k: bytes(back[c] for c in shown) for shown, k in self.tokenizer.get_vocab().items()}
        self.n = max(tokens) + 1
        raw = [tokens.get(k, b"") for k in range(self.n)]
        self.length = np.array([len(x) for x in raw], np.int64)
        self.at_surface = np.cumsum(self.length) - self.length
        self.surface = np.frombuffer(b"".join(raw), np.uint8)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and n + 1 offsets."""
        parts, texts = cut(data, offsets)
        coded = parts.dictionary_encode()
        starts, lengths = self.parts(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = coded.indices.to_numpy(zero_copy_only=False)
        each = lengths[which]
        return self.ids[ragged(starts[which], each)], np.concatenate([[0], np.cumsum(each)])[texts]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids, one after the other."""
        return self.surface[ragged(self.at_surface[ids], self.length[ids])]


_MODELS: dict[tuple[str, str], ByteModel] = {}


def byte_model(path: str, pattern: str) -> ByteModel:
    """The model of a file, read once per Python process."""
    if (path, pattern) not in _MODELS:
        _MODELS[path, pattern] = ByteModel(path, pattern)
    return _MODELS[path, pattern]


def byte_encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and for each id where it stands in the text: its first byte and the byte behind it (byte_starts, byte_ends), and the
    characters it has a part of (starts, ends; end exclusive), which neighbours share where tokens split a character."""

    def block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        model = byte_model(path, pattern)
        ids, ends = model.encode(data, offsets)
        width = model.length[ids]
        last = np.cumsum(width)
        base = np.repeat(offsets[:-1], np.diff(ends))
        character = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters that start before each byte
        first = last - width
        inside = (np.append(data, 0)[first] & 0xC0) == 0x80 if len(first) else np.zeros(0, bool)
        shift = character[base]
        columns = [ids.astype(np.int32), first - base, last - base, character[first] - inside - shift, character[last] - shift]
        listed = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c, pa.int32())) for c in columns]
        return pa.RecordBatch.from_arrays([rows.column(0), *listed], names=["doc_id", "ids", "byte_starts", "byte_ends", "starts", "ends"])

    return per_block(narrowed(df, id_col, text_col), block, "doc_id long, ids array<int>, byte_starts array<int>, byte_ends array<int>, starts array<int>, ends array<int>")


def byte_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes and text of rows with ids; null ids give null, null elements and ids that the file doesn't have are left out."""

    def run(batches):
        model = byte_model(path, pattern)
        for batch in batches:
            raw = []
            for own in batch.column(1).to_pylist():
                ids = np.array([i for i in own or [] if i is not None and 0 <= i < model.n], np.int64)
                raw.append(None if own is None else model.decode(ids).tobytes())
            text = [None if x is None else x.decode("utf-8", "replace") for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(text, pa.string())], names=["doc_id", "bytes", "text"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary, text string")


def byte_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: number of ids, digests of the ids (unsigned, 32 bits, little-endian) and of the bytes decoded from them."""

    def block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        model = byte_model(path, pattern)
        ids, ends = model.encode(data, offsets)
        back = model.decode(ids)
        places = np.concatenate([[0], np.cumsum(model.length[ids])])[ends]
        digest = lambda raw, at, size: pa.array([hashlib.sha256(raw[size * a : size * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())
        whole = memoryview(ids.astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(ends)), digest(whole, ends, 4), digest(memoryview(back.tobytes()), places, 1)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return per_block(narrowed(df, id_col, text_col), block, SCHEMA)
