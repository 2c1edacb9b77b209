"""Secret scans: a trigram inverted index narrows documents, regular expressions verify them.

Each rule's regular expression is parsed and turned into a Boolean query on lower-case byte trigrams that every
match must hold. A block of documents is indexed (trigram -> ascending document numbers, for trigrams that some
rule asks for), postings are intersected and united as the query says, and only the candidates are scanned by the
expression. A rule with no mandatory trigram (runs of hexadecimal digits) scans every document of the block.

Defined results: null text counts as empty; empty text has no spans and the digest of the empty string; repeated
rows each give a row; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from re import _constants as sre, _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, bounded, flat, narrowed, per_block

#: Kinds in the order in which spans of one start are listed: name, expression, group that is measured, its least length.
BASE_RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.ASCII | re.IGNORECASE),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, re.ASCII),
    ("hex", r"[0-9a-f]+", 0, 32, re.ASCII),
]
MORE_RULES = [
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, re.ASCII),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, re.ASCII),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, re.ASCII),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, re.ASCII),
    ("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{16,}=*", 0, 1, re.ASCII | re.IGNORECASE),
    ("url_password", r"[a-z]{2,10}://[A-Za-z0-9._-]{1,64}:[^\s:@/]{3,64}@[A-Za-z0-9.-]+", 0, 1, re.ASCII),
]
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
#: Exact string sets larger than this are turned into trigrams and given up.
MOST_STRINGS = 64


def trigram_query(pattern: str):
    """True (no trigram is mandatory), a trigram (bytes), ('and', [...]) or ('or', [...]); letters in lower case."""
    exact, query = _analyse(sre_parse.parse(pattern))
    return _both(query, _of_strings(exact))


def _both(a, b):
    parts = [x for q in (a, b) for x in ([] if q is True else q[1] if q[0] == "and" and isinstance(q, tuple) else [q])]
    parts = list(dict.fromkeys(parts))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(parts):
    parts = list(dict.fromkeys(parts))
    return True if not parts or any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings):
    """What a text that holds one of the strings must hold."""
    if strings is None or any(len(s) < 3 for s in strings):
        return True
    found = []
    for s in strings:
        query = True
        for i in range(len(s) - 2):
            query = _both(query, s[i : i + 3])
        found.append(query)
    return _either(found)


def _analyse(items):
    """The set of all strings that items can match (None: too many to say), and a query beside it."""
    exact, query = {b""}, True
    for op, arg in items:
        own, more = _one(op, arg)
        query = _both(query, more)
        if own is not None and exact is not None and len(own) * len(exact) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in own}
        else:
            query = _both(query, _of_strings(exact))
            exact = own
    if exact is not None and len(exact) > MOST_STRINGS:
        exact, query = None, _both(query, _of_strings(exact))
    # a part before exact was given up: then exact is only a suffix, and its trigrams hold all the same
    whole = exact if all(_one(op, arg)[0] is not None for op, arg in items) and _product(items) <= MOST_STRINGS else None
    return (whole, query) if whole is not None else (None, _both(query, _of_strings(exact)))


def _product(items):
    n = 1
    for op, arg in items:
        own = _one(op, arg)[0]
        n *= len(own) if own is not None else MOST_STRINGS + 1
    return n


def _one(op, arg):
    if op is sre.LITERAL:
        return {chr(arg).lower().encode() if arg < 128 else chr(arg).encode()}, True
    if op is sre.IN:
        chars = set()
        for kind, value in arg:
            if kind is sre.LITERAL and value < 128:
                chars.add(chr(value).lower().encode())
            elif kind is sre.RANGE and value[1] < 128 and value[1] - value[0] < 8:
                chars |= {chr(c).lower().encode() for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return chars, True
    if op is sre.SUBPATTERN:
        return _analyse(arg[-1])
    if op is sre.BRANCH:
        parts = [_analyse(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and len(union := set().union(*(e for e, _ in parts))) <= MOST_STRINGS:
            return union, True
        return None, _either([_both(q, _of_strings(e)) for e, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, sub = arg
        exact, query = _analyse(sub)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {b""}, True
        if low == high and exact is not None and len(exact) ** low <= MOST_STRINGS:
            out = {b""}
            for _ in range(low):
                out = {a + b for a in out for b in exact}
            return out, True
        return None, True if low == 0 else _both(query, _of_strings(exact))
    if op is sre.AT:
        return {b""}, True
    return None, True


def trigrams_of(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


def _ask(query, postings, n: int) -> np.ndarray:
    """Ascending numbers of the documents that fulfil the query."""
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return postings.get(query, np.empty(0, np.int64))
    found = [_ask(x, postings, n) for x in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(found))
    out = min(found, key=len)
    for x in sorted(found, key=len):
        out = np.intersect1d(out, x, assume_unique=True) if len(out) else out
    return out


def index_block(data: np.ndarray, offsets: np.ndarray, wanted: list[bytes], table: np.ndarray) -> dict[bytes, np.ndarray]:
    """Postings of the wanted trigrams over the documents of a block; table: trigram code -> number in wanted + 1."""
    if len(data) < 3:
        return {}
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    code = low[:-2].astype(np.int32) << 16
    code |= low[1:-1].astype(np.int32) << 8
    code |= low[2:]
    hits = np.flatnonzero(table[code])
    doc = np.searchsorted(offsets, hits, "right") - 1
    inside = hits + 3 <= offsets[doc + 1]
    pairs = np.unique(table[code[hits[inside]]].astype(np.int64) * len(offsets) + doc[inside])
    which, doc = np.divmod(pairs, len(offsets))
    cuts = np.searchsorted(which, np.arange(1, len(wanted) + 2))
    return {t: doc[cuts[k] : cuts[k + 1]] for k, t in enumerate(wanted)}


class Rules:
    def __init__(self, rules):
        self.kinds = [r[0] for r in rules]
        self.rules = [(re.compile(p, flags), group, least) for _, p, group, least, flags in rules]
        self.queries = [trigram_query(p) for _, p, *_ in rules]
        self.wanted = sorted(set().union(*map(trigrams_of, self.queries)))
        self.table = None

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Spans (start, kind's place, end) in code points by document, sorted."""
        if self.table is None:
            self.table = np.zeros(1 << 24, np.min_scalar_type(len(self.wanted)))
            for k, t in enumerate(self.wanted):
                self.table[int.from_bytes(t, "big")] = k + 1
        n, raw = len(offsets) - 1, data.tobytes()
        postings = index_block(data, offsets, self.wanted, self.table)
        found: dict[int, list[tuple[int, int, int]]] = {}
        texts: dict[int, str] = {}
        for k, (expression, group, least) in enumerate(self.rules):
            for doc in _ask(self.queries[k], postings, n).tolist():
                if (text := texts.get(doc)) is None:
                    text = texts[doc] = raw[offsets[doc] : offsets[doc + 1]].decode("utf-8", "replace")
                for m in expression.finditer(text):
                    if m.end(group) - m.start(group) >= least:
                        found.setdefault(doc, []).append((m.start(), k, m.end()))
        return {doc: sorted(x) for doc, x in found.items()}

    def text(self, spans) -> str:
        return ",".join(f"{self.kinds[k]}:{a}:{b}" for a, k, b in spans)


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", more_rules=MORE_RULES) -> DataFrame:
    """One row per row of df: counts of the base kinds, digest of the base spans, all spans.

    more_rules: rules beyond the base ones, as (kind, expression, measured group, least length, flags)."""
    rules = Rules([*BASE_RULES, *more_rules])
    n_base = len(BASE_RULES)

    def block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        found = rules.scan(data, offsets)
        none = hashlib.sha256(b"").hexdigest()
        n = rows.num_rows
        counts, digests, spans, totals = np.zeros((n_base, n), np.int64), [none] * n, [""] * n, np.zeros(n, np.int64)
        for doc, own in found.items():
            base = [x for x in own if x[1] < n_base]
            for _, k, _ in base:
                counts[k, doc] += 1
            digests[doc], spans[doc], totals[doc] = hashlib.sha256(rules.text(base).encode()).hexdigest(), rules.text(own), len(own)
        return pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(totals)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return per_block(narrowed(df, id_col, text_col), block, SCHEMA)


def without_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", more_rules=MORE_RULES) -> DataFrame:
    """df with each secret replaced by [kind]; rows without one stay as they are, null text stays null.

    Where spans overlap, they are replaced together by the kind of the first."""
    bounded(df.sparkSession)
    rules = Rules([*BASE_RULES, *more_rules])
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            column, done = batch.column(at), 0
            for rows, data, offsets in blocks(iter([pa.RecordBatch.from_arrays([column], names=["text"])])):
                own = rows.column(0)
                if found := rules.scan(data, offsets):
                    texts = own.to_pylist()
                    for doc, spans in found.items():
                        texts[doc] = masked(texts[doc], spans, rules.kinds)
                    own = pa.array(texts, column.type)
                yield batch.slice(done, len(own)).set_column(at, batch.schema.field(at), own)
                done += len(own)

    return df.mapInArrow(run, df.schema)


def masked(text: str, spans, kinds) -> str:
    parts, last = [], 0
    for start, kind, end in spans:
        if start >= last:
            parts += [text[last:start], f"[{kinds[kind]}]"]
        last = max(last, end)
    return "".join([*parts, text[last:]])
