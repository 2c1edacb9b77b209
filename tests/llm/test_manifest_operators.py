"""Byte-level BPE, collocations and the Merkle manifest against the library and brute force."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from veriframe.llm import byte_pairs, collocations, merkle, queries
from veriframe.llm.common import flat

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", None, " ", "\n\n  x", "é", "x" * 20_000, "a b " * 4000, "\x00  ﬁ 😀😀", "don't DON'T we'll 12345 -----====  \t", "<|endoftext|>", "日本語 текст ñandú"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(RANKS), special_tokens={})


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def documents(spark, texts, more="n k row lang_ key pos block digest upper"):
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (0, texts[0]), (None, "null id"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in more.split()}), rows


def test_byte_pairs(spark, library):
    r = random.Random(5)
    texts = ODD + ["".join(r.choices(["the", "ing", " ", "  ", "\n", "-", "=", "é", "😀", "1", "'s", "Q", "x", "文", "."], k=r.randint(0, 80))) for _ in range(200)]
    df, rows = documents(spark, texts)
    want = []
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert key(byte_pairs.byte_digests(df, RANKS, public_tokenizers.PATTERN).collect()) == key(want)
    assert byte_pairs.byte_digests(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    encoded = byte_pairs.byte_encode(df, RANKS, public_tokenizers.PATTERN)
    for row in encoded.collect():
        options = [t or "" for d, t in rows if d == row["doc_id"] and library.encode_ordinary(t or "") == row["ids"]]
        assert options
        raw = options[0].encode()
        for i, a, b, s, e in zip(*(row[c] for c in ("ids", "byte_starts", "byte_ends", "starts", "ends"))):
            assert raw[a:b] == library.decode_single_token_bytes(i) and raw[a:b] in options[0][s:e].encode() and len(options[0][s:e].encode()) - (b - a) < 7
    back = byte_pairs.byte_decode(encoded.select("doc_id", "ids", F.lit(0).alias("bytes")), RANKS, public_tokenizers.PATTERN)
    assert key((r["doc_id"], r["text"]) for r in back.collect()) == key((d, t or "") for d, t in rows)
    odd = spark.createDataFrame([(1, [12520]), (2, None), (3, [99_999, None, -1, 64])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: (r["bytes"], r["text"]) for r in byte_pairs.byte_decode(odd, RANKS, public_tokenizers.PATTERN).collect()}
    assert got[2] == (None, None) and got[3][1] == "a" and bytes(got[1][0]).decode("utf-8", "replace") == got[1][1]


def test_every_character(library):
    """The pattern cuts as the other library's does for each code point, before and behind letters, digits, spaces and itself."""
    model = byte_pairs.byte_model(RANKS, public_tokenizers.PATTERN)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 17 == 0)]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1 {chr(c)} .{chr(c)}" for c in points]
    ids, ends = model.encode(*flat(pa.array(texts)))
    assert all(ids[a:b].tolist() == own for a, b, own in zip(ends, ends[1:], library.encode_ordinary_batch(texts)))


def test_merges_of_ranks(library):
    """One merge a token is enough: runs that could be cut in several ways give the ids of merging by rank."""
    model = byte_pairs.byte_model(RANKS, public_tokenizers.PATTERN)
    r = random.Random(2)
    texts = [c * k for c in "-=* a\n" for k in range(90)] + ["".join(r.choices("-=*a_", k=r.randint(1, 200))) for _ in range(1500)] + ["".join(r.choices("abcdest", k=r.randint(1, 40))) for _ in range(3000)]
    ids, ends = model.encode(*flat(pa.array(texts)))
    assert all(ids[a:b].tolist() == library.encode_ordinary(t) for a, b, t in zip(ends, ends[1:], texts))


def collocation_model(rows, least, longest=5, first=2000):
    counts, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = {p: n for p, n in f.items() if n >= least}
        inner = {" ".join(w[i:j]) for p in kept for w in [p.split(" ")] for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * kept[p] >= 100 * kept[" ".join(w[i:j])]}
        scored = []
        for p, a in kept.items():
            w = p.split(" ")
            if len(w) > 1 and p not in inner:
                score, _, left, right = min((1000 * a * words[lang] // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w)))
                scored.append((-score, -a, p.encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, words[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:first], 1)]
    return key(out)


@pytest.fixture(scope="module")
def phrases():
    r = random.Random(8)
    words = ["the", "of", "a", "Cat", "dog", "é", "x-y", "sat", "on", "mat", "'s", "\x00"]
    sentence = lambda: " ".join(r.choices(words, weights=[9, 6, 6, 3, 3, 2, 2, 1, 1, 1, 1, 1], k=r.randint(1, 14)))
    rows = [(r.choice(["en", "fr", None, "und", "en"]), r.choice([". ", "\n", ";;", " ", "\t"]).join(sentence() for _ in range(r.randint(0, 9)))) for _ in range(150)]
    rows += [("en", "New York City is big. ") for _ in range(12)] + [("en", None), ("fr", ""), (None, None), ("xx", "...!"), ("yy", "one word")] + [rows[0]] * 3
    return rows


@pytest.mark.parametrize("least, longest, buckets", [(3, 5, 1 << 16), (10, 5, 8), (1, 3, 1 << 10), (200, 5, 64)])
def test_collocations(spark, phrases, least, longest, buckets):
    """With few buckets all bits are set and the counts decide alone."""
    df = spark.createDataFrame(phrases, "lang string, text string").repartition(4).withColumns({c: F.lit(1) for c in ("n", "phrase", "words", "slice", "a", "l", "r")})
    assert key(collocations.collocations(df, least, longest, buckets=buckets).collect()) == collocation_model(phrases, least, longest)
    assert collocations.collocations(df.limit(0), least, longest, buckets=buckets).count() == 0


def test_first_collocations(spark, phrases):
    df = spark.createDataFrame(phrases, "lang string, text string")
    assert key(collocations.collocations(df, 2, 4, first=7, buckets=1 << 12).collect()) == collocation_model(phrases, 2, 4, 7)


def test_bucket_counts_lose_nothing(phrases):
    """A bucket's bytes stop at the least count; bits are set for all phrases that have it."""
    table = pa.record_batch({"lang": [x or "und" for x, _ in phrases], "text": [t or "" for _, t in phrases]})
    rows = list(collocations._scan(iter([table]), 1, 1 << 12, 5, True, None, None))
    sums = np.zeros(1 << 12, np.int64)
    for batch in rows:
        for k, own in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
            if own:
                collocations._add(sums[k * collocations.SLICE : (k + 1) * collocations.SLICE], own)
    frequent = [x for x in collocation_model(phrases, 5, 2) if x[3] >= 5]
    for lang, _, phrase, *_ in frequent:
        own = collocations.mixed(collocations.text_hashes(pa.array([lang])), [collocations.text_hashes(pa.array([w.encode()])) for w in phrase.split(" ")])
        assert sums[collocations._bucket(own, 1 << 12)[0]] >= 5
    assert sums.max() <= 5 and frequent


@pytest.mark.parametrize("share", [0, 0.001, 0.2, 0.9])
def test_packed_counts(share):
    """Dense and sparse slices give the counts back, added over tasks."""
    r = np.random.default_rng(1)
    counts = [np.where(r.random(1 << 18) < share, r.integers(1, 101, 1 << 18), 0).astype(np.uint8) for _ in range(3)]
    sums = np.zeros(1 << 18, np.int64)
    for own in counts:
        for slices, packed in collocations._packed(own):
            for k, raw in zip(slices.to_pylist(), packed.to_pylist()):
                collocations._add(sums[k * collocations.SLICE : (k + 1) * collocations.SLICE], raw)
    assert (sums == np.sum(counts, axis=0, dtype=np.int64)).all()


def test_distinct_tuples():
    """Numbers too wide for one of 62 bits are made dense on the way."""
    r = np.random.default_rng(2)
    parts = [r.integers(0, 3, 500), *(r.choice([0, 1, (1 << 24) - 1], 500) for _ in range(5))]
    got, n = collocations._distinct(parts)
    assert Counter(dict(zip(zip(*(p.tolist() for p in got)), n.tolist()))) == Counter(zip(*(p.tolist() for p in parts)))


def test_long_products(spark):
    """Products beyond 64 bits stay exact."""
    assert spark.sql("SELECT cast((cast(1000 as decimal(4,0)) * cast(99999999999999 as decimal(14,0)) * cast(999999999999999999 as decimal(18,0))) div (cast(100000000000001 as decimal(18,0)) * cast(100000000000003 as decimal(18,0))) as long)").first()[0] == 1000 * 99999999999999 * 999999999999999999 // (100000000000001 * 100000000000003)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_model(rows, fields=5):
    enc = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda row: digest(*map(enc, row))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, at):
        out = []
        for nodes in levels[:-1]:
            first = at // 16 * 16
            out.append((nodes[first:at], nodes[at + 1 : first + 16]))
            at //= 16
        return out

    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in order}
    top = tree([trees[s][-1][0] for s in order]) if order else [[]]
    out = []
    for k, s in enumerate(order):
        for at, row in enumerate(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            sides = path(trees[s], at) + path(top, k)
            own = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                own = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            now = leaf(own)
            for a, b in sides:
                now = digest(*a, now, *b)
            out.append((row[0], leaf(row), trees[s][-1][0], top[-1][0], digest(*(x for a, b in sides for x in a + b)), now, now == top[-1][0]))
    return key(out)


@pytest.fixture(scope="module")
def leaves():
    r = random.Random(4)
    rows = [(k, r.choice(["a", "a", "a", "é", "b:1", None, ""]), r.choice(["en", None]), r.choice([None, 3, 40]), r.choice(["Text", "text", None, "", "É ß X", "y" * 3000])) for k in range(700)]
    rows += [(5000, f"s{k}", "en", 1, "One") for k in range(40)] + [rows[0], rows[0], (None, "a", "en", 1, "Null id"), (None, "a", "en", 1, "Null id too"), (rows[3][0], rows[3][1], "other", 1, "Same id")]
    return rows


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest(spark, leaves, height):
    """Blocks of 16 nodes give several tiers, those of 4,096 one."""
    df = spark.createDataFrame(leaves, "doc_id long, source string, lang string, n_chars int, text string").repartition(5)
    df = df.withColumns({c: F.lit(1) for c in ("key", "pos", "n", "digest", "upper", "changed", "block", "own", "leaf", "k__")})
    assert key(merkle.merkle_manifest(df, height=height).collect()) == manifest_model(leaves)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17])
def test_small_manifests(spark, n):
    rows = [(k, "s", "en", 1, f"Text {k}") for k in range(n)]
    got = key(merkle.merkle_manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")).collect())
    assert got == manifest_model(rows)
    assert n != 1 or got[0][1] == got[0][2] == got[0][3]


@pytest.mark.parametrize("n", [1, 15, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_traversal(n):
    """Existing and desired subtrees give the siblings of the whole tree, also in blocks whose runs of one are raised to the full height."""
    nodes = [digest(str(k)) for k in range(n)]
    for levels in {merkle.levels_of(n), 3}:
        whole = [nodes]
        for _ in range(levels):
            whole.append([digest(*whole[-1][i : i + 16]) for i in range(0, len(whole[-1]), 16)])
        for i, own in enumerate(merkle.proofs(nodes, levels)):
            for k, (a, b) in enumerate(own):
                at = i // 16**k
                assert a == "".join(whole[k][at // 16 * 16 : at]) and b == "".join(whole[k][at + 1 : at // 16 * 16 + 16])
            assert merkle.folded(nodes[i], own) == whole[-1][0]
        assert merkle.block_root(nodes, levels) == whole[-1][0]


@pytest.mark.parametrize("name", ["op12_collocations", "op13_merkle_manifest"])
def test_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got, want = queries.queries()[name](spark, folder), duck.execute(queries.oracle_sql()[name])
    order = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(order) and key(got.select(*order).collect()) == key(want.fetchall())
