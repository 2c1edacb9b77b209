"""Operators over the whole collection against brute force: substrings, leaks, near copies, revisits, the pipeline."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veriframe.llm import decontaminate, jaccard, queries, revisits, substrings

CLASH = ["start", "gram", "key", "cls", "comp", "spans", "n", "score", "item_id", "words", "want", "doc"]


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def removed_model(rows):
    texts, seen = [(t or "").encode() for _, t in rows], Counter()
    for b in texts:
        seen.update(b[i : i + 400] for i in range(len(b) - 399))
    out = []
    for (doc, _), b in zip(rows, texts):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone])) == 1)
        out.append((doc, len(b), int(gone.sum()), len(edge), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    runs = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    return key((*o, len({j for i in range(len(w) - 50) if runs[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)})) for o, w in zip(out, words))


@pytest.fixture(scope="module")
def copied():
    r = random.Random(1)
    text = lambda n: "".join(r.choices("abcdeé \n", k=n))
    base = [text(r.choice([300, 399, 400, 401, 450, 700, 1200, 3000])) for _ in range(30)]
    docs = list(base)
    for _ in range(60):
        b, k = r.choice(base), r.random()
        i = r.randrange(len(b))
        docs.append(b if k < 0.2 else b[:i] + "Z" + b[i + 1 :] if k < 0.5 else text(50) + b[i : i + r.choice([380, 400, 420, 800])] + text(80) if k < 0.8 else b + text(20) + b)
    for _ in range(25):  # passages of short words
        words = " ".join(r.choices("a b c d ee".split(), k=r.choice([50, 51, 52, 70, 120])))
        docs += [f"{text(30)} {words} {text(30)}" for _ in range(r.choice([1, 2, 3]))]
    docs += ["", None, "a" * 1000, "ab" * 700, "x" * 399, "a" * 400, "abc" * 300]
    rows = list(enumerate(docs))
    return [*rows, rows[2], rows[2], (None, text(500)), (None, docs[7])]


def test_substrings(spark, copied, monkeypatch):
    df = spark.createDataFrame(copied, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in CLASH})
    want = removed_model(copied)
    assert key(substrings.without_repeats(df).collect()) == want
    assert substrings.without_repeats(df.limit(0)).count() == 0
    for most in (("MOST_STRINGS",), ("MOST_STRINGS", "MOST_SPLIT")):  # all grams of several strings in four classes; in single windows
        for name in most:
            monkeypatch.setattr(substrings, name, 1)
        assert key(substrings.without_repeats(df).collect()) == want


def test_substrings_without_ids(spark):
    """Rows without an id and repeated rows stand for themselves."""
    r = random.Random(41)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    shared = text(450)
    rows = [(None, text(300) + shared + text(100 + k)) for k in range(60)] + [(None, text(900)) for _ in range(60)] + [(7, text(900))] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert key(substrings.without_repeats(df).collect()) == removed_model(rows)


@pytest.mark.parametrize("n", [7, 3000, 2 * substrings.PROFILE_BYTES + 50])
def test_gram_and_word_hashes(n):
    """Grams and words have equal hashes where they are equal, wherever they stand, and others where they aren't."""
    r = np.random.default_rng(n)
    texts = ["".join(r.choice(list("ab \n"), min(n, 3000))), "", " ", "ab", "a", " ab a", "x" * max(0, n - 3000), "é a"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    words = [w for t in texts for w in re.findall("[^\x20\x09-\x0d]+", t)]
    own, at = substrings.symbols(data, offsets, substrings.WORDS)
    assert np.diff(at).tolist() == [len(re.findall("[^\x20\x09-\x0d]+", t)) for t in texts]
    assert len(own) == len(words) and len(set(zip(words, own.tolist()))) == len(set(words)) == len(set(own.tolist()))
    code = substrings.gram_hashes(substrings._TABLE[data], 4)
    grams = [data[i : i + 4].tobytes() for i in range(min(len(code), 5000))]
    assert len(code) == max(0, len(data) - 3) and len(set(zip(grams, code.tolist()))) == len(set(grams)) == len(set(code[: len(grams)].tolist()))


def test_segments_are_all_windows():
    """Each window of each text lies in one segment, and its gram is the leftmost of the least ones in it."""
    r = random.Random(5)
    texts = [bytes(r.choices(b"abc", k=n)) for n in (0, 399, 400, 401, 1500, 0, 800)] + [b"a" * 900]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    start, windows, dist, gram, at = substrings.segments(data, offsets)
    code = substrings.gram_hashes(substrings._TABLE[data], 64)
    for k in range(len(texts)):
        mine = [(int(s) + i, int(s + d), g) for s, n, d, g in zip(*(x[at[k] : at[k + 1]] for x in (start, windows, dist, gram))) for i in range(n)]
        assert [m[0] for m in mine] == list(range(offsets[k], offsets[k + 1] - 399))
        for w, place, g in mine:
            lead = code[w : w + 337] >> np.uint64(32)
            assert place == w + int(np.argmin(lead)) and g == code[place]


def test_split_groups(monkeypatch, copied):
    """Groups of many strings are split by class of distance; the windows found are the same."""
    texts = [(t or "").encode() for _, t in copied if t]
    whole, split = set(), set()
    from veriframe.llm.common import flat
    import pyarrow as pa

    data, offsets = flat(pa.array(texts, pa.binary()))
    start, windows, dist, gram, at = substrings.segments(data, offsets)
    raw = data.tobytes()
    rows = sorted((int(g.view(np.int64)), int(s), int(w), int(d)) for g, s, w, d in zip(gram, start, windows, dist))
    for (g, s, w, d), hit in zip(rows, substrings.repeated([(g, w, d, raw[s : s + w + 399]) for g, s, w, d in rows])):
        whole |= {s + int(i) for i in np.flatnonzero(hit)}
    parts = []
    for g, s, w, d in rows:
        for q in range(4):
            first, stop = max(0, d - (q + 1) * substrings.QUARTER + 1), min(w, d - q * substrings.QUARTER + 1)
            if first < stop:
                core = raw[s + d - q * substrings.QUARTER : s + d - q * substrings.QUARTER - substrings.QUARTER + 401]
                parts.append((hash((g, q, core)), s + first, stop - first, d - first))
    parts.sort()
    for (_, s, w, d), hit in zip(parts, substrings.repeated([(k, w, d, raw[s : s + w + 399]) for k, s, w, d in parts])):
        split |= {s + int(i) for i in np.flatnonzero(hit)}
    assert whole == split and len(whole) > 1000
    monkeypatch.setattr(substrings, "COLUMN_BYTES", 1)  # columns in a file
    again = set()
    for (g, s, w, d), hit in zip(rows, substrings.repeated([(g, w, d, raw[s : s + w + 399]) for g, s, w, d in rows])):
        again |= {s + int(i) for i in np.flatnonzero(hit)}
    assert again == whole


def near_rows():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(50):
        n = r.choice([1, 2, 3, 5, 9, 12, 14, 20, 40, 80, 150, 400, 1500])
        base = r.choices(words, k=n)
        docs.append(" ".join(base))
        for _ in range(r.randint(0, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, n // 45))):
                w[r.randrange(len(w))] = r.choice(words)
            base = w if r.random() < 0.5 else base
            docs.append("  \n".join(w).upper() if r.random() < 0.3 else " ".join(w))
    docs += ["", None, "   ", "a", "A", "a b", " a  b ", "b a"]
    r.shuffle(docs)
    rows = list(enumerate(docs))
    return [*rows, rows[3], rows[10], (None, "zz yy"), (None, docs[5])]


def component_model(rows, percent=90, width=3):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min((x for x in (least.get(top(i)), doc) if x is not None), default=None)
    return key((doc, len(sets[i]), least[top(i)]) for i, (doc, _) in enumerate(rows))


def test_near_copies(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in CLASH})
    want = component_model(rows)
    assert key(jaccard.jaccard_components(df).collect()) == want
    one = jaccard.one_of_each(df.where("doc_id is not null"))
    own = component_model([x for x in rows if x[0] is not None])
    assert one.columns == df.columns and sorted(x["doc_id"] for x in one.collect()) == sorted({d for d, _, c in own if d == c})
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_near_copies_stage(spark):
    """The pipeline's stage takes runs of five words and 80 %."""
    import corpus_pipeline

    r = random.Random(14)
    rows = [x for x in dict(near_rows()).items() if x[0] is not None]
    base = [f"s{i}" for i in range(100)]
    longer = [*base, *(f"t{i}" for i in range(15))]
    twice = [w if k not in (30, 70) else f"u{k}" for k, w in enumerate(base)]
    apart = [w if k % 10 else f"x{k}" for k, w in enumerate(base)]
    rows += [(1000 + k, " ".join(w)) for k, w in enumerate([base, longer, twice, apart])]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = component_model(rows, 80, 5)
    assert key(jaccard.jaccard_components(df, percent=80, width=5).collect()) == want
    kept = {x["doc_id"] for x in corpus_pipeline.near_copies_stage(spark, df, "").collect()}
    assert kept == {d for d, _, c in want if d == c} and kept & set(range(1000, 1004)) == {1000, 1003}


def test_keys_told_apart(spark):
    """Of keys with the same members one is searched, whatever their components; no set of members goes."""
    rows = [(k, c) for k, own in {1: "ab", 2: "ab", 3: "abc", 4: "bc", 5: "ab", 6: "bc"}.items() for c in own]
    members = spark.createDataFrame([(k, ord(c), ord(c)) for k, c in rows], "key long, cls long, comp long").repartition(3)
    assert sorted(map(tuple, jaccard._told_apart(members).select("key", "cls").collect())) == sorted((k, ord(c)) for k, c in rows if k in (1, 3, 4))


def test_one_of_each_row(spark):
    """Null and repeated ids: each component keeps one row, and rows of other components under the same id stay."""
    r = random.Random(15)
    clean, *texts = (" ".join(r.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(5))
    near = lambda t: t + " end"
    rows = [(1, texts[0]), (None, texts[0]), (None, near(texts[0])), (5, near(texts[0])), (5, clean)]
    rows += [(7, texts[1]), (7, near(texts[1])), (7, texts[1].upper())]
    rows += [(None, texts[2]), (None, near(texts[2])), (None, texts[2]), (None, texts[3]), (None, None), (8, ""), (9, "")]
    got = [(x["doc_id"], x["text"]) for x in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    of = lambda t: [x for x in got if x[1] and x[1].lower() in (t, near(t))]
    assert of(texts[0]) == [(1, texts[0])] and of(clean) == [(5, clean)] and of(texts[3]) == [(None, texts[3])]
    assert [x[0] for x in of(texts[1])] == [7] and [x[0] for x in of(texts[2])] == [None]
    assert len(got) == 8 and {(None, None), (8, ""), (9, "")} <= set(got)


def test_tree_search():
    r = np.random.default_rng(3)
    point = r.poisson(3, (700, jaccard.GROUPS)).astype(np.int32)
    point[350:] = point[:350] + (r.random((350, jaccard.GROUPS)) < 0.03)
    size, measure = point.sum(1), jaccard.Measure(90)
    tree = jaccard.Tree(point, size)
    bound = np.minimum(point[:, None], point[None]).sum(2)
    for i in range(0, 700, 7):
        assert sorted(tree.search(point[i], int(size[i]), measure).tolist()) == np.flatnonzero(measure.links(bound[i], size[i], size)).tolist()


def test_forest():
    """Searches of many entries at once give all pairs of unlike components that the bound allows, and few others are visited."""
    r = np.random.default_rng(4)
    n, measure = 600, jaccard.Measure(90)
    point = np.repeat(r.poisson(4, (30, jaccard.GROUPS)), 20, 0).astype(np.int32) + (r.random((n, jaccard.GROUPS)) < 0.02)
    size, ident, comp, entry = point.sum(1), r.permutation(n), r.integers(0, 40, n), np.repeat(np.arange(30) // 3, 20)
    bound = np.minimum(point[:, None], point[None]).sum(2)
    want = {(int(ident[a]), int(ident[b])) for a, b in np.argwhere(measure.links(bound, size[:, None], size[None]) & (ident[None] < ident[:, None]) & (entry[:, None] == entry[None]) & (comp[:, None] != comp[None]))}
    built, visited = jaccard.Tree.built, jaccard.Tree.visited
    a, b = jaccard.tree_pairs(entry, ident, comp, size, point, np.zeros(n, bool), None, measure)
    assert {(int(ident[x]), int(ident[y])) for x, y in zip(a, b)} == want and len(want) > 1000
    assert jaccard.Tree.built == built + 1 and 0 < jaccard.Tree.visited - visited < n * n / 4
    guest = r.random(n) < 0.3
    a, b = jaccard.tree_pairs(entry, ident, comp, size, point, guest, None, measure)
    assert {tuple(sorted((int(ident[x]), int(ident[y])))) for x, y in zip(a, b)} == {tuple(sorted((int(ident[x]), int(ident[y])))) for x, y in np.argwhere(measure.links(bound, size[:, None], size[None]) & (entry[:, None] == entry[None]) & (comp[:, None] != comp[None]) & ~(guest[:, None] & guest[None])) if x != y}


@pytest.mark.parametrize(("percent", "width"), [(90, 3), (80, 5)])
def test_entries_lose_nothing(percent, width):
    """Sets that link have an entry in common; trees find all links of a driver table and made copies, and visit few of all pairs."""
    import pyarrow.parquet as pq

    from veriframe.llm.common import flat

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    codes, at = jaccard.sets_of(*flat(pa.array(texts + [t for _, t in near_rows()], pa.string())), width)
    measure, size = jaccard.Measure(percent), np.diff(at)
    sets = [frozenset(codes[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    classes = {s: k for k, s in enumerate(sets) if s}
    rows = sorted(classes.values())
    holders = {}
    for k in rows:
        for c in sets[k]:
            holders.setdefault(c, []).append(k)
    links = {(a, b) for own in holders.values() if len(own) > 1 for a in own for b in own if a < b and 100 * min(size[a], size[b]) >= percent * max(size[a], size[b])}
    links = {(a, b) for a, b in links if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert len(links) > 50
    keys, ends = jaccard.entries(codes, at, measure)
    owner = np.repeat(np.arange(len(size)), np.diff(ends))
    inside = np.isin(owner, rows)
    owner, entry = owner[inside], np.unique(keys[inside], return_inverse=True)[1]
    order = np.argsort(entry, kind="stable")
    owner, entry = owner[order], entry[order]
    assert all(set(entry[owner == a]) & set(entry[owner == b]) for a, b in links)
    built, visited = jaccard.Tree.built, jaccard.Tree.visited
    point = jaccard.points(codes, at)
    a, b = jaccard.tree_pairs(entry, owner, owner, size[owner], point[owner], np.zeros(len(owner), bool), None, measure)
    assert links <= {(int(min(x)), int(max(x))) for x in zip(owner[a], owner[b])}
    assert jaccard.Tree.built > built and len(links) < jaccard.Tree.visited - visited < 40 * len(owner)


@pytest.mark.parametrize("percent", [10, 30, 40, 49, 50, 51, 60])
def test_entries_at_low_percentages(percent):
    """Partners may lie several levels apart; sets of one element link with larger ones up to 50 percent."""
    r = random.Random(percent)
    sets = []
    for _ in range(500):
        base = r.sample(range(4000), r.choice([1, 2, 3, 5, 9, 17, 40, 80, 200]))
        part = r.sample(base, max(1, len(base) * r.randint(percent, 100) // 100))
        sets += [base, part, part + r.sample(range(4000, 9000), r.randint(0, len(part)))]
    codes = [np.sort(jaccard.mixed(np.array(s, np.uint64))) for s in sets]
    at = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
    keys, ends = jaccard.entries(np.concatenate(codes), at, jaccard.Measure(percent))
    own = [set(keys[a:b].tolist()) for a, b in zip(ends, ends[1:])]
    n, linked = 0, [frozenset(s) for s in sets]
    for k in range(0, len(sets), 3):
        for a, b in ((k, k + 1), (k, k + 2), (k + 1, k + 2)):
            if linked[a] != linked[b] and 100 * len(linked[a] & linked[b]) >= percent * len(linked[a] | linked[b]):
                assert own[a] & own[b], (len(linked[a]), len(linked[b]))
                n += 1
    assert n > 150


@pytest.mark.parametrize("percent", [30, 50])
def test_components_at_low_percentages(spark, percent):
    r = random.Random(percent)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[(a := r.randrange(280)) : a + r.choice([1, 3, 4, 6, 12, 30])])) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert key(jaccard.jaccard_components(df, percent=percent).collect()) == component_model(rows, percent)
    for wrong in (0, 101):
        with pytest.raises(ValueError):
            jaccard.jaccard_components(df, percent=wrong)


def test_large_entries(spark, monkeypatch):
    """Entries of more members than a tree's are dealt out by size and hash; components stay the same."""
    r = random.Random(21)
    base = [f"w{i}" for i in range(150)]
    rows = [(k, " ".join(w if r.random() > 0.03 else r.choice(base) for w in base[: r.choice([150, 150, 120])])) for k in range(90)]
    rows += [(90 + k, " ".join(base[:20] + r.choices(base, k=100))) for k in range(20)]
    monkeypatch.setattr(jaccard, "TILE", 6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent, width in ((90, 3), (80, 5)):
        assert key(jaccard.jaccard_components(df, percent=percent, width=width).collect()) == component_model(rows, percent, width)


def smith_waterman(a, b):
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b, 1):
            now.append(max(0, last[j - 1] + (decontaminate.MATCH if x == y else -decontaminate.LOSS), last[j] - decontaminate.LOSS, now[-1] - decontaminate.LOSS))
        best, last = max(best, *now), now
    return best


def test_alignment():
    r = random.Random(8)
    for _ in range(60):
        a, b = r.choices(range(5), k=r.randint(1, 14)), r.choices(range(5), k=r.randint(1, 30))
        got, _ = decontaminate.align(np.array([[*a, -2, -2]]), np.array([len(a)]), np.array([[*b, -1]]))
        assert got[0] == smith_waterman(a, b)


def test_leaks(spark, monkeypatch):
    r = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    items = [(k, " ".join(r.choices(words, k=r.choice([12, 30, 60])))) for k in range(20)] + [(20, "uniqueone"), (21, "two uniques"), (22, ""), (23, None), (None, "null item has words enough to be found here")]
    docs, planted = [], set()
    for k in range(120):
        text = r.choices(words, k=r.randint(0, 200))
        if k % 3 == 0:
            item = k % 20
            copy = [w if r.random() > 0.12 else r.choice(words) for w in items[item][1].split()]
            text[len(text) // 2 : len(text) // 2] = copy
            planted.add((k, item))
        docs.append((k, " ".join(text)))
    docs += [(120, "so UniqueOne, here"), (121, "the two uniques are"), (122, None), (123, ""), (None, items[3][1]), (124, "xx " + items[-1][1])]
    docs += [(200 + k, items[5][1] + " " + " ".join(r.choices(words, k=20))) for k in range(80)]  # a third of all rows
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in CLASH})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(2))
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(df, bench).collect()}
    assert got == planted | {(120, 20), (121, 21), (None, 3), (124, None)} | {(200 + k, 5) for k in range(80)}
    left = decontaminate.without_leaks(df, bench)
    assert left.columns == df.columns and {x["doc_id"] for x in left.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0
    whole = key(decontaminate.leaks(df, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 0)  # the same by joins
    assert key(decontaminate.leaks(df, bench).collect()) == whole
    assert key(decontaminate.without_leaks(df, bench).collect()) == key(left.collect())


def test_leaks_brute_force(spark):
    """Every document against every item: alignments of whole texts, where the two share a seed."""
    r = random.Random(31)
    words = [f"w{i}" for i in range(150)]
    items = [(k, r.choices(words, k=r.choice([5, 9, 20, 40]))) for k in range(12)]
    docs = []
    for k in range(60):
        text = r.choices(words, k=r.choice([0, 3, 40, 150]))
        if k % 2:
            own = [w if r.random() > r.choice([0, 0.2, 0.35]) else r.choice(words) for w in items[k % 12][1]]
            text[len(text) // 2 : len(text) // 2] = [w for w in own if r.random() > 0.05]
        docs.append((k, text))
    docs.append((60, r.choices(words, k=20_000) + items[3][1]))
    runs = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    score = lambda item, text: smith_waterman(item, text) / (2 * len(item))
    want = {(d, i): score(item, t) for d, t in docs[:60] for i, item in items if runs(item) & runs(t)}
    want = {k: s for k, s in want.items() if s >= 0.5}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string").repartition(3)
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.leaks(df, spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")).collect()}
    assert {k: s for k, s in got.items() if k[0] < 60} == pytest.approx(want) and len(want) > 20 and got[60, 3] == 1


def edited(words, every):
    """words with each every-th one replaced."""
    return [f"edit{i}" if i % every == every - 1 else w for i, w in enumerate(words)]


@pytest.mark.parametrize("n_docs", [300, 60])
def test_shared_paraphrase(spark, n_docs):
    """One copy of an item, about 30 % of its words edited, in a third of all rows; also where 1 % is less than a row."""
    r = random.Random(12)
    words = [f"v{i}" for i in range(3000)]
    items = [(k, " ".join(r.choices(words, k=n))) for k, n in enumerate([30, 45, 60])]
    copy = items[1][1].split()
    copy = [w if k % 7 not in (2, 6) else f"edit{k}" for k, w in enumerate(copy)]
    docs = [(k, " ".join([*r.choices(words, k=40), *(copy if k % 3 == 0 else []), *r.choices(words, k=40)])) for k in range(n_docs)]
    own = items[1][1].split()
    assert smith_waterman(own, copy) >= len(own)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(df, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(k, 1) for k in range(0, n_docs, 3)}
    assert {x["doc_id"] for x in decontaminate.without_leaks(df, bench).collect()} == {k for k in range(n_docs) if k % 3}


def test_common_seeds(spark, monkeypatch):
    """One seed in all documents and all items: the shuffled way makes a row a document for it where items have nothing rarer only, and
    finds what the other way does; edited copies by their rarest seeds."""
    r = random.Random(17)
    words = [f"w{i}" for i in range(2000)]
    items = [(k, " ".join(["all", "have", "this", *r.choices(words, k=40)])) for k in range(30)] + [(30, "all have this")]
    docs = [(k, " ".join(["all", "have", "this", *r.choices(words, k=60)])) for k in range(400)]
    docs += [(400 + k, " ".join(["all", "have", "this", *r.choices(words, k=20), *(w if r.random() > 0.25 else "edit" for w in items[k][1].split()[3:])])) for k in range(30)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    whole = key(decontaminate.leaks(df, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 0)
    monkeypatch.setattr(decontaminate, "SALT_ROWS", 50)
    monkeypatch.setattr(decontaminate, "COMMON", 100)
    sizes = {}
    real = decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda rows, name="step": sizes.setdefault(name, real(rows, name)))
    assert key(decontaminate.leaks(df, bench).collect()) == whole and len({x[0] for x in whole if x[1] < 30}) > 24
    assert sizes["pairs"].count() < 430 + 400  # those of the item without another seed, and few of the others


def test_common_passage(spark, monkeypatch):
    """A passage of more than COMMON documents makes half of an item whose other half has many rarer seeds: all of them hold the item,
    also by several passes, and beside items that are joined by seeds."""
    r = random.Random(19)
    words = [f"w{i}" for i in range(2000)]
    passage, tail = r.sample(words, 30), r.sample(words, 28)
    items = [(1, " ".join(passage + tail)), (2, " ".join(passage[:20])), (3, " ".join(own := r.choices(words, k=30)))]
    docs = [(k, " ".join([*r.choices(words, k=20), *passage, *r.choices(words, k=20)])) for k in range(20)] + [(20, items[0][1]), (21, " ".join(own[3:])), (22, " ".join(tail[:9]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    whole = key(decontaminate.leaks(df, bench).collect())
    assert {(x[0], x[1]) for x in whole} == {(k, i) for k in range(21) for i in (1, 2)} | {(21, 3)}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 0)
    monkeypatch.setattr(decontaminate, "COMMON", 5)
    for size in (1 << 20, 200):
        monkeypatch.setattr(decontaminate, "PASS_BYTES", size)
        assert key(decontaminate.leaks(df, bench).collect()) == whole
        assert {x["doc_id"] for x in decontaminate.without_leaks(df, bench).collect()} == {22}


def test_windows_lose_nothing(monkeypatch):
    """With common seeds everywhere, cut and skipped windows give the items and scores of whole texts that hold a seed."""
    r = random.Random(13)
    words = [f"c{i}" for i in range(9)] + [f"v{i}" for i in range(60)]
    draw = lambda n: r.choices(words, [12] * 9 + [1] * 60, k=n)
    items = [draw(n) for n in (5, 8, 12, 20, 30)]
    texts = []
    for k in range(60):
        t = draw(r.choice([0, 10, 60, 300]))
        if k % 2:
            t[len(t) // 2 : len(t) // 2] = edited(items[k % 5], r.choice([4, 5, 7]))
        texts.append(t)
    own = decontaminate.Items(list(range(5)), [" ".join(x) for x in items])
    column = pa.array([" ".join(t) for t in texts], pa.string())
    whole, (coded, at) = {}, own.numbered(column)
    for text, item, start, stop in own.windows(coded, at):
        for x, i, a, b in zip(text.tolist(), item.tolist(), start.tolist(), stop.tolist()):
            t = texts[x][a - at[x] : b - at[x]]
            score = smith_waterman(items[i], t) / (2 * len(items[i]))
            if score >= 0.5:
                whole[x, i] = max(score, whole.get((x, i), 0))
    for most in (decontaminate.MOST_WINDOWS, 50):
        monkeypatch.setattr(decontaminate, "MOST_WINDOWS", most)
        text, item, score, _, _ = decontaminate.found_in(own, column)
        assert dict(zip(zip(text.tolist(), item.tolist()), score.tolist())) == whole and len(whole) >= 30


def revisit_model(records):
    out = []
    full = [x for x in records if x[3] == 200 and x[1] is not None and x[2] is not None]
    for id_, url, ts, status, headers, _ in records:
        if status != 304:
            continue
        before = [f for f in full if f[1] == url and ts is not None and f[2] < ts]
        best = max(before, key=lambda f: (f[2], f[0]), default=None)
        h, s = headers or {}, (best[4] or {}) if best else {}
        tag = lambda x: x.removeprefix("W/") if x is not None else None
        pair = (tag(h.get("etag")), tag(s.get("etag"))) if h.get("etag") and s.get("etag") else (h.get("last-modified"), s.get("last-modified"))
        said = "orphan" if best is None else "unvalidated" if None in pair else "resolved" if pair[0] == pair[1] else "mismatch"
        merged = {**s, **{k: v for k, v in h.items() if k not in revisits.KEPT_HEADERS}} if said == "resolved" else None
        out.append((id_, said, best[0] if best else None, merged, best[5] if said == "resolved" else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_revisits(spark, slices):
    r = random.Random(slices)
    records = []
    for k in range(400):
        url = None if k % 50 == 7 else "h.example/a" if r.random() < 0.4 else f"h.example/{r.randint(0, 20)}"
        status = r.choice([200, 304, 304, 404])
        headers = r.choice([None, {}, {"etag": r.choice(['"a"', 'W/"a"', '"b"']), "content-length": str(k)}, {"last-modified": r.choice("xy"), "date": str(k), "content-type": "t"}])
        records.append((k, url, None if k % 60 == 9 else r.randint(0, 150), status, headers, f"body{k}" if status == 200 else None))
    df = spark.createDataFrame(records, "id long, url string, ts long, status int, headers map<string,string>, body string").withColumns({c: F.lit(1) for c in ("answer", "near__", "slice__", "full", "key")})
    got = sorted(((x["id"], x["outcome"], x["answer_id"], x["headers"], x["body"]) for x in revisits.resolve(df, slices).collect()), key=repr)
    order = lambda rows: sorted((repr((a, b, c, sorted(h.items()) if h is not None else None, e)) for a, b, c, h, e in rows))
    assert order(got) == order(revisit_model(records))
    assert revisits.resolve(df.limit(0)).count() == 0


def test_canonical_urls(spark):
    cases = {"HTTPS://www.Example.com:443/A/?b=2&utm_source=x&a=1#f": "example.com/A?a=1&b=2", "http://u:p@h.example//": "h.example", "h.example?x": "h.example?x", " http://h.example/a?utm_a=1 ": "h.example/a", "": ""}
    rows = spark.createDataFrame([(u,) for u in cases] + [(None,)], "u string").coalesce(1).select(revisits.canonical_url(F.col("u")).alias("c")).collect()
    assert [x["c"] for x in rows] == [*cases.values(), None]


def test_revisit_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    got = queries.op9_revisits(spark, "/root/testdata/sf0.001")
    want = con.execute(queries.oracle_sql()["op9_revisits"])
    names = [c[0] for c in want.description]
    assert key(got.select(*names).collect()) == key(want.fetchall())


def test_pipeline(spark, tmp_path):
    """Each stage on what its predecessor kept, against brute force."""
    import corpus_pipeline
    from test_text_operators import base_secrets, quality_model

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("more", F.lit("x"))
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(9999).cast("long")))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns
        rows = {r["doc_id"]: r for r in after.collect()}
        kept[name] = len(rows)
        if name == "quality":
            small = {d: t for d, t in before.items() if len(t or "") < 4000}
            assert {d for d in rows if d in small} == {d for d, t in small.items() if quality_model(t or "")[6]}
        elif name == "near_copies":
            assert set(rows) == {d for d, _, c in component_model(list(before.items()), 80, 5) if d == c}
        elif name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert all(d not in rows for d, t in before.items() if any(i in t for i in items)) and set(rows) <= set(before)
        else:
            assert set(rows) == set(before) and all((rows[d]["text"] == t) == (not base_secrets(t)) and not base_secrets(rows[d]["text"]) and rows[d]["n_chars"] == len(rows[d]["text"]) for d, t in before.items())
        docs = after
    assert 0 < kept["secrets"] == kept["decontamination"] <= kept["near_copies"] <= kept["quality"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == kept["secrets"] and corpus_pipeline.run(spark, sf).count() == kept["secrets"]


def test_pipeline_edges(spark, tmp_path):
    """Stages on nulls in any column, repeated rows, columns named like internals and an empty table; a run is taken up where it ended."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    r = random.Random(51)
    text = lambda n: " ".join(r.choices([f"w{i}" for i in range(300)], k=n))
    one, two, three = text(80), text(90), text(100)
    rows = [(None, one, None, None, None), (1, one, "en", "s", 1), (2, two, None, "s", None), (2, two, None, "s", None), (None, three, "de", None, 5), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, text(60) + " password = abcdefgh123", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("rk", "goes", "word", "mask", "fp", "cls", "comp", "keys", "kept", "n", "spans", "want")})
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf)
            assert name == "pieces" or now.columns == docs.columns
            now.write.parquet(str(tmp_path / f"{name}{empty}"))
            now = spark.read.parquet(str(tmp_path / f"{name}{empty}"))
            if name == "secrets" and not empty:
                left = sorted(((x["doc_id"], x["text"]) for x in now.collect()), key=repr)
                assert [d for d, _ in left] == [1, 2, 5, None] and "[assign]" in left[2][1] and left[3][1] == three
        assert now.count() == (0 if empty else 4)
    folder = str(tmp_path / "run")
    (tmp_path / "in").mkdir()
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "in" / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "in" / "benchmark.parquet"))
    whole = key(corpus_pipeline.run(spark, str(tmp_path / "in"), folder).collect())
    import shutil

    shutil.rmtree(f"{folder}/pieces")
    (tmp_path / "run" / "secrets" / "_SUCCESS").unlink()
    assert key(corpus_pipeline.run(spark, str(tmp_path / "in"), folder).collect()) == whole and len(whole) == 4


def test_sql_of_operators(spark):
    """SQL over the smallest driver table."""
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    for name in ("op1_secret_scan", "license_phrases", "op3_substring_dedup"):
        got, want = queries.queries()[name](spark, "/root/testdata/sf0.001"), con.execute(queries.oracle_sql()[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns) and key(got.select(*names).collect()) == key(want.fetchall())
    texts = ["é Password: 'abcdefgh12' api-key=zz secret=aaaaaaaaa", "AKIA" + "A" * 12 + " " + "0f" * 16, "postgres://me:pass%word@host.example xoxb-1234567890 ghp_" + "a" * 36, "BEARER  " + "t" * 16 + "== -----BEGIN RSA PRIVATE KEY-----", "", None]
    rows = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    con.register("made", rows)
    con.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM made")
    from veriframe.llm import secrets

    want = con.execute(queries.oracle_sql()["op1_secret_scan"])
    names = [c[0] for c in want.description]
    assert key(secrets.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(*names).collect()) == key(want.fetchall())
    texts = ["MIT license, mit LICENSE; the apache license cc by", "gnu general public", "x GNU General-Public_License cc by mit license é", "by cc by", "mit", "a\x00mit\x7flicense", "", None, "mit license"]
    rows = pa.table({"doc_id": pa.array([*range(8), 7], pa.int64()), "text": pa.array(texts, pa.string())})
    con.register("made", rows)
    from veriframe.llm import licenses

    want = con.execute(queries.oracle_sql()["license_phrases"])
    names = [c[0] for c in want.description]
    want = key(want.fetchall())
    assert key(licenses.license_scan(spark.createDataFrame(list(zip([*range(8), 7], texts)), "doc_id long, text string")).select(*names).collect()) == want and sum(r[2] for r in want) == 10  # 4 + 0 + 3 + 1 + 0 + 1 + 0 + 0 + 1
