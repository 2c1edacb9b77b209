"""N-gram Jaccard join with count-vector R-trees.

A document's set holds 64-bit hashes of its distinct shingles. Hashing shingles into groups gives a point, the counts by
group, and the sum of coordinate minima of two points bounds their overlap from above. R-trees of points give the candidates:
an inner node keeps the greatest counts and the ranges of sizes, components and entries below it, and a search goes down only
where these allow a link. Candidates are verified on the sets.

One tree over all points would compare each set with most of the collection, as the counts of unrelated texts of one size
are alike. So a set enters the forest once for each of its entries, and the entry is the leading coordinate of every tree. An entry
is a group with exactly its members, of a number of groups that depends on the size's level (a factor of two). Two sets that link
differ in few elements, and each of them touches one group; of all groups, in an order that depends on number and hash of their
members, the first that both sets have alike comes behind no more than these. So a set enters with that many groups and one more,
and loses no link. Groups with most members come first: unrelated texts hardly ever share one.

Equal sets are one class. Entries of one component have nothing to find, so the first rounds search for a few partners a
member, and the last one for all that are left: the limit sets the order of work only. An entry of more than TILE members is
dealt out by hash into trees of its own; in the last round members of other components than the entry's least one are
sent to each of them. Links are verified in a join whose hot side is salted by its number of pairs, and
components come from minimum labels with pointer jumping; all state is in tables of the shared folder.

Defined results: null, empty and wordless texts have an empty set, link with nothing, and are their own component; repeated
rows each give a row; of rows with a null doc_id a component takes the least id that isn't null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, dropped, free_name, maybe_in, narrowed, per_block, ragged, released, strings, written
from .quality import words_of

GROUPS = 256
#: Members of an entry that share a tree at most; trees are built over about BATCH rows of neighbouring entries.
TILE, BATCH = 2048, 16_384
LEAF, FANOUT = 8, 16
#: Bytes of text whose shingles and entries are laid out at once.
SET_BYTES = 2 << 20
#: Partners a member in the rounds of the search; None: all.
ROUNDS = (1, 4, None)
_M, _G = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    for _ in range(2):
        x ^= x >> np.uint64(33)
        x *= _M
    x ^= x >> np.uint64(29)
    return x


def _in_order(owner: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Order by owner, then code: one sort by owner and leading bits, unless these tie for unequal codes."""
    bits = int(owner.max(initial=0)).bit_length()
    lead = (owner.astype(np.uint64) << np.uint64(64 - bits)) | (code >> np.uint64(bits)) if bits else code
    order = np.argsort(lead)
    tied = lead[order[1:]] == lead[order[:-1]]
    return np.lexsort((code, owner)) if (tied & (code[order[1:]] != code[order[:-1]])).any() else order


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and n + 1 offsets."""
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    words, doc = words_of(low, offsets)
    n_docs = len(offsets) - 1
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    coded = words.dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    pieces = np.where(count == 0, 0, np.maximum(1, count - width + 1))  # a short text is one shingle of all its words
    starts = ragged(first, pieces)
    owner = np.repeat(np.arange(n_docs), pieces)
    own = np.concatenate([own, np.zeros(width, np.uint64)])
    code, at = np.full(len(starts), width, np.uint64), np.cumsum(pieces) - pieces
    for k in range(width):
        code = mixed(code * _G + own[starts + k])
    for row in np.flatnonzero((count > 0) & (count < width)).tolist():
        value = np.array([count[row]], np.uint64)
        for k in range(int(count[row])):
            value = mixed(value * _G + own[first[row] + k : first[row] + k + 1])
        code[at[row]] = value[0]
    order = _in_order(owner, code)
    code, owner = code[order], owner[order]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    return code[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=n_docs))])


class Measure:
    """100 * intersection >= percent * union, for 1 to 100 percent."""

    def __init__(self, percent: int = 90):
        if not 1 <= percent <= 100:
            raise ValueError("percent is from 1 to 100")
        self.percent = percent
        self.most_equal = -(-percent // (100 - percent)) - 1 if percent < 100 else 2**31  # n / (n + 1) is too little up to here

    def level(self, size: np.ndarray) -> np.ndarray:
        """Level of sets by their size, a factor of two each; -1 for those that link with equal sets only."""
        return np.where(size > self.most_equal, np.floor(np.log2(np.maximum(size, 1) / (self.most_equal + 1))), -1).astype(np.int64)

    def groups(self, level: int) -> tuple[int, int]:
        """Number of groups at a level, and the most differences of two sets of which the smaller one is there."""
        top = (self.most_equal + 1) * 2 ** (level + 1)
        return int(top * (100 - self.percent) / (0.75 * self.percent)) + 2, top * (100 - self.percent) // self.percent

    def differences(self, size: np.ndarray) -> np.ndarray:
        """Most elements in which a set and a larger one that links differ: union <= size * 100 / percent."""
        return size * (100 - self.percent) // self.percent

    def links(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (a + b - both)


def entries(codes: np.ndarray, at: np.ndarray, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all sets, one set after the other, and their n + 1 offsets. A set enters at its level, and at each down to that of
    the smallest set it may link with (one more from 50 percent on); there its differences are bounded by its own size as the
    larger one, too."""
    size = np.diff(at)
    level, least = measure.level(size), measure.level(-(-size * measure.percent // 100))
    least = np.where((level >= 0) & (least < 0), 0, least)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero((least <= k) & (k <= level))
        if not len(own):
            continue
        groups, most = measure.groups(k)
        members = codes[ragged(at[own], size[own])]
        group = (mixed(members ^ np.uint64(groups)) % np.uint64(groups)).astype(np.int64)
        cell = np.repeat(np.arange(len(own)) * groups, size[own]) + group
        counts = np.bincount(cell, minlength=len(own) * groups)
        total, filled = np.zeros(len(counts), np.uint64), np.flatnonzero(counts)
        order = np.argsort(cell)
        total[filled] = np.add.reduceat(mixed(members[order] + np.uint64(0x5851F42D4C957F2D)), (np.cumsum(counts) - counts)[filled])
        key = mixed(total + mixed(np.tile(np.arange(groups, dtype=np.uint64), len(own)) + np.uint64((k + 1) << 32)) + counts.astype(np.uint64))
        # Order by set, members (many first), hash; equal ones by group.
        bits = int(len(own)).bit_length()
        lead = np.repeat(np.arange(len(own), dtype=np.uint64) << np.uint64(64 - bits), groups)
        lead |= (255 - np.minimum(counts, 255)).astype(np.uint64) << np.uint64(56 - bits)
        order = np.argsort(lead | (key >> np.uint64(8 + bits)), kind="stable")
        wanted = 1 + np.where(level[own] == k, measure.differences(size[own]), np.minimum(most, 2 * (100 - measure.percent) * size[own] // (100 + measure.percent)))
        take = order[ragged(np.arange(len(own)) * groups, np.minimum(wanted, groups))]
        parts.append((np.repeat(own, np.minimum(wanted, groups)), key[take]))
    if not parts:
        return np.empty(0, np.int64), np.zeros(len(size) + 1, np.int64)
    owner, key = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(owner, kind="stable")
    return key[order].view(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))])


def points(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts by group, a row a set."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    group = (mixed(codes) >> np.uint64(56)).astype(np.int64)
    return np.bincount(owner * GROUPS + group, minlength=(len(at) - 1) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


class Tree:
    """An R-tree of points, packed in order of entry, size and leading counts. A level has for each node the greatest counts and
    the least and greatest entry, size and component below it. built and visited count trees and the nodes that searches reach."""

    built = visited = 0

    def __init__(self, point: np.ndarray, size: np.ndarray, entry: np.ndarray | None = None, comp: np.ndarray | None = None):
        entry = np.zeros(len(size), np.int64) if entry is None else entry
        comp = np.arange(len(size)) if comp is None else comp
        self.order = np.lexsort((*(point[:, k] for k in range(3)), size, entry))
        top, *ends = point[self.order], *(x for own in (entry, size, comp) for x in (own[self.order],) * 2)
        self.levels = [(top, *ends)]
        width = LEAF
        while len(top) > 1:
            cuts = np.arange(0, len(top), width)
            top = np.maximum.reduceat(top, cuts)
            ends = [(np.maximum if k % 2 else np.minimum).reduceat(x, cuts) for k, x in enumerate(ends)]
            self.levels.append((top, *ends))
            width = FANOUT
        Tree.built += 1

    def pairs(self, point: np.ndarray, size: np.ndarray, entry: np.ndarray, comp: np.ndarray, measure: Measure, most: int = 25_000) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of searches and of points as given, which have the same entry, differ in component, and may link.

        The searches go down together, level by level; most: nodes whose counts are summed at once."""
        ask, at = np.arange(len(size)), np.zeros(len(size), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, entry0, entry1, low, high, comp0, comp1 = self.levels[depth]
            fits = (entry0[at] <= entry[ask]) & (entry[ask] <= entry1[at]) & ~((comp0[at] == comp1[at]) & (comp0[at] == comp[ask]))
            ask, at = ask[fits], at[fits]
            fits = (low[at] * measure.percent <= 100 * size[ask]) & (100 * high[at] >= measure.percent * size[ask])
            ask, at = ask[fits], at[fits]
            Tree.visited += len(at)
            fits = np.empty(len(at), bool)
            for k in range(0, len(at), most):
                a, x = at[k : k + most], ask[k : k + most]
                both = np.minimum(np.minimum(top[a], point[x]).sum(1), np.minimum(size[x], high[a]))
                fits[k : k + most] = measure.links(both, size[x], np.maximum(low[a], both))
            ask, at = ask[fits], at[fits]
            if depth:
                width = LEAF if depth == 1 else FANOUT
                ask, at = np.repeat(ask, width), (at[:, None] * width + np.arange(width)).ravel()
                inside = at < len(self.levels[depth - 1][0])
                ask, at = ask[inside], at[inside]
        return ask, self.order[at]

    def search(self, point: np.ndarray, size: int, measure: Measure) -> np.ndarray:
        """Points (numbers as given) that may link with the one asked for."""
        return self.pairs(point[None], np.array([size]), self.levels[-1][1][:1], np.array([-1]), measure)[1]


def tree_pairs(entry: np.ndarray, ident: np.ndarray, comp: np.ndarray, size: np.ndarray, point: np.ndarray, guest: np.ndarray, most: int | None, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row numbers) of one entry and different components that may link, from a tree of the rows that aren't guests.
    Members search for those of lesser ident, guests for all; of each search the most least partners at most."""
    own = np.flatnonzero(~guest)
    if not len(own):
        return own, own
    tree, found = Tree(point[own], size[own], entry[own], comp[own]), []
    for k in range(0, len(ident), 2048):
        a, b = tree.pairs(point[k : k + 2048], size[k : k + 2048], entry[k : k + 2048], comp[k : k + 2048], measure)
        a, b = a + k, own[b]
        keep = guest[a] | (ident[b] < ident[a])
        a, b = a[keep], b[keep]
        if most is not None and len(a):
            order = np.lexsort((ident[b], a))
            a, b = a[order], b[order]
            starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
            a, b = a[rank < most], b[rank < most]
        found.append((a, b))
    return tuple(np.concatenate(x) for x in zip(*found))


def _profiles(docs: DataFrame, measure: Measure, width: int) -> DataFrame:
    """doc_id, fp, n, cls (digest of the set; null if empty) and keys (entries; none if the task has sent the class's before)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, data, offsets in blocks(batches, SET_BYTES):
            codes, at = sets_of(data, offsets, width)
            keys, ends = entries(codes, at, measure)
            size, cls = np.diff(at), _digests(codes, at)
            new = np.array([not (x in seen or seen.add(x)) for x in cls.tolist()], bool)
            keys, ends = keys[np.repeat(new, np.diff(ends))], np.concatenate([[0], np.cumsum(np.diff(ends) * new)])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(size), pa.array(cls, pa.int64(), mask=size == 0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))], names=["doc_id", "fp", "n", "cls", "keys"])

    return docs.select("doc_id", "text", "fp").mapInArrow(run, "doc_id long, fp long, n long, cls long, keys array<long>")


def _digests(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    raw = codes.astype("<u8").tobytes()
    return np.array([xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b], seed=b - a) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64).view(np.int64)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """cls, size, point (8-bit counts; the greatest stands for itself and all above) and codes (binary) of rows with want (a class)."""

    def block(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        codes, at = sets_of(data, offsets, width)
        same = _digests(codes, at) == rows.column(0).to_numpy(zero_copy_only=False)
        point = np.minimum(points(codes, at), 255).astype(np.uint8).reshape(-1)
        n = rows.num_rows
        out = [rows.column(0), pa.array(np.diff(at)), strings(point, np.arange(n) * GROUPS, n * GROUPS), strings(codes.astype("<u8").view(np.uint8), at[:-1] * 8, int(at[-1]) * 8)]
        return pa.RecordBatch.from_arrays(out, names=["cls", "size", "point", "codes"]).filter(pa.array(same))

    return per_block(docs, block, "cls long, size long, point binary, codes binary", SET_BYTES)


def _searched(members: DataFrame, points_of: DataFrame, most: int | None, measure: Measure) -> DataFrame:
    """members: key, cls, comp. Pairs a > b of classes that may link."""
    large = members.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.min("comp").alias("home")).where(F.col("all") > TILE)
    tiles = written(large.select("key", "home", F.ceil(F.col("all") / F.lit(TILE)).cast("int").alias("tiles")), "tiles")
    mine = F.pmod(F.xxhash64("cls"), F.coalesce("tiles", F.lit(1))).cast("int")
    rows = members.join(tiles, "key", "left").select("key", mine.alias("tile"), "cls", "comp", F.lit(False).alias("guest"))
    if most is None:  # members of an entry's home component are found by the others
        away = members.join(tiles, "key").where("comp <> home").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        rows = rows.unionByName(away.where(F.col("tile") != mine).select("key", "tile", "cls", "comp", F.lit(True).alias("guest")))
    dealt = rows.join(points_of, "cls").select("key", "tile", "cls", "comp", "guest", "size", "point")
    dealt = dealt.repartition("key", "tile").sortWithinPartitions("key", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(table: pa.Table) -> pa.RecordBatch:
            take = lambda k: table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            key, tile, ident, comp, guest, size = (take(k) for k in ("key", "tile", "cls", "comp", "guest", "size"))
            point = np.frombuffer(b"".join(table.column("point").to_pylist()), np.uint8).reshape(-1, GROUPS).astype(np.int32)
            point[point == 255] = 2**22  # so many at least
            new = np.zeros(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
            a, b = tree_pairs(np.cumsum(new), ident, comp, size, point, guest, most, measure)
            both = np.unique(np.stack([np.maximum(ident[a], ident[b]), np.minimum(ident[a], ident[b])]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        held, n = [], 0
        for batch in batches:  # whole trees' rows together: the last tree's rows of a batch may go on
            if not batch.num_rows:
                continue
            if n + batch.num_rows >= BATCH:
                lead = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)])
                if held:
                    lead = np.concatenate([[[held[-1].column(k)[-1].as_py()] for k in range(2)], lead], axis=1)
                new = np.flatnonzero((lead[:, 1:] != lead[:, :-1]).any(0)) + (not held)
                if len(new):
                    yield search(pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))]))
                    held, n, batch = [], 0, batch.slice(int(new[-1]))
            held.append(batch)
            n += batch.num_rows
        if held:
            yield search(pa.Table.from_batches(held))
        released()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, measure: Measure, heap: int = 512) -> DataFrame:
    """a, b and whether they link. b is the side with many pairs; it is salted by their number, and its set leads their rows."""
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(heap)).cast("int").alias("salts"))
    left = pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    left = left.join(sets.select(F.col("cls").alias("a"), "codes"), "a").select("b", "salt", F.lit(True).alias("ask"), "a", "codes")
    right = salts.join(sets.select(F.col("cls").alias("b"), "codes"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "codes")
    rows = left.unionByName(right.select("b", "salt", F.lit(False).alias("ask"), F.lit(0).cast("long").alias("a"), "codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, own = np.empty(0, np.uint64), None
        for batch in batches:
            out = []
            for k, (b, salt, ask) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                x = np.frombuffer(batch.column(4)[k].as_buffer(), "<u8")
                if not ask:
                    y, own = x.copy(), (b, salt)
                elif own == (b, salt):
                    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    out.append((batch.column(3)[k].as_py(), b, bool(measure.links(int((y[place] == x).sum()), len(x), len(y)))))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate([pa.int64(), pa.int64(), pa.bool_()])], names=["a", "b", "links"])
        released()

    return rows.repartition("b", "salt").sortWithinPartitions("b", "salt", "ask").mapInArrow(run, "a long, b long, links boolean")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """cls and comp, the least class that links (a, b) reach, of nodes (cls). Minimum labels with pointer jumping, a table a round."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = nodes.select("cls", F.col("cls").alias("comp"))
    while True:
        seen = both.join(labels.select(F.col("cls").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        step = labels.join(seen, "cls", "left").select("cls", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        jump = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("further"))
        step = step.join(jump, "comp", "left").select("cls", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp"))
        step = written(step, "labels")
        labels = step.select("cls", "comp")
        if step.where("was <> comp").isEmpty():
            dropped(both)
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (cls, comp) with links (a, b) taken in: components of the components that they connect."""
    head = lambda k: labels.select(F.col("cls").alias(k), F.col("comp").alias(f"{k}_"))
    joined = links.join(head("a"), "a").join(head("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b")).distinct()
    joined = written(joined, "joined")
    found = components(joined.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), joined)
    return labels.join(found.select(F.col("cls").alias("comp"), F.col("comp").alias("now")), "comp", "left").select("cls", F.coalesce("now", "comp").alias("comp"))


def _mixed(rows: DataFrame, of: str) -> DataFrame:
    """Keys whose rows differ in a column. They come by an aggregate and go back by a join, which Spark may split where a key
    is hot; a window would hold the key's rows in one task."""
    return rows.groupBy("key").agg(F.min(of).alias("lo"), F.max(of).alias("hi")).where("lo <> hi").select("key")


def _told_apart(members: DataFrame) -> DataFrame:
    """members (key, cls, comp) of one key of each set of members: keys with the same ones find the same pairs, and texts that share a
    passage have many such keys. Sets of members are told apart by their number and two 64-bit hashes."""
    one, two = F.xxhash64("cls"), F.xxhash64("cls", F.lit(1))
    sets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x"), F.bit_xor(two).alias("y"))
    return members.join(sets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key")


def _few(shared: DataFrame, turn: int) -> DataFrame:
    """Two entries of each class, others each turn: they find most links."""
    by = F.xxhash64("key", F.lit(turn))
    few = shared.groupBy("cls").agg(F.array_distinct(F.array(F.min_by("key", by), F.max_by("key", by))).alias("k"))
    return few.select(F.explode("k").alias("key"), "cls")


def _labelled(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, fp, n, cls and comp (null where the set is empty) of docs (doc_id, text, fp), one row per row."""
    measure = Measure(percent)
    found = written(_profiles(docs, measure, width), "profiles")
    keys = found.where("cls is not null").select(F.explode("keys").alias("key"), "cls")
    many = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "many")
    shared = maybe_in(keys, "key", many).join(many, "key").distinct()  # copies of a class in two tasks count as two: more than classes tell
    shared = written(shared.join(_mixed(shared, "cls"), "key"), "shared")
    dropped(many)
    nodes = written(shared.select("cls").distinct(), "classes")
    first = found.join(nodes, "cls", "left_semi").groupBy(F.col("cls").alias("want")).agg(F.min(F.struct("doc_id", "fp")).alias("row"))
    texts = written(first.select("want", F.xxhash64("row.doc_id", "row.fp").alias("rk")), "wanted")
    rows = maybe_in(docs.select("text", F.xxhash64("doc_id", "fp").alias("rk")), "rk", texts)
    sets = written(_sets(rows.join(texts, "rk").dropDuplicates(["rk", "want"]).select("want", "text"), width), "sets")
    points_of = sets.select("cls", "size", "point")
    labels, tested = nodes.select("cls", F.col("cls").alias("comp")), None
    for turn, most in enumerate(ROUNDS):
        members = (shared if most is None else _few(shared, turn)).join(labels, "cls")
        if turn:  # components only grow: entries of one component are done
            members = written(members.join(_mixed(members, "comp"), "key"), "mixed")
        if most is None:
            members = written(_told_apart(members), "apart")
        pairs = _searched(members, points_of, most, measure)
        if tested is not None:  # of the pairs once, not of each key that found one: Spark moves the join in front of distinct()
            pairs = written(pairs, "found").join(tested.select("a", "b"), ["a", "b"], "left_anti")
        checked = written(_verified(written(pairs, "pairs"), sets, measure), "checked")
        tested = checked if tested is None else tested.unionByName(checked)
        if not checked.where("links").isEmpty():
            links = checked.where("links")
            labels = written(merged(labels, links), "labels") if turn else components(nodes, links)
    return found.drop("keys").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, width: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id that links reach), one row per row of df."""
    whole = _labelled(narrowed(df, id_col, text_col).withColumn("fp", F.xxhash64("text")), percent, width)
    least = whole.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return whole.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, width: int = 3) -> DataFrame:
    """One row of df of each component, with all its columns: that of the least doc_id; of repeated rows one stays.

    Rows are told apart by doc_id and text (its hash): a component keeps the least doc_id that isn't null, and of its texts under
    that doc_id, or without any, the one of the least hash. Documents with an empty set all stay, but for repeated rows."""
    docs = narrowed(df, id_col, text_col).withColumn("fp", F.xxhash64("text"))
    found = written(_labelled(docs, percent, width).groupBy("doc_id", "fp", "comp").agg(F.count(F.lit(1)).alias("rows")), "rows")
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    kept = found.where("comp is not null").groupBy("comp").agg(F.min(mine).alias("kept"))
    gone = found.join(kept, "comp", "left").withColumn("goes", F.col("kept").isNotNull() & ~mine.eqNullSafe(F.col("kept")))
    rk, goes = free_name(df, "rk"), free_name(df, "goes")
    # Most rows are neither copies nor repeated: only those that may be are shuffled.
    acts = written(gone.where("goes or rows > 1").select(F.xxhash64("doc_id", "fp").alias(rk), F.col("goes").alias(goes)), "acts")
    own = F.xxhash64(df[id_col].cast("long"), F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))))
    rows = df.withColumn(rk, own)
    touched = maybe_in(rows, rk, acts).join(acts, rk, "left").where(F.coalesce(~F.col(goes), F.lit(True))).drop(goes).dropDuplicates([rk, id_col, text_col])
    return maybe_in(rows, rk, acts, other=True).unionByName(touched).select(*df.columns)
