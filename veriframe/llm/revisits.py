"""WARC revisits: a not-modified record takes its body from the latest earlier full response of its canonical URL.

An as-of join. The most frequent URL may hold a third of all records, so time is cut into slices of about as many records: within (URL, slice) a
running maximum of (time, record) of full responses answers most records; the slices' maxima, one row per URL and slice,
run on over the slices and answer the rest. Bodies and headers come by the answer's record id afterwards, in a join that
Spark may split where many records took one answer. Everything is built-in functions.

A revisit is good if its validators agree with the full response's: entity tags where both have one (weak comparison, W/
is left off), else the Last-Modified values where both have one; else nothing vouches for it. A good one takes the body
and the stored headers, over which those of the 304 are laid that such a response may update; the body's own headers
(Content-Length, Content-Encoding, Content-Type, Content-Range, Transfer-Encoding and connection-level ones) stay.

Defined results: outcome is resolved, mismatch (validators disagree), unvalidated (nothing to compare), or orphan (no
earlier full response; also where the URL or the time is null). Earlier means a lesser time; of several at one time the
greatest record id counts; full responses without time or URL answer nothing. Null headers count as none. Repeated
revisit rows each give a row; full responses of one record id count as the one with the greatest time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_in, written

#: Slices of time, at least; as many more as there are shuffle partitions.
SLICES, MOST_SLICES = 64, 1024
#: Stored headers that a 304 doesn't replace.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Lower-case host without scheme, credentials, www. and default port; no fragment; no utm_ parameters, the others sorted; no closing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^.*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.trim(F.try_element_at(headers, F.lit("etag"))), r"^[Ww]/", "")


def _slice(ts: Column, cuts: list[int]) -> Column:
    """How many of the cuts (ascending) ts has reached, in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    reached = lambda own: F.size(F.filter(own, lambda c: c <= ts))
    longs = lambda own: F.array(*(F.lit(c).cast("long") for c in own))
    coarse = reached(longs([p[0] for p in parts]))
    return F.when(coarse > 0, (coarse - 1) * step + reached(F.element_at(F.array(*map(longs, parts)), coarse))).otherwise(0)


def latest_before(rows: DataFrame, slices: int | None = None) -> DataFrame:
    """rows (key, ts long, id, full boolean, and others), with answer: the struct (ts, id) of the latest full row of the key before ts.

    slices: SLICES or twice the shuffle partitions, whichever is more, MOST_SLICES at most. They hold about as many rows each, so a
    burst is cut as well as a long history, and a stray time doesn't stretch them."""
    slices = slices or max(SLICES, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slices = min(slices, MOST_SLICES)
    cuts = rows.agg(F.percentile_approx("ts", [k / slices for k in range(1, slices)] or [0.5], 10_000).alias("q")).first()["q"]
    cut = rows.withColumn("slice__", _slice(F.col("ts"), sorted(set(cuts or ()))))
    mine = F.when(F.col("full") & F.col("key").isNotNull() & F.col("ts").isNotNull(), F.struct("ts", "id"))
    before = Window.partitionBy("key", "slice__").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = cut.where(F.col("ts").isNotNull() & F.col("key").isNotNull()).withColumn("near__", F.max(mine).over(before))
    # One row for each slice of a key: what its earlier slices end with.
    tops = cut.where(F.col("ts").isNotNull() & F.col("key").isNotNull()).groupBy("key", "slice__").agg(F.max(mine).alias("top__"))
    over = Window.partitionBy("key").orderBy("slice__").rowsBetween(Window.unboundedPreceding, -1)
    far = tops.select("key", "slice__", F.max("top__").over(over).alias("far__"))
    joined = near.join(far, ["key", "slice__"], "left").withColumn("answer", F.coalesce("near__", "far__")).drop("near__", "far__", "slice__")
    return joined.unionByName(rows.where(F.col("ts").isNull() | F.col("key").isNull()).withColumn("answer", F.lit(None).cast(joined.schema["answer"].dataType)))


def resolve(records: DataFrame, slices: int | None = None) -> DataFrame:
    """records: id long, url string, ts long, status int, headers map of lower-case names, body string. One row per record of
    status 304: id, key, outcome, answer_id, headers (merged) and body (both null unless resolved)."""
    base = records.withColumn("key", canonical_url(F.col("url"))).withColumn("full", F.coalesce(F.col("status") == 200, F.lit(False)))
    head = base.select("id", "key", "ts", "full", F.coalesce(F.col("status") == 304, F.lit(False)).alias("again"), F.when(F.col("status") == 304, F.col("headers")).alias("own"))
    asked = latest_before(head, slices).where("again").select("id", "key", "own", F.col("answer.id").alias("answer_id"))
    asked = written(asked, "asked")
    answers = asked.where("answer_id is not null").select(F.col("answer_id").alias("id")).distinct()
    full = maybe_in(base.where("full and id is not null"), "id", answers)  # bodies that answer nothing aren't shuffled
    full = full.groupBy(F.col("id").alias("answer_id")).agg(F.max_by(F.struct(F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("h"), "body"), F.struct("ts", F.coalesce("body", F.lit("")))).alias("found"))
    none = F.create_map().cast("map<string,string>")
    own, stored = F.coalesce("own", none), F.coalesce("found.h", none)
    tags, dates = (_tag(own), _tag(stored)), (F.try_element_at(own, F.lit("last-modified")), F.try_element_at(stored, F.lit("last-modified")))
    same = F.when(tags[0].isNotNull() & tags[1].isNotNull(), tags[0] == tags[1]).when(dates[0].isNotNull() & dates[1].isNotNull(), dates[0] == dates[1])
    out = asked.join(full, "answer_id", "left")
    out = out.withColumn("outcome", F.when(F.col("found").isNull(), "orphan").when(same, "resolved").when(~same, "mismatch").otherwise("unvalidated"))
    permitted = F.map_filter(own, lambda k, v: ~k.isin(*KEPT_HEADERS) & v.isNotNull())
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k)), permitted)
    good = F.col("outcome") == "resolved"
    return out.select("id", "key", "outcome", F.when(F.col("outcome") != "orphan", F.col("answer_id")).alias("answer_id"), F.when(good, merged).alias("headers"), F.when(good, F.col("found.body")).alias("body"))


def captures(pages: DataFrame) -> DataFrame:
    """Records made from pages (page_id, url, html): each is fetched at time page_id with its full body and asked for again at
    twice that time, with a 304. Every seventh 304 has no validators, every fifth a weak tag; id is 2 * page_id (+ 1: the 304)."""
    tag = F.concat(F.lit('"'), F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16), F.lit('"'))
    page = F.col("page_id").cast("long")
    text = page.cast("string")
    full = pages.select((2 * page).alias("id"), "url", page.alias("ts"), F.lit(200).alias("status"), F.create_map(F.lit("etag"), tag, F.lit("date"), text, F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("x-cache"), F.lit("miss")).alias("headers"), F.col("html").alias("body"))
    bare = F.create_map(F.lit("date"), (2 * page).cast("string"), F.lit("content-length"), F.lit("0"), F.lit("x-cache"), F.lit("hit"))
    weak = F.when(page % 5 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    again = pages.select((2 * page + 1).alias("id"), "url", (2 * page).alias("ts"), F.lit(304).alias("status"), F.when(page % 7 == 0, bare).otherwise(F.map_concat(bare, F.create_map(F.lit("etag"), weak))).alias("headers"), F.lit(None).cast("string").alias("body"))
    return full.unionByName(again)


def revisit_report(pages: DataFrame) -> DataFrame:
    """The 304 records of captures(pages) as resolved; the body by its digest, headers as sorted name=value lines,
    answer_page_id -1 for orphans."""
    found = resolve(captures(pages))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select(F.expr("(id - 1) div 2").alias("page_id"), F.col("key").alias("canonical_url"), "outcome", F.coalesce(F.expr("answer_id div 2"), F.lit(-1)).cast("long").alias("answer_page_id"), lines.alias("headers"), F.sha2("body", 256).alias("body_sha256"))
