"""Joins: span containment, edge resolution, neighbours, coverage and anti-joins. All keys are equalities, so each is a hash or
sort-merge join that adaptive execution may split or broadcast by measured size; nothing is broadcast by hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a bucket in span joins: a span joins the buckets it touches, a node its own.
BUCKET_LINES = 64
#: Rows of one key that a task of quotes_in should get; the busiest key's count by this gives the number of salts, MOST_SALTS at most.
SALT_ROWS, MOST_SALTS = 100_000, 256


def manifest_index(artifacts: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """artifacts with their function_id, and those that have none."""
    joined = artifacts.join(manifest.select("artifact", "function_id", "source_path", "line_start", "line_end"), "artifact", "left")
    return joined.where("function_id is not null"), joined.where("function_id is null").select("artifact")


def innermost_spans(nodes: DataFrame, spans: DataFrame, bucket_lines: int = BUCKET_LINES) -> DataFrame:
    """nodes (node_id, path, line) with span_id of the smallest span (span_id, path, line_start, line_end, ord) of their file that
    holds their line; equal sizes go by ord. Nodes in no span have null.

    Spans are cut into buckets of lines, so a long file's nodes don't all meet its spans; each bucket's part of a span counts once."""
    cut = lambda c: F.floor(c / F.lit(bucket_lines)).cast("long")
    parts = spans.where("line_end >= line_start").withColumn("b__", F.explode(F.sequence(cut(F.col("line_start")), cut(F.col("line_end")))))
    asked = nodes.select("node_id", "path", "line").withColumn("b__", cut(F.col("line")))
    hit = asked.join(parts, ["path", "b__"]).where("line between line_start and line_end")
    best = hit.groupBy("node_id").agg(F.min_by("span_id", F.struct(F.col("line_end") - F.col("line_start"), "ord")).alias("span_id"))
    return nodes.join(best, "node_id", "left")


def unmapped_nodes(mapped: DataFrame, files: DataFrame) -> DataFrame:
    """Mapped nodes of known files (path) that lie in no span."""
    return mapped.where("span_id is null").join(files.select("path").distinct(), "path", "left_semi")


def resolve_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """edges (source, target, kind) by the functions of their nodes (mapping: node_id, span_id); self edges, unresolved and repeated ones go."""
    a = mapping.where("span_id is not null").select(F.col("node_id").alias("source"), F.col("span_id").alias("caller"))
    b = a.select(F.col("source").alias("target"), F.col("caller").alias("callee"))
    return edges.join(a, "source").join(b, "target").where("caller <> callee").select("caller", "callee", "kind").distinct()


def validate_edges(edges: DataFrame, known: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """edges (caller, callee, ...) whose two ends are known (id) and distinct, the first of each pair; and the others."""
    ids = known.select(F.col("id").alias("k__")).distinct()
    first = edges.join(ids, F.col("caller") == F.col("k__"), "left").withColumn("c__", F.col("k__").isNotNull()).drop("k__")
    both = first.join(ids, F.col("callee") == F.col("k__"), "left").withColumn("good__", F.col("c__") & F.col("k__").isNotNull() & (F.col("caller") != F.col("callee"))).drop("k__", "c__")
    nth = F.row_number().over(Window.partitionBy("caller", "callee").orderBy(order))
    good = both.where("good__").withColumn("n__", nth).where("n__ = 1").drop("n__", "good__")
    return good, both.where("not good__ or good__ is null").drop("good__")


def neighbors(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Direct callers and callees of members (id) that aren't members themselves."""
    both = edges.select(F.col("caller").alias("a"), F.col("callee").alias("id")).unionByName(edges.select(F.col("callee").alias("a"), F.col("caller").alias("id")))
    return both.join(members.select(F.col("id").alias("a")), "a", "left_semi").select("id").distinct().join(members.select("id"), "id", "left_anti")


def neighbor_counts(edges: DataFrame) -> DataFrame:
    """id and the number of its distinct callers and callees."""
    both = edges.select(F.col("caller").alias("id"), F.col("callee").alias("o")).unionByName(edges.select(F.col("callee").alias("id"), F.col("caller").alias("o")))
    return both.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("neighbors"))


def phase_functions(phases: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions (id, path) of each phase by its modules' source files."""
    files = phases.select("phase", F.explode("modules").alias("m")).select("phase", F.explode("m.source_files").alias("path")).distinct()
    return files.join(functions, "path")


def read_sets(jobs: DataFrame, functions: DataFrame, edges: DataFrame, existing: DataFrame, contexts: tuple[str, ...] = ()) -> DataFrame:
    """job_id and path: what a job may read. Its artifacts and their neighbours', those functions' sources, and the contexts;
    only paths that exist."""
    own = jobs.select("job_id", F.explode("artifacts").alias("artifact")).join(functions.select("artifact", "id", "path"), "artifact")
    links = edges.select(F.col("caller").alias("id"), F.col("callee").alias("other")).unionByName(edges.select(F.col("callee").alias("id"), F.col("caller").alias("other")))
    near = own.join(links, "id").select("job_id", F.col("other").alias("id")).join(functions.select("artifact", "id", "path"), "id")
    all_ = own.select("job_id", "artifact", "path").unionByName(near.select("job_id", "artifact", "path"))
    paths = all_.select("job_id", F.explode(F.array("artifact", "path")).alias("path"))
    if contexts:
        paths = paths.unionByName(jobs.select("job_id", F.explode(F.array(*map(F.lit, contexts))).alias("path")))
    return paths.distinct().join(existing.select("path"), "path", "left_semi")


def plan_violations(plan: DataFrame, jobs: DataFrame) -> DataFrame:
    """Entries of plan (phase, artifact, job_id, type) without a job of that phase and type that owns the artifact, and jobs'
    artifacts that no entry has, with a reason."""
    owned = jobs.select("job_id", "phase", "type", F.explode("artifacts").alias("artifact"))
    keys = ["job_id", "phase", "type", "artifact"]
    missing = plan.join(owned, keys, "left_anti").select(*keys).withColumn("reason", F.lit("no job owns the planned artifact"))
    return missing.unionByName(owned.join(plan, keys, "left_anti").select(*keys).withColumn("reason", F.lit("owned artifact isn't planned")))


def result_path(artifact: Column) -> Column:
    """An artifact's path with .json for its suffix."""
    return F.concat(F.regexp_replace(artifact, r"\.[^./]+$", ""), F.lit(".json"))


def results_of(functions: DataFrame, results: DataFrame) -> DataFrame:
    """functions (artifact, ...) with the result (path, ...) written for each, null where there is none."""
    return functions.withColumn("path__", result_path(F.col("artifact"))).join(results.withColumnRenamed("path", "path__"), "path__", "left").drop("path__")


def set_differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key and side (missing or extra) of keys that only one has."""
    a, b = expected.select(key).distinct().withColumn("e__", F.lit(True)), actual.select(key).distinct().withColumn("a__", F.lit(True))
    return a.join(b, key, "full").where("e__ is null or a__ is null").select(key, F.when(F.col("a__").isNull(), "missing").otherwise("extra").alias("side"))


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right hasn't: static findings are mismatches without a dynamic result."""
    return left.join(right.select(key), key, "left_anti")


def unsatisfied(dependencies: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id and the number of its dependencies (job_id, depends_on) that are missing or haven't succeeded."""
    status = jobs.select(F.col("job_id").alias("depends_on"), "status")
    joined = dependencies.join(status, "depends_on", "left")
    return joined.groupBy("job_id").agg(F.count_if(F.coalesce(F.col("status"), F.lit("missing")) != "succeeded").alias("unsatisfied"))


def ready_jobs(jobs: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Queued jobs without an unsatisfied dependency."""
    return jobs.where("status = 'queued'").join(unsatisfied(dependencies, jobs).where("unsatisfied > 0"), "job_id", "left_anti")


def unique_output_match(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs with the report at their single required output, where exactly one report matches."""
    one = jobs.where(F.size("required_outputs") == 1).withColumn("path", F.element_at("required_outputs", 1))
    joined = one.join(reports, "path")
    return joined.withColumn("n__", F.count(F.lit(1)).over(Window.partitionBy("job_id"))).where("n__ = 1").drop("n__")


#: Kinds of quotes other than those of one, two and three characters.
_EMPTY, _WORD, _RUN = 0, 4, 8


def _quote_kind(quote: Column, words: int) -> Column:
    """How a quote is found: _RUN by runs of inner words (those between two single spaces), _WORD by single inner words, else by its
    characters, three at a time or as many as it has."""
    inner = F.greatest(F.size(F.split(quote, " ")) - 2, F.lit(0))
    return F.when(inner >= words, _RUN).when(inner > 0, _WORD).otherwise(F.least(F.length(quote), F.lit(3)))


def _keys_of(rows: DataFrame, ident: str, text: str, kind: int, words: int, inner: bool) -> DataFrame:
    """ident and key__ (hash) of the runs of a kind in text, once each a row; inner: without the first and last word.

    Pieces are cut once into a column that a generator keeps from being computed again; neighbours come from slices of it laid side
    by side, so a text costs its length."""
    wide = kind in (_RUN, _WORD)
    n = words if kind == _RUN else 1 if kind == _WORD else kind
    pieces = F.split(text, " ") if wide else F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    cut = rows.select(ident, F.explode(F.array(pieces)).alias("p__"))
    if inner and wide:
        cut = cut.select(ident, F.explode(F.array(F.slice("p__", F.lit(2), F.greatest(F.size("p__") - 2, F.lit(0))))).alias("p__"))
    cut = cut.where(F.size("p__") >= n)
    side = F.arrays_zip(*(F.slice("p__", F.lit(k + 1), F.size("p__") - (n - 1)).alias(str(k)) for k in range(n)))
    each = cut.select(ident, F.explode(side).alias("z__"))
    return each.select(ident, F.xxhash64(*(F.col("z__")[str(k)] for k in range(n))).alias("key__"))


def quotes_in(sources: DataFrame, quotes: DataFrame, words: int = 4) -> DataFrame:
    """source_id and quote_id, once each, where the quote (quote_id, text) is an exact substring of the source (source_id, text).

    A quote has the keys of its kind (runs of four inner words, cut at single spaces; inner words where there are fewer; runs of three
    characters where there are none), all of which stand in a source that has the quote. Sources' keys are kept where a quote has them
    and counted; each quote is then looked up by its rarest one, and not at all if one of its keys stands nowhere. What meets is
    verified. Keys of many rows are salted by the busiest count. An empty quote stands everywhere, a null text nowhere."""
    from .graph import saved

    q = quotes.select("quote_id", F.col("text").alias("quote")).where("quote is not null").withColumn("kind__", _quote_kind(F.col("quote"), words))
    s = sources.select("source_id", F.col("text").alias("source")).where("source is not null")
    kinds = sorted(r["kind__"] for r in q.select("kind__").distinct().collect())
    near = None
    for kind in kinds:
        own = q.where(F.col("kind__") == kind)
        if kind == _EMPTY:
            salted = own.select("quote_id", F.explode(F.sequence(F.lit(0), F.lit(MOST_SALTS - 1))).alias("salt__"))
            pairs = s.select("source_id", F.pmod(F.xxhash64("source_id"), F.lit(MOST_SALTS)).cast("int").alias("salt__")).join(salted, "salt__").select("source_id", "quote_id")
        else:
            asked = _keys_of(own, "quote_id", "quote", kind, words, inner=True).distinct()
            found = _keys_of(s, "source_id", "source", kind, words, inner=False).join(asked.select("key__").distinct(), "key__", "left_semi")
            found = saved(found.distinct())
            counts = found.groupBy("key__").agg(F.count(F.lit(1)).alias("n__"))
            rarest = asked.join(counts, "key__", "left").groupBy("quote_id").agg(F.min(F.struct(F.coalesce("n__", F.lit(0)).alias("n__"), "key__")).alias("k__"))
            chosen = saved(rarest.where("k__.n__ > 0").select("quote_id", "k__.key__", "k__.n__"))
            most = chosen.agg(F.max("n__")).first()[0] or 0
            salts = max(1, min(MOST_SALTS, -(-most // SALT_ROWS)))
            salted = chosen.select("quote_id", "key__", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt__"))
            pairs = found.withColumn("salt__", F.pmod(F.xxhash64("source_id"), F.lit(salts)).cast("int")).join(salted, ["key__", "salt__"]).select("source_id", "quote_id")
        near = pairs if near is None else near.unionByName(pairs)
    if near is None:
        return s.join(q, F.lit(False)).select("source_id", "quote_id")
    texts = near.join(q.select("quote_id", "quote"), "quote_id").join(s, "source_id")
    return texts.where(F.col("source").contains(F.col("quote"))).select("source_id", "quote_id").distinct()


def plan_form_violations(phases: DataFrame, sources: DataFrame, plan: str = "plan") -> DataFrame:
    """The first reason, in order, why a phase isn't in normal form: plan, position, reason.

    phases: plan, position (place in the list, from 1), phase, modules (array of struct source_files: array of text), depends_on (array of
    int); sources: path of existing files. A phase has its position as number; every module has sources, which exist and aren't tests;
    dependencies come strictly earlier. A plan without rows here, and with a phase at all, is ready."""
    from ..functions.predicates import is_test_path

    each = phases.select(plan, "position", F.posexplode("modules").alias("m__", "module")).withColumn("files__", F.col("module.source_files"))
    empty = each.where(F.coalesce(F.size("files__"), F.lit(-1)) <= 0).select(plan, "position", "m__", F.lit("invalid module sources").alias("reason"))
    named = each.select(plan, "position", "m__", F.explode("files__").alias("path"))
    known = named.join(sources.select("path").distinct().withColumn("there__", F.lit(True)), "path", "left")
    wrong = known.where(F.col("there__").isNull() | is_test_path(F.col("path"))).select(plan, "position", "m__", F.lit("invalid production source").alias("reason"))
    first = empty.unionByName(wrong).groupBy(plan, "position").agg(F.min(F.struct("m__", "reason"))["reason"].alias("sources__"))
    early = F.coalesce(F.forall("depends_on", lambda d: F.coalesce((d > 0) & (d < F.col("position")), F.lit(False))), F.lit(False))
    normal = F.coalesce(F.col("phase") == F.col("position"), F.lit(False)) & F.col("modules").isNotNull()
    reason = F.when(~normal, "not normalized").when(F.col("sources__").isNotNull(), F.col("sources__")).when(~early, "invalid dependencies")
    return phases.join(first, [plan, "position"], "left").select(plan, "position", reason.alias("reason")).where("reason is not null")
