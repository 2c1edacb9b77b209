"""Registered queries: each operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import inventory as D
from ..operators import joins as J
from ..operators import ledger as L
from ..operators import ranking as R
from ..operators.documents import document_digests, joined_text
from ..schemas import CONTRACT_BASES, FULL_PHASES, JOB_STATUSES, VERDICTS
from ..session import table
from ..sources import registry
from . import gates, incremental
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: str = "", recursive: bool = False):
    """Registers a query by its function's name, with its SQL behind the named views."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = V.with_views(views, sql, recursive)
        return function

    return register


def _counts(column: str, domain: tuple[str, ...], prefix: str = "n_") -> str:
    return ", ".join(f"count(*) FILTER (WHERE {column} = '{v}') AS {prefix}{v.lower()}" for v in domain)


@query(
    """SELECT doc_id, path FROM (SELECT doc_id, source || '/' || CASE WHEN doc_id % 11 = 0 THEN 'tests/' ELSE '' END || lang || '/' || CASE WHEN doc_id % 13 = 0 THEN 'test_' ELSE '' END || 'd' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.txt' END AS path FROM documents)
    WHERE path LIKE '%.py' AND NOT regexp_matches(lower(path), '(^|/)(test|tests|testing|fixtures)/') AND NOT regexp_matches(lower(path), '(^|/)test[_-][^/]*$')
      AND NOT regexp_matches(lower(path), '_tests?\\.[^/]*$') AND (path LIKE 'src1/%' OR path LIKE 'src2/en/%')"""
)
def source_scan_filter(spark, d):
    """S1 F1 F2 F3."""
    from ..sources.scans import production_sources

    test, named = F.when(F.col("doc_id") % 11 == 0, "tests/").otherwise(""), F.when(F.col("doc_id") % 13 == 0, "test_").otherwise("")
    end = F.when(F.col("doc_id") % 3 == 0, ".py").otherwise(".txt")
    path = F.concat("source", F.lit("/"), test, "lang", F.lit("/"), named, F.lit("d"), F.col("doc_id").cast("string"), end)
    return production_sources(table(spark, d, "documents").select("doc_id", path.alias("path")), scopes=("./src1/", "src2/en"))


@query("SELECT CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'typescript' WHEN 'de' THEN 'c' ELSE 'unknown' END AS language, count(*) AS files FROM documents GROUP BY 1")
def language_lookup(spark, d):
    """P1 A13."""
    end = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".ts").when(F.col("lang") == "de", ".C").otherwise(".none")
    files = table(spark, d, "documents").select(F.concat(F.lit("a/b.x"), F.col("doc_id").cast("string"), end).alias("path"))
    return registry.with_language(files, registry.profiles(spark)).groupBy("language").agg(F.count(F.lit(1)).alias("files"))


@query(
    """WITH n AS (SELECT path, line, lower(split_part(trim(content), ' ', 1)) AS name FROM units)
    SELECT path, line, path || '::' || name || CASE WHEN count(*) OVER (PARTITION BY path, name) > 1 THEN '#' || row_number() OVER (PARTITION BY path, name ORDER BY line) ELSE '' END AS function_id,
      replace(path, '.txt', '') || '-' || coalesce(nullif(regexp_replace(regexp_replace(name, '[^A-Za-z0-9_.-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g'), ''), 'function') || '-' || row_number() OVER (PARTITION BY path ORDER BY line) || '.txt' AS artifact
    FROM n""",
    "units",
)
def function_identity(spark, d):
    """P3 P4 P5 A12 W4."""
    named = V.units(spark, d).select("path", "line", F.lower(F.split_part(F.trim("content"), F.lit(" "), F.lit(1))).alias("name"))
    return S.function_identity(named, order="line").select("path", "line", "function_id", "artifact")


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS lines FROM files", "files")
def line_slice(spark, d):
    """P6."""
    return V.files(spark, d).select("doc_id", S.line_slice(F.col("text"), 2, 4).alias("lines"))


@query(
    """SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS source_lines, CAST(greatest(1, ceil(length(text) / 4e0)) AS BIGINT) AS token_estimate,
      strlen(text) AS source_bytes, 1 + len(regexp_extract_all(text, '\\b(if|else\\s+if|for|while|case|catch|except|when)\\b|&&|\\|\\||\\?')) AS cyclomatic FROM documents"""
)
def complexity_features(spark, d):
    """P12."""
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in S.complexity_features(F.col("text")).items()))


@query(
    """WITH f AS (SELECT doc_id, lang, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS lines, greatest(1, ceil(length(text) / 4e0)) AS tokens,
      1 + len(regexp_extract_all(text, '\\b(if|else\\s+if|for|while|case|catch|except|when)\\b|&&|\\|\\||\\?')) AS cyclo FROM documents),
    n AS (SELECT id, count(*) AS neighbors FROM (SELECT caller AS id, callee AS o FROM edge UNION SELECT callee, caller FROM edge) GROUP BY id)
    SELECT doc_id, CAST(ceil((tokens + coalesce(neighbors, 0) * 80 + doc_id % 3 * 120 + cyclo * 100 + lines * 2) * CASE lang WHEN 'en' THEN 0.9e0 WHEN 'fr' THEN 1.0e0 WHEN 'de' THEN 1.15e0 ELSE 1.1e0 END
      * (1e0 + least(doc_id % 400, 300e0) / 1200e0)) AS BIGINT) AS score FROM f LEFT JOIN n ON n.id = doc_id""",
    "edge",
)
def complexity_score(spark, d):
    """P13 J8."""
    docs = table(spark, d, "documents").withColumns(S.complexity_features(F.col("text")))
    joined = docs.join(J.neighbor_counts(V.edge(spark, d)), F.col("doc_id") == F.col("id"), "left")
    end = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".ts").when(F.col("lang") == "de", ".cc").otherwise(".none")
    score = S.complexity_score(F.col("token_estimate"), F.coalesce("neighbors", F.lit(0)), F.col("doc_id") % 3, F.col("cyclomatic"), F.col("source_lines"), end, (F.col("doc_id") % 400).cast("double"))
    return joined.select("doc_id", score.alias("score"))


@query("SELECT sha256(text) AS sha256, strlen(text) AS size, count(*) AS copies FROM documents GROUP BY 1, 2")
def content_object_store(spark, d):
    """One object for each distinct content."""
    return table(spark, d, "documents").select(S.digest(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("size")).groupBy("sha256", "size").agg(F.count(F.lit(1)).alias("copies"))


@query("SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'removed' WHEN a.path IS NULL THEN 'produced' WHEN a.sha256 = b.sha256 THEN 'preserved' ELSE 'changed' END AS change FROM v0 a FULL JOIN v1 b ON a.path = b.path", "v0 v1")
def inventory_delta(spark, d):
    """D1."""
    return D.inventory_delta(V.v0(spark, d), V.v1(spark, d))


@query(
    """WITH b AS (SELECT coalesce(a.path, b.path) AS artifact, coalesce(b.source, a.source) AS path, CASE WHEN b.path IS NULL THEN 'removed' WHEN a.path IS NULL THEN 'added' WHEN a.sha256 <> b.sha256 THEN 'modified' END AS change FROM v0 a FULL JOIN v1 b ON a.path = b.path),
    f AS (SELECT path, bool_or(change IS NOT NULL) AS file_changed FROM b GROUP BY path)
    SELECT artifact, b.path, change, file_changed FROM b JOIN f ON f.path = b.path WHERE change IS NOT NULL OR file_changed""",
    "v0 v1",
)
def artifact_diff(spark, d):
    """Artifacts are documents, files their sources."""
    cut = lambda v: v.select(F.col("path").alias("artifact"), F.col("source").alias("path"), "sha256")
    return D.artifact_diff(cut(V.v0(spark, d)), cut(V.v1(spark, d)))


@query(
    """WITH o AS (SELECT DISTINCT sha256 FROM v0)
    SELECT * FROM (SELECT path, CASE WHEN o.sha256 IS NULL THEN 'object missing' END AS problem FROM v1 LEFT JOIN o ON o.sha256 = v1.sha256
      UNION ALL SELECT coalesce(a.path, b.path), CASE WHEN b.path IS NULL THEN 'unexpected' WHEN a.path IS NULL THEN 'mirror missing' WHEN a.sha256 <> b.sha256 THEN 'mirror differs' END FROM v0 a FULL JOIN v1 b ON a.path = b.path) WHERE problem IS NOT NULL""",
    "v0 v1",
)
def inventory_integrity(spark, d):
    """The newer inventory against the older one's objects and files."""
    old = V.v0(spark, d)
    return D.inventory_problems(V.v1(spark, d), old, old.select("sha256", "size").distinct())


@query(
    """WITH m AS (SELECT path, max(line) AS top FROM units GROUP BY path),
    s AS (SELECT path, w, k * w + 1 AS a, (k + 1) * w AS b FROM (SELECT path, w, unnest(range(0, top // w + 1)) AS k FROM m, (VALUES (1), (10), (40)) v(w)) WHERE (w = 1 AND k % 3 = 0) OR (w = 10 AND k % 2 = 0) OR (w = 40 AND k % 3 <> 1))
    SELECT u.path || ':' || line AS node_id, (SELECT arg_min(w || ':' || a, w) FROM s WHERE s.path = u.path AND u.line BETWEEN a AND b) AS span_id FROM units u""",
    "units",
)
def node_to_innermost_span(spark, d):
    """J2 J3."""
    units = V.units(spark, d)
    tops = units.groupBy("path").agg(F.max("line").alias("top"))
    w, k = F.col("w"), F.col("k")
    cut = tops.withColumn("w", F.explode(F.array(F.lit(1), F.lit(10), F.lit(40)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("top") / w).cast("int"))))
    cut = cut.where(((w == 1) & (k % 3 == 0)) | ((w == 10) & (k % 2 == 0)) | ((w == 40) & (k % 3 != 1)))
    spans = cut.select("path", F.concat(w.cast("string"), F.lit(":"), (k * w + 1).cast("string")).alias("span_id"), (k * w + 1).alias("line_start"), ((k + 1) * w).alias("line_end"), w.alias("ord"))
    nodes = units.select(F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("node_id"), "path", "line")
    return J.innermost_spans(nodes, spans).select("node_id", "span_id")


@query("SELECT DISTINCT a AS caller, b AS callee FROM (SELECT CAST(floor(caller / 3) AS BIGINT) AS a, CAST(floor(callee / 3) AS BIGINT) AS b FROM edge_sparse WHERE caller % 7 <> 0 AND callee % 7 <> 0) WHERE a <> b", "edge_sparse")
def edge_resolve(spark, d):
    """Nodes lie in functions of three; every seventh node isn't mapped."""
    edges = V.edge_sparse(spark, d).select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit("calls").alias("kind"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"))
    mapping = part.withColumn("span_id", F.when(F.col("node_id") % 7 != 0, F.floor(F.col("node_id") / 3).cast("long")))
    return J.resolve_edges(edges, mapping).select("caller", "callee")


@query("SELECT caller, callee, CASE WHEN caller % 5 <> 0 AND callee % 5 <> 0 THEN 'good' ELSE 'bad' END AS side FROM edge_sparse", "edge_sparse")
def edge_validate(spark, d):
    """Ids divisible by five are unknown; each edge is sent twice."""
    edges = V.edge_sparse(spark, d).withColumn("ord", F.explode(F.array(F.lit(1), F.lit(2))))
    known = table(spark, d, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id"))
    good, bad = J.validate_edges(edges, known)
    return good.select("caller", "callee", F.lit("good").alias("side")).unionByName(bad.select("caller", "callee", F.lit("bad").alias("side")).distinct())


@query(
    """WITH e AS (SELECT 'f' || caller % 20 AS caller, 'f' || callee % 20 AS callee, 'e' || (caller + callee) % 4 AS ev, caller * 100000 + callee AS ord FROM edge_sparse),
    g AS (SELECT caller, callee, ev, min(ord) AS first FROM e GROUP BY ALL)
    SELECT caller, callee, string_agg(ev, ',' ORDER BY first) AS evidence FROM g GROUP BY caller, callee""",
    "edge_sparse",
)
def edge_merge(spark, d):
    """A11."""
    name = lambda c: F.concat(F.lit("f"), (F.col(c) % 20).cast("string"))
    rows = V.edge_sparse(spark, d).select(
        (F.col("caller") * 100000 + F.col("callee")).alias("ord"), F.struct(name("caller").alias("fqn"), F.array().cast("array<string>").alias("callsite_names")).alias("caller"),
        F.struct(name("callee").alias("fqn"), F.array().cast("array<string>").alias("info_names")).alias("callee"), F.array(F.concat(F.lit("e"), ((F.col("caller") + F.col("callee")) % 4).cast("string"))).alias("evidence"),
    )
    return A.merge_edges(rows).select("caller", "callee", F.array_join("evidence", ",").alias("evidence"))


@query(
    """WITH m AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 97 = 0), n AS (SELECT callee AS id FROM edge_sparse WHERE caller IN (FROM m) UNION SELECT caller FROM edge_sparse WHERE callee IN (FROM m))
    SELECT id FROM n WHERE id NOT IN (FROM m)""",
    "edge_sparse",
)
def neighbor_expansion(spark, d):
    """J7."""
    return J.neighbors(V.edge_sparse(spark, d), table(spark, d, "part").where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("id")))


@query(
    """WITH e AS (SELECT caller, callee FROM edge_sparse WHERE caller < callee), n AS (SELECT caller AS id FROM e UNION SELECT callee FROM e),
    r(id, layer) AS (SELECT id, 0 FROM n UNION SELECT e.callee, layer + 1 FROM r JOIN e ON e.caller = r.id)
    SELECT id, max(layer) AS layer FROM r GROUP BY id""",
    "edge_sparse",
    True,
)
def caller_first_layers(spark, d):
    """G1 on an acyclic graph, by frontier rounds."""
    edges = V.edge_sparse(spark, d).where("caller < callee")
    return G.acyclic_layers(edges.select(F.explode(F.array("caller", "callee")).alias("id")), edges)


_CYCLIC = """WITH own AS (SELECT DISTINCT caller, callee, CAST(floor(caller / 3) AS BIGINT) % 2 AS phase FROM edge_sparse WHERE caller <> callee AND CAST(floor(caller / 3) AS BIGINT) % 2 = CAST(floor(callee / 3) AS BIGINT) % 2),
    n AS (SELECT DISTINCT CAST(floor(id / 3) AS BIGINT) % 2 AS phase, id FROM (SELECT caller AS id FROM edge_sparse UNION SELECT callee FROM edge_sparse)),
    r AS (SELECT phase, -1 AS layer, list(id) AS rest, CAST([] AS BIGINT[]) AS now FROM n GROUP BY phase
      UNION ALL SELECT phase, layer + 1, list_filter(rest, lambda x: NOT list_contains(next, x)), next FROM (SELECT phase, layer, rest, CASE WHEN len(free) > 0 THEN free ELSE [list_min(rest)] END AS next FROM (
        SELECT r.phase, r.layer, r.rest, list_filter(r.rest, lambda x: NOT list_contains(held.ids, x)) AS free FROM r JOIN (
          SELECT r.phase, coalesce(list(DISTINCT own.callee) FILTER (WHERE own.callee IS NOT NULL), []) AS ids FROM r LEFT JOIN own ON own.phase = r.phase AND list_contains(r.rest, own.caller) GROUP BY r.phase) held ON held.phase = r.phase
        WHERE len(r.rest) > 0)))
    SELECT CAST(phase AS INT) AS phase, unnest(now) AS id, CAST(layer AS INT) AS layer FROM r"""


@query(
    _CYCLIC,
    "edge_sparse",
    True,
)
def caller_first_layers_cyclic(spark, d):
    """G1 with cycles: what lies on or below one is folded in a task a phase, as it is small; two phases by parity of the id's third."""
    edges = V.edge_sparse(spark, d)
    nodes = edges.select(F.explode(F.array("caller", "callee")).alias("id")).distinct().select((F.floor(F.col("id") / 3) % 2).cast("int").alias("phase"), "id")
    return G.caller_first_layers(nodes, edges)


@query(_CYCLIC, "edge_sparse", True)
def caller_first_layers_by_rounds(spark, d):
    """G1 with cycles: the same phases, what lies on and below cycles layered by joins alone."""
    edges = V.edge_sparse(spark, d)
    nodes = edges.select(F.explode(F.array("caller", "callee")).alias("id")).distinct().select((F.floor(F.col("id") / 3) % 2).cast("int").alias("phase"), "id")
    return G.caller_first_layers(nodes, edges, fold_edges=0)


@query(
    """WITH both_ AS (SELECT caller AS a, callee AS b, 'callee-propagation' AS how FROM edge_sparse UNION SELECT callee, caller, 'caller-propagation' FROM edge_sparse),
    r(id, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 97 = 0 UNION SELECT b, depth + 1 FROM r JOIN both_ ON a = r.id WHERE depth < 64),
    n AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)
    SELECT n.id, CASE WHEN any_value(n.depth) = 0 THEN 'file-change' ELSE min(how) END AS reason FROM n LEFT JOIN both_ ON b = n.id LEFT JOIN n m ON m.id = a WHERE n.depth = 0 OR m.depth = n.depth - 1 GROUP BY n.id""",
    "edge_sparse",
    True,
)
def impact_closure(spark, d):
    """Of several ways in from one distance, the caller's reach counts."""
    return G.impact_closure(V.edge_sparse(spark, d), table(spark, d, "part").where("p_partkey % 97 = 0").select(F.col("p_partkey").alias("id")))


@query("SELECT job_id % 10 AS phase, status, count(*) AS jobs FROM log GROUP BY ALL", "log")
def job_rollup(spark, d):
    """A1."""
    return A.job_rollup(V.log(spark, d).withColumn("phase", F.col("job_id") % 10), "phase")


@query("SELECT job_id % 10 AS phase, count(*) FILTER (WHERE status IN ('queued', 'running', 'retryable')) AS pending, count(*) FILTER (WHERE status = 'failed') AS failed, pending = 0 AND failed = 0 AS converged FROM log GROUP BY 1", "log")
def convergence(spark, d):
    """A1: what is pending."""
    return A.convergence(V.log(spark, d).withColumn("phase", F.col("job_id") % 10), "phase")


@query(f"SELECT job_id, {_counts('status', JOB_STATUSES)}, CASE WHEN n_failed > 0 THEN 'phase_failed' WHEN n_queued + n_running + n_retryable > 0 THEN 'wait' ELSE 'converged' END AS action FROM log GROUP BY job_id", "log")
def barrier(spark, d):
    """A14."""
    return A.barrier(V.log(spark, d), "job_id")


@query(
    f"""WITH j AS (SELECT job_id % 10 AS phase, event_id, status, CASE event_id % 6 WHEN 0 THEN 'DEPENDENCY_RISK' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'INCONCLUSIVE' WHEN 3 THEN 'MATCH' WHEN 4 THEN 'MISMATCH' END AS verdict FROM log)
    SELECT phase, {_counts('status', JOB_STATUSES)}, {_counts('verdict', VERDICTS)}, count(*) FILTER (WHERE status IN ('failed', 'retryable') OR verdict IN ('ERROR', 'INCONCLUSIVE', 'DEPENDENCY_RISK')) AS n_escalations FROM j GROUP BY phase""",
    "log",
)
def phase_receipt(spark, d):
    """A2."""
    verdict = F.try_element_at(F.array(*map(F.lit, VERDICTS)), (F.col("event_id") % 6 + 1).cast("int"))
    jobs = V.log(spark, d).select((F.col("job_id") % 10).alias("phase"), F.col("event_id").alias("job_id"), "status", verdict.alias("verdict"), F.lit(None).cast("string").alias("escalation"))
    return A.phase_receipt(jobs, "phase")


@query(
    """WITH j AS (SELECT job_id % 10 AS phase, event_id, CASE WHEN status IN ('failed', 'retryable') THEN status ELSE CASE event_id % 6 WHEN 0 THEN 'DEPENDENCY_RISK' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'INCONCLUSIVE' END END AS reason FROM log)
    SELECT phase, count(*) AS lines, CAST(sum(strlen(event_id || ' ' || reason)) + count(*) - 1 AS BIGINT) AS bytes, sha256(string_agg(event_id || ' ' || reason, chr(10) ORDER BY event_id)) AS sha256 FROM j WHERE reason IS NOT NULL GROUP BY phase""",
    "log",
)
def escalation_documents(spark, d):
    """A2: a phase's escalations as a document, by its digest."""
    verdict = F.try_element_at(F.array(*map(F.lit, VERDICTS)), (F.col("event_id") % 6 + 1).cast("int"))
    jobs = V.log(spark, d).select((F.col("job_id") % 10).alias("phase"), F.col("event_id").alias("job_id"), "status", verdict.alias("verdict"), F.lit(None).cast("string").alias("escalation"))
    lines = A.escalations(jobs, "phase").withColumn("line", F.concat_ws(" ", F.col("job_id").cast("string"), "reason"))
    return document_digests(lines, ["phase"], ["job_id"])


_COVERAGE = f"""SELECT source, count(*) AS total, {_counts('verdict', VERDICTS)}, {_counts('basis', CONTRACT_BASES, 'b_')}, n_match + n_mismatch AS conclusive, CASE WHEN total = 0 THEN 0e0 ELSE conclusive / total END AS conclusive_ratio FROM verdicts GROUP BY source"""


@query(_COVERAGE, "verdicts")
def coverage(spark, d):
    """A3."""
    return A.coverage(V.verdicts(spark, d), "source")


@query(
    f"""WITH c AS ({_COVERAGE}), g AS (SELECT *, CAST(floor((total + 1) / 2) AS BIGINT) AS required, CASE WHEN total = 0 OR b_normative + b_inferred < floor((total + 1) / 2) THEN 'insufficient_specification' WHEN n_error > 0 THEN 'verification_incomplete'
      WHEN conclusive < floor((total + 1) / 2) THEN 'insufficient_specification' ELSE '' END AS reason FROM c) SELECT *, reason = '' AS ready FROM g""",
    "verdicts",
)
def coverage_gate(spark, d):
    """A4."""
    return A.coverage_gate(A.coverage(V.verdicts(spark, d), "source"))


_PHASES = ", ".join(f"'{p}'" for p in FULL_PHASES)


@query(
    f"""WITH p AS (SELECT job_id, event_id % 9 + 1 AS k, bool_or(status <> 'succeeded') AS open FROM log GROUP BY ALL)
    SELECT job_id, coalesce([{_PHASES}][min(k) FILTER (WHERE open)], 'finalize') AS phase FROM p GROUP BY job_id""",
    "log",
)
def earliest_incomplete(spark, d):
    """A5."""
    phase = F.element_at(F.array(*map(F.lit, FULL_PHASES)), (F.col("event_id") % 9 + 1).cast("int"))
    return A.earliest_incomplete(V.log(spark, d).withColumn("phase", phase), FULL_PHASES, "finalize", "job_id")


@query(f"WITH p AS (SELECT job_id, event_id % 9 + 1 AS k FROM log WHERE status = 'succeeded'), u AS (SELECT DISTINCT job_id FROM log) SELECT job_id, coalesce([{_PHASES}][(SELECT min(i) FROM range(1, 10) t(i) WHERE (u.job_id, i) NOT IN (SELECT job_id, k FROM p))], 'finalize') AS phase FROM u", "log")
def first_incomplete(spark, d):
    """W8."""
    phase = F.element_at(F.array(*map(F.lit, FULL_PHASES)), (F.col("event_id") % 9 + 1).cast("int"))
    return A.first_incomplete(V.log(spark, d).withColumn("phase", phase), FULL_PHASES, "job_id")


_TYPES = "['spec_batch', 'verify_batch', 'bug_validate', 'phase_plan'][CAST(event_id * 7 % 5 % 4 + 1 AS INT)]"


@query(
    f"""WITH r AS (SELECT event_id AS job_id, {_TYPES} AS type, job_id % 10 AS run FROM log WHERE status = 'queued'),
    p AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY job_id) <= 64),
    t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY run, type ORDER BY job_id) <= CASE type WHEN 'spec_batch' THEN 8 - 3 WHEN 'verify_batch' THEN 12 WHEN 'bug_validate' THEN 4 ELSE 16 END)
    SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY run ORDER BY job_id) <= 16 - 3""",
    "log",
)
def capped_admission(spark, d):
    """Runs by tens of users; three specification batches of each run already."""
    kinds = F.array(*map(F.lit, ("spec_batch", "verify_batch", "bug_validate", "phase_plan")))
    ready = V.log(spark, d).where("status = 'queued'").select(F.col("event_id").alias("job_id"), F.element_at(kinds, (F.col("event_id") * 7 % 5 % 4 + 1).cast("int")).alias("type"), (F.col("job_id") % 10).alias("run"))
    running = spark.range(10).select(F.col("id").alias("run"), F.lit("spec_batch").alias("type"), F.lit(3).alias("n"))
    return R.capped_admission(ready, running, keys=("run",))


@query(
    """WITH i AS (SELECT source, doc_id, CAST(greatest(1, ceil(length(text) / 4e0)) AS BIGINT) AS t, strlen(text) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
    r AS (SELECT source, doc_id, rn, 1 AS batch, CASE WHEN t >= 12000 THEN 20 ELSE 1 END AS n, t AS ts, b AS bs FROM i WHERE rn = 1
      UNION ALL SELECT i.source, i.doc_id, i.rn, CASE WHEN x THEN batch + 1 ELSE batch END, CASE WHEN t >= 12000 THEN 20 WHEN x THEN 1 ELSE n + 1 END, CASE WHEN x THEN t ELSE ts + t END, CASE WHEN x THEN b ELSE bs + b END
      FROM (SELECT r.batch, r.n, r.ts, r.bs, i.*, r.n >= 20 OR r.ts + i.t > 12000 OR r.bs + i.b > 262144 AS x FROM r JOIN i ON i.source = r.source AND i.rn = r.rn + 1) i)
    SELECT source, doc_id, batch FROM r""",
    "",
    True,
)
def greedy_partition(spark, d):
    """W2."""
    features = S.complexity_features(F.col("text"))
    items = table(spark, d, "documents").select("source", "doc_id", features["token_estimate"].alias("tokens"), features["source_bytes"].alias("bytes"))
    return R.greedy_batches(items, "source", "doc_id").select("source", "doc_id", "batch")


@query("SELECT doc_id % 40 AS batch, count(*) AS items, sum(CAST(greatest(1, ceil(length(text) / 4e0)) AS BIGINT)) AS tokens, sum(strlen(text)) AS bytes FROM documents GROUP BY 1")
def batch_totals(spark, d):
    """A15."""
    features = S.complexity_features(F.col("text"))
    return A.batch_totals(table(spark, d, "documents").select((F.col("doc_id") % 40).alias("batch"), features["token_estimate"].alias("tokens"), features["source_bytes"].alias("bytes")), "batch")


@query(
    """WITH i AS (SELECT source, doc_id, CAST(greatest(1, ceil(length(text) / 4e0)) AS BIGINT) AS t, strlen(text) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
    r AS (SELECT source, doc_id, rn, 1 AS batch, CASE WHEN t >= 12000 THEN 20 ELSE 1 END AS n, t AS ts, b AS bs, t, b FROM i WHERE rn = 1
      UNION ALL SELECT i.source, i.doc_id, i.rn, CASE WHEN x THEN batch + 1 ELSE batch END, CASE WHEN t >= 12000 THEN 20 WHEN x THEN 1 ELSE n + 1 END, CASE WHEN x THEN t ELSE ts + t END, CASE WHEN x THEN b ELSE bs + b END, t, b
      FROM (SELECT r.batch, r.n, r.ts, r.bs, i.*, r.n >= 20 OR r.ts + i.t > 12000 OR r.bs + i.b > 262144 AS x FROM r JOIN i ON i.source = r.source AND i.rn = r.rn + 1) i)
    SELECT source, batch, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS names, count(*) AS items, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(b) AS BIGINT) AS bytes FROM r GROUP BY source, batch""",
    "",
    True,
)
def batch_items(spark, d):
    """Each batch's items and totals."""
    features = S.complexity_features(F.col("text"))
    items = table(spark, d, "documents").select("source", "doc_id", features["token_estimate"].alias("tokens"), features["source_bytes"].alias("bytes"))
    out = A.batch_items(R.greedy_batches(items, "source", "doc_id"), "doc_id", "source", "batch")
    return out.withColumn("names", F.array_join(F.col("names").cast("array<string>"), ","))


@query(
    """WITH b AS (SELECT source, doc_id // (20 + 20 * (CAST(substr(source, 4) AS INT) % 5)) AS batch, list(doc_id ORDER BY doc_id) AS items FROM documents GROUP BY ALL),
    s AS (SELECT source, 0 AS late, batch, unnest(items) AS i, generate_subscripts(items, 1) AS pos, NULL AS l FROM b WHERE len(items) < 3 UNION ALL SELECT source, 1, batch, NULL, 0, items FROM b WHERE len(items) >= 3)
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY late, batch, pos) AS ordinal, CASE WHEN late = 0 THEN CAST(i AS VARCHAR) ELSE array_to_string(l, ',') END AS items FROM s"""
)
def batch_reshape(spark, d):
    """A phase a source; its batches are ranges of ids, longer ones in some sources."""
    batch = F.expr("doc_id div (20 + 20 * (cast(substr(source, 4) as int) % 5))")
    batches = table(spark, d, "documents").groupBy("source", batch.alias("batch")).agg(F.array_sort(F.collect_list("doc_id")).alias("items"))
    return R.reshape_batches(batches, keys=("source",)).select("source", F.col("ordinal").cast("long").alias("ordinal"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("WITH a AS (SELECT job_id % 10 AS type, status, ts, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS done FROM log) SELECT type, round(greatest(0e0, coalesce(avg(epoch(done) - epoch(ts)) FILTER (WHERE status = 'succeeded'), 0e0)), 3) AS seconds FROM a GROUP BY type", "log")
def historical_seconds(spark, d):
    """A7 J16."""
    done = F.lead("ts").over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    attempts = V.log(spark, d).select((F.col("job_id") % 10).alias("type"), "status", F.col("ts").alias("started_at"), done.alias("completed_at"))
    return A.historical_seconds(attempts, "type").withColumn("seconds", F.round("seconds", 3))


@query("SELECT event_id AS job_id, CAST(1 AS INT) AS attempt FROM log WHERE status = 'running' AND ts + INTERVAL 900 SECOND <= (SELECT max(ts) - INTERVAL 3 DAY FROM events)", "log")
def lease_expiry(spark, d):
    """T2 J15."""
    log = V.log(spark, d)
    jobs = log.select(F.col("event_id").alias("job_id"), "status")
    now = log.agg((F.max("ts") - F.expr("interval 3 days")).alias("now"))
    leases = log.join(now, F.lit(True)).select(F.col("event_id").alias("job_id"), F.lit(1).alias("attempt"), L.lease_expiry(F.col("ts")).alias("expires_at"), "now")
    return L.expired_leases(leases, jobs, F.col("now"))


@query("SELECT CAST(n_chars AS VARCHAR) AS job_id, count(*) AS copies, count(DISTINCT sha256(text)) = 1 AS accepted FROM documents GROUP BY 1")
def receipt_idempotence(spark, d):
    """Receipts of a job are documents of one length; copies agree, others conflict."""
    rows = table(spark, d, "documents").select(F.col("n_chars").cast("string").alias("job_id"), F.lit(1).alias("attempt"), F.lit("i").alias("input_hash"), F.lit("a").alias("artifact_hash"), F.col("text").alias("payload"))
    good, bad = L.accepted_receipts(rows)
    return good.select("job_id", "copies", F.lit(True).alias("accepted")).unionByName(bad.select("job_id", "copies", F.lit(False).alias("accepted")))


@query(
    """WITH e AS (SELECT job_id, action, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM log),
    r AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS rn, 'queued' AS status, 0 AS attempts FROM e
      UNION ALL SELECT r.job_id, e.rn, CASE WHEN action = 'start' AND status = 'queued' THEN 'running' WHEN action = 'complete' AND status = 'running' THEN 'succeeded'
        WHEN action = 'fail' AND status IN ('queued', 'running') THEN CASE WHEN attempts < 5 THEN 'retryable' ELSE 'failed' END WHEN action = 'retry' AND status = 'retryable' THEN 'queued' ELSE status END,
        CASE WHEN action = 'start' AND status = 'queued' THEN attempts + 1 ELSE attempts END
      FROM r JOIN e ON e.job_id = r.job_id AND e.rn = r.rn + 1)
    SELECT job_id, arg_max(status, rn) AS status, arg_max(attempts, rn) AS attempts FROM r GROUP BY job_id""",
    "log",
    True,
)
def job_state_machine(spark, d):
    """T1."""
    return L.fold_events(V.log(spark, d).withColumn("failure_class", F.lit("execution")), order=("ts", "event_id")).select("job_id", "status", "attempts")


@query()
def stream_job_status(spark, d):
    """T1 as a stream over the events, each job's last state; leases (T2) and receipts (T3) of the stream are tested apart."""
    from ..streaming.jobs import job_status_stream, latest_states, upsert_latest

    folder = _folder(spark)
    raw = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    action = V._mapped(F.col("event_type"), {"view": "start", "purchase": "complete", "error": "fail", "click": "retry"}, None)
    events = raw.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), action.alias("action"), F.lit("execution").alias("failure_class"))
    upsert_latest(job_status_stream(events), f"{folder}/states", f"{folder}/checkpoint")
    return latest_states(spark.read.parquet(f"{folder}/states")).select("job_id", "status", "attempts")


@query(
    """WITH e AS (SELECT job_id, action, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM log), w AS (SELECT max(ms) - 3600000 AS mark FROM e),
    r AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS rn, 'queued' AS status, 0 AS attempts, CAST(0 AS BIGINT) AS last FROM e
      UNION ALL SELECT job_id, rn, CASE WHEN action = 'start' AND status = 'queued' THEN 'running' WHEN action = 'complete' AND status = 'running' THEN 'succeeded'
        WHEN action = 'fail' AND status IN ('queued', 'running') THEN CASE WHEN attempts < 5 THEN 'retryable' ELSE 'failed' END WHEN action = 'retry' AND status = 'retryable' THEN 'queued' ELSE status END,
        CASE WHEN action = 'start' AND status = 'queued' THEN attempts + 1 ELSE attempts END, ms
      FROM (SELECT r.job_id, e.rn, e.action, e.ms, attempts, CASE WHEN status = 'running' AND e.ms >= last + 43200000 THEN CASE WHEN attempts < 5 THEN 'retryable' ELSE 'failed' END ELSE status END AS status FROM r JOIN e ON e.job_id = r.job_id AND e.rn = r.rn + 1)),
    f AS (SELECT job_id, arg_max(status, rn) AS status, arg_max(attempts, rn) AS attempts, arg_max(last, rn) AS last FROM r GROUP BY job_id)
    SELECT job_id, CASE WHEN status = 'running' AND last + 43200000 <= mark THEN CASE WHEN attempts < 5 THEN 'retryable' ELSE 'failed' END ELSE status END AS status, attempts FROM f, w""",
    "log",
    True,
)
def stream_leases(spark, d):
    """T2 on the stream: leases of half a day as event-time timers, the watermark an hour behind."""
    from ..streaming.jobs import job_status_stream, latest_states, upsert_latest

    folder = _folder(spark)
    raw = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    action = V._mapped(F.col("event_type"), {"view": "start", "purchase": "complete", "error": "fail", "click": "retry"}, None)
    events = raw.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), action.alias("action"), F.lit("execution").alias("failure_class"))
    upsert_latest(job_status_stream(events, lease_seconds=43_200, delay="1 hour"), f"{folder}/states", f"{folder}/checkpoint")
    return latest_states(spark.read.parquet(f"{folder}/states")).select("job_id", "status", "attempts")


@query("SELECT user_id AS job_id, attempt, count(*) AS firsts FROM (SELECT DISTINCT user_id, event_id % 7 AS attempt, sha256(event_type) AS identity FROM events) GROUP BY ALL")
def stream_receipts(spark, d):
    """T3 on the stream: of receipts sent again with one content the first passes; each other content does."""
    from ..streaming.jobs import first_receipts

    folder = _folder(spark)
    raw = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    receipts = raw.select(F.col("user_id").alias("job_id"), (F.col("event_id") % 7).alias("attempt"), F.col("event_type").alias("payload"), F.col("ts").cast("timestamp").alias("received_at"))
    first_receipts(receipts, delay="1000 days").writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("job_id", "attempt").agg(F.count(F.lit(1)).alias("firsts"))


@query("SELECT p_partkey AS job_id FROM part p WHERE p_size % 2 <> 0 AND NOT EXISTS (FROM edge e JOIN part q ON q.p_partkey = e.caller WHERE e.callee = p.p_partkey AND q.p_size % 2 <> 0)", "edge")
def ready_jobs(spark, d):
    """Parts are jobs; those of even size have succeeded; a part depends on its parent."""
    jobs = table(spark, d, "part").select(F.col("p_partkey").alias("job_id"), F.when(F.col("p_size") % 2 == 0, "succeeded").otherwise("queued").alias("status"))
    return J.ready_jobs(jobs, V.edge(spark, d).select(F.col("callee").alias("job_id"), F.col("caller").alias("depends_on"))).select("job_id")


@query("SELECT doc_id FROM verdicts WHERE verdict = 'MISMATCH' AND doc_id % 3 <> 0", "verdicts")
def static_findings(spark, d):
    """Every third document has a dynamic result."""
    return J.without(V.verdicts(spark, d).where("verdict = 'MISMATCH'"), table(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id"), "doc_id").select("doc_id")


@query("SELECT path, 'missing' AS side FROM v0 WHERE path NOT IN (SELECT path FROM v1) UNION ALL SELECT path, 'extra' FROM v1 WHERE path NOT IN (SELECT path FROM v0)", "v0 v1")
def set_equality_report(spark, d):
    """J12 D3 D6."""
    return J.set_differences(V.v0(spark, d), V.v1(spark, d), "path")


@query("SELECT count(*) AS stale, min(path) AS first FROM v1 WHERE path NOT IN (SELECT path FROM v0)", "v0 v1")
def stale_artifacts(spark, d):
    """D3 D4."""
    return D.stale(V.v0(spark, d), V.v1(spark, d), "path")


@query("SELECT doc_id AS source_id, item_id AS quote_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def quote_containment(spark, d):
    """F8 J18."""
    return J.quotes_in(table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), "text"))


_MARK = "(?i)(\\bBUG\\s*:|\\bFIXME\\s*:|\\bTODO\\s*:|\\bseeded[ -]bug\\b|\\bknown defect\\b|\\bintentionally (broken|defective)\\b)"


@query(f"SELECT origin, count(*) AS texts, count(*) FILTER (WHERE regexp_matches(t, '{_MARK}')) AS marked FROM (SELECT 'documents' AS origin, CASE WHEN doc_id % 9 = 0 THEN 'Fixme : ' || text ELSE text END AS t FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY origin")
def oracle_marker(spark, d):
    """every ninth document gets a marker."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("origin"), F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("Fixme : "), "text")).otherwise(F.col("text")).alias("t"))
    rows = docs.union(table(spark, d, "pages").select(F.lit("pages"), "html")).union(table(spark, d, "conversations").select(F.lit("conversations"), "text"))
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("texts"), F.count_if(P.has_oracle_marker(F.col("t"))).alias("marked"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE len(k) = 1 AND k[1] = 'k') AS exact FROM (SELECT event_type, json_keys(CASE WHEN event_id % 4 = 0 THEN '{\"k\": 1, \"x\": 2}' ELSE props END) AS k FROM events) GROUP BY event_type")
def json_closed_schema(spark, d):
    """F5 F6 section 2.10: exact key sets; every fourth document has one key too many."""
    props = F.when(F.col("event_id") % 4 == 0, F.lit('{"k": 1, "x": 2}')).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_type", P.has_exact_keys(props, ("k",)).alias("ok")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("exact"))


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS rn FROM conversations) WHERE rn = 1")
def latest_attempt(spark, d):
    """W5."""
    return R.latest(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn", "text"])


@query("SELECT doc_id % 100 AS id, bool_or(quality = 1) AS included FROM labels WHERE doc_id % 100 < 90 GROUP BY 1")
def selection_merge(spark, d):
    """D5."""
    labels = table(spark, d, "labels").select((F.col("doc_id") % 100).alias("id"), (F.col("quality") == 1).alias("included"), F.lit("label").alias("reason"))
    good, _ = D.selection_merge(labels, spark.range(90))
    return good.select("id", "included")


@query("SELECT * FROM (SELECT a.path, unnest(['lang', 'sha256', 'size']) AS field, unnest([a.lang, a.sha256, CAST(a.size AS VARCHAR)]) AS was, unnest([b.lang, b.sha256, CAST(b.size AS VARCHAR)]) AS now FROM v0 a JOIN v1 b ON a.path = b.path) WHERE was IS DISTINCT FROM now", "v0 v1")
def version_diff(spark, d):
    """D9."""
    return D.version_differences(V.v0(spark, d), V.v1(spark, d), "path", ["lang", "sha256", "size"])


@query(
    """WITH c AS (SELECT coalesce(a.source, b.source) AS source, count(*) FILTER (WHERE a.path IS NULL OR b.path IS NULL OR a.sha256 <> b.sha256) AS changes FROM v0 a FULL JOIN v1 b ON a.path = b.path GROUP BY 1)
    SELECT source, changes, CASE WHEN source = 'src3' THEN 'full' WHEN changes = 0 THEN 'noop' ELSE 'incremental' END AS mode FROM c""",
    "v0 v1",
)
def mode_decision(spark, d):
    """By source; one has no baseline."""
    delta = D.inventory_delta(V.v0(spark, d), V.v1(spark, d))
    per = delta.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("source")).agg(F.count_if(F.col("change") != "preserved").alias("changes"))
    return per.withColumn("mode", gates.mode_decision(F.col("source") != "src3", F.col("changes")))


@query(
    """WITH f AS (SELECT source, doc_id, verdict = 'MISMATCH' AS m, CASE doc_id % 6 WHEN 0 THEN 'confirmed' WHEN 3 THEN 'rejected' END AS s FROM verdicts)
    SELECT source, count(*) AS total, count(*) FILTER (WHERE m) AS mismatches, count(*) FILTER (WHERE m AND s IS NULL) AS static_findings, count(*) FILTER (WHERE m AND s = 'confirmed') AS confirmed,
      CASE WHEN source <> 'src1' THEN coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (WHERE m AND s IS NULL), '') END AS static_ids FROM f GROUP BY source""",
    "verdicts",
)
def terminal_report(spark, d):
    """A10: one source isn't official."""
    rows = V.verdicts(spark, d).withColumnRenamed("doc_id", "function_id")
    dynamic = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("function_id"), F.when(F.col("doc_id") % 6 == 0, "confirmed").otherwise("rejected").alias("confirmation_status"))
    found = gates.terminal_findings(rows, dynamic, F.col("source") != "src1", "source").where("finding = 'static'").withColumn("line", F.col("function_id").cast("string"))
    ids = joined_text(found, ["source"], ["function_id"], separator=",").withColumnRenamed("text", "static_ids")
    none = F.when(F.col("source") != "src1", "")
    return gates.terminal_report(rows, dynamic, "source").join(ids, "source", "left").withColumn("static_ids", F.coalesce("static_ids", none))


@query("SELECT source, count(*) AS candidates, count(*) FILTER (WHERE s = 0) AS confirmed, count(*) FILTER (WHERE s = 1) AS rejected, count(*) FILTER (WHERE s = 2) AS inconclusive FROM (SELECT source, doc_id % 4 AS s FROM verdicts WHERE verdict = 'MISMATCH') GROUP BY source", "verdicts")
def bug_summary(spark, d):
    """A8."""
    status = F.try_element_at(F.array(F.lit("confirmed"), F.lit("rejected"), F.lit("inconclusive")), (F.col("doc_id") % 4 + 1).cast("int"))
    return A.bug_summary(V.verdicts(spark, d).where("verdict = 'MISMATCH'").withColumn("confirmation_status", status), "source")


@query("SELECT source, lang, sha256(string_agg(path || chr(9) || sha256 || chr(9) || size, chr(10) ORDER BY path || chr(9) || sha256 || chr(9) || size)) AS identity FROM v0 GROUP BY ALL", "v0")
def composite_identity(spark, d):
    """A17 P8."""
    return A.composite_identity(V.v0(spark, d), "source", "lang")


@query("SELECT path || '::' || 'f' || doc_id AS id, source || '::' || lang || '::d' || doc_id || '-txt::f' || doc_id AS fqn, substr(sha256(path), 1, 16) AS short_id FROM files", "files")
def qualified_names(spark, d):
    """P7 P9."""
    own = F.concat("path", F.lit("::f"), F.col("doc_id").cast("string"))
    return V.files(spark, d).select(own.alias("id"), S.qualified_name(own).alias("fqn"), S.short_id(F.col("path")).alias("short_id"))


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 'runtime_error' WHEN event_type = 'view' THEN 'confirmed' WHEN event_type = 'click' THEN 'not_reproduced' ELSE 'inconclusive' END AS class, right(props, 5) AS tail FROM events"""
)
def output_classes(spark, d):
    """P16 P17."""
    said = F.when(F.col("event_type") == "view", "x\nCONFIRMED").when(F.col("event_type") == "click", "NOT CONFIRMED y").when(F.col("event_type") == "error", "CONFIRMED\nNOT CONFIRMED").otherwise("maybe CONFIRMED")
    return table(spark, d, "events").select("event_id", S.output_class((F.col("event_id") % 5 == 1).cast("int"), said).alias("class"), S.tail(F.col("props"), 5).alias("tail"))


@query("SELECT event_id AS job_id, CASE WHEN event_id % 3 = 0 THEN 'succeeded' WHEN event_id % 6 < 5 THEN 'retryable' ELSE 'failed' END AS recovered FROM log WHERE status = 'running'", "log")
def crash_recovery(spark, d):
    """Every third job has a receipt; attempts follow the id."""
    jobs = V.log(spark, d).select(F.col("event_id").alias("job_id"), "status", (F.col("event_id") % 6).cast("int").alias("attempt"))
    return L.recover(jobs, jobs.where("job_id % 3 = 0").select("job_id", "attempt")).select("job_id", "recovered")


@query("SELECT source AS job_id, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) FILTER (WHERE doc_id % 4 <> 0), '') AS completed, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) FILTER (WHERE doc_id % 4 = 0), '') AS remaining FROM documents GROUP BY source")
def partial_batches(spark, d):
    """A source's documents are a batch; every fourth is invalid."""
    docs = table(spark, d, "documents").select(F.col("source").alias("job_id"), F.col("doc_id").cast("string").alias("artifact"), "doc_id")
    jobs = docs.groupBy("job_id").agg(F.array_sort(F.collect_list("artifact")).alias("artifacts"))
    out = L.partial_batches(jobs, docs.where("doc_id % 4 = 0"))
    return out.select("job_id", F.array_join("completed", ",").alias("completed"), F.array_join("remaining", ",").alias("remaining"))


@query("SELECT doc_id AS function_id FROM verdicts WHERE verdict = 'MISMATCH' AND doc_id % 10 <> 1", "verdicts")
def activated_probes(spark, d):
    """A tenth has jobs already."""
    rows = V.verdicts(spark, d).withColumnRenamed("doc_id", "function_id")
    jobs = rows.where("function_id % 10 = 1").select(F.lit("bug_validate").alias("type"), F.array("function_id").alias("artifacts"))
    return L.activated_probes(rows, jobs, "bug_validation")


@query("SELECT p_brand AS phase, count(DISTINCT p_size) AS layers, count(*) AS functions FROM part GROUP BY 1")
def layer_summary(spark, d):
    """A16."""
    return A.layer_summary(table(spark, d, "part").select(F.col("p_brand").alias("phase"), F.col("p_size").alias("layer")))


@query(
    """WITH b AS (SELECT p_brand AS phase, p_size % 5 AS layer, p_partkey AS job_id FROM part WHERE p_size % 5 <> 2), l AS (SELECT DISTINCT phase, layer, dense_rank() OVER (PARTITION BY phase ORDER BY layer) AS k FROM b)
    SELECT b.job_id, (SELECT count(*) FROM b c JOIN l m ON m.phase = c.phase AND m.layer = c.layer WHERE c.phase = b.phase AND m.k = l.k - 1) AS n_deps FROM b JOIN l ON l.phase = b.phase AND l.layer = b.layer"""
)
def previous_layer_jobs(spark, d):
    """All jobs of the phase's previous layer that has any."""
    batches = table(spark, d, "part").where("p_size % 5 <> 2").select(F.col("p_brand").alias("phase"), (F.col("p_size") % 5).alias("layer"), F.col("p_partkey").alias("job_id"))
    return G.previous_layer(batches).select("job_id", "n_deps")


@query(
    """WITH c AS (SELECT coalesce(a.path, b.path) AS path FROM v0 a FULL JOIN v1 b ON a.path = b.path WHERE b.path IS NOT NULL AND (a.path IS NULL OR a.sha256 <> b.sha256)),
    both_ AS (SELECT caller AS a, callee AS b FROM edge_sparse UNION SELECT callee, caller FROM edge_sparse),
    r(id) AS (SELECT doc_id FROM files WHERE path IN (FROM c) UNION SELECT b FROM r JOIN both_ ON a = r.id)
    SELECT lang, count(*) AS total, count(*) FILTER (WHERE verdict = 'MATCH') AS n_match, count(*) FILTER (WHERE verdict = 'MISMATCH') AS n_mismatch, CAST(floor((count(*) + 1) / 2) AS BIGINT) AS required FROM verdicts WHERE doc_id IN (FROM r) GROUP BY lang""",
    "files v0 v1 edge_sparse verdicts",
    True,
)
def incremental_impact(spark, d):
    """The flagship: delta, changed units, closure, coverage of what is affected, by language."""
    units = V.files(spark, d).select(F.col("doc_id").alias("id"), "path")
    decisions = incremental.affected(V.v0(spark, d), V.v1(spark, d), units, V.edge_sparse(spark, d))
    out = incremental.affected_coverage(decisions, V.verdicts(spark, d).withColumnRenamed("doc_id", "id"), "lang")
    return out.select("lang", "total", "n_match", "n_mismatch", "required")


# ---- registry, scans, small expressions -------------------------------------------------------------------------------------


@query(
    "SELECT unnest(['.py', '.js', '.jsx', '.mjs', '.cjs', '.ts', '.tsx', '.mts', '.cts', '.go', '.rs', '.java', '.c', '.cc', '.cpp', '.cxx', '.h', '.hpp', '.cu', '.cuh', '.ets', '.erl']) AS extension, "
    "unnest(['python', 'javascript', 'javascript', 'javascript', 'javascript', 'typescript', 'typescript', 'typescript', 'typescript', 'go', 'rust', 'java', 'c', 'cpp', 'cpp', 'cpp', 'cpp', 'cpp', 'cuda', 'cuda', 'arkts', 'erlang']) AS key"
)
def capability_matrix(spark, d):
    """P2."""
    return registry.capability_matrix(registry.profiles(spark)).select("extension", "key")


@query("SELECT CASE p_size % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'none' WHEN 2 THEN 'cmake' ELSE 'python' END AS adapter, count(*) AS n FROM part GROUP BY 1")
def build_adapters(spark, d):
    """Rust needs two files of which one is there; Python needs none."""
    cases = {0: ("go.mod", "go"), 1: ("Cargo.toml", "rust"), 2: ("CMakeLists.txt", "c"), 3: ("none", "python")}
    profile, out = registry.profiles(spark), None
    for k, (name, key) in cases.items():
        adapter = registry.build_adapter(spark.createDataFrame([(name,)], "name string"), spark.createDataFrame([(key,), ("erlang",)], "key string"), profile)
        own = adapter.join(table(spark, d, "part").where(F.col("p_size") % 4 == k).agg(F.count(F.lit(1)).alias("n")), F.lit(True))
        out = own if out is None else out.unionByName(own)
    return out.where("n > 0")


@query("SELECT path FROM v1 WHERE path NOT IN (SELECT path FROM v0)", "v0 v1")
def untracked_scan(spark, d):
    """S3."""
    from ..sources.scans import untracked_sources

    return untracked_sources(V.v1(spark, d), V.v0(spark, d)).select("path")


@query("SELECT CASE WHEN doc_id % 3 = 0 THEN path || '.spec.json' WHEN doc_id % 3 = 1 THEN path || '.info.json' ELSE path END AS path FROM files WHERE doc_id % 3 = 2", "files")
def artifact_scan(spark, d):
    """Artifacts without the documents beside them."""
    from ..sources.scans import artifacts

    end = F.when(F.col("doc_id") % 3 == 0, ".spec.json").when(F.col("doc_id") % 3 == 1, ".info.json").otherwise("")
    return artifacts(V.files(spark, d).select(F.concat("path", end).alias("path")))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS INT) END AS k FROM events")
def json_fallback(spark, d):
    """Every fifth document is malformed."""
    from ..sources.scans import json_or

    text = F.when(F.col("event_id") % 5 == 0, "{").otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", json_or(text, "k int", F.struct(F.lit(-1).alias("k")))["k"].alias("k"))


@query("SELECT 'p' || p_partkey AS name, CAST(p_size AS VARCHAR) AS version FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 = 0")
def unlocked_packages(spark, d):
    """A lockfile a part; packages of parts divisible by three are in them, those divisible by seven are installed."""
    from ..sources.scans import lockfile_packages
    from ..sources.scans import unlocked_packages as unlocked

    part = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("string").alias("version"), "p_partkey")
    text = F.concat(F.lit('{// lock\n"packages": {"'), "name", F.lit('@x": {"version": "'), "version", F.lit('",},},}'))
    locked = lockfile_packages(part.where("p_partkey % 3 = 0").select("name", text.alias("text")).withColumnRenamed("name", "path"))
    return unlocked(part.where("p_partkey % 7 = 0").select("name", "version"), locked)


@query("SELECT lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '-d' || doc_id || '.md' AS name FROM documents WHERE doc_id % 4 = 0")
def knowledge_documents(spark, d):
    """Markdown documents whose digest is the recorded one; the others' extension or digest is wrong."""
    from ..sources.scans import knowledge_documents as known

    end = F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("k/d"), F.col("doc_id").cast("string"), end).alias("path"), "text")
    want = docs.select((F.col("doc_id") % 1000).alias("ord"), "path", F.when(F.col("doc_id") % 4 == 2, "0").otherwise(F.sha2("text", 256)).alias("sha256"))
    return known(docs, want)[0].select("name")


@query("SELECT 'm' || p_partkey || '.py' AS path, unnest(['f' || p_partkey, 'g']) AS name, unnest([1, 2]) AS line_start, unnest([3, 3]) AS line_end FROM part WHERE p_partkey % 5 <> 0")
def span_extraction(spark, d):
    """A Python file a part; every fifth doesn't parse and fails closed."""
    from ..sources.spans import function_spans

    key = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_partkey") % 5 == 0, "def (").otherwise(F.concat(F.lit("def f"), key, F.lit("():\n    def g():\n        pass\n")))
    return function_spans(table(spark, d, "part").select(F.concat(F.lit("m"), key, F.lit(".py")).alias("path"), text.alias("text"), F.lit("python").alias("language"))).select("path", "name", "line_start", "line_end")


@query("SELECT 'm' || p_partkey || '.ets' AS path, 'f' || p_partkey AS name, 1 AS line_start, 3 AS line_end FROM part WHERE p_partkey % 5 <> 0")
def span_extraction_braces(spark, d):
    """A file with braces a part; every fifth has one too many."""
    from ..sources.spans import function_spans

    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("function f"), key, F.lit("(a: number): void {\n  // }\n}"), F.when(F.col("p_partkey") % 5 == 0, "}").otherwise(""))
    return function_spans(table(spark, d, "part").select(F.concat(F.lit("m"), key, F.lit(".ets")).alias("path"), text.alias("text"), F.lit("arkts").alias("language"))).select("path", "name", "line_start", "line_end")


@query(f"SELECT k AS ordinal, [{_PHASES}][k] AS phase, [{_PHASES}][k + 1] AS next FROM range(1, 10) t(k)")
def phase_order(spark, d):
    """P19."""
    phase = F.element_at(F.array(*map(F.lit, FULL_PHASES)), F.col("id").cast("int"))
    return spark.range(1, 10).select(S.ordinal(FULL_PHASES, phase).alias("ordinal"), phase.alias("phase"), S.next_of(FULL_PHASES, phase).alias("next"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'explicit' WHEN p_size % 2 = 0 THEN 'saved' ELSE 'default' END AS retries, 'default' AS caps FROM part")
def config_merge(spark, d):
    """P20: keys that have no default are dropped."""
    m = lambda *kv: F.create_map(*map(F.lit, kv))
    none = F.lit(None).cast("map<string,string>")
    merged = S.merged_config(m("retries", "default", "caps", "default"), F.when(F.col("p_size") % 2 == 0, m("retries", "saved", "zz", "x")).otherwise(none), F.when(F.col("p_size") % 3 == 0, m("retries", "explicit")).otherwise(none))
    return table(spark, d, "part").select("p_partkey", merged["retries"].alias("retries"), merged["caps"].alias("caps"))


@query("SELECT count(DISTINCT p_brand || ':' || p_size % 7) AS fingerprints, count(*) AS n FROM part")
def fingerprints(spark, d):
    """As many fingerprints as combinations of what decides; operational keys and the order of scopes don't count."""
    config = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("workers"), F.col("p_partkey").cast("string"))
    size = (F.col("p_size") % 7).cast("string")
    scope = F.when(F.col("p_partkey") % 2 == 0, F.array(size, F.lit("x"))).otherwise(F.array(F.lit("x"), size, F.lit("x")))
    own = S.fingerprint(config, ["workers"], F.lit(False), scope, F.lit("e"), F.array().cast("array<string>"))
    return table(spark, d, "part").select(own.alias("f")).agg(F.countDistinct("f").alias("fingerprints"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, least(7200, greatest(600, o_orderkey % 10000)) AS ttl, o_orderkey % 3 = 0 OR o_orderkey % 5000 > least(7200, greatest(600, o_orderkey % 10000)) AS takeover FROM orders")
def lock_takeover(spark, d):
    """P21 T9."""
    orders, key = table(spark, d, "orders"), F.col("o_orderkey")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    written = F.date_format(now - F.make_dt_interval(secs=key % 5000), "yyyy-MM-dd'T'HH:mm:ss")
    status, lease = F.when(key % 3 == 0, "failed").otherwise("running"), key % 10000
    return orders.select("o_orderkey", S.lease_seconds(F.lit(7200), F.lit(600), lease).alias("ttl"), L.lock_takeover(status, written, now, F.lit(7200), F.lit(600), lease).alias("takeover"))


# ---- documents and validators -----------------------------------------------------------------------------------------------


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'fields differ: unsupported fields: z' WHEN 2 THEN 'fields differ: missing fields: pre_condition' WHEN 3 THEN 'blank or non-text field' WHEN 4 THEN 'oracle marker in the contract' ELSE 'not a JSON object' END AS reason FROM events"""
)
def spec_validation(spark, d):
    """F5."""
    good = '{"signature": "f", "pre_condition": "x", "post_condition": "y"%s}'
    texts = [good % "", good % ', "z": 1', '{"signature": "f", "post_condition": "y"}', good.replace('"f"', '" "') % "", good.replace('"y"', '"TODO: y"') % "", "[1]"]
    return table(spark, d, "events").select("event_id", P.spec_check(F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 6 + 1).cast("int")))["reason"].alias("reason"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 1 THEN 'y' || chr(10) || 'Error behavior: fails ' || user_id ELSE 'y' END AS post_condition, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'error_behavior' ELSE '' END AS removed FROM events")
def spec_canonical(spark, d):
    """An error behaviour is appended; a document without a signature has no canonical form."""
    text = F.when(F.col("event_id") % 3 == 0, '{"signature": "f", "pre_condition": "x", "post_condition": "y"}').when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"signature": "f", "pre_condition": "x", "post_condition": "y  ", "error_behavior": " fails '), F.col("user_id").cast("string"), F.lit('"}'))).otherwise('{"pre_condition": "x"}')
    out = S.spec_canonical(text)
    return table(spark, d, "events").select("event_id", out["spec"]["post_condition"].alias("post_condition"), F.array_join(out["removed"], ",").alias("removed"))


@query("SELECT event_id, event_id % 4 IN (0, 3) AS valid, CASE event_id % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'h' WHEN 3 THEN '' END AS names FROM events")
def callee_documents(spark, d):
    """A name falls back to the id; one bad element spoils the list."""
    one = '{"callees": [{"%s": "%s", "signature": "s", "pre_condition": "p", "post_condition": "q"}%s]}'
    texts = [one % ("name", "g", ""), one % ("id", "h", ""), one % ("name", "g", ', {"name": 3}'), '{"callees": []}']
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", P.info_check(text).alias("valid"), F.array_join(F.transform(S.callees_canonical(text), lambda c: c["name"]), ",").alias("names"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'job id' WHEN 2 THEN 'outputs differ from the required ones' WHEN 3 THEN 'verdict' ELSE 'unsupported keys: extra' END AS reason FROM events")
def receipt_validation(spark, d):
    """F13."""
    job = F.col("user_id").cast("string")
    ends = ['"outputs": ["a", "b"]}', '"outputs": ["a", "b"]}', '"outputs": ["b", "a"]}', '"outputs": ["a", "b"], "verdict": "NO"}', '"outputs": ["a", "b"], "extra": 1}']
    own = F.concat(F.lit('{"job_id": "'), F.when(F.col("event_id") % 5 == 1, "other").otherwise(job), F.lit('", "status": "done", '), F.element_at(F.array(*map(F.lit, ends)), (F.col("event_id") % 5 + 1).cast("int")))
    check = P.receipt_check(own, job, F.lit("spec_batch"), F.array(F.lit("a"), F.lit("b")))
    return table(spark, d, "events").select("event_id", check["reason"].alias("reason"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'post-conditions missing or changed' WHEN 2 THEN CASE WHEN length(text) > 8000 OR trim(text) = '' THEN 'mismatch without counterexample, statements and reason' ELSE '' END
      WHEN 3 THEN 'statements are no quote of the source' ELSE 'no structured reasoning' END AS reason FROM documents"""
)
def reasoning_validation(spark, d):
    """F8: the document is the source; a mismatch has to quote it."""
    k = F.col("doc_id") % 5
    text = F.lit(None).cast("string")
    r = F.when(k == 4, None).otherwise(F.struct(F.lit("a").alias("actual_postcondition"), F.when(k == 1, "other").otherwise("post").alias("spec_postcondition"), F.when(k >= 2, "cx").otherwise(text).alias("counterexample"), F.when(k == 2, F.col("text")).when(k == 3, F.concat(F.lit("zz\0zz"), F.left("text", F.lit(20)))).otherwise(text).alias("offending_statements"), F.lit("r").alias("reason")))
    return table(spark, d, "documents").select("doc_id", P.reasoning_check(r, F.lit("post"), F.col("text"), k >= 2)["reason"].alias("reason"))


@query("SELECT event_id, event_id % 4 = 0 AS safe, event_id % 3 <> 0 AS identifier FROM events")
def path_and_identifier(spark, d):
    """F11 F12."""
    paths = F.element_at(F.array(F.lit("out/a..b/c"), F.lit("/a"), F.lit("a/../b"), F.lit("../a")), (F.col("event_id") % 4 + 1).cast("int"))
    name = F.concat(F.when(F.col("event_id") % 3 == 0, "-").otherwise(""), F.col("user_id").cast("string"), F.lit("_a.b"))
    return table(spark, d, "events").select("event_id", P.is_safe_path(paths).alias("safe"), P.is_identifier(name).alias("identifier"))


@query("SELECT event_id, event_id % 4 IN (0, 2) AS risk_ok, event_id % 3 = 0 AS reproduction_ok, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'classification differs from the result''s' ELSE 'evidence path' END AS attempt FROM events")
def evidence_validation(spark, d):
    """F9 F10 F16."""
    k4, k3 = F.col("event_id") % 4, F.col("event_id") % 3
    callees = F.when(k4 == 0, F.array(F.lit("g"))).when(k4 == 1, F.array(F.lit("f"))).when(k4 == 2, F.array(F.lit("g"), F.lit("h"))).otherwise(F.array(F.lit("zz")))
    risk = P.dependency_check(callees, F.lit("f"), F.array(*map(F.lit, "fgh")))
    pair = P.reproduction_check(F.when(k3 == 0, "completed").otherwise("unsupported"), F.lit("confirmed"))
    attempt = P.dynamic_attempt_check(F.lit("confirmed"), F.when(k3 == 2, "/abs").otherwise("probes/1.json"), F.lit("s"), F.lit("completed"), F.when(k3 == 0, "confirmed").otherwise("inconclusive"), F.lit("s"))
    return table(spark, d, "events").select("event_id", risk.alias("risk_ok"), pair.alias("reproduction_ok"), attempt["reason"].alias("attempt"))


# ---- joins, plans, sets -----------------------------------------------------------------------------------------------------


@query("SELECT path AS artifact, CASE WHEN doc_id % 6 <> 0 THEN 'id' || doc_id END AS function_id FROM files", "files")
def manifest_index(spark, d):
    """Every sixth artifact has no manifest row."""
    rows = V.files(spark, d).select(F.col("path").alias("artifact"), "doc_id")
    manifest = rows.where("doc_id % 6 <> 0").select("artifact", F.concat(F.lit("id"), F.col("doc_id").cast("string")).alias("function_id"), F.lit("s").alias("source_path"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"))
    good, bad = J.manifest_index(rows.select("artifact"), manifest)
    return good.select("artifact", "function_id").unionByName(bad.withColumn("function_id", F.lit(None).cast("string")))


@query("SELECT CAST(substr(source, 4) AS INT) % 4 AS phase, count(*) AS functions FROM files GROUP BY 1", "files")
def phase_functions(spark, d):
    """A phase's modules name its source files."""
    rows = V.files(spark, d)
    phase = (F.substr("source", F.lit(4)).cast("int") % 4).alias("phase")
    plan = rows.groupBy(phase, "source").agg(F.collect_set("path").alias("source_files")).groupBy("phase").agg(F.collect_list(F.struct(F.col("source").alias("name"), "source_files")).alias("modules"))
    return J.phase_functions(plan, rows.select(F.col("doc_id").alias("id"), "path")).groupBy("phase").agg(F.count(F.lit(1)).alias("functions"))


@query(
    """WITH n AS (SELECT caller AS a, callee AS b FROM edge_sparse UNION SELECT callee, caller FROM edge_sparse), j AS (SELECT p_partkey AS job_id FROM part WHERE p_partkey % 50 = 0)
    SELECT job_id, 'a' || job_id AS path FROM j WHERE job_id % 4 <> 0 UNION SELECT job_id, 'a' || b FROM j JOIN n ON a = job_id WHERE b % 4 <> 0 UNION SELECT job_id, 'ctx' FROM j""",
    "edge_sparse",
)
def read_sets(spark, d):
    """Artifacts of parts divisible by four don't exist."""
    part = table(spark, d, "part").select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("artifact"), F.col("p_partkey").alias("id"), F.lit("gone").alias("path"))
    jobs = part.where("id % 50 = 0").select(F.col("id").alias("job_id"), F.array("artifact").alias("artifacts"))
    have = part.where("id % 4 <> 0").select(F.col("artifact").alias("path")).unionByName(spark.createDataFrame([("ctx",)], "path string"))
    return J.read_sets(jobs, part, V.edge_sparse(spark, d), have, ("ctx",))


@query("SELECT CAST(doc_id AS VARCHAR) AS artifact, CASE WHEN doc_id % 9 = 0 THEN 'no job owns the planned artifact' ELSE 'owned artifact isn''t planned' END AS reason FROM documents WHERE doc_id % 9 = 0 OR doc_id % 9 = 4")
def plan_violations(spark, d):
    """J10."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("artifact"))
    plan = docs.where("doc_id % 9 <> 4").select(F.col("source").alias("job_id"), F.lit("p").alias("phase"), F.lit("t").alias("type"), "artifact")
    jobs = docs.where("doc_id % 9 <> 0").groupBy(F.col("source").alias("job_id")).agg(F.collect_list("artifact").alias("artifacts")).select("job_id", F.lit("p").alias("phase"), F.lit("t").alias("type"), "artifacts")
    return J.plan_violations(plan, jobs).select("artifact", "reason")


@query("SELECT path AS artifact, CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id END AS result FROM files", "files")
def result_join(spark, d):
    """Results lie at the artifact's path with another suffix."""
    rows = V.files(spark, d)
    results = rows.where("doc_id % 2 = 0").select(F.regexp_replace("path", r"\.txt$", ".json").alias("path"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("result"))
    return J.results_of(rows.select(F.col("path").alias("artifact")), results).select("artifact", "result")


@query("SELECT callee AS job_id, CASE WHEN q.p_partkey IS NULL OR q.p_size % 2 <> 0 THEN 1 ELSE 0 END AS unsatisfied FROM edge LEFT JOIN (SELECT p_partkey, p_size FROM part WHERE p_partkey % 11 <> 0) q ON q.p_partkey = caller", "edge")
def unsatisfied_dependencies(spark, d):
    """A part depends on its parent; parents divisible by eleven are missing."""
    jobs = table(spark, d, "part").where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("job_id"), F.when(F.col("p_size") % 2 == 0, "succeeded").otherwise("running").alias("status"))
    return J.unsatisfied(V.edge(spark, d).select(F.col("callee").alias("job_id"), F.col("caller").alias("depends_on")), jobs)


@query("SELECT doc_id AS job_id FROM documents WHERE doc_id % 4 = 1")
def unique_outputs(spark, d):
    """Jobs of one output that exactly one report matches."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.col("doc_id").cast("string").alias("p"))
    outputs = F.when(F.col("job_id") % 4 == 3, F.array("p", F.lit("x"))).otherwise(F.array("p"))
    reports = docs.where("job_id % 4 <> 0").withColumn("n", F.explode(F.when(F.col("job_id") % 4 == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select(F.col("p").alias("path"))
    return J.unique_output_match(docs.select("job_id", outputs.alias("required_outputs")), reports).select("job_id")


@query("SELECT a.path, 'kept' AS side FROM v0 a JOIN v1 b ON a.path = b.path AND a.sha256 = b.sha256", "v0 v1")
def preserve_restore(spark, d):
    """Sidecars of unchanged files whose artifact still exists."""
    old, new = V.v0(spark, d), V.v1(spark, d)
    changed = D.inventory_delta(old, new).where("change = 'changed'")
    kept = D.preserved_sidecars(old.select("path", F.col("path").alias("artifact")), changed)
    return D.restored_sidecars(kept, new.select(F.col("path").alias("artifact"))).select("path", F.lit("kept").alias("side"))


@query("SELECT DISTINCT path AS artifact FROM (SELECT path FROM v0 UNION SELECT path FROM v1)", "v0 v1")
def applied_union(spark, d):
    """D7."""
    a = lambda v: v.select(F.col("path").alias("artifact"))
    return D.applied_union(a(V.v0(spark, d)), a(V.v1(spark, d)))


@query("SELECT coalesce(b.path, a.path) AS artifact, coalesce(b.sha256, a.sha256) AS sha256 FROM v0 a FULL JOIN v1 b ON a.path = b.path", "v0 v1")
def plan_apply(spark, d):
    """No violation, so all updates are applied."""
    a = lambda v: v.select(F.col("path").alias("artifact"), "sha256")
    old = a(V.v0(spark, d))
    return D.apply_plan(old, a(V.v1(spark, d)), old.limit(0))


@query("SELECT a.path, array_to_string(list_filter([CASE WHEN a.sha256 <> b.sha256 THEN 'sha256' END, CASE WHEN a.size <> b.size THEN 'size' END], lambda x: x IS NOT NULL), ',') AS differences FROM v0 a JOIN v1 b ON a.path = b.path", "v0 v1")
def resume_differences(spark, d):
    """D10 E5."""
    old, new = V.v0(spark, d), V.v1(spark, d).select("path", F.col("sha256").alias("h"), F.col("size").alias("s"))
    both = old.join(new, "path")
    return both.select("path", F.array_join(D.resume_differences({"sha256": F.col("sha256"), "size": F.col("size")}, {"sha256": F.col("h"), "size": F.col("s")}), ",").alias("differences"))


@query("SELECT p_partkey AS function_id, CASE WHEN p_partkey % 8 = 0 THEN 'missing' WHEN p_partkey % 8 = 1 THEN 'repeated' WHEN p_partkey % 8 = 2 THEN 'other phase' ELSE 'unknown' END AS reason FROM part WHERE p_partkey % 8 < 4")
def coverage_violations(spark, d):
    """D6."""
    part, k = table(spark, d, "part"), F.col("p_partkey") % 8
    assigned = part.where(k != 0).select(F.col("p_partkey").alias("function_id"), F.when(k == 2, 9).otherwise(1).alias("phase"), F.explode(F.when(k == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return D.coverage_violations(assigned.select("function_id", "phase"), part.where(k != 3).select(F.col("p_partkey").alias("function_id"), F.lit(1).alias("phase")))


@query("SELECT source, n, n + 1 AS stored FROM (SELECT source, count(*) AS n FROM verdicts WHERE verdict = 'MISMATCH' GROUP BY source) WHERE CAST(substr(source, 4) AS INT) % 2 = 1", "verdicts")
def summary_consistency(spark, d):
    """Every other source's stored summary is wrong."""
    reports = V.verdicts(spark, d).where("verdict = 'MISMATCH'").withColumn("confirmation_status", F.lit("confirmed"))
    stored = A.bug_summary(reports, "source").withColumn("candidates", F.col("candidates") + F.substr("source", F.lit(4)).cast("int") % 2)
    return A.summary_differences(stored, reports, "source").select("source", F.col("candidates__").alias("n"), F.col("candidates").alias("stored"))


@query("SELECT count(*) FILTER (WHERE i) AS included, count(*) FILTER (WHERE NOT i) AS excluded, (SELECT count(*) FROM v0 WHERE path NOT IN (SELECT path FROM v1)) AS removed FROM (SELECT doc_id % 3 = 0 AS i FROM documents)", "v0 v1")
def selection_summary(spark, d):
    """A18."""
    removed = D.inventory_delta(V.v0(spark, d), V.v1(spark, d)).where("change = 'removed'")
    return A.selection_summary(table(spark, d, "documents").select((F.col("doc_id") % 3 == 0).alias("included")), removed)


# ---- job graph, chains, gates -----------------------------------------------------------------------------------------------


@query("SELECT 'v' || p_partkey AS job_id, 's' || p_brand AS dep FROM part WHERE p_partkey % 2 = 0")
def verification_jobs(spark, d):
    """A specification job a brand owns the even parts."""
    part = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("artifact"), "p_partkey", "p_brand")
    spec = part.where("p_partkey % 2 = 0").groupBy(F.concat(F.lit("s"), "p_brand").alias("job_id")).agg(F.collect_list("artifact").alias("artifacts"))
    verify = part.select(F.concat(F.lit("v"), "artifact").alias("job_id"), F.array("artifact").alias("artifacts"))
    return G.verification_jobs(verify, spec).select("job_id", F.explode("depends_on").alias("dep"))


@query("SELECT k AS ordinal, CASE WHEN k = 1 THEN '' ELSE CAST(k - 1 AS VARCHAR) END AS depends_on FROM (SELECT row_number() OVER (ORDER BY r_regionkey) AS k FROM region WHERE r_regionkey <> 2)")
def phase_resolution(spark, d):
    """One phase is empty; each names the one before by name and itself."""
    rows = table(spark, d, "region").select(F.col("r_regionkey").alias("phase"), F.concat(F.lit("id"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") == 2, F.array().cast("array<string>")).otherwise(F.array("r_name")).alias("files"))
    before = F.lag("name").over(Window.orderBy("phase"))
    filled = F.lag(F.when(F.size("files") > 0, F.col("name"))).over(Window.orderBy("phase"))
    plan = rows.withColumn("depends_on", F.array_compact(F.array(F.coalesce(filled, F.when(F.col("phase") == 3, F.lit("phase-1")), before), "name")))
    return G.resolve_phases(plan, G.phase_aliases(plan)).select(F.col("ordinal").cast("long").alias("ordinal"), F.array_join(F.col("depends_on").cast("array<string>"), ",").alias("depends_on"))


@query(
    """WITH r AS (SELECT n_nationkey AS k, n_regionkey AS phase, n_nationkey % 4 <> 0 AS done FROM nation) SELECT 'p' || phase AS phase, 'c' || max(k) AS checkpoint_id FROM r WHERE done AND k % 2 = 1 GROUP BY phase"""
)
def checkpoint_ancestry(spark, d):
    """Odd nations form a chain from the last one back."""
    rows = table(spark, d, "nation").where("n_nationkey % 2 = 1")
    cid = lambda k: F.concat(F.lit("c"), k.cast("string"))
    chain = rows.select(cid(F.col("n_nationkey")).alias("checkpoint_id"), F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("phase"), F.when(F.col("n_nationkey") % 4 != 0, "complete").otherwise("committing").alias("status"), F.when(F.col("n_nationkey") > 1, cid(F.col("n_nationkey") - 2)).alias("previous_checkpoint_id"))
    return R.latest_complete_by_phase(chain, "c23")


@query("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 7 OFFSET 5")
def job_page(spark, d):
    """The limit is the feature."""
    return R.page(table(spark, d, "part").select("p_partkey"), "p_partkey", 7, 5)


@query("SELECT source, array_to_string(list_slice(list_sort(list(DISTINCT doc_id)), 1, 3), ',') AS first FROM documents GROUP BY source")
def first_errors(spark, d):
    """The first three of each source."""
    return R.first_n(table(spark, d, "documents"), "source", "doc_id", 3).select("source", F.array_join(F.col("first").cast("array<string>"), ",").alias("first"))


@query("SELECT source, CASE WHEN n < 3 THEN 'no phase plan' WHEN n % 2 = 0 THEN 'other range or configuration' WHEN n % 3 = 0 THEN 'baseline reference differs' ELSE '' END AS reason FROM (SELECT source, count(*) FILTER (WHERE lang = 'en') AS n FROM documents GROUP BY source)")
def baseline_validity(spark, d):
    """E2."""
    rows = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("n"))
    n, yes = F.col("n"), F.lit(True)
    check = gates.baseline_check(n >= 3, F.lit("f"), F.when(n % 2 == 0, "g").otherwise("f"), F.lit("c"), yes, F.when(n % 3 == 0, "d").otherwise("c"), n, yes, yes, F.lit("t"))
    return rows.select("source", check["reason"].alias("reason"))


@query("SELECT job_id, array_to_string(list_slice(list_sort(list('j' || event_id) FILTER (WHERE status = 'failed')), 1, 8), '; ') AS message FROM log GROUP BY job_id HAVING count(*) FILTER (WHERE status = 'failed') > 0 UNION ALL SELECT job_id, 'phase failed' FROM log GROUP BY job_id HAVING count(*) FILTER (WHERE status = 'failed') = 0", "log")
def failure_messages(spark, d):
    """E6."""
    failed = F.collect_list(F.when(F.col("status") == "failed", F.concat(F.lit("j"), F.col("event_id").cast("string"))))
    rows = V.log(spark, d).groupBy("job_id").agg(failed.alias("failed"))
    none = F.lit(None).cast("string")
    return rows.select("job_id", gates.failure_message(none, F.col("failed"), none).alias("message"))


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id % 9 = 4) = 0 AS ok, CASE WHEN (SELECT count(*) FROM documents WHERE doc_id % 9 = 4) = 0 THEN '' ELSE 'plan' END AS reason, CASE WHEN (SELECT count(*) FROM documents WHERE doc_id % 9 = 4) = 0 THEN 'ready' ELSE 'invalid' END AS class")
def phase_gate(spark, d):
    """Of two rules the lesser one is violated."""
    docs = table(spark, d, "documents").where("doc_id % 9 = 4")
    return gates.phase_gate(docs.select(F.lit(2).alias("rule_no"), F.lit("results").alias("reason")), docs.select(F.lit(1).alias("rule_no"), F.lit("plan").alias("reason")))


@query(f"SELECT k AS rule_no, 'unfinished: ' || [{_PHASES}][k] AS reason FROM range(1, 6) t(k) WHERE k NOT IN (SELECT r_regionkey + 1 FROM region WHERE r_regionkey % 2 = 0)")
def phase_ordering(spark, d):
    """Specification can't start before the phases in front of it."""
    done = table(spark, d, "region").where("r_regionkey % 2 = 0").select(F.element_at(F.array(*map(F.lit, FULL_PHASES)), (F.col("r_regionkey") + 1).cast("int")).alias("phase"), F.lit("succeeded").alias("status"))
    return gates.order_violations(done, FULL_PHASES, "specification")


@query(
    """SELECT event_id, CASE status WHEN 'queued' THEN 'start' WHEN 'retryable' THEN 'retry' WHEN 'running' THEN CASE WHEN event_id % 7 = 0 THEN 'prepare' WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'execute' ELSE 'run_dynamic' END
        WHEN event_id % 2 = 0 THEN 'submit_execution' WHEN event_id % 5 = 0 THEN 'finalize' ELSE 'submit_finalization' END ELSE 'terminal' END AS action,
      CASE WHEN status <> 'running' OR event_id % 5 = 0 THEN 'approve' ELSE 'block' END AS stop FROM log""",
    "log",
)
def next_actions(spark, d):
    """T10 T12."""
    status, k = F.col("status"), F.col("event_id")
    action = L.probe_action(status, k % 7 != 0, k % 3 != 0, k % 2 == 0, k % 5 != 0)
    return V.log(spark, d).select("event_id", action.alias("action"), L.stop_decision(status, F.lit("verification"), F.when(k % 5 == 0, "phase_failed").otherwise("wait")).alias("stop"))


@query("SELECT job_id, 'c' || max(event_id) AS checkpoint_id, count(*) FILTER (WHERE status = 'failed') AS n_failed, (list('r' || event_id ORDER BY ts DESC))[1] AS receipt_reason FROM log GROUP BY job_id", "log")
def diagnosis(spark, d):
    """E7."""
    log = V.log(spark, d).withColumnRenamed("job_id", "run_id")
    text = lambda p: F.concat(F.lit(p), F.col("event_id").cast("string"))
    runs = log.select("run_id").distinct()
    points = log.select("run_id", text("c").alias("checkpoint_id"), F.col("event_id").alias("ordinal"), F.lit("complete").alias("status"))
    said = log.select("run_id", text("r").alias("reason"), F.col("ts").alias("received_at"))
    return gates.diagnosis(runs, said, points, log).select(F.col("run_id").alias("job_id"), "checkpoint_id", "n_failed", "receipt_reason")


@query("SELECT path, sha256 FROM v1", "v1")
def checkpoint_restore(spark, d):
    """Two checkpoints are published; the later one is rebuilt from its inventory and the object store."""
    from ..sources import store

    root = _folder(spark)
    store.publish(V.v0(spark, d).select("path", "text"), root, "c0", "extraction", 1, "s0")
    store.publish(V.v1(spark, d).select("path", "text"), root, "c1", "extraction", 2, "s1")
    return store.restore(spark, root).select("path", F.sha2("text", 256).alias("sha256"))


# ---- documents in folders, sinks --------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None) or G.local_folder(spark)
    return f"{top}/folder-{uuid.uuid4().hex}"


@query("SELECT 'f' || caller % 20 AS caller, 'f' || callee % 20 AS callee, count(*) AS edges FROM edge_sparse GROUP BY ALL", "edge_sparse")
def edge_documents(spark, d):
    """Edges as JSON documents, one a caller's group, read again from their folder."""
    from ..sources.scans import edge_documents as read

    name = lambda c: F.concat(F.lit("f"), (F.col(c) % 20).cast("string"))
    edge = F.struct(F.struct(name("caller").alias("fqn"), F.array().cast("array<string>").alias("callsite_names")).alias("caller"), F.struct(name("callee").alias("fqn"), F.array().cast("array<string>").alias("info_names")).alias("callee"), F.array(F.lit("e")).alias("evidence"), F.lit("s").alias("source"))
    path = _folder(spark)
    docs = V.edge_sparse(spark, d).groupBy((F.col("caller") % 20).alias("g")).agg(F.collect_list(edge).alias("edges"))
    docs.repartitionByRange(64, "g").select("edges").write.option("maxRecordsPerFile", 1).json(path)
    return read(spark, path).select(F.col("caller.fqn").alias("caller"), F.col("callee.fqn").alias("callee")).groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT (SELECT count(*) FROM part WHERE p_size % 3 < 2) AS nodes, (SELECT count(*) FROM lineitem WHERE l_linenumber IN (1, 2)) AS edges")
def graph_export(spark, d):
    """Functions and methods, calls and instantiations of a graph store's tables."""
    from ..sources.scans import graph_export as export

    kinds = F.array(F.lit("function"), F.lit("method"), F.lit("class"))
    nodes = table(spark, d, "part").select("p_partkey", F.element_at(kinds, F.col("p_size") % 3 + 1).alias("kind"))
    edges = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 1, "calls").when(F.col("l_linenumber") == 2, "instantiates").otherwise("imports").alias("kind"))
    a, b = export(nodes, edges)
    return a.agg(F.count(F.lit(1)).alias("nodes")).join(b.agg(F.count(F.lit(1)).alias("edges")), F.lit(True))


@query("SELECT job_id % 10 AS phase, status, 2 * count(*) AS jobs FROM log GROUP BY ALL", "log")
def log_and_progress(spark, d):
    """K1 K4 K5: a log appended to twice, and its summary written and read."""
    from ..sources import store

    path = _folder(spark)
    rows = V.log(spark, d).select((F.col("job_id") % 10).alias("phase"), "status")
    for _ in range(2):
        store.append_log(rows, f"{path}/log")
    store.progress(spark.read.parquet(f"{path}/log"), f"{path}/progress")
    return store.documents(spark, f"{path}/progress")


@query("SELECT '# Intent' || repeat(chr(10), 2) || '## Commits' || chr(10) || (SELECT string_agg('- c' || r_regionkey || ' ' || r_name, chr(10) ORDER BY r_regionkey) FROM region) || repeat(chr(10), 2) || '## Changes (' || count(*) || ')' || chr(10) || string_agg('- removed ' || path, chr(10) ORDER BY path) || repeat(chr(10), 2) || '## Note' || chr(10) || 'why' || chr(10) AS report FROM v0 WHERE path NOT IN (SELECT path FROM v1)", "v0 v1")
def intent_report(spark, d):
    """K6."""
    from ..sources import store

    commits = table(spark, d, "region").select(F.col("r_regionkey").alias("ord"), F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("subject"))
    return store.intent_report(commits, D.inventory_delta(V.v0(spark, d), V.v1(spark, d)).where("change = 'removed'"), "why")


@query("SELECT count(*) AS folders, sum(files) AS files, string_agg(lang, ',' ORDER BY lang) AS left_ FROM (SELECT lang, count(*) AS files FROM documents WHERE lang IS NOT NULL AND lang <> 'en' AND lang NOT LIKE 'f%' GROUP BY lang)")
def artifact_reset(spark, d):
    """K7: artifacts in a folder for each language; the reset names one and gives a pattern for others, and what stays is read."""
    from ..sources import store

    root = _folder(spark)
    table(spark, d, "documents").where("lang is not null").select("doc_id", "lang", F.col("lang").alias("folder")).write.partitionBy("folder").parquet(root)
    store.reset(spark, root, ("folder=en", "folder=f*", "folder=none"))
    per = spark.read.schema("doc_id long, lang string, folder string").parquet(root).groupBy("lang").agg(F.count(F.lit(1)).alias("files"))
    return per.agg(F.count(F.lit(1)).alias("folders"), F.sum("files").alias("files"), F.array_join(F.array_sort(F.collect_list("lang")), ",").alias("left_"))


@query("SELECT 'm' || p_partkey || '.c' AS path, 'f' || p_partkey AS name, 2 AS line_start, 4 AS line_end FROM part WHERE p_partkey % 3 = 0")
def span_extraction_compiler(spark, d):
    """A compiler's syntax tree a part; a third are included from elsewhere, a third have no body."""
    from ..sources.spans import compiler_spans, function_spans

    key, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    body = F.when(k == 2, "ParmVarDecl").otherwise("CompoundStmt")
    place = F.when(k == 1, '"includedFrom": {"file": "x.h"}, "line": 2').otherwise('"line": 2')
    tree = F.concat(F.lit('{"kind": "TranslationUnitDecl", "inner": [{"kind": "FunctionDecl", "name": "f'), key, F.lit('", "loc": {'), place, F.lit('}, "range": {"begin": {"offset": 1}, "end": {"line": 4}}, "inner": [{"kind": "'), body, F.lit('"}]}]}'))
    files = table(spark, d, "part").select(F.concat(F.lit("m"), key, F.lit(".c")).alias("path"), F.lit("\n\nint f(){\n}").alias("text"), F.lit("c").alias("language"), tree.alias("tree"))
    exported = compiler_spans(files.select("path", "text"), files.select("path", "tree"))
    return function_spans(files.select("path", "text", "language"), exported).select("path", "name", "line_start", "line_end")


from . import checks  # noqa: E402, F401  it registers its queries here
