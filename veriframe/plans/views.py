"""Projections of the engine's tables onto the driver's: the same text in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

#: Common table expressions that queries' SQL builds on.
SQL = {
    "files": "files AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.txt' AS path, lang, source, text FROM documents)",
    "v0": "v0 AS (SELECT path, source, lang, text, sha256(text) AS sha256, strlen(text) AS size FROM files WHERE doc_id % 10 <> 0)",
    "v1": "v1 AS (SELECT path, source, lang, text, sha256(text) AS sha256, strlen(text) AS size FROM (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN text || ' v1' ELSE text END AS text) FROM files WHERE doc_id % 7 <> 0))",
    "units": "units AS (SELECT * FROM (SELECT path, doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files) WHERE trim(content) <> '')",
    "edge": "edge AS (SELECT CAST(floor((p_partkey - 1) / 2) AS BIGINT) AS caller, p_partkey AS callee FROM part WHERE p_partkey >= 1)",
    "edge_sparse": "edge_sparse AS (SELECT DISTINCT a AS caller, b AS callee FROM (SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS a, l_partkey AS b FROM lineitem) WHERE a <> b AND (a * 31 + b) % 40 = 0)",
    "log": "log AS (SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'queued' ELSE 'retryable' END AS status, CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' WHEN 'click' THEN 'retry' END AS action FROM events)",
    "verdicts": "verdicts AS (SELECT d.doc_id, d.source, d.lang, CASE WHEN l.doc_id IS NULL THEN 'INCONCLUSIVE' WHEN quality = 1 AND toxic = 0 THEN 'MATCH' WHEN quality = 0 AND toxic = 0 THEN 'MISMATCH' WHEN quality = 0 THEN 'DEPENDENCY_RISK' ELSE 'ERROR' END AS verdict, CASE d.doc_id % 5 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'normative' ELSE 'inferred' END AS basis FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)",
}
_NEEDS = {"v0": ["files"], "v1": ["files"], "units": ["files"]}


def with_views(names: str, query: str, recursive: bool = False) -> str:
    """query behind the named expressions and those that they need."""
    order: list[str] = []
    for name in names.split():
        for n in [*_NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    head = ",\n".join(SQL[n] for n in order)
    body = query.strip()
    joined = f"{head},\n{body[5:].lstrip()}" if head and body.upper().startswith("WITH ") else f"{head}\n{body}" if head else body
    if not head and body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {body[5:]}" if recursive else body
    return f"WITH {'RECURSIVE ' if recursive else ''}{joined}" if head else body


def files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", path.alias("path"), "lang", "source", "text")


def _version(rows: DataFrame) -> DataFrame:
    return rows.select("path", "source", "lang", "text", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


def v0(spark: SparkSession, d: str) -> DataFrame:
    return _version(files(spark, d).where("doc_id % 10 <> 0"))


def v1(spark: SparkSession, d: str) -> DataFrame:
    return _version(files(spark, d).where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" v1"))).otherwise(F.col("text"))))


def units(spark: SparkSession, d: str) -> DataFrame:
    lines = files(spark, d).select("path", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    return lines.where(F.trim("content") != "").select("path", "doc_id", "content", (F.col("pos") + 1).cast("long").alias("line"))


def edge(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").where(key >= 1).select(F.floor((key - 1) / 2).cast("long").alias("caller"), key.alias("callee"))


def edge_sparse(spark: SparkSession, d: str) -> DataFrame:
    over = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = table(spark, d, "lineitem").select(F.lag("l_partkey").over(over).alias("caller"), F.col("l_partkey").alias("callee"))
    return pairs.where("caller <> callee and (caller * 31 + callee) % 40 = 0").distinct()


def _mapped(column: Column, pairs: dict[str, str | None], other: str | None) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(other))


def log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = _mapped(kind, {"view": "running", "purchase": "succeeded", "error": "failed", "click": "queued"}, "retryable")
    action = _mapped(kind, {"view": "start", "purchase": "complete", "error": "fail", "click": "retry"}, None)
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), action.alias("action"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("l__"), "quality", "toxic")
    rows = table(spark, d, "documents").select("doc_id", "source", "lang").join(labels, F.col("doc_id") == F.col("l__"), "left")
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    verdict = F.when(F.col("l__").isNull(), "INCONCLUSIVE").when(good & ~bad, "MATCH").when(~good & ~bad, "MISMATCH").when(~good, "DEPENDENCY_RISK").otherwise("ERROR")
    basis = F.when(F.col("doc_id") % 5 == 0, "unavailable").when(F.col("doc_id") % 5 == 1, "normative").otherwise("inferred")
    return rows.select("doc_id", "source", "lang", verdict.alias("verdict"), basis.alias("basis"))
