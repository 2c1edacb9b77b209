"""Scans: source trees, JSON documents and edge folders, knowledge documents, graph exports, lockfiles. Paths are read by Spark, so
any store that it can read will do."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import has_folder, in_scope, is_supported_source, is_test_path
from ..functions.scalars import suffix

# Folders that are never walked.
IGNORED_FOLDERS = (".git", ".hg", ".idea", ".svn", ".venv", ".vscode", "__pycache__", "build", "dist", "node_modules", "oh_modules", "target", "venv")
EXTENSIONS = (".c", ".cc", ".cjs", ".cpp", ".cts", ".cxx", ".ets", ".go", ".h", ".hpp", ".java", ".js", ".jsx", ".mjs", ".mts", ".py", ".rs", ".ts", ".tsx")
SIDECARS = (".spec.json", ".info.json")
GRAPH_EDGE_KINDS = ("calls", "instantiates")


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), text and size of all files below root. Text that isn't UTF-8 has replacement characters."""
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace(F.col("path"), r"^[a-z0-9+.-]+:/+", "/")
    cut = re.sub(r"^[a-z0-9+.-]+:/+", "/", base)
    return raw.select(F.when(plain.startswith(cut), F.substring(plain, len(cut) + 1, 2**31 - 1)).otherwise(plain).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("size"))


def production_sources(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, scopes: tuple[str, ...] = ()) -> DataFrame:
    """Files of known extensions outside ignored and test folders, in the scopes if there are any."""
    path = F.col("path")
    scope = F.array(*map(F.lit, scopes)) if scopes else F.array().cast("array<string>")
    return files.where(suffix(path).isin(*extensions) & ~has_folder(path, IGNORED_FOLDERS) & ~is_test_path(path) & in_scope(path, scope))


def changed_sources(previous: DataFrame, current: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path and change of supported production files that differ between two inventories (path, sha256)."""
    from ..operators.inventory import inventory_delta

    delta = inventory_delta(previous, current).where("change <> 'preserved'")
    return delta.where(is_supported_source(F.col("path"), extensions, IGNORED_FOLDERS))


def untracked_sources(files: DataFrame, tracked: DataFrame) -> DataFrame:
    return files.join(tracked.select("path"), "path", "left_anti")


def inventory_of(files: DataFrame, checkpoint_id: str = "") -> DataFrame:
    return files.select(F.lit(checkpoint_id).alias("checkpoint_id"), "path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


def artifacts(files: DataFrame) -> DataFrame:
    """Files but for the documents written beside artifacts."""
    path, out = F.col("path"), F.lit(True)
    for s in SIDECARS:
        out = out & ~path.endswith(s)
    return files.where(out)


def json_or(text: Column, schema: str, fallback: Column | None = None) -> Column:
    """A JSON document as a struct; fallback (null) where it's missing or malformed."""
    value = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad__"})
    good = F.try_parse_json(text).isNotNull()
    return F.when(good, value).otherwise(fallback if fallback is not None else F.lit(None))


def edge_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of all JSON documents below folder, each of which must hold an array edges; ord follows path and place."""
    schema = T.StructType().add("edges", T.ArrayType(T.StringType()))
    raw = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder).select("edges", F.col("_metadata.file_path").alias("file"))
    checked = raw.select("file", F.when(F.col("edges").isNull(), F.raise_error(F.concat(F.lit("no edges array in "), F.col("file")))).otherwise(F.col("edges")).alias("edges"))
    each = checked.select("file", F.posexplode("edges").alias("pos", "e"))
    edge = F.from_json("e", "caller struct<fqn:string, callsite_names:array<string>>, callee struct<fqn:string, info_names:array<string>>, evidence array<string>, source string")
    return each.select(F.concat_ws("\0", "file", F.lpad(F.col("pos").cast("string"), 10, "0")).alias("ord"), edge.alias("edge")).select("ord", "edge.*")


def graph_export(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions and methods of a graph store's node table, and its call and instantiation edges; from JDBC or files alike."""
    return nodes.where(F.col("kind").isin("function", "method")), edges.where(F.col("kind").isin(*GRAPH_EDGE_KINDS))


def jdbc_graph(spark: SparkSession, url: str, driver: str, nodes: str = "nodes", edges: str = "edges") -> tuple[DataFrame, DataFrame]:
    """graph_export over JDBC (the driver's jar has to be on the class path); the filters reach the database."""
    read = lambda t: spark.read.format("jdbc").options(url=url, driver=driver, dbtable=t).load()
    return graph_export(read(nodes), read(edges))


def knowledge_documents(files: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markdown files whose digest is the recorded one (expected: ord, path, sha256), with the name NNN-<clean name>; and the others."""
    from ..functions.scalars import clean_name

    md = expected.join(files.select("path", "text"), "path", "left").withColumn("is__", F.sha2("text", 256))
    good = F.lower("path").endswith(".md") & F.col("is__").eqNullSafe(F.col("sha256"))
    name = F.concat(F.lpad(F.col("ord").cast("string"), 3, "0"), F.lit("-"), clean_name(F.regexp_replace("path", r"^.*/", "")))
    return md.where(good).select(name.alias("name"), "path", "sha256", "text"), md.where(~good | good.isNull()).select("path", F.when(F.col("text").isNull(), "missing").when(~F.lower("path").endswith(".md"), "not Markdown").otherwise("digest differs").alias("reason"))


def relaxed_json(text: str):
    """JSON with comments and trailing commas; single quotes are refused. None where it can't be read."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif c == "'":
            return None
        elif text.startswith("//", i):
            i = n if (k := text.find("\n", i)) < 0 else k
        elif text.startswith("/*", i):
            if (k := text.find("*/", i + 2)) < 0:
                return None
            i = k + 2
        else:
            out.append(c)
            i += 1
    plain = "".join(out)
    # Commas before a closing bracket; strings are whole parts of out, so none of theirs is taken.
    kept: list[str] = []
    for part in out:
        if part in "]}" and len(part) == 1:
            k = len(kept) - 1
            while k >= 0 and kept[k].isspace():
                k -= 1
            if k >= 0 and kept[k] == ",":
                del kept[k]
        kept.append(part)
    try:
        return json.loads("".join(kept) if kept else plain)
    except ValueError:
        return None


def lockfile_packages(files: DataFrame) -> DataFrame:
    """Distinct path, name and version of the packages in lockfiles (path, text); unreadable files give none."""
    import pyarrow as pa

    def packages(value, name=None):
        if isinstance(value, dict):
            own = value.get("name") if isinstance(value.get("name"), str) else name
            if isinstance(value.get("version"), str) and isinstance(own, str):
                yield own, value["version"]
            for key, item in value.items():
                yield from packages(item, key.rsplit("@", 1)[0] if "@" in key[1:] else key)
        elif isinstance(value, list):
            for item in value:
                yield from packages(item)

    def run(batches):
        for batch in batches:
            rows = [(p, *x) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in dict.fromkeys(packages(relaxed_json(t or "")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["path", "name", "version"])

    return files.select("path", "text").mapInArrow(run, "path string, name string, version string").distinct()


def unlocked_packages(installed: DataFrame, locked: DataFrame) -> DataFrame:
    """Installed (name, version) that no lockfile has; has to be empty."""
    return installed.join(locked.select("name", "version"), ["name", "version"], "left_anti")
