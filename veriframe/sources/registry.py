"""The language registry as a table: the only part of the engine that is meant to be extended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import suffix
from ..schemas import SCHEMAS

_DEFAULT = "codegraph-then-tree-sitter"
_NODE = ("host-project-toolchain",)
# Key, name, extensions, grammar names, detectors, whether metadata is required, build and dynamic adapter, level.
LANGUAGES = [
    ("python", "Python", [".py"], ["python"], ["python"], f"{_DEFAULT}-then-python-ast", ".py", ["pyproject.toml", "setup.py", "setup.cfg"], False, "python", "python-packaging", None, "full"),
    ("javascript", "JavaScript", [".js", ".jsx", ".mjs", ".cjs"], ["javascript", "jsx"], ["javascript"], _DEFAULT, ".js", ["package.json"], False, "javascript", "node", None, "full"),
    ("typescript", "TypeScript", [".ts", ".tsx", ".mts", ".cts"], ["typescript", "tsx"], ["typescript", "tsx"], _DEFAULT, ".ts", ["tsconfig.json"], True, "typescript", "node-typescript", None, "full"),
    ("go", "Go", [".go"], ["go"], ["go"], _DEFAULT, ".go", ["go.mod"], True, "go", "go-modules", None, "full"),
    ("rust", "Rust", [".rs"], ["rust"], ["rust"], _DEFAULT, ".rs", ["Cargo.toml", "Cargo.lock"], True, "cargo", "cargo", None, "full"),
    ("java", "Java", [".java"], ["java"], ["java"], _DEFAULT, ".java", ["pom.xml", "build.gradle", "build.gradle.kts"], False, "java", None, None, "full"),
    ("c", "C", [".c"], ["c"], ["c"], f"{_DEFAULT}-then-clang-ast", ".c", ["CMakeLists.txt"], True, "cmake", None, None, "full"),
    ("cpp", "C++", [".cc", ".cpp", ".cxx", ".h", ".hpp"], ["cpp"], ["cpp"], f"{_DEFAULT}-then-clang-ast", ".cpp", ["CMakeLists.txt"], True, "cmake", None, None, "full"),
    ("cuda", "CUDA", [".cu", ".cuh"], ["cpp"], ["cpp"], _DEFAULT, ".cu", ["CMakeLists.txt"], True, None, None, None, "capability_plugin"),
    ("arkts", "ArkTS", [".ets"], [], [], "arkts-brace", ".ets", ["hvigorfile.ts", "build-profile.json5"], True, None, None, ("oh_modules", ["oh-package-lock.json5", "oh-package-lock.json"]), "full"),
    ("erlang", "Erlang", [".erl"], [], [], _DEFAULT, ".erl", ["rebar.config", "mix.exs"], True, None, None, None, "capability_plugin"),
]


def profiles(spark: SparkSession, languages: list = LANGUAGES) -> DataFrame:
    """Table language_profile, one row a language in order."""
    rows = [(k, key, name, ext, graph, tree, span, "structured-public-entrypoint", probe, found, need, build, dynamic, list(_NODE), hydrate, level) for k, (key, name, ext, graph, tree, span, probe, found, need, build, dynamic, hydrate, level) in enumerate(languages)]
    return spark.createDataFrame(rows, SCHEMAS["language_profile"])


def capability_matrix(profile: DataFrame) -> DataFrame:
    """One row for each language and extension."""
    return profile.select("key", "display_name", "support_level", "build_adapter", "dynamic_adapter", F.explode("extensions").alias("extension"))


def with_language(files: DataFrame, profile: DataFrame) -> DataFrame:
    """files (path) with their language's key, unknown if no profile has the extension. The registry is a declared short table."""
    names = profile.select(F.explode("extensions").alias("e__"), F.col("key").alias("k__"))
    return files.join(names, suffix(F.col("path")) == F.col("e__"), "left").withColumn("language", F.coalesce("k__", F.lit("unknown"))).drop("e__", "k__")


def build_adapter(present: DataFrame, languages: DataFrame, profile: DataFrame) -> DataFrame:
    """One row: the build adapter of the first profile in registry order that has one, whose language (key) occurs, and whose detectors
    are all among the present file names (name) unless it needs none; none if there is no such profile."""
    own = profile.where("build_adapter is not null").join(languages.select("key").distinct(), "key", "left_semi")
    hits = own.select("ord", "build_adapter", "requires_build_metadata", F.explode("build_detectors").alias("name")).join(present.select("name").distinct().withColumn("has", F.lit(True)), "name", "left")
    good = hits.groupBy("ord", "build_adapter", "requires_build_metadata").agg(F.min(F.coalesce("has", F.lit(False))).alias("all")).where("all or not requires_build_metadata")
    return good.agg(F.coalesce(F.min_by("build_adapter", "ord"), F.lit("none")).alias("adapter"))
