"""Scalar expressions: names, identities, hashes, complexity, canonical forms. All are columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
BRANCHES = r"\b(if|else\s+if|for|while|case|catch|except|when)\b|&&|\|\||\?"
LANGUAGE_FACTORS = {".c": 1.10, ".cc": 1.15, ".cpp": 1.15, ".cxx": 1.15, ".h": 0.90, ".hpp": 0.90, ".java": 1.05, ".kt": 1.05, ".ets": 1.10, ".ts": 1.00, ".js": 0.95, ".py": 0.90, ".go": 1.00, ".rs": 1.10}
PUBLIC_INTERFACE_SUFFIXES = (".h", ".hh", ".hpp", ".hxx", ".inc", ".inl")


def suffix(path: Column) -> Column:
    """Lower-case suffix of the last path component with its dot; empty if there is none (a leading dot doesn't count)."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def clean_name(name: Column, default: str = "function") -> Column:
    """Runs of other characters become -, outer dots and dashes go, nothing left gives the default."""
    kept = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "-"), r"^[.-]+|[.-]+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def function_identity(units: DataFrame, path: str = "path", name: str = "name", order: str = "ord") -> DataFrame:
    """Adds function_id (path::name, with #k where the name repeats in its file) and artifact (dir/stem-name-index.ext)."""
    same = Window.partitionBy(path, name)
    nth = F.row_number().over(same.orderBy(order))
    count = F.count(F.lit(1)).over(same)
    place = F.row_number().over(Window.partitionBy(path).orderBy(order))
    base = F.concat(F.col(path), F.lit("::"), F.col(name))
    folder = F.regexp_extract(F.col(path), r"^(.*/)?[^/]*$", 1)
    last = F.regexp_replace(F.col(path), r"^.*/", "")
    stem = F.when(last.rlike(r"^.+\.[^.]+$"), F.regexp_replace(last, r"\.[^.]+$", "")).otherwise(last)
    tail = F.regexp_extract(last, r"^.+(\.[^.]+)$", 1)
    return units.withColumns({"function_id": F.when(count > 1, F.concat(base, F.lit("#"), nth)).otherwise(base), "artifact": F.concat(folder, stem, F.lit("-"), clean_name(F.col(name)), F.lit("-"), place, tail)})


def line_slice(text: Column, first: Column | int, last: Column | int) -> Column:
    """Lines first to last, from 1, joined by line feeds."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def qualified_name(identity: Column) -> Column:
    """a/b/f.ext::fn as a::b::f-ext::fn; anything without :: or a folder stays."""
    path, name = F.regexp_extract(identity, r"^(.*?)::(.*)$", 1), F.regexp_extract(identity, r"^(.*?)::(.*)$", 2)
    folder, last = F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    flat = F.concat(F.replace(folder, F.lit("/"), F.lit("::")), F.lit("::"), F.regexp_replace(last, r"\.([^.]*)$", "-$1"), F.lit("::"), name)
    return F.when(identity.contains("::") & path.contains("/"), flat).otherwise(identity)


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def joint_digest(values: Column) -> Column:
    """Digest of an array of strings whatever its order."""
    return F.sha2(F.array_join(F.array_sort(values), "\n"), 256)


def short_id(value: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(value, 256), 1, length)


def run_id(snapshot: Column, fingerprint: Column) -> Column:
    return F.substring(F.sha2(F.concat(snapshot, F.lit("\0"), fingerprint), 256), 1, 24)


def canonical_map(values: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def fingerprint(config: Column, operational: list[str], one_phase: Column, submodules: Column, edges: Column, knowledge: Column) -> Column:
    """Digest of what decides an analysis's results: the configuration (a map) without operational keys, scope and inputs' hashes."""
    meant = F.map_filter(config, lambda k, v: ~k.isin(*operational)) if operational else config
    return digest(F.to_json(F.struct(one_phase.alias("one_phase"), F.array_sort(F.array_distinct(submodules)).alias("submodules"), edges.alias("edges"), knowledge.alias("knowledge"), canonical_map(meant).alias("config"))))


def payload_digest(*parts: Column) -> Column:
    """Digest of the fields that say what a job is to do, in the given order."""
    return digest(F.to_json(F.struct(*(p.alias(f"p{k}") for k, p in enumerate(parts))), {"ignoreNullFields": "false"}))


def complexity_features(text: Column) -> dict[str, Column]:
    """source_lines, token_estimate, source_bytes and cyclomatic of a source text."""
    return {
        "source_lines": F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint"),
        "token_estimate": F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("bigint"),
        "source_bytes": F.octet_length(text).cast("bigint"),
        "cyclomatic": (F.lit(1) + F.regexp_count(text, F.lit(BRANCHES))).cast("bigint"),
    }


def complexity_score(tokens: Column, neighbors: Column, callee_specs: Column, cyclomatic: Column, lines: Column, suffix_: Column, seconds: Column) -> Column:
    """Work estimate of a function: size, graph and branches, times the language's factor (1.10 if unknown) and past seconds (300 at most)."""
    factor = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGE_FACTORS.items() for x in kv)), suffix_), F.lit(1.10))
    return F.ceil((tokens + neighbors * 80 + callee_specs * 120 + cyclomatic * 100 + lines * 2) * factor * (1.0 + F.least(seconds, F.lit(300.0)) / 1200.0)).cast("bigint")


def output_class(returncode: Column, output: Column) -> Column:
    """runtime_error for a failed run; confirmed or not_reproduced if exactly one marker begins a line; else inconclusive."""
    yes, no = output.rlike(r"(?m)^CONFIRMED(\s|$)"), output.rlike(r"(?m)^NOT CONFIRMED(\s|$)")
    return F.when(returncode != 0, "runtime_error").when(yes & ~no, "confirmed").when(no & ~yes, "not_reproduced").otherwise("inconclusive")


def tail(text: Column, n: int = 8000) -> Column:
    return F.right(text, F.lit(n))


def public_interfaces(paths: Column) -> Column:
    return F.filter(paths, lambda p: suffix(p).isin(*PUBLIC_INTERFACE_SUFFIXES))


def next_of(order: tuple[str, ...], current: Column) -> Column:
    """The element after current in a declared order, null after the last and for unknown ones."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in zip(order, order[1:]) for x in pair)), current)


def ordinal(order: tuple[str, ...], current: Column) -> Column:
    """Place of current in a declared order from 1, 0 if it isn't there."""
    return F.array_position(F.array(*map(F.lit, order)), current).cast("int")


def merged_config(defaults: Column, saved: Column, explicit: Column) -> Column:
    """Maps laid over each other; keys that defaults lack are dropped."""
    allow = lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: F.map_contains_key(defaults, k))
    kept = lambda m, over: F.map_filter(m, lambda k, v: ~F.map_contains_key(over, k))
    own, top = allow(saved), allow(explicit)
    low = F.map_concat(kept(defaults, own), own)
    return F.map_concat(kept(low, top), top)


def lease_seconds(ttl: Column, grace: Column, lease: Column) -> Column:
    return F.least(ttl, F.greatest(grace, lease))


def age_seconds(written: Column, now: Column) -> Column:
    """Seconds since a time written as text; infinite if it can't be read."""
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(written))).cast("double"), F.lit(float("inf")))


def spec_canonical(document: Column) -> Column:
    """struct(spec, removed): three fields of a JSON document, error_behavior appended to the post-condition unless it says so
    already; spec is null where the result isn't valid, removed has the keys that were left out."""
    from .predicates import spec_check

    field = lambda k: F.get_json_object(document, f"$.{k}")
    error, post = F.trim(field("error_behavior")), field("post_condition")
    adds = json_string(document, "error_behavior") & (error != "") & ~post.contains(error)
    full = F.when(F.coalesce(adds, F.lit(False)), F.concat(F.regexp_replace(post, r"\s+$", ""), F.lit("\nError behavior: "), error)).otherwise(post)
    spec = F.struct(field("signature").alias("signature"), field("pre_condition").alias("pre_condition"), full.alias("post_condition"))
    strings = json_string(document, "signature") & json_string(document, "pre_condition") & json_string(document, "post_condition")
    good = F.coalesce(strings & spec_check(F.to_json(spec))["ok"], F.lit(False))
    removed = F.array_sort(F.array_except(F.json_object_keys(document), F.array(*map(F.lit, ("signature", "pre_condition", "post_condition")))))
    return F.struct(F.when(good, spec).alias("spec"), F.when(good, removed).otherwise(F.array().cast("array<string>")).alias("removed"))


def callees_canonical(document: Column) -> Column:
    """Array of callees of a JSON document; name falls back to id; null if any element is wrong."""
    raw = F.from_json(F.get_json_object(document, "$.callees"), "array<string>")
    item = lambda x: F.struct(F.when(json_string(x, "name"), F.get_json_object(x, "$.name")).when(json_string(x, "id"), F.get_json_object(x, "$.id")).alias("name"), *(F.when(json_string(x, k), F.get_json_object(x, f"$.{k}")).alias(k) for k in ("signature", "pre_condition", "post_condition")))
    items = F.transform(raw, item)
    whole = F.forall(items, lambda c: c["name"].isNotNull() & c["signature"].isNotNull() & c["pre_condition"].isNotNull() & c["post_condition"].isNotNull())
    return F.when(whole, items)


def json_string(document: Column, key: str) -> Column:
    """Whether the JSON object has a string at key."""
    return F.coalesce(F.schema_of_variant(F.variant_get(F.try_parse_json(document), f"$.{key}", "variant")) == "STRING", F.lit(False))
