"""Hand-computed cases of expressions and predicates, one row a rule."""

import json

import pytest
from pyspark.sql import functions as F

from veriframe.functions import predicates as P
from veriframe.functions import scalars as S


def values(spark, column, *rows, schema="a string"):
    return [r["v"] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).coalesce(1).select(column.alias("v")).collect()]


def test_test_paths(spark):
    assert values(spark, P.is_test_path(F.col("a")), "tests/a.py", "a/test_x.py", "a/x_test.go", "a/contest.py", "latest/a.py", "tests.py", "a/Testing/b.c") == [True, True, True, False, False, False, True]


def test_names_and_identities(spark):
    assert values(spark, S.clean_name(F.col("a")), "a b", "..x--", "???", "ok_1") == ["a-b", "x", "function", "ok_1"]
    assert values(spark, S.qualified_name(F.col("a")), "src/a/b.py::f", "b.py::f", "plain") == ["src::a::b-py::f", "b.py::f", "plain"]
    rows = spark.createDataFrame([("p.py", "f", 1), ("p.py", "g", 2), ("p.py", "f", 3)], "path string, name string, ord int")
    out = S.function_identity(rows).orderBy("ord").collect()
    assert [r["function_id"] for r in out] == ["p.py::f#1", "p.py::g", "p.py::f#2"]
    assert [r["artifact"] for r in out] == ["p-f-1.py", "p-g-2.py", "p-f-3.py"]
    assert values(spark, S.suffix(F.col("a")), "a/b.C", "a.x/b", "x.tar.gz", ".env") == [".c", "", ".gz", ""]
    assert values(spark, S.line_slice(F.col("a"), 2, 3), "1\n2\n3\n4", "1") == ["2\n3", ""]


def test_complexity(spark):
    text = "if (a) {\n}\n"
    row = spark.createDataFrame([(text,), ("",)], "t string").select(*(c.alias(n) for n, c in S.complexity_features(F.col("t")).items())).collect()
    assert tuple(row[0]) == (3, 3, 11, 2) and tuple(row[1]) == (0, 1, 0, 1)
    score = S.complexity_score(F.lit(3), F.lit(1), F.lit(0), F.lit(2), F.lit(3), F.lit(".py"), F.lit(0.0))
    assert spark.range(1).select(score.alias("s")).first()["s"] == 261


def test_output_classes(spark):
    rows = [(1, "CONFIRMED"), (0, "x\nCONFIRMED"), (0, "NOT CONFIRMED x"), (0, "CONFIRMED\nNOT CONFIRMED"), (0, "")]
    assert values(spark, S.output_class(F.col("rc"), F.col("o")), *rows, schema="rc int, o string") == ["runtime_error", "confirmed", "not_reproduced", "inconclusive", "inconclusive"]


def test_scopes_and_paths(spark):
    scopes = F.array(F.lit("./src/"), F.lit("lib/a"))
    assert values(spark, P.in_scope(F.col("a"), scopes), "src/x.c", "src2/x.c", "lib/a", "lib/ab") == [True, False, True, False]
    assert values(spark, P.is_safe_path(F.col("a")), "a/b", "/a", "a/../b", "..", "a..b") == [True, False, False, False, True]
    assert values(spark, P.is_identifier(F.col("a")), "a.b-1", "-a", "a" * 129, None) == [True, False, False, False]
    assert values(spark, P.has_oracle_marker(F.col("a")), "fixme : x", "a known defect", "debug: no", "Seeded-bug") == [True, True, False, True]


SPEC = {"signature": "f()", "pre_condition": "x", "post_condition": "y"}


@pytest.mark.parametrize(
    ("document", "reason"),
    [
        (SPEC, ""),
        (SPEC | {"z": 1}, "fields differ: unsupported fields: z"),
        ({"signature": "f"}, "fields differ: missing fields: post_condition, pre_condition"),
        (SPEC | {"signature": " "}, "blank or non-text field"),
        (SPEC | {"signature": 3}, "blank or non-text field"),
        (SPEC | {"post_condition": "TODO: y"}, "oracle marker in the contract"),
        ([1], "not a JSON object"),
    ],
)
def test_spec_check(spark, document, reason):
    assert values(spark, P.spec_check(F.col("a"))["reason"], json.dumps(document)) == [reason]


def test_canonical_documents(spark):
    longer = SPEC | {"error_behavior": " fails ", "more": 1}
    got = values(spark, S.spec_canonical(F.col("a")), *map(json.dumps, (longer, SPEC | {"error_behavior": "y"}, {"signature": "x"})))
    assert got[0]["spec"]["post_condition"] == "y\nError behavior: fails" and got[0]["removed"] == ["error_behavior", "more"]
    assert got[1]["spec"]["post_condition"] == "y" and got[2]["spec"] is None and got[2]["removed"] == []
    one = {"id": "g", "signature": "s", "pre_condition": "p", "post_condition": "q"}
    got = values(spark, S.callees_canonical(F.col("a")), *map(json.dumps, ({"callees": [one]}, {"callees": [one, {"name": "h"}]}, {"callees": []})))
    assert [c["name"] for c in got[0]] == ["g"] and got[1] is None and got[2] == []
    named = {"name": "g", "signature": "s", "pre_condition": "p", "post_condition": "q"}
    assert values(spark, P.info_check(F.col("a")), *map(json.dumps, ({"callees": [named]}, {"callees": [one]}, {"callees": [], "x": 1}, {"callees": []}))) == [True, False, False, True]


def test_receipts(spark):
    good = {"job_id": "j", "status": "done", "outputs": ["a", "b"]}
    cases = [(good, ""), (good | {"x": 1}, "unsupported keys: x"), (good | {"job_id": "k"}, "job id"), (good | {"status": " "}, "status"), (good | {"outputs": ["b", "a"]}, "outputs differ from the required ones"), ({"job_id": "j", "status": "s"}, "outputs missing"), (good | {"verdict": "MAYBE"}, "verdict"), (good | {"summary": "x" * 501}, "summary"), (good | {"counts": "y" * 9000}, "too large")]
    check = P.receipt_check(F.col("a"), F.lit("j"), F.lit("spec_batch"), F.array(F.lit("a"), F.lit("b")))
    assert values(spark, check["reason"], *(json.dumps(d) for d, _ in cases)) == [r for _, r in cases]


def test_verifications(spark):
    from veriframe.schemas import SCHEMAS

    why = ("actual", "post", None, None, "because")
    base = (2, "f", "c1", "MATCH", why, None, None)
    cases = [
        (base, ""),
        ((1, *base[1:]), "schema version"),
        ((2, "g", *base[2:]), "function identity"),
        ((2, "f", "c2", *base[3:]), "snapshot"),
        ((*base[:3], "YES", *base[4:]), "verdict"),
        ((*base[:4], ("actual", "other", None, None, "r"), None, None), "post-conditions missing or changed"),
        ((*base[:4], ("actual", "post", "cx", None, "r"), None, None), "match with a counterexample or statements"),
        ((*base[:3], "MISMATCH", why, None, None), "mismatch without counterexample, statements and reason"),
        ((*base[:3], "MISMATCH", ("actual", "post", "cx", "x = 2", "r"), None, None), "statements are no quote of the source"),
        ((*base[:3], "MISMATCH", ("actual", "post", "cx", "x = 1", "r"), None, None), ""),
        ((*base[:3], "INCONCLUSIVE", None, (["m"], None, "r"), None), ""),
        ((*base[:3], "INCONCLUSIVE", None, ([], None, "r"), None), "missing evidence blank"),
        ((*base[:3], "INCONCLUSIVE", why, (["m"], None, "r"), None), "unsettled verdict with reasoning"),
        ((*base[:3], "DEPENDENCY_RISK", None, (None, ["g"], "r"), None), ""),
        ((*base[:3], "DEPENDENCY_RISK", None, (None, ["f"], "r"), None), "affected callees unknown or own"),
        ((*base[:3], "DEPENDENCY_RISK", None, (None, ["zz"], "r"), None), "affected callees unknown or own"),
        ((*base[:3], "ERROR", None, None, "broke"), ""),
        ((*base[:3], "ERROR", None, None, " "), "error blank or with gaps"),
    ]
    rows = spark.createDataFrame([c for c, _ in cases], SCHEMAS["verification"]).coalesce(1)
    v = {c: F.col(c) for c in rows.columns}
    check = P.verification_check(v, F.lit("f"), F.lit("c1"), F.lit("post"), F.lit("inferred"), F.lit("a\nx = 1\n"), F.array(F.lit("f"), F.lit("g")))
    assert [r["r"] for r in rows.select(check["reason"].alias("r")).collect()] == [r for _, r in cases]


def test_small_predicates(spark):
    assert values(spark, P.reproduction_check(F.col("s"), F.col("c")), ("completed", "confirmed"), ("unsupported", "confirmed"), ("unsupported", "inconclusive"), (None, None), schema="s string, c string") == [True, False, True, False]
    contract = {"ecosystem": "node", "timeout_seconds": 5}
    check = P.contract_check(F.col("a"), ("ecosystem", "timeout_seconds"), F.array(F.lit("node")))
    assert values(spark, check["reason"], json.dumps(contract), json.dumps(contract | {"timeout_seconds": 0}), json.dumps(contract | {"ecosystem": "x"}), "{}") == ["", "timeout", "ecosystem", "keys"]
    one = spark.createDataFrame([([("ls", "p/1/x", "")], "completed"), ([("ls", "q", "")], "completed"), ([], "completed"), ([], "unsupported")], "c array<struct<command:string, cwd:string, output:string>>, s string").coalesce(1)
    assert [r[0] for r in one.select(P.commands_check(F.col("c"), F.lit("p/1"), F.col("s"))).collect()] == [True, False, False, True]
    attempt = P.dynamic_attempt_check(F.col("c"), F.lit("probes/1.json"), F.lit("s"), F.col("st"), F.col("rc"), F.lit("s"))["reason"]
    assert values(spark, attempt, ("confirmed", "completed", "confirmed"), ("confirmed", "completed", "inconclusive"), ("inconclusive", "unsupported", "inconclusive"), ("no", "completed", "x"), schema="c string, st string, rc string") == ["", "classification differs from the result's", "", "classification"]


def test_configuration(spark):
    m = lambda **k: F.create_map(*(F.lit(x) for kv in k.items() for x in kv)) if k else F.create_map().cast("map<string,string>")
    merged = S.merged_config(m(a="1", b="2", c="3"), m(b="5", z="9"), m(c="7"))
    assert spark.range(1).select(merged.alias("m")).first()["m"] == {"a": "1", "b": "5", "c": "7"}
    same = lambda cfg, subs: spark.range(1).select(S.fingerprint(cfg, ["b"], F.lit(False), subs, F.lit("e"), F.array(F.lit("k"))).alias("f")).first()["f"]
    x, y = F.array(F.lit("s1"), F.lit("s2")), F.array(F.lit("s2"), F.lit("s1"), F.lit("s2"))
    assert same(m(a="1", b="2"), x) == same(m(b="3", a="1"), y) != same(m(a="2", b="2"), x)
    phases = ("p", "q", "r")
    assert values(spark, S.next_of(phases, F.col("a")), "p", "r", "z") == ["q", None, None]
    assert spark.range(1).select(S.lease_seconds(F.lit(7200), F.lit(600), F.lit(900)).alias("v")).first()["v"] == 900
    assert values(spark, S.age_seconds(F.col("a"), F.lit("2024-01-01 00:01:00").cast("timestamp")), "2024-01-01T00:00:00", "never") == [60.0, float("inf")]
