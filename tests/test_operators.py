"""Operators against hand-computed cases and small plain models on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from veriframe.operators import aggregates as A
from veriframe.operators import graph as G
from veriframe.operators import inventory as D
from veriframe.operators import joins as J
from veriframe.operators import ledger as L
from veriframe.operators import ranking as R


def test_inventory_delta(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    b = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    got = {r["path"]: r["change"] for r in D.inventory_delta(a, b).collect()}
    assert got == {"a": "preserved", "b": "changed", "c": "removed", "d": "produced"}
    assert {r["change"] for r in D.inventory_delta(a.limit(0), b).collect()} == {"produced"} and D.inventory_delta(a, a).where("change <> 'preserved'").count() == 0


def test_innermost_span(spark):
    spans = spark.createDataFrame([("outer", "p", 1, 200, 1), ("inner", "p", 5, 8, 2), ("twin", "p", 5, 8, 3)], "span_id string, path string, line_start int, line_end int, ord int")
    nodes = spark.createDataFrame([("x", "p", 6), ("y", "p", 120), ("z", "p", 300), ("o", "q", 1)], "node_id string, path string, line int")
    got = {r["node_id"]: r["span_id"] for r in J.innermost_spans(nodes, spans).collect()}
    assert got == {"x": "inner", "y": "outer", "z": None, "o": None}
    assert [r["node_id"] for r in J.unmapped_nodes(J.innermost_spans(nodes, spans), spans).collect()] == ["z"]


def layers_model(nodes, edges):
    left, out, layer = set(nodes), [], 0
    while left:
        free = sorted(n for n in left if not any(b == n and a in left and a != b for a, b in edges)) or [min(left)]
        out += [(layer, n) for n in free]
        left -= set(free)
        layer += 1
    return out


@pytest.mark.parametrize("edges", [[("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], [("x", "y"), ("y", "x"), ("y", "a")], *[[(random.Random(s).choice("abcdefgh"), random.Random(s * 7 + k).choice("abcdefgh")) for k in range(9)] for s in range(8)]])
def test_layers(edges):
    nodes = sorted({n for e in edges for n in e})
    assert G.layers_of(nodes, edges) == layers_model(nodes, edges)


def test_layers_in_spark(spark):
    nodes = spark.createDataFrame([(1, n) for n in "abcd"] + [(2, "z")], "phase int, id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("z", "a")], "caller string, callee string")
    got = {(r["phase"], r["id"]): r["layer"] for r in G.caller_first_layers(nodes, edges).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 3, (2, "z"): 0}
    with pytest.raises(ValueError):
        G.acyclic_layers(nodes.select("id"), edges)


@pytest.mark.parametrize("seed", range(3))
def test_layers_of_random_graphs(spark, seed):
    """Peeling before the fold gives the layers of the fold alone; a node may be in two phases."""
    r = random.Random(seed)
    edges = list({(r.randrange(30), r.randrange(30)) for _ in range(25 + 12 * seed)})
    phases = {1: list(range(20)), 2: list(range(10, 30))}
    nodes = spark.createDataFrame([(p, n) for p, own in phases.items() for n in own], "phase int, id int")
    got = {(x["phase"], x["layer"], x["id"]) for x in G.caller_first_layers(nodes, spark.createDataFrame(edges, "caller int, callee int")).collect()}
    assert got == {(p, k, n) for p, own in phases.items() for k, n in layers_model(own, [e for e in edges if set(e) <= set(own)])}


def burst_model(nodes, edges):
    """The greatest solution of burst(v) = min(v, max of the callers' bursts)."""
    callers = {v: [a for a, b in edges if b == v] for v in nodes}
    burst = {v: v for v in nodes}
    while True:
        new = {v: min(v, max(burst[a] for a in callers[v])) for v in nodes}
        if new == burst:
            return burst
        burst = new


@pytest.mark.parametrize("seed", range(150))
def test_bursts_are_those_of_the_fold(seed):
    """On what is left behind peeling, bursts in order with longest ways inside give the fold's layers."""
    r = random.Random(seed)
    n = r.randint(2, 24)
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(r.randint(2, 3 * n))}
    edges = {(a, b) for a, b in edges if a != b}
    left = set(range(n))
    while free := [v for v in left if not any(b == v and a in left for a, b in edges)]:
        left -= set(free)
    edges = [(a, b) for a, b in edges if a in left and b in left]
    burst, layer = burst_model(left, edges), {}
    for b in sorted(set(burst.values())):
        own = {v for v in left if burst[v] == b}
        inner, start = [(x, y) for x, y in edges if x in own and y in own and y != b], max(layer.values(), default=-1) + 1
        for k, v in layers_model(own, inner):
            layer[v] = start + k
    assert {(k, v) for v, k in layer.items()} == set(layers_model(left, edges))


@pytest.mark.parametrize("seed", range(2))
def test_layers_by_rounds(spark, seed):
    """Without a fold the layers are the same; phases of texts share nodes, one has no cycle, one is a cycle of eight."""
    r = random.Random(seed)
    name = lambda k: f"n{k:02d}"
    edges = list({(name(r.randrange(26)), name(r.randrange(26))) for _ in range(45)} | {(name(30 + k), name(30 + (k * 3 + 1) % 8)) for k in range(8)} | {(name(40), name(41))})
    phases = {1: [name(k) for k in range(18)], 2: [name(k) for k in range(8, 26)], 3: [name(30 + k) for k in range(8)], 4: [name(40), name(41)]}
    nodes = spark.createDataFrame([(p, n) for p, own in phases.items() for n in own], "phase int, id string")
    got = {(x["phase"], x["layer"], x["id"]) for x in G.caller_first_layers(nodes, spark.createDataFrame(edges, "caller string, callee string"), fold_edges=0).collect()}
    assert got == {(p, k, n) for p, own in phases.items() for k, n in layers_model(own, [e for e in edges if set(e) <= set(own)])}


def test_long_paths(spark):
    """Loops of many rounds keep each node once."""
    edges = spark.range(40).selectExpr("id AS caller", "id + 1 AS callee")
    start = spark.createDataFrame([(0,)], "id long")
    assert sorted(map(tuple, G.impact_closure(edges, start).collect())) == [(0, "file-change"), *((k, "callee-propagation") for k in range(1, 41))]
    assert sorted(map(tuple, G.reachable(edges.toDF("a", "b"), start).collect())) == [(k, k) for k in range(41)]
    assert sorted(map(tuple, G.acyclic_layers(spark.range(41), edges).collect())) == [(k, k) for k in range(41)]


def test_closure_beyond_the_guard(spark):
    """The closure has no depth at which it stops; the query's SQL has one of 64."""
    edges = spark.range(70).selectExpr("id AS caller", "id + 1 AS callee")
    assert G.impact_closure(edges, spark.createDataFrame([(0,)], "id long")).count() == 71


def test_closure(spark):
    edges = spark.createDataFrame([("p", "q"), ("r", "q"), ("s", "t")], "caller string, callee string")
    got = {r["id"]: r["reason"] for r in G.impact_closure(edges, spark.createDataFrame([("p",)], "id string")).collect()}
    assert got == {"p": "file-change", "q": "callee-propagation", "r": "caller-propagation"}


def admission_model(ready, cap, caps, running):
    out, used, all_ = [], dict(running), sum(running.values())
    for job, kind in sorted(ready)[: max(4 * cap, 16)]:
        if all_ >= cap:
            break
        if used.get(kind, 0) < caps.get(kind, cap):
            out.append(job)
            used[kind], all_ = used.get(kind, 0) + 1, all_ + 1
    return out


def test_admission(spark):
    for seed in range(6):
        r = random.Random(seed)
        ready = [(k, r.choice("ABC")) for k in range(r.randint(0, 90))]
        cap, caps, running = r.randint(2, 9), {"A": r.randint(1, 3), "B": r.randint(1, 5)}, {"A": r.randint(0, 1)}
        got = R.capped_admission(spark.createDataFrame(ready, "job_id int, type string"), spark.createDataFrame(list(running.items()), "type string, n int"), cap, caps)
        assert sorted(x["job_id"] for x in got.collect()) == admission_model(ready, cap, caps, running)
    five = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "B"), (5, "B")], "job_id int, type string")
    assert sorted(x["job_id"] for x in R.capped_admission(five, None, 3, {"A": 2, "B": 2}).collect()) == [1, 2, 4]


def test_greedy_batches(spark):
    rows = [("k", i, t, 1) for i, t in enumerate((5000, 5000, 5000, 12000, 100))] + [("l", 0, 1, 300_000), ("l", 1, 1, 1)]
    got = R.greedy_batches(spark.createDataFrame(rows, "k string, i int, tokens int, bytes int"), "k", "i").orderBy("k", "i").collect()
    assert [r["batch"] for r in got] == [1, 1, 2, 3, 4, 1, 2]
    many = R.greedy_batches(spark.createDataFrame([("k", i, 1, 1) for i in range(45)], "k string, i int, tokens int, bytes int"), "k", "i")
    assert [r["count"] for r in many.groupBy("batch").count().orderBy("batch").collect()] == [20, 20, 5]


def test_reshape(spark):
    rows = spark.createDataFrame([(1, [1]), (2, [2, 3, 4, 5, 6]), (3, [7, 8])], "batch int, items array<int>")
    assert [r["items"] for r in R.reshape_batches(rows).orderBy("ordinal").collect()] == [[1], [7], [8], [2, 3, 4, 5, 6]]


def test_coverage_gate(spark):
    def gate(verdicts, basis="inferred"):
        rows = spark.createDataFrame([(1, v, basis) for v in verdicts], "k int, verdict string, basis string")
        return A.coverage_gate(A.coverage(rows, "k")).first()["reason"]

    assert gate(["MATCH", "MATCH", "MISMATCH", "INCONCLUSIVE", "INCONCLUSIVE"]) == ""
    assert gate(["MATCH", "MATCH", "MISMATCH", "INCONCLUSIVE", "ERROR"]) == "verification_incomplete"
    assert gate(["MATCH", "MATCH", "INCONCLUSIVE", "INCONCLUSIVE", "INCONCLUSIVE"]) == "insufficient_specification"
    assert gate(["MATCH"] * 3, "unavailable") == "insufficient_specification"
    empty = A.coverage_gate(A.coverage(spark.createDataFrame([], "verdict string, basis string"))).first()
    assert empty["reason"] == "insufficient_specification" and empty["conclusive_ratio"] == 0.0


def folded(spark, events, **more):
    rows = spark.createDataFrame([("j", k, *e) for k, e in enumerate(events)], "job_id string, seq int, action string, failure_class string, negative boolean, type string")
    return L.fold_events(rows, order=("seq",), **more).first()


def test_state_machine(spark):
    ev = lambda a, f=None, n=False, t="spec_batch": (a, f, n, t)
    start, fail, retry = ev("start"), ev("fail", "execution"), ev("retry")
    assert folded(spark, [start, fail], max_attempts=2)["status"] == "retryable"
    assert folded(spark, [start, fail, retry, start, fail], max_attempts=2)["status"] == "failed"
    assert folded(spark, [start, ev("fail", "semantic")])["status"] == "failed"
    assert folded(spark, [ev("complete"), retry])["ignored"] == 2
    probe = [ev("start", t="bug_validate"), ev("complete", None, True, "bug_validate"), ev("retry", t="bug_validate")]
    one = folded(spark, probe * 2)
    assert (one["status"], one["negative_attempts"]) == ("queued", 2)
    three = folded(spark, probe * 3)
    assert (three["status"], three["negative_attempts"], three["ignored"]) == ("succeeded", 3, 1)
    lost = [ev("start", t="bug_validate"), ev("fail", "interrupted", False, "bug_validate"), ev("retry", t="bug_validate")]
    assert folded(spark, lost * 2, max_attempts=2)["runtime_attempts"] == 2 and folded(spark, lost * 2, max_attempts=2)["status"] == "failed"


def test_receipts_and_batches(spark):
    rows = spark.createDataFrame([("a", 1, "i", "h", "x")] * 2 + [("b", 1, "i", "h", "x"), ("b", 1, "i", "h", "y")], "job_id string, attempt int, input_hash string, artifact_hash string, payload string")
    good, bad = L.accepted_receipts(rows)
    assert [(r["job_id"], r["copies"]) for r in good.collect()] == [("a", 2)] and [r["job_id"] for r in bad.collect()] == ["b"]
    jobs = spark.createDataFrame([("j", ["p", "q", "r"])], "job_id string, artifacts array<string>")
    part = L.partial_batches(jobs, spark.createDataFrame([("j", "q")], "job_id string, artifact string")).first()
    assert part["completed"] == ["p", "r"] and part["remaining"] == ["q"]


def test_selection_and_plan(spark):
    rows = spark.createDataFrame([("x", True, "r"), ("x", False, "s"), ("y", False, "t"), ("y", True, "u"), ("zz", True, "v")], "id string, included boolean, reason string")
    good, unknown = D.selection_merge(rows, spark.createDataFrame([("x",), ("y",)], "id string"))
    assert {(r["id"], r["included"], r["reason"]) for r in good.collect()} == {("x", True, "r"), ("y", True, "u")} and unknown.count() == 1
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "artifact string, v string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "artifact string, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(D.apply_plan(now, new, now.limit(0))) == [("a", "1"), ("b", "3"), ("c", "4")] and rows(D.apply_plan(now, new, now)) == rows(now)
    bad = D.coverage_violations(spark.createDataFrame([("f", 1), ("f", 1), ("g", 2), ("h", 1)], "function_id string, phase int"), spark.createDataFrame([("f", 1), ("g", 1), ("i", 1)], "function_id string, phase int"))
    assert rows(bad) == [("f", "repeated"), ("g", "other phase"), ("h", "unknown"), ("i", "missing")]


def test_job_graph(spark):
    plan = spark.createDataFrame([(1, "p1", "one", ["x"], []), (2, "p2", "two", [], ["1"]), (4, "p4", "four", ["y"], ["one", "two", "phase-4"])], "phase int, id string, name string, files array<string>, depends_on array<string>")
    got = G.resolve_phases(plan, G.phase_aliases(plan)).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["depends_on"]) for r in got] == [(1, []), (2, [1])]
    batches = spark.createDataFrame([(1, 0, "a"), (1, 2, "b"), (1, 2, "c"), (1, 5, "d"), (2, 0, "e")], "phase int, layer int, job_id string")
    deps = G.specification_jobs(batches, spark.createDataFrame([(2, [1])], "phase int, depends_on array<int>"), "ctx").where("depends_on <> 'ctx'")
    assert sorted(map(tuple, deps.collect())) == [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d")]
    jobs = lambda *r: spark.createDataFrame(r, "job_id string, artifacts array<string>")
    assert G.verification_jobs(jobs(("v", ["x", "y"])), jobs(("s", ["x"]), ("t", ["y", "z"]))).first()["depends_on"] == ["s", "t"]


def test_previous_layer(spark):
    """Each job has the whole layer before it; numbers are counted a layer, without pairs of jobs and without arrays."""
    batches = spark.createDataFrame([(1, 0, "a"), (1, 2, "b"), (1, 2, "c"), (1, 5, "d"), (2, 0, "e"), (None, 1, "f")], "phase int, layer int, job_id string")
    got = {r["job_id"]: (r["n_deps"], r["depends_on"]) for r in G.previous_layer(batches).collect()}
    assert got == {"a": (0, []), "b": (1, ["a"]), "c": (1, ["a"]), "d": (2, ["b", "c"]), "e": (0, [])}
    wide = spark.range(60_000).selectExpr("1 AS phase", "cast(id % 3 AS int) AS layer", "id AS job_id")
    counts = G.previous_layer(wide).select("job_id", "n_deps")
    assert "collect_set" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["n_deps"], r["n"]) for r in counts.groupBy("n_deps").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, 20_000), (20_000, 40_000)}


def test_chain(spark):
    rows = spark.createDataFrame([("c1", "p", 1, "complete", None), ("c2", "q", 2, "complete", "c1"), ("c3", "p", 3, "committing", "c2"), ("c4", "q", 4, "complete", "c3"), ("x", "p", 9, "complete", None)], "checkpoint_id string, phase string, ordinal int, status string, previous_checkpoint_id string")
    assert {r["phase"]: r["checkpoint_id"] for r in R.latest_complete_by_phase(rows, "c4").collect()} == {"q": "c4", "p": "c1"}
    assert R.last_complete(rows, "c1").first()["checkpoint_id"] == "x"
    long = spark.range(1, 12_001).selectExpr("cast(id as string) AS checkpoint_id", "'p' AS phase", "cast(id as int) AS ordinal", "if(id = 3, 'complete', 'committing') AS status", "cast(id - 1 as string) AS previous_checkpoint_id")
    assert R.last_complete(long, "12000").first()["checkpoint_id"] == "3"
    round_ = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b")], "checkpoint_id string, previous_checkpoint_id string")
    assert {r["checkpoint_id"]: r["depth"] for r in R.chain(round_, "a").collect()} == {"a": 0, "c": 1, "b": 2}
    assert R.last_complete(rows, "c4").first()["checkpoint_id"] == "c2" and R.last_complete(rows, None).first()["checkpoint_id"] == "x"


def test_chain_sizes(spark, monkeypatch):
    """Pointers' estimated size doesn't square each round; rounds end once a complete row is found, and go on to the end without one."""
    digits = []
    real = G.stored

    def stored(df, **more):
        out = real(df, **more)
        digits.append(len(out._jdf.queryExecution().optimizedPlan().stats().simpleString()))
        return out

    monkeypatch.setattr(G, "stored", stored)
    rows = spark.range(3000).selectExpr("cast(id as string) AS checkpoint_id", "cast(id as int) AS ordinal", "if(id % 5 = 1, 'complete', 'committing') AS status", "cast(id - 1 as string) AS previous_checkpoint_id")
    assert R.last_complete(rows, "2999").first()["checkpoint_id"] == "2996" and len(digits) <= 2 + 2 * 3
    assert R.last_complete(rows, "2996").first()["checkpoint_id"] == "2991"
    digits.clear()
    whole = R.chain(rows, "2999")
    assert whole.count() == 3000 and whole.agg(F.max("depth")).first()[0] == 2999 and len(digits) >= 2 + 2 * 11 and max(digits) < 60
    assert R.last_complete(rows.withColumn("status", F.when(F.col("ordinal") < 1, "complete").otherwise("committing")), "2999").first()["checkpoint_id"] == "0"


def test_quotes(spark):
    s = spark.createDataFrame([(1, "xx one two three four five six yy"), (2, "one two"), (3, None), (4, "")], "source_id int, text string")
    q = spark.createDataFrame([(1, "x one two three four five six y"), (2, "e tw"), (3, "none of that at all is there"), (4, None)], "quote_id int, text string")
    assert sorted(map(tuple, J.quotes_in(s, q).collect())) == [(1, 1), (1, 2), (2, 2)]
    assert J.quotes_in(s, q.limit(0)).count() == 0
    more = ["", "w", "wo", "two", "  ", "one two", "ne two three", "x one two three four five", "six  ", "é", "y" * 5]
    texts = ["xx one two three four five six yy", "two  two", "", "é one two three", "yyyyyy w"]
    s, q = (spark.createDataFrame(list(enumerate(x)), f"{n}_id int, text string") for n, x in (("source", texts), ("quote", more)))
    assert sorted(map(tuple, J.quotes_in(s, q).collect())) == sorted((i, k) for i, t in enumerate(texts) for k, x in enumerate(more) if x in t)


def test_many_short_quotes(spark):
    """More short quotes than a plan could list."""
    s = spark.createDataFrame([(1, "a q7 b"), (2, "a q11999 b c")], "source_id int, text string")
    q = spark.range(12_000).selectExpr("cast(id as int) AS quote_id", "concat('a q', id, ' b') AS text")
    assert sorted(map(tuple, J.quotes_in(s, q).collect())) == [(1, 7), (2, 11999)]


def test_plan_form(spark):
    kind = "plan string, position int, phase int, modules array<struct<source_files: array<string>>>, depends_on array<int>"
    module = lambda *files: (list(files),)
    rows = [("p", 1, 1, [module("a.py")], []), ("p", 2, 2, [module("b.py", "gone.py"), module()], [1]), ("p", 3, 3, [module(), module("gone.py")], [1]), ("p", 4, 5, [module("a.py")], []), ("p", 5, 5, [module("a.py")], [1, 5])]
    rows += [("q", 1, 1, [module("tests/t.py")], []), ("q", 2, 2, [(None,)], []), ("q", 3, 3, None, []), ("q", 4, 4, [], None), ("q", 5, 5, [module("b.py")], [0]), ("q", 6, None, [module("b.py")], []), ("r", 1, 1, [], [])]
    found = J.plan_form_violations(spark.createDataFrame(rows, kind), spark.createDataFrame([("a.py",), ("b.py",), ("tests/t.py",)], "path string"))
    source, production, order, normal = "invalid module sources", "invalid production source", "invalid dependencies", "not normalized"
    assert {(r["plan"], r["position"]): r["reason"] for r in found.collect()} == {("p", 2): production, ("p", 3): source, ("p", 4): normal, ("p", 5): order, ("q", 1): production, ("q", 2): source, ("q", 3): normal, ("q", 4): order, ("q", 5): order, ("q", 6): normal}


def test_edges_and_reads(spark):
    edges = spark.createDataFrame([("f", "g"), ("g", "h")], "caller string, callee string")
    functions = spark.createDataFrame([("af", "f", "pf"), ("ag", "g", "pg"), ("ah", "h", "ph")], "artifact string, id string, path string")
    jobs = spark.createDataFrame([("j", ["af"])], "job_id string, artifacts array<string>")
    have = spark.createDataFrame([(p,) for p in ("af", "pf", "pg", "ctx", "ph")], "path string")
    assert sorted(r["path"] for r in J.read_sets(jobs, functions, edges, have, ("ctx", "gone")).collect()) == ["af", "ctx", "pf", "pg"]
    plan = spark.createDataFrame([("1", "s", "af", "j"), ("1", "s", "ag", "j")], "phase string, type string, artifact string, job_id string")
    own = spark.createDataFrame([("1", "s", "j", ["af", "ah"])], "phase string, type string, job_id string, artifacts array<string>")
    assert sorted(r["artifact"] for r in J.plan_violations(plan, own).collect()) == ["ag", "ah"]


def test_quotes_grow_with_the_text(spark):
    """A text of 20,000 words costs little more than one of 2,000; one word in all sources is no quote's only key."""
    import time

    words = [f"w{k * 7919 % 20011}" for k in range(20_000)]
    q = spark.createDataFrame([(1, " ".join(words[11_000:11_030])), (2, " ".join(words[-3:]) + "x"), (3, words[19_999][:2]), (4, "no " + " ".join(words[5:9]) + " such end")], "quote_id int, text string")
    took = {}
    for n in (2_000, 20_000):
        s = spark.createDataFrame([(n, " ".join(words[:n]))], "source_id int, text string")
        J.quotes_in(s, q).collect()  # classes are loaded and code is made here
        began = time.time()
        assert sorted(map(tuple, J.quotes_in(s, q).collect())) == [(n, k) for k in ((1, 3) if n == 20_000 else (3,))]
        took[n] = time.time() - began
    assert took[20_000] < took[2_000] + 3


def test_quotes_with_hot_keys(spark, monkeypatch):
    """A key of all sources is salted; sources that come twice give one row."""
    monkeypatch.setattr(J, "SALT_ROWS", 10)
    s = spark.range(100).selectExpr("cast(id as int) AS source_id", "concat('a the same four words here ', id, ' z') AS text").unionByName(spark.createDataFrame([(7, "a the same four words here 7 z")], "source_id int, text string"))
    q = spark.createDataFrame([(1, "a the same four words here"), (2, "the same four words here 7 z")], "quote_id int, text string")
    got = [tuple(r) for r in J.quotes_in(s, q).collect()]
    assert len(got) == 101 and set(got) == {*((k, 1) for k in range(100)), (7, 2)}


def test_merged_lists(spark):
    """First-seen order over edges and within them; repeated edges, null lists and null elements."""
    kind = "ord int, caller struct<fqn: string, callsite_names: array<string>>, callee struct<fqn: string, info_names: array<string>>, evidence array<string>"
    r = random.Random(3)
    some = lambda letters: None if r.random() < 0.1 else [r.choice([*letters, None]) for _ in range(r.randint(0, 5))]
    rows = [(k, (r.choice("fg"), ["x"]), (r.choice("hi"), some("abc")), some("stuv")) for k in range(60)] + [(99, ("only", ["y"]), ("null", None), None)]
    want = {}
    for _, (caller, _), (callee, info), evidence in rows:
        own = want.setdefault((caller, callee), ([], []))
        for had, new in zip(own, (info, evidence)):
            had += [x for k, x in enumerate(new or []) if x not in had and x not in new[:k]]
    got = {(x["caller"], x["callee"]): (x["info_names"], x["evidence"]) for x in A.merge_edges(spark.createDataFrame(rows, kind).repartition(3)).collect()}
    assert got == want


def test_documents(spark, tmp_path):
    """Parts, files and digests of a hot key's lines are those of the whole document; lines of no key, empty tables and long lines."""
    import hashlib

    from veriframe.operators import documents as O

    rows = [("hot", k, f"line {k} é") for k in range(3000)] + [("b", 1, ""), ("b", 2, "x" * 5000), ("b", 3, None), (None, 5, "no key"), ("one", 1, "same"), ("one", 1, "same")]
    want = {}
    for key, k, line in sorted(rows, key=lambda x: x[1]):
        if line is not None:
            want.setdefault(key, []).append(line)
    df = spark.createDataFrame(rows, "k string, ord int, line string").repartition(4)
    parts = O.document_parts(df, ["k"], ["ord"], size=1000)
    held = {}
    for x in sorted(parts.collect(), key=lambda x: x["part"]):
        held.setdefault(x["k"], []).append(x["text"])
    assert {k: "\n".join(v) for k, v in held.items()} == {k: "\n".join(v) for k, v in want.items()}
    assert max(len(x) for x in held["hot"]) < 1200 and len(held["hot"]) > 30
    got = {x["k"]: (x["lines"], x["bytes"], x["sha256"]) for x in O.document_digests(df, ["k"], ["ord"]).collect()}
    assert got == {k: (len(v), len(raw), hashlib.sha256(raw).hexdigest()) for k, v in want.items() for raw in ["\n".join(v).encode()]}
    assert {x["k"]: x["text"] for x in O.joined_text(df, ["k"], ["ord"], separator=", ").collect()} == {k: ", ".join(v) for k, v in want.items()}
    assert O.document_digests(df.limit(0), ["k"], ["ord"]).count() == 0 and O.joined_text(df.where("k = 'one'"), [], ["ord"]).first()["text"] == "same\nsame"
    O.write_lines(df, str(tmp_path / "out"), ["k"], ["ord"])
    for key, lines in want.items():
        files = sorted((tmp_path / "out" / f"k={key or '__HIVE_DEFAULT_PARTITION__'}").glob("part-*"))
        assert "".join(f.read_text() for f in files) == "\n".join(lines) + "\n"
    O.write_lines(df.where("k = 'hot'"), str(tmp_path / "flat"), [], ["ord"])
    assert "".join(f.read_text() for f in sorted((tmp_path / "flat").glob("part-*"))) == "\n".join(want["hot"]) + "\n"


def test_hot_key_document(spark):
    """A key of a million lines is spread over tasks and comes out whole."""
    import hashlib

    from veriframe.operators import documents as O

    df = spark.range(1_000_000).selectExpr("'k' AS k", "id AS ord", "concat('line ', id) AS line")
    assert O.document_parts(df, ["k"], ["ord"]).selectExpr("part >> 32 AS task").distinct().count() > 1
    state = hashlib.sha256("\n".join(f"line {k}" for k in range(1_000_000)).encode()).hexdigest()
    assert O.document_digests(df, ["k"], ["ord"]).first()["sha256"] == state


def test_findings_and_escalations(spark):
    from veriframe.plans import gates

    jobs = spark.createDataFrame([("p", 1, "failed", "ERROR", "x"), ("p", 2, "succeeded", "ERROR", None), ("p", 3, "succeeded", "MATCH", "late"), ("q", 4, "succeeded", "MATCH", None), ("q", 5, "succeeded", None, None)], "phase string, job_id int, status string, verdict string, escalation string")
    assert sorted(map(tuple, A.escalations(jobs, "phase").collect())) == [("p", 1, "failed"), ("p", 2, "ERROR"), ("p", 3, "late")]
    assert {r["phase"]: r["n_escalations"] for r in A.phase_receipt(jobs, "phase").collect()} == {"p": 3, "q": 0}
    checks = spark.createDataFrame([("s", 1, "MISMATCH"), ("s", 2, "MISMATCH"), ("s", 3, "MATCH"), ("t", 4, "MISMATCH"), ("s", 5, "MISMATCH")], "source string, function_id int, verdict string")
    dynamic = spark.createDataFrame([(2, "confirmed"), (3, "confirmed"), (5, "rejected")], "function_id int, confirmation_status string")
    assert {r["source"]: tuple(r)[1:] for r in gates.terminal_report(checks, dynamic, "source").collect()} == {"s": (4, 3, 1, 1), "t": (1, 1, 1, 0)}
    assert sorted(map(tuple, gates.terminal_findings(checks, dynamic, F.col("source") != "t", "source").collect())) == [("s", "confirmed", 2), ("s", "static", 1)]


def test_hot_job(spark):
    """Jobs whose events lie in several ranges, one with most of all, end as in a plain fold; kinds and failures change within a job."""
    r = random.Random(11)
    event = lambda job, k: (job, k, r.choice(["start", "complete", "fail", "retry", "start", None, "odd"]), r.choice(["execution", "semantic", "interrupted", None]), r.random() < 0.4, r.choice(["bug_validate", "spec_batch"]))
    rows = [event("hot", k) for k in range(6000)] + [event(f"j{k % 40}", k) for k in range(900)] + [event(None, k) for k in range(30)] + [("once", 0, "start", None, False, None)]
    want = {}
    for job, _, action, failure, negative, kind in sorted(rows, key=lambda x: x[1]):
        want.setdefault(job, L.Job()).apply(action, failure, negative, kind, 5, 3)
    df = spark.createDataFrame(rows, "job_id string, seq int, action string, failure_class string, negative boolean, type string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be one range
    try:
        spread = df.repartitionByRange("job_id", "seq").where("job_id = 'hot'").select(F.spark_partition_id()).distinct().count()
        cut = {x["job_id"]: tuple(x)[1:] for x in L.fold_events(df, order=("seq",)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = {x["job_id"]: tuple(x)[1:] for x in L.fold_events(df, order=("seq",)).collect()}
    assert got == {k: (j.status, j.attempts, j.runtime_attempts, j.negative_attempts, j.ignored) for k, j in want.items()}
    assert cut == got and spread > 1 and L.fold_events(df.limit(0), order=("seq",)).count() == 0


def test_composed_runs():
    """A table of a run, cut anywhere, does what its events do one by one."""
    r = random.Random(5)
    moves = L.Transitions(3, 2)
    for _ in range(60):
        events = [(r.choice(["start", "complete", "fail", "retry", "x"]), r.choice(["execution", "semantic"]), r.random() < 0.5, r.choice(["bug_validate", "other"])) for _ in range(r.randint(0, 40))]
        job, cut, run = L.Job(), r.randint(0, len(events)), moves.none()
        for k, e in enumerate(events):
            if k < cut:
                job.apply(*e, 3, 2)
            else:
                run = moves.then(run, moves.of(*e))
        whole = L.Job()
        for e in events:
            whole.apply(*e, 3, 2)
        assert moves.applied(job, run) == whole
