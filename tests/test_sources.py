"""Scans, spans, stores and streams."""

import json

import pytest
from pyspark.sql import functions as F

from veriframe.sources import registry, scans, spans, store


def test_source_tree(spark, tmp_path):
    for name, text in {"src/a.py": "def f(): pass", "src/tests/b.py": "x", "node_modules/c.js": "x", "src/d.txt": "x", "src/E.CPP": "int f(){}", "src/a.py.spec.json": "{}"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = scans.files_below(spark, str(tmp_path))
    assert sorted(r["path"] for r in scans.production_sources(files).collect()) == ["src/E.CPP", "src/a.py"]
    assert sorted(r["path"] for r in scans.production_sources(files, scopes=("src/a.py",)).collect()) == ["src/a.py"]
    assert "src/a.py.spec.json" not in {r["path"] for r in scans.artifacts(files).collect()}
    named = {r["path"]: r["language"] for r in registry.with_language(files, registry.profiles(spark)).collect()}
    assert named["src/a.py"] == "python" and named["src/E.CPP"] == "cpp" and named["src/d.txt"] == "unknown"
    assert registry.capability_matrix(registry.profiles(spark)).where("extension = '.ets'").count() == 1
    known = spark.createDataFrame([("src/a.py",)], "path string")
    assert scans.untracked_sources(files, known).where("path = 'src/a.py'").count() == 0
    old = scans.inventory_of(files)
    new = old.where("path <> 'src/E.CPP'").withColumn("sha256", F.lit("x"))
    assert {(r["path"], r["change"]) for r in scans.changed_sources(old, new).collect()} == {("src/a.py", "changed"), ("src/E.CPP", "removed")}


def test_build_adapter(spark):
    profile = registry.profiles(spark)
    rows = lambda names, column: spark.createDataFrame([(n,) for n in names], f"{column} string")
    adapter = lambda names, keys: registry.build_adapter(rows(names, "name"), rows(keys, "key"), profile).first()["adapter"]
    assert adapter(["go.mod"], ["go", "rust"]) == "go" and adapter(["Cargo.toml"], ["rust"]) == "none" and adapter(["Cargo.toml", "Cargo.lock"], ["rust"]) == "cargo"
    assert adapter(["x"], ["java", "go"]) == "java" and adapter(["hvigorfile.ts", "build-profile.json5"], ["arkts"]) == "none"


def test_json_and_edges(spark, tmp_path):
    got = spark.createDataFrame([('{"a": 1}',), ("{",), (None,)], "t string").select(scans.json_or(F.col("t"), "a int", F.struct(F.lit(9).alias("a"))).alias("v")).collect()
    assert [r["v"]["a"] for r in got] == [1, 9, 9]
    edge = lambda a, b, e: {"caller": {"fqn": a, "callsite_names": ["x"]}, "callee": {"fqn": b, "info_names": ["i"]}, "evidence": [e], "source": "s"}
    (tmp_path / "1.json").write_text(json.dumps({"edges": [edge("f", "g", "e2"), edge("f", "g", "e1")]}))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "2.json").write_text(json.dumps({"edges": [edge("f", "g", "e2"), edge("f", "h", "e9")]}))
    from veriframe.operators.aggregates import merge_edges

    merged = {r["callee"]: r["evidence"] for r in merge_edges(scans.edge_documents(spark, str(tmp_path))).collect()}
    assert merged == {"g": ["e2", "e1"], "h": ["e9"]}
    (tmp_path / "3.json").write_text("{}")
    with pytest.raises(Exception, match="no edges array"):
        scans.edge_documents(spark, str(tmp_path)).collect()


def test_lockfiles(spark):
    assert scans.relaxed_json('{"a": [1, 2,], // c\n "b": "x//y", /* d */ }') == {"a": [1, 2], "b": "x//y"}
    assert scans.relaxed_json("{'a': 1}") is None and scans.relaxed_json("{") is None
    lock = '{"packages": {"m@1.0": {"version": "1.0"}, "n": {"name": "nn", "version": "2",}, },}'
    got = scans.lockfile_packages(spark.createDataFrame([("l", lock), ("bad", "'"), ("none", None)], "path string, text string"))
    assert sorted((r["name"], r["version"]) for r in got.collect()) == [("m", "1.0"), ("nn", "2")]
    have = spark.createDataFrame([("m", "1.0"), ("m", "1.1")], "name string, version string")
    assert [tuple(r) for r in scans.unlocked_packages(have, got).collect()] == [("m", "1.1")]


def test_knowledge(spark):
    files = spark.createDataFrame([("k/My doc.md", "hello"), ("k/b.md", "x"), ("k/c.txt", "y")], "path string, text string")
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = spark.createDataFrame([(1, "k/My doc.md", sha("hello")), (2, "k/b.md", sha("z")), (3, "k/c.txt", sha("y")), (4, "k/d.md", "0")], "ord int, path string, sha256 string")
    good, bad = scans.knowledge_documents(files, want)
    assert [r["name"] for r in good.collect()] == ["001-My-doc.md"]
    assert {r["path"]: r["reason"] for r in bad.collect()} == {"k/b.md": "digest differs", "k/c.txt": "not Markdown", "k/d.md": "missing"}


def test_spans(spark):
    py = "def f():\n    def g():\n        pass\n\nasync def h():\n    return 1\n"
    assert spans.python_spans(py) == [("f", 1, 3), ("g", 2, 3), ("h", 5, 6)] and spans.python_spans("def (") is None
    ets = "function a(x: number): void {\n  // }\n  if (x) { b('}') }\n}\nclass C {\n  m(): string {\n    return `{`\n  }\n}\n"
    assert spans.brace_spans(ets) == [("a", 1, 4), ("m", 6, 8)] and spans.brace_spans("f() {") is None
    files = spark.createDataFrame([("a.py", py, "python"), ("b.py", "def (", "python"), ("c.go", "func f() {}", "go"), ("d.ets", ets, "arkts"), ("n.py", None, "python")], "path string, text string, language string")
    found = spans.function_spans(files)
    assert sorted((r["path"], r["name"], r["extraction_backend"]) for r in found.collect()) == [("a.py", "f", "python-ast"), ("a.py", "g", "python-ast"), ("a.py", "h", "python-ast"), ("d.ets", "a", "brace"), ("d.ets", "m", "brace")]
    assert {r["path"] for r in spans.uncovered_files(files, found).collect()} == {"b.py", "c.go", "n.py"}
    export = spark.createDataFrame([("c.go", "f", 1, 1)], "path string, name string, line_start int, line_end int")
    assert spans.function_spans(files, export).where("path = 'c.go'").first()["extraction_backend"] == "export"


def test_arrow_functions():
    ts = "export const f = async (a: number): Promise<void> => {\n  g(a)\n}\nconst h = (x) => x + 1\nlet k: Fn = <T>(x: T) => {\n}\nexport function* gen() {\n}\n"
    assert spans.brace_spans(ts) == [("f", 1, 3), ("k", 5, 6), ("gen", 7, 8)]


class Node:
    """A tree-sitter node, as far as spans are concerned."""

    def __init__(self, type_, line, end, children=(), name=None, value=None):
        self.type, self.start_point, self.end_point, self.children, self.parent = type_, (line, 0), (end, 0), list(children), None
        self.fields = {"name": name, "value": value}
        self.named_children = self.children
        for c in self.children:
            c.parent = self

    def child_by_field_name(self, name):
        return self.fields.get(name)


def test_tree_spans():
    raw = b"f g h"
    name = lambda k: type("Name", (), {"start_byte": 2 * k, "end_byte": 2 * k + 1})()
    arrow = lambda k, line: Node("variable_declarator", line, line, name=name(k), value=Node("arrow_function", line, line))
    one = Node("export_statement", 0, 9, [Node("lexical_declaration", 1, 8, [arrow(0, 2)])])
    two = Node("lexical_declaration", 10, 14, [arrow(1, 11), arrow(2, 12)])
    gen = Node("generator_function_declaration", 20, 22, name=name(0))
    assert spans.tree_spans(Node("program", 0, 30, [one, two, gen]), raw) == [("f", 1, 10), ("g", 12, 12), ("h", 13, 13), ("f", 21, 23)]


def test_store_integrity(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = lambda **kv: spark.createDataFrame(list(kv.items()), "path string, text string")
    store.publish(rows(a="1", b="2"), root, "c1", "p", 1, "s")
    held = spark.read.parquet(f"{root}/objects")
    again = held.where("text = '1'")
    again.write.mode("append").partitionBy("shard").parquet(f"{root}/objects")  # a second writer's copy
    assert {r["path"]: r["text"] for r in store.restore(spark, root).collect()} == {"a": "1", "b": "2"} and store.restore(spark, root).count() == 2
    bad = spark.createDataFrame([(held.where("text = '1'").first()["sha256"], 1, "x", "zz")], "sha256 string, size long, text string, shard string")
    bad.write.mode("append").partitionBy("shard").parquet(f"{root}/objects")
    with pytest.raises(store.CorruptObject):
        store.publish(rows(a="1"), root, "c2", "p", 2, "s")
    with pytest.raises(ValueError):
        store.restore(spark, root, "c2")


@pytest.mark.parametrize("point", store.POINTS)
def test_crash_points(spark, tmp_path, point):
    root = str(tmp_path / "store")
    rows = lambda **kv: spark.createDataFrame(list(kv.items()), "path string, text string")
    files = lambda: {r["path"]: r["text"] for r in store.restore(spark, root).collect()}
    store.publish(rows(a="1", b="2", c="2"), root, "c1", "p", 1, "s")
    with pytest.raises(store.Crash):
        store.publish(rows(a="1", b="3"), root, "c2", "q", 2, "s", crash=point)
    assert files() == {"a": "1", "b": "2", "c": "2"}  # a head whose record is still committing doesn't count
    store.publish(rows(a="1", b="3"), root, "c2", "q", 2, "s")
    assert files() == {"a": "1", "b": "3"} and store.head(spark, root) == "c2"
    assert store.problems(spark, root, "c2").count() == 0 and store.corrupt_objects(spark, f"{root}/objects").count() == 0
    assert spark.read.parquet(f"{root}/objects").count() == 3


def test_reports(spark, tmp_path):
    commits = spark.createDataFrame([(2, "b", "later"), (1, "a", "first")], "ord int, id string, subject string")
    report = store.intent_report(commits, spark.createDataFrame([("x", "M")], "path string, change string"), "why").first()["report"]
    assert report.index("first") < report.index("later") and "- M x" in report and report.endswith("why\n")
    path = str(tmp_path / "log")
    store.append_log(commits, path)
    store.append_log(commits, path)
    assert spark.read.parquet(path).count() == 4
    store.reset(spark, str(tmp_path), ("log", "none"))
    assert not store.exists(spark, path)


def test_stream_equals_batch(spark, tmp_path):
    from veriframe.operators.ledger import fold_events
    from veriframe.streaming import jobs

    events = spark.createDataFrame([(f"j{k % 5}", k, ("start", "fail", "retry", "complete", "noop")[k * 7 % 5]) for k in range(60)], "job_id string, seq int, action string").withColumn("ts", F.timestamp_seconds(F.col("seq"))).withColumn("failure_class", F.lit("output"))
    for part in range(3):  # three files in time order, taken one a batch
        events.where((F.col("seq") >= 20 * part) & (F.col("seq") < 20 * part + 20)).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    raw = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.upsert_latest(jobs.job_status_stream(raw), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = jobs.latest_states(spark.read.parquet(str(tmp_path / "out")))
    names = ["job_id", "status", "attempts", "ignored"]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, fold_events(events).select(*names).collect()))


def test_stream_leases(spark, tmp_path):
    from veriframe.streaming import jobs

    for part, rows in enumerate(([("a", 50_000, "start"), ("b", 50_000, "start")], [("b", 50_100, "complete"), ("d", 60_000, "start")], [("c", 70_000, "start")])):
        spark.createDataFrame(rows, "job_id string, seq int, action string").withColumn("ts", F.timestamp_seconds(F.col("seq"))).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    schema = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).schema
    raw = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.upsert_latest(jobs.job_status_stream(raw, lease_seconds=900, delay="1 minute"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["job_id"]: r["status"] for r in jobs.latest_states(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert (got["a"], got["b"]) == ("retryable", "succeeded")


def test_stream_leases_by_event_time(spark, tmp_path):
    """However a job's events are cut into batches, its leases end at the same events; a timer is due when the watermark reaches it."""
    import random

    from veriframe.operators.ledger import Job
    from veriframe.streaming import jobs

    r = random.Random(1)
    rows, now = [], 100_000
    for k in range(120):
        now += r.choice([10, 200, 500])
        rows.append((f"j{r.randrange(4)}", k, r.choice(["start", "start", "complete", "fail", "retry"]), now))
    rows += [("edge", 998, "start", now - 900), ("young", 999, "start", now - 899), ("last", 1000, "start", now + 60)]
    want = {}
    for job, _, action, at in sorted(rows, key=lambda x: x[1]):
        own, last = want.get(job, (Job(), None))
        if last is not None and at >= last + 900 and own.status == "running":
            own.apply("fail", "interrupted", False, None, 5, 3)
        own.apply(action, "execution", False, None, 5, 3)
        want[job] = own, at
    for own, at in want.values():
        if at + 900 <= now and own.status == "running":
            own.apply("fail", "interrupted", False, None, 5, 3)
    for parts in (1, 4):
        place = tmp_path / f"p{parts}"
        events = spark.createDataFrame(rows, "job_id string, seq int, action string, at int").withColumn("ts", F.timestamp_seconds("at")).withColumn("failure_class", F.lit("execution")).drop("at")
        for part in range(parts):
            events.where(f"seq >= {part * 1001 // parts} and seq < {(part + 1) * 1001 // parts}" if parts == 1 else f"least(seq, 119) div 30 = {part}").coalesce(1).write.parquet(str(place / f"in/{part}"))
        raw = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(place / "in"))
        jobs.upsert_latest(jobs.job_status_stream(raw, lease_seconds=900, delay="1 minute"), str(place / "out"), str(place / "cp"))
        got = {x["job_id"]: (x["status"], x["attempts"], x["ignored"]) for x in jobs.latest_states(spark.read.parquet(str(place / "out"))).collect()}
        assert got == {k: (j.status, j.attempts, j.ignored) for k, (j, _) in want.items()}
    assert (want["edge"][0].status, want["young"][0].status) == ("retryable", "running")


def test_stream_receipts(spark, tmp_path):
    """Of identical receipts the first passes, one with another payload too."""
    from veriframe.streaming import jobs

    schema = "job_id string, attempt int, payload string, received_at timestamp"
    rows = [("a", 1, "x", 0), ("a", 1, "x", 5), ("a", 1, "y", 9), ("a", 2, "x", 9), ("b", 1, None, 9)]
    spark.createDataFrame(rows, "job_id string, attempt int, payload string, t int").select("job_id", "attempt", "payload", F.timestamp_seconds("t").alias("received_at")).write.parquet(str(tmp_path / "in"))
    stream = jobs.first_receipts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    jobs.run_to_table(stream.select("job_id", "attempt", "payload"), "first_receipts", str(tmp_path / "cp"), "append")
    assert sorted(map(tuple, spark.table("first_receipts").collect()), key=repr) == sorted([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "x"), ("b", 1, None)], key=repr)


def test_jdbc_graph(spark):
    """A graph store read over JDBC, from the database that Spark brings along."""
    from veriframe.sources.scans import jdbc_graph

    url, driver = "jdbc:derby:memory:graph;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    for name, kinds in (("nodes", ["function", "method", "class"]), ("edges", ["calls", "imports", "instantiates"])):
        spark.createDataFrame([(k, x) for k, x in enumerate(kinds)], "id int, kind string").write.jdbc(url, name, "overwrite", {"driver": driver, "createTableColumnTypes": "kind VARCHAR(40)"})
    nodes, edges = jdbc_graph(spark, url, driver)
    assert sorted(r["id"] for r in nodes.collect()) == [0, 1] and sorted(r["id"] for r in edges.collect()) == [0, 2]


@pytest.mark.parametrize("point", ["after_rows", "after_pointer", "write"])
def test_rows_are_replaced_whole(spark, tmp_path, point):
    """A writer that is lost at any point leaves the old rows or the new ones, and old versions go later."""
    from veriframe.sources import shared

    path, rows = str(tmp_path / "rows"), lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    read = lambda: sorted(r["v"] for r in shared.replaced_rows(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        shared.replaced_rows(spark, path)
    shared.replace_rows(rows(1, 2, 3), path)
    held = shared.replaced_rows(spark, path)
    lost = rows(4, 5).select(F.when(F.col("v") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).alias("v")) if point == "write" else rows(4, 5)
    with pytest.raises(Exception, match="lost|after"):
        shared.replace_rows(lost, path, crash=point)
    assert read() == ([4, 5] if point == "after_pointer" else [1, 2, 3])
    assert shared.replace_rows(rows(6), path) == (3 if point == "after_pointer" else 2) and read() == [6]
    assert sorted(r["v"] for r in held.collect()) == [1, 2, 3]  # a reader that came before keeps its rows
    assert shared.drop_old_rows(spark, path) == []  # too young
    assert shared.drop_old_rows(spark, path, older_than=0) and read() == [6] and len(shared.names_in(spark, f"{path}/versions")) == 1
    assert len(shared.names_in(spark, f"{path}/pointers")) == 1 and shared.replace_rows(rows(7), path) > 2 and read() == [7]  # numbers go on


def together(n, act):
    """Results (or errors) of n calls at one time."""
    import threading
    from concurrent.futures import ThreadPoolExecutor

    gate = threading.Barrier(n)

    def one(k):
        gate.wait()
        try:
            return act(k)
        except Exception as error:  # noqa: BLE001
            return error

    with ThreadPoolExecutor(n) as pool:
        return list(pool.map(one, range(n)))


def test_files_are_created_once(spark, tmp_path):
    from veriframe.sources import shared

    for k in range(20):
        got = together(8, lambda i, k=k: shared.create_once(spark, f"{tmp_path}/f{k}", f"{i}" * 1000))
        assert got.count(True) == 1 and shared.content_of(spark, f"{tmp_path}/f{k}") == f"{got.index(True)}" * 1000
    assert shared.names_in(spark, str(tmp_path)) == sorted(f"f{k}" for k in range(20)) and shared.content_of(spark, f"{tmp_path}/none") is None


def test_writers_at_one_time(spark, tmp_path):
    from veriframe.sources import shared

    path = str(tmp_path / "rows")
    got = together(4, lambda k: shared.replace_rows(spark.createDataFrame([(k,)], "v int"), path))
    assert sorted(got) == [1, 2, 3, 4] and shared.replaced_rows(spark, path).first()["v"] == got.index(4)


def test_locks(spark, tmp_path):
    import datetime as dt

    from veriframe.sources import locks

    root, start = str(tmp_path / "lock"), dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    after = lambda seconds: start + dt.timedelta(seconds=seconds)
    won = lambda got: [x for x in got if isinstance(x, locks.Lock)]
    got = together(8, lambda k: locks.acquire(spark, root, f"o{k}", now=start))
    assert len(won(got)) == 1 and sum(isinstance(x, locks.Held) for x in got) == 7
    first = won(got)[0]
    assert locks.holds(spark, first) and locks.current(spark, root).owner == first.owner
    with pytest.raises(locks.Held):
        locks.acquire(spark, root, "x", now=after(899))
    locks.heartbeat(spark, first, now=after(800))
    with pytest.raises(locks.Held):
        locks.acquire(spark, root, "x", now=after(1600))
    second = won(together(8, lambda k: locks.acquire(spark, root, f"p{k}", now=after(1800))))  # the lease has run out
    assert len(second) == 1 and second[0].number == 2 and not locks.holds(spark, first)
    with pytest.raises(locks.Held):
        locks.heartbeat(spark, first, now=after(1801))
    assert locks.release(spark, first) and locks.holds(spark, second[0])  # it gives back only its own
    third = won(together(8, lambda k: locks.acquire(spark, root, f"q{k}", run_status="succeeded", now=after(1801))))
    assert len(third) == 1 and locks.release(spark, third[0]) and not locks.release(spark, third[0])
    assert locks.acquire(spark, root, "last", now=after(1802)).number == 4


def test_publishers_at_one_time(spark, tmp_path):
    """Two publishers behind one head: one is told so, and both heads are never there; a claim whose publisher is gone is taken over."""
    root = str(tmp_path / "store")
    rows = lambda **kv: spark.createDataFrame(list(kv.items()), "path string, text string")
    files = lambda: {r["path"]: r["text"] for r in store.restore(spark, root).collect()}
    store.publish(rows(a="1"), root, "c1", "p", 1, "s")
    got = together(2, lambda k: store.publish(rows(a=f"{k}"), root, f"d{k}", "q", 2, "s"))
    done = [k for k in range(2) if got[k] is None]
    assert [type(x) for k, x in enumerate(got) if k not in done] == [store.Conflict] * (2 - len(done)) and done
    assert store.head(spark, root) == f"d{done[-1]}" or len(done) == 2
    chain = {r["checkpoint_id"]: r["previous_checkpoint_id"] for r in store.records(spark, root).where("status = 'complete'").collect()}
    assert len(chain) == 1 + len(done) and len(set(chain.values())) == len(chain)  # each follows another one
    with pytest.raises(store.Crash):
        store.publish(rows(a="8"), root, "e", "r", 3, "s", crash="after_head")
    with pytest.raises(store.Conflict):
        store.publish(rows(a="9"), root, "f", "r", 3, "s")
    store.publish(rows(a="9"), root, "f", "r", 3, "s", take_over=True)
    assert files() == {"a": "9"} and store.head(spark, root) == "f" and {r["checkpoint_id"]: r["status"] for r in store.records(spark, root).collect()}["e"] == "abandoned"
    store.publish(rows(a="8"), root, "e", "r", 3, "s")  # it comes back, and has to claim a place anew
    assert store.head(spark, root) == "e" and files() == {"a": "8"}
