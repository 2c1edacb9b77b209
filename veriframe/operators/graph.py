"""Graph operators: frontier loops whose state is written to shared storage each round, so lineage stays short."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """df through checkpoint(), in the folder that the session's cluster names in spark.checkpoint.dir (where that is unset, a folder
    of its own on a local master, and an error on a cluster, whose executors would each write to their own disk)."""
    _shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """df as Parquet in the folder of saved(), and read again; what instead has stored goes, once df no longer needs it.

    Rows of saved() keep the size that Spark estimated for their plan, and a join's is the product of its sides': in a loop that joins a
    table with itself the number's digits double each round, and after some 25 it fills the driver. A stored table has its files' size."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(place(path))
    for old in {f.rsplit("/", 1)[0] for f in instead.inputFiles()} if instead is not None else ():
        files.delete(place(old), True)
    return spark.read.schema(df.schema).parquet(path)


def _shared(spark) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or local_folder(spark))
    return context.getCheckpointDir()


def local_folder(spark) -> str:
    """A folder of this machine, for sessions on a local master that name none."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/veriframe-{uuid.uuid4().hex}"


class Found:
    """Rows of all rounds of a loop, as saved tables of which two of about one size become one: each row is written as often as the
    number of rounds has binary digits at most, and a union has as many parts."""

    def __init__(self, first: DataFrame):
        self.parts = [(0, first)]

    def add(self, rows: DataFrame) -> None:
        self.parts.append((0, rows))
        while len(self.parts) > 1 and self.parts[-1][0] == self.parts[-2][0]:
            (k, a), (_, b) = self.parts.pop(), self.parts.pop()
            self.parts.append((k + 1, saved(b.unionByName(a))))

    def all(self) -> DataFrame:
        out = self.parts[0][1]
        for _, part in self.parts[1:]:
            out = out.unionByName(part)
        return out


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id and depth (fewest steps from a seed, id) along edges (a, b). Each round joins the last round's new nodes only."""
    frontier, depth = saved(seeds.select("id").distinct().withColumn("depth", F.lit(0))), 0
    found = Found(frontier)
    while True:
        depth += 1
        step = edges.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = saved(step.join(found.all().select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return found.all()
        found.add(frontier)


def impact_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id and reason of all nodes connected with a seed (id) by edges (caller, callee) in either direction: file-change for seeds,
    else how the nearest reached it; a caller's reach (callee-propagation) before a callee's.

    Edges go both ways, so a frontier's neighbours lie in it, in the one before or in neither: only these two are compared, and
    each node is written once."""
    down = edges.select(F.col("caller").alias("a"), F.col("callee").alias("b"), F.lit("callee-propagation").alias("how"))
    up = edges.select(F.col("callee").alias("a"), F.col("caller").alias("b"), F.lit("caller-propagation").alias("how"))
    both = saved(down.unionByName(up).distinct())
    frontier = saved(seeds.select("id").distinct().withColumn("reason", F.lit("file-change")))
    found, before = Found(frontier), frontier
    while True:
        step = both.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("how").alias("reason"))
        seen = frontier.select("id") if before is frontier else frontier.select("id").unionByName(before.select("id"))
        before, frontier = frontier, saved(step.join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            return found.all()
        found.add(frontier)


def peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and layer of those nodes (id, distinct) that have no cycle above them: the longest path from a node without callers.

    A round sends the last layer's edges (caller, callee) only; a node joins the next layer when as many have arrived as it has callers."""
    own = edges.select("caller", "callee").where("caller <> callee").distinct()
    own = own.join(nodes.select(F.col("id").alias("caller")), "caller", "left_semi").join(nodes.select(F.col("id").alias("callee")), "callee", "left_semi")
    own = saved(own)
    callers = saved(own.groupBy(F.col("callee").alias("id")).agg(F.count(F.lit(1)).alias("callers")))
    frontier, layer = saved(nodes.join(callers, "id", "left_anti").select("id").withColumn("layer", F.lit(0))), 0
    found, arrived = Found(frontier), None
    while not frontier.isEmpty():
        layer += 1
        now = saved(own.join(frontier.select(F.col("id").alias("caller")), "caller", "left_semi").groupBy(F.col("callee").alias("id")).agg(F.count(F.lit(1)).alias("n")))
        if arrived is None:
            arrived = Found(now)
        else:
            arrived.add(now)
        total = arrived.all().join(now.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("n").alias("n"))
        frontier = saved(total.join(callers, "id").where("n = callers").select("id").withColumn("layer", F.lit(layer)))
        found.add(frontier)
    return found.all()


def acyclic_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and layer of nodes (id) of an acyclic graph: the longest path from a node without callers. A cycle is an error."""
    nodes = saved(nodes.select("id").distinct())
    out = saved(peeled(nodes, edges))
    if not nodes.join(out, "id", "left_anti").isEmpty():
        raise ValueError("the graph has a cycle; use caller_first_layers")
    return out


def layers_of(nodes: list, edges: list[tuple]) -> list[tuple[int, object]]:
    """(layer, node), caller first: each layer has the nodes without a caller left, or the least node left if all have one."""
    import heapq

    left, callees, callers = set(nodes), {}, {}
    for a, b in set(edges):
        if a in left and b in left and a != b:
            callees.setdefault(a, []).append(b)
            callers[b] = callers.get(b, 0) + 1
    heap, free, layer, out = sorted(left), sorted(n for n in left if not callers.get(n)), 0, []
    while left:
        if not free:
            while heap[0] not in left:
                heapq.heappop(heap)
            free = [heap[0]]
        out += [(layer, n) for n in free]
        left.difference_update(free)
        after = []
        for n in free:
            for m in callees.get(n, ()):
                callers[m] -= 1
                if not callers[m] and m in left:
                    after.append(m)
        free, layer = sorted(after), layer + 1
    return out


#: Edges that lie on and below cycles up to which a phase's are folded in one task; beyond it they're layered by rounds.
FOLD_EDGES = 1 << 20


def burst_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and burst of nodes (id: struct of phase and id) that all have a caller (edges: caller, callee, distinct, without loops).

    Layering takes the least node left whenever all have a caller left, and then, layer by layer, what this frees: a burst, named by the node
    that was taken. A node comes in the last burst of its callers, unless its own turn as the least one comes before:
    burst(v) = min(v, max of its callers' bursts), and of the solutions the greatest. So values fall from v on, and a round looks at callees of
    nodes whose value fell only. A node's value is the least of those written for it."""
    edges = saved(edges)
    fallen = saved(nodes.select("id", F.col("id.id").alias("burst")))
    found, first = Found(fallen), True
    while True:
        hit = edges.select("callee").distinct() if first else edges.join(fallen.select(F.col("id").alias("caller")), "caller", "left_semi").select("callee").distinct()
        first = False
        need = edges.join(hit, "callee", "left_semi")
        asked = need.select(F.explode(F.array("caller", "callee")).alias("id")).distinct()
        held = found.all().join(asked, "id", "left_semi").groupBy("id").agg(F.min("burst").alias("burst"))
        top = need.join(held.withColumnRenamed("id", "caller"), "caller").groupBy(F.col("callee").alias("id")).agg(F.max("burst").alias("top"))
        now = F.least(F.col("id.id"), F.col("top"))
        fallen = saved(top.join(held, "id").where(now < F.col("burst")).select("id", now.alias("burst")))
        if fallen.isEmpty():
            return found.all().groupBy("id").agg(F.min("burst").alias("burst"))
        found.add(fallen)


def _before(rows: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """group, order and the sum of the sizes of the group's rows in front (before), by ranges: a group may lie in many tasks."""
    from pyspark.sql import Window

    placed = saved(rows.select(group, order, size).repartitionByRange(group, order).withColumn("p__", F.spark_partition_id()))
    parts = placed.groupBy(group, "p__").agg(F.sum(size).alias("s__"))
    front = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "p__", F.coalesce(F.sum("s__").over(front(Window.partitionBy(group).orderBy("p__"))), F.lit(0)).alias("f__"))
    own = F.coalesce(F.sum(size).over(front(Window.partitionBy(group, "p__").orderBy(order))), F.lit(0))
    return placed.withColumn("o__", own).join(parts, [group, "p__"]).select(group, order, (F.col("f__") + F.col("o__")).cast("int").alias("before"))


def layers_by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id (struct of phase and id) and layer, from 0, of nodes that all have a caller, as layers_of gives them, by joins alone.

    Within a burst a node's layer is its longest way from the burst's first node, and bursts follow one another in the order of these."""
    bursts = saved(burst_of(nodes, edges))
    of = lambda k: bursts.select(F.col("id").alias(k), F.col("burst").alias(f"{k}_burst"))
    inner = edges.join(of("caller"), "caller").join(of("callee"), "callee").where("caller_burst = callee_burst and callee.id <> callee_burst")
    places = saved(peeled(nodes.select("id"), inner.select("caller", "callee")).join(bursts, "id").select("id", F.col("id.phase").alias("phase"), "burst", "layer"))
    lengths = places.groupBy("phase", "burst").agg((F.max("layer") + 1).alias("length"))
    return places.join(_before(lengths, "phase", "burst", "length"), ["phase", "burst"]).select("id", (F.col("before") + F.col("layer")).alias("layer"))


def caller_first_layers(nodes: DataFrame, edges: DataFrame, fold_edges: int = FOLD_EDGES) -> DataFrame:
    """phase, id and layer of nodes (phase, id; not null), by edges (caller, callee) within a phase; others don't count.

    Nodes without cycles above them get their layer by frontier rounds over the whole graph. What is left (nodes on and below cycles) is
    folded in a task a phase where it has fold_edges edges in all at most, and layered by rounds (layers_by_rounds) beyond: rounds
    cost jobs, a fold memory; the layers are the same."""
    of = lambda k, phase: nodes.select(F.col("phase").alias(phase), F.col("id").alias(k))
    nodes = saved(nodes.select("phase", "id").distinct())
    within = saved(edges.select("caller", "callee").where("caller <> callee").distinct().join(of("caller", "phase"), "caller").join(of("callee", "q"), "callee").where("phase = q").select("phase", "caller", "callee"))
    own = lambda c: F.struct("phase", c)  # noqa: E731  a node may be in several phases
    names = nodes.select(own(F.col("id").alias("id")).alias("id"))
    done = peeled(names, within.select(own(F.col("caller").alias("id")).alias("caller"), own(F.col("callee").alias("id")).alias("callee")))
    done = saved(done.select("id.phase", "id.id", "layer"))
    left = saved(nodes.join(done, ["phase", "id"], "left_anti"))
    start = done.groupBy("phase").agg((F.max("layer") + 1).alias("start"))
    rest = within.join(left.select("phase", F.col("id").alias("caller")), ["phase", "caller"], "left_semi").join(left.select("phase", F.col("id").alias("callee")), ["phase", "callee"], "left_semi")
    rest = saved(rest)
    if rest.limit(fold_edges + 1).count() > fold_edges:
        below = layers_by_rounds(left.select(own("id").alias("id")), rest.select(own(F.col("caller").alias("id")).alias("caller"), own(F.col("callee").alias("id")).alias("callee")))
        below = below.select("id.phase", "id.id", "layer").join(start, "phase", "left")
        return done.unionByName(below.select("phase", "id", (F.col("layer") + F.coalesce("start", F.lit(0))).cast("int").alias("layer")))
    none = F.lit(None).cast(nodes.schema["id"].dataType)
    rows = left.select("phase", F.col("id").alias("a"), none.alias("b")).unionByName(rest.select("phase", F.col("caller").alias("a"), F.col("callee").alias("b")))
    rows = rows.join(start, "phase", "left").withColumn("start", F.coalesce("start", F.lit(0)))

    def fold(key, table):
        pairs = list(zip(table.column("a").to_pylist(), table.column("b").to_pylist()))
        out, first = layers_of([a for a, b in pairs if b is None], [(a, b) for a, b in pairs if b is not None]), table.column("start")[0].as_py()
        return pa.table({"phase": pa.array([key[0].as_py()] * len(out), table.schema.field("phase").type), "id": pa.array([n for _, n in out], table.schema.field("a").type), "layer": pa.array([first + k for k, _ in out], pa.int32())})

    kind = dict(rows.dtypes)
    return done.unionByName(rows.groupBy("phase").applyInArrow(fold, f"phase {kind['phase']}, id {kind['a']}, layer int"))


def resolve_phases(plan: DataFrame, aliases: DataFrame) -> DataFrame:
    """plan (phase, name, depends_on array of text, files): empty phases go, the others are numbered from 1 by phase, and dependencies
    (number, id, name or phase-N, by aliases: alias, phase) stay where they name an earlier one."""
    from pyspark.sql import Window

    full = plan.where(F.size("files") > 0)
    number = full.select("phase", F.dense_rank().over(Window.orderBy("phase")).alias("ordinal"))  # as many rows as a plan has phases
    names = aliases.join(number, "phase").select("alias", F.col("ordinal").alias("to"))
    named = full.join(number, "phase").select("ordinal", "name", F.explode_outer("depends_on").alias("alias")).join(names, "alias", "left")
    return named.groupBy("ordinal", "name").agg(F.array_sort(F.collect_set(F.when(F.col("to") < F.col("ordinal"), F.col("to")))).alias("depends_on"))


def phase_aliases(plan: DataFrame) -> DataFrame:
    """alias and phase: the phase's number, phase-N, its id and its name (columns phase, id, name) as text."""
    texts = F.array(F.col("phase").cast("string"), F.concat(F.lit("phase-"), F.col("phase").cast("string")), F.col("id").cast("string"), F.col("name"))
    return plan.select("phase", F.explode(texts).alias("alias")).where("alias is not null").dropDuplicates(["alias"])


def _with_before(layers: DataFrame, **columns: str) -> DataFrame:
    """layers (phase, layer, distinct; not null) with columns of the phase's layer before under new names (new=column)."""
    from pyspark.sql import Window

    over = Window.partitionBy("phase").orderBy("layer")  # one row a layer
    return layers.select("phase", "layer", *(F.lag(c).over(over).alias(new) for new, c in columns.items()))


def previous_layer(batches: DataFrame) -> DataFrame:
    """batches (phase, layer, job_id) with the jobs of the phase's previous layer that has any: their number (n_deps) and ids (depends_on).

    A layer is counted and gathered once, not once for each job behind it, and its number goes without its ids: jobs and the jobs
    before them are never paired, and who reads no depends_on makes no array."""
    layers = batches.where("phase is not null and layer is not null").groupBy("phase", "layer").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("job_id")).alias("jobs"))
    linked = batches.join(_with_before(layers, n="n", jobs="jobs"), ["phase", "layer"])
    none = F.array().cast(layers.schema["jobs"].dataType)
    return linked.select("phase", "layer", "job_id", F.coalesce("n", F.lit(0)).alias("n_deps"), F.coalesce("jobs", none).alias("depends_on"))


def specification_jobs(batches: DataFrame, phase_deps: DataFrame, context_job: str) -> DataFrame:
    """job_id and depends_on (rows): the context job, the last layer's jobs of the phases that the phase depends on (phase, depends_on),
    and all jobs of the previous layer of the phase."""
    last = batches.groupBy("phase").agg(F.max("layer").alias("layer"))
    terminal = batches.join(last, ["phase", "layer"]).select(F.col("phase").alias("on"), F.col("job_id").alias("depends_on"))
    links = phase_deps.select("phase", F.explode("depends_on").alias("on")).join(terminal, "on").select("phase", "depends_on")
    across = batches.select("phase", "job_id").join(links, "phase").select("job_id", "depends_on")
    before = _with_before(batches.where("phase is not null and layer is not null").select("phase", "layer").distinct(), was="layer")
    inner = batches.join(before, ["phase", "layer"]).join(batches.select("phase", F.col("layer").alias("was"), F.col("job_id").alias("depends_on")), ["phase", "was"]).where("depends_on is not null").select("job_id", "depends_on")
    return batches.select("job_id", F.lit(context_job).alias("depends_on")).unionByName(across).unionByName(inner).distinct()


def verification_jobs(verify: DataFrame, spec: DataFrame) -> DataFrame:
    """verify and spec (job_id, artifacts): job_id and the spec jobs that own one of its artifacts."""
    owner = spec.select(F.col("job_id").alias("dep"), F.explode("artifacts").alias("artifact"))
    own = verify.select("job_id", F.explode("artifacts").alias("artifact"))
    return own.join(owner, "artifact").groupBy("job_id").agg(F.array_sort(F.collect_set("dep")).alias("depends_on"))


