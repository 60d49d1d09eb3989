"""Bounded walks over the graph. Only RESOLVED edges expand; weaker neighbours are reported, never expanded.

Each hop is one join of the frontier with the edges, written to the shared folder, so a plan never grows with the depth.
Edges are cut to the walked kinds and columns once and lie in buckets by the end a hop looks up: a small frontier reads the
buckets of its names only, and a large one is moved to the edges, which stay where they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierwalk.functions import columns as C
from tierwalk.functions.vocabulary import CALLER_KINDS, DECAY, FLOOR, IMPACT_KINDS, IMPACT_WEIGHTS, TEST_KINDS
from tierwalk.session import materialise, shared_folder
from tierwalk.sources.graph import Graph


@dataclass(frozen=True)
class Walk:
    """Rows, and how the walk ended."""

    rows: DataFrame
    truncated: bool
    depth_exhausted: bool
    skipped: int = 0
    seeds_dropped: int = 0


def _edges(g: Graph, kinds: Sequence[str]) -> DataFrame:
    return g.linked().where(F.col("kind").isin(*kinds)).select("source_qname", "target_qname", "kind", F.coalesce("confidence_tier", F.lit("RESOLVED")).alias("tier"), "file_path", "line")


#: Names of a frontier that go into the filter of a scan; more are joined.
FEW = 200
#: Edges of a bucket, about.
BUCKET_ROWS = 1_000_000


class Steps:
    """Edges in buckets by one of their ends."""

    def __init__(self, edges: DataFrame, key: str):
        spark = edges.sparkSession
        edges = materialise(edges, "edges")
        n = int(max(spark.sparkContext.defaultParallelism, edges.count() // BUCKET_ROWS))
        name = f"tierwalk_steps_{uuid.uuid4().hex}"
        edges.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
        self.edges, self.key = spark.table(name), key

    def of(self, frontier: DataFrame, column: str, few: list | None) -> DataFrame:
        """Edges of the frontier's names (its `column`), with the frontier's other columns; `few` are its rows if they are few."""
        if few is not None:
            near = self.edges.where(F.col(self.key).isin([r[column] for r in few]))
            return near.join(F.broadcast(frontier.withColumnRenamed(column, self.key)), self.key)
        return self.edges.join(frontier.withColumnRenamed(column, self.key), self.key)


def _few(frontier: DataFrame) -> list | None:
    """The rows of a small frontier, else nothing; one job says whether it is empty, small or large."""
    rows = frontier.limit(FEW + 1).collect()
    return rows if len(rows) <= FEW else None


def impact(g: Graph, seeds: DataFrame, depth: int = 2, max_nodes: int = 500, kinds: Sequence[str] = IMPACT_KINDS, without_tests: bool = False) -> Walk:
    """Blast radius: best score of each name that leads to a seed; score falls by kind and hop.

    A better score replaces, an equal one does not; tier and depth come from the rows of the best score. A name expands only
    if its best RESOLVED score is the one it keeps. Each wave is cut to `max_nodes` by seed, score and name.
    """
    weight = F.create_map(*[x for k in kinds for x in (F.lit(k), F.lit(IMPACT_WEIGHTS[k]))])
    edges = _edges(g, kinds)
    if without_tests:
        tests = g.nodes.where("is_test").select(F.col("qualified_name").alias("source_qname")).distinct()
        edges = edges.join(tests, "source_qname", "left_anti")
    steps = Steps(edges.select("source_qname", "target_qname", "kind", "tier").distinct(), "target_qname")
    start = materialise(seeds.toDF("qname").distinct(), "impact-seeds")
    dropped = max(0, start.count() - max_nodes)
    best = start.select("qname", F.lit(1.0).alias("score"), F.lit(0).alias("depth"), F.lit("RESOLVED").alias("tier"), F.lit(True).alias("is_seed"))
    if dropped:
        best = best.orderBy("qname").limit(max_nodes)
    best = materialise(best, "impact")
    frontier, skipped, cut, hop = best.select("qname", "score", "depth"), 0, False, 0
    few = _few(frontier)
    while hop < depth and few != []:
        hop += 1
        step = steps.of(frontier, "qname", few).select(F.col("source_qname").alias("qname"), (F.col("score") * weight[F.col("kind")] * DECAY).alias("score"), (F.col("depth") + 1).alias("depth"), "tier").where(F.col("score") >= FLOOR - 1e-12)
        step = materialise(step.groupBy("qname", "score", "tier").agg(F.min("depth").alias("depth")), "impact-step")
        skipped += step.where("tier <> 'RESOLVED'").select("qname").distinct().count()
        rows = step.groupBy("qname").agg(F.max(F.struct("score", (-F.col("depth")).alias("d"))).alias("top"), F.max(F.struct("score", "tier")).alias("t"), F.max(F.when(F.col("tier") == "RESOLVED", F.col("score"))).alias("proven"))
        rows = rows.select("qname", F.col("top.score").alias("score2"), (-F.col("top.d")).alias("depth2"), F.col("t.tier").alias("tier2"), "proven")
        better = F.col("score").isNull() | (F.col("score2") > F.col("score"))
        merged = best.join(rows, "qname", "full_outer").select("qname", F.when(better, F.col("score2")).otherwise(F.col("score")).alias("score"), F.when(better, F.col("depth2")).otherwise(F.col("depth")).alias("depth"), F.when(better, F.col("tier2")).otherwise(F.col("tier")).alias("tier"), F.coalesce("is_seed", F.lit(False)).alias("is_seed"), "proven")
        kept = materialise(merged.orderBy(F.desc("is_seed"), F.desc("score"), "qname").limit(max_nodes + 1), "impact")
        cut = cut or kept.count() > max_nodes
        kept = kept.orderBy(F.desc("is_seed"), F.desc("score"), "qname").limit(max_nodes)
        best = kept.drop("proven")
        frontier = kept.where("proven is not null and abs(proven - score) < 1e-12").select("qname", "score", "depth")
        few = _few(frontier)
    return Walk(best, cut or dropped > 0, hop == depth and few != [], skipped, dropped)


def reach(g: Graph, seeds: DataFrame, depth: int | None = None, max_nodes: int | None = None, kinds: Sequence[str] = IMPACT_KINDS, with_containers: bool = True) -> Walk:
    """Forward closure: (qname, depth, state); `unproven` names were met only over weaker edges."""
    steps = Steps(_edges(g, kinds).select("source_qname", "target_qname", "tier").distinct(), "source_qname")
    seen = materialise(seeds.toDF("qname").distinct().select("qname", F.lit(0).alias("depth")), "reach")
    frontier, weak, hop, cut = seen, None, 0, False
    few = _few(frontier)
    while (depth is None or hop < depth) and few != []:
        hop += 1
        step = steps.of(frontier.select("qname"), "qname", few).select(F.col("target_qname").alias("qname"), "tier").distinct()
        # One write a hop; what was seen is the union of the hops' tables, written as one now and then.
        new = materialise(step.join(seen, "qname", "left_anti"), "reach-new")
        more = new.where("tier <> 'RESOLVED'").select("qname")
        weak = more if weak is None else weak.union(more)
        frontier = new.where("tier = 'RESOLVED'").select("qname", F.lit(hop).alias("depth"))
        few = _few(frontier)
        seen = seen.union(frontier)
        if hop % 8 == 0:
            seen, weak = materialise(seen, "reach"), materialise(weak.distinct(), "reach-weak")
        if max_nodes is not None and seen.count() > max_nodes:
            cut = True
            seen = materialise(seen.orderBy("depth", "qname").limit(max_nodes), "reach")
            frontier = materialise(frontier.join(seen, "qname", "left_semi"), "reach-new")
            few = _few(frontier)
    ended = depth is not None and few != []
    if with_containers:
        up = seen.select(F.explode(C.containers("qname")).alias("qname"), "depth")
        seen = materialise(seen.union(up).groupBy("qname").agg(F.min("depth").alias("depth")), "reach")
    rows = seen.withColumn("state", F.lit("reached"))
    if weak is not None:
        rows = rows.union(weak.distinct().join(seen, "qname", "left_anti").select("qname", F.lit(None).cast("int"), F.lit("unproven")))
    return Walk(rows, cut, ended)


def orphans(g: Graph, seeds: DataFrame, kinds: Sequence[str] = IMPACT_KINDS) -> DataFrame:
    """Names that nothing from the seeds reaches, and whether anything points at them at all."""
    walk = reach(g, seeds, kinds=kinds).rows.select(F.col("qname").alias("qualified_name"))
    inbound = _edges(g, kinds).select(F.col("target_qname").alias("qualified_name")).distinct().withColumn("hit", F.lit(True))
    names = g.nodes.where("kind <> 'File'").select("qualified_name").distinct()
    return names.join(walk, "qualified_name", "left_anti").join(inbound, "qualified_name", "left").select("qualified_name", F.when(F.col("hit"), "unreachable_from_roots").otherwise("no_inbound").alias("why"))


def _search(edges: DataFrame, a: str, b: str, depth: int, max_nodes: int) -> tuple[str, DataFrame]:
    """Breadth first with one predecessor a name, the first by kind, source, file and line."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(a, 0, None, None, None)], "qname string, depth int, source string, kind string, tier string")
    frontier, hop = seen.select("qname"), 0
    order = Window.partitionBy("target_qname").orderBy("kind", "source_qname", "file_path", "line")
    while hop < depth:
        hop += 1
        step = edges.join(frontier.withColumnRenamed("qname", "source_qname"), "source_qname").join(seen.select(F.col("qname").alias("target_qname")), "target_qname", "left_anti")
        new = step.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(F.col("target_qname").alias("qname"), F.lit(hop).alias("depth"), F.col("source_qname").alias("source"), "kind", "tier")
        new = materialise(new, "path-new")
        if new.isEmpty():
            return "no_path", seen
        seen = materialise(seen.union(new), "path")
        if not new.where(F.col("qname") == b).isEmpty():
            return "path", seen
        if seen.count() > max_nodes:
            return "incomplete_budget", seen
        frontier = new.select("qname")
    return "incomplete", seen


def explain_path(g: Graph, a: str, b: str, depth: int = 6, max_nodes: int = 100_000) -> tuple[str, list[tuple[int, str, str, str, str]]]:
    """Status and the hops (number, source, target, kind, tier) of a shortest path: over RESOLVED edges, else over any."""
    known = {r.qualified_name for r in g.nodes.where(F.col("qualified_name").isin(a, b)).select("qualified_name").distinct().collect()}
    if {a, b} - known:
        return "unknown", []
    if a == b:
        return "path", []
    edges = materialise(_edges(g, IMPACT_KINDS), "path-edges")
    proven, seen = _search(edges.where("tier = 'RESOLVED'"), a, b, depth, max_nodes)
    status = proven
    if proven == "incomplete_budget":
        return "incomplete", []
    if proven != "path":
        status, seen = _search(edges, a, b, depth, max_nodes)
        status = {"path": "unproven", "incomplete_budget": "incomplete"}.get(status, status)
        if status == "no_path" and proven == "incomplete":
            status = proven
    if status not in ("path", "unproven"):
        return status, []
    hops, at = [], b
    while at != a:  # one keyed read a hop, at most `depth`
        r = seen.where(F.col("qname") == at).first()
        hops.append((r.depth, r.source, at, r.kind, r.tier))
        at = r.source
    return status, hops[::-1]


def required(g: Graph, seed: str, targets: Sequence[str], depth: int = 5) -> tuple[bool, int]:
    """Whether a target is reached over RESOLVED edges, and how many weaker or unlinked edges were met before."""
    seen = reach(g, g.nodes.where(F.col("qualified_name") == seed).select("qualified_name"), depth, with_containers=False).rows.where("state = 'reached'")
    if not seen.where(F.col("qname").isin(*targets)).isEmpty():
        return True, 0
    out = g.edges.join(seen.select(F.col("qname").alias("source_qname")), "source_qname", "left_semi").where(F.col("kind").isin(*IMPACT_KINDS))
    return False, out.where("target_qname is null or confidence_tier <> 'RESOLVED'").count()


def callers_within(g: Graph, qname: str, hops: int) -> DataFrame:
    """Callers of callers: (source, hop, tier); RESOLVED ones expand."""
    edges = materialise(_edges(g, CALLER_KINDS).select("source_qname", "target_qname", "tier").distinct(), "callers-edges")
    frontier = edges.sparkSession.createDataFrame([(qname,)], "target_qname string")
    seen = None
    for hop in range(1, hops + 1):
        step = edges.join(F.broadcast(frontier) if hop == 1 else frontier, "target_qname").groupBy("source_qname").agg(F.min(C.tier_rank("tier")).alias("rank")).withColumn("hop", F.lit(hop))
        new = materialise(step if seen is None else step.join(seen, "source_qname", "left_anti"), "callers-new")
        seen = materialise(new if seen is None else seen.union(new), "callers")
        frontier = new.where("rank = 0").select(F.col("source_qname").alias("target_qname"))
    return seen.select("source_qname", "hop", C.tier_of("rank").alias("confidence_tier"))


def include_walk(g: Graph, path: str, direction: str = "imports", hops: int = 2) -> DataFrame:
    edges = g.linked().where("kind = 'INCLUDES'").select(F.col("source_qname").alias("a"), F.col("target_qname").alias("b")).distinct()
    if direction != "imports":
        back = edges.selectExpr("b as a", "a as b")
        edges = back if direction == "imported_by" else edges.union(back).distinct()
    edges = materialise(edges, "includes")
    seen = edges.sparkSession.createDataFrame([(path, 0)], "path string, depth int")
    frontier = seen.select("path")
    for hop in range(1, hops + 1):
        new = materialise(edges.join(frontier.toDF("a"), "a").select(F.col("b").alias("path")).distinct().join(seen, "path", "left_anti").withColumn("depth", F.lit(hop)), "includes-new")
        seen = materialise(seen.union(new), "includes-seen")
        frontier = new.select("path")
    return seen.where("depth > 0")


def subtree_report(g: Graph, subtree: str) -> DataFrame:
    """Edges into and out of a path subtree by direction, tier and whether the target is declared on one side only."""
    under = C.path_under("file_path", subtree)
    sides = g.nodes.groupBy(F.col("qualified_name").alias("target_qname")).agg(F.max(under).alias("inside"), F.max(~under).alias("outside"))
    crossing = g.linked().select("target_qname", "confidence_tier", under.alias("from_inside")).groupBy("target_qname", "confidence_tier", "from_inside").agg(F.count("*").alias("n")).join(sides, "target_qname")
    inbound = crossing.where("not from_inside and inside").select(F.lit("inbound").alias("direction"), "confidence_tier", (~F.col("outside")).alias("attributable"), "n")
    outbound = crossing.where("from_inside and outside").select(F.lit("outbound").alias("direction"), "confidence_tier", (~F.col("inside")).alias("attributable"), "n")
    return inbound.union(outbound).groupBy("direction", "confidence_tier", "attributable").agg(F.sum("n").alias("n"))


def dynamic_bridges(g: Graph, subtree: str) -> DataFrame:
    """Files with a DYNAMIC edge onto a name inside and no RESOLVED edge of the same file onto it."""
    inside = g.nodes.where(C.path_under("file_path", subtree)).select(F.col("qualified_name").alias("target_qname")).distinct()
    hits = g.linked().join(inside, "target_qname", "left_semi")
    proven = hits.where("confidence_tier = 'RESOLVED'").select("file_path", "target_qname").distinct()
    return hits.where("confidence_tier = 'DYNAMIC'").select("file_path", "target_qname").distinct().join(proven, ["file_path", "target_qname"], "left_anti").groupBy("file_path").agg(F.count("*").alias("bridges"))


def candidate_tests(g: Graph, changed: DataFrame, depth: int = 2) -> DataFrame:
    """Tests that use names of changed files, directly or through production code; all tiers expand, tests never do."""
    steps = Steps(_edges(g, TEST_KINDS).select("source_qname", "target_qname", "tier"), "target_qname")
    tests = materialise(g.nodes.where("is_test").select(F.col("qualified_name").alias("source_qname")).distinct(), "tests")
    frontier = g.nodes.where("not is_test").join(changed.toDF("file_path"), "file_path", "left_semi").select(F.col("qualified_name").alias("target_qname")).distinct()
    walked, found = frontier, None
    for hop in range(1, depth + 1):
        step = materialise(steps.of(frontier, "target_qname", None).groupBy("source_qname").agg(F.min(C.tier_rank("tier")).alias("rank")), "tests-step")
        hits = step.join(tests, "source_qname", "left_semi").withColumn("hop", F.lit(hop))
        found = materialise(hits if found is None else found.union(hits.join(found, "source_qname", "left_anti")), "tests-found")
        frontier = materialise(step.join(tests, "source_qname", "left_anti").select(F.col("source_qname").alias("target_qname")).join(walked, "target_qname", "left_anti"), "tests-next")
        walked = materialise(walked.union(frontier), "tests-walked")
    return found.select("source_qname", "hop", C.tier_of("rank").alias("confidence_tier"))


