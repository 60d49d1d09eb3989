"""Which definition of a name counts, what implements or extends it, and models of types and tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierwalk.functions import columns as C
from tierwalk.functions.vocabulary import CALLER_KINDS, INHERIT_KINDS, TYPE_KINDS
from tierwalk.operators.relational import edges_to, one_a_source
from tierwalk.session import materialise
from tierwalk.sources.graph import Graph


def precedence_rank(path: str, globs: Sequence[str]) -> Column:
    """The number of the first glob that a path matches, or null."""
    ranks = [F.when(F.col(path).rlike(C.glob(x)), i) for i, x in enumerate(globs)]
    return F.coalesce(*ranks) if ranks else F.lit(None).cast("int")


def version(path: str, pattern: str) -> Column:
    """The numbers of a dotted version in a path, without trailing zeros."""
    found = F.regexp_extract(path, pattern, 1)
    parts = F.transform(F.filter(F.split(found, "[._]"), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("long"))
    last = F.array_max(F.transform(parts, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    return F.slice(parts, 1, F.coalesce(last, F.lit(0)))


def states(g: Graph, globs: Sequence[str] = ()) -> DataFrame:
    """(qualified_name, file_path, state) of names with several definitions: test_copy, live, superseded, or unranked.

    One production definition wins over test copies; of several, the first declared glob wins if only one matches it best.
    """
    defs = g.nodes.where("kind not in ('File', 'Namespace')").select("qualified_name", "file_path", "is_test").distinct()
    defs = defs.withColumn("rank", precedence_rank("file_path", globs))
    by_name = Window.partitionBy("qualified_name")
    live = F.when(~F.col("is_test"), F.col("rank"))
    marked = defs.withColumn("n", F.count("*").over(by_name)).withColumn("production", F.count_if(~F.col("is_test")).over(by_name)).withColumn("best", F.min(live).over(by_name))
    marked = marked.where("n > 1").withColumn("winners", F.count_if(~F.col("is_test") & (F.col("rank") == F.col("best"))).over(by_name))
    state = F.when(F.col("is_test") & (F.col("production") > 0), "test_copy").when(F.col("production") == 1, "live").when((F.col("winners") == 1) & (F.col("rank") == F.col("best")), "live").when(F.col("winners") == 1, "superseded").otherwise("unranked")
    return marked.select("qualified_name", "file_path", state.alias("state"))


def implementations(g: Graph, qname: str) -> DataFrame:
    """Direct subtypes with their first declaration."""
    subs = g.linked().where(F.col("kind").isin(*INHERIT_KINDS) & (F.col("target_qname") == qname)).select(F.col("source_qname").alias("qualified_name"), "kind").distinct()
    return subs.join(g.first_nodes().select("qualified_name", "file_path"), "qualified_name", "left")


def descendants(g: Graph, qname: str, depth: int = 4) -> DataFrame:
    """(qualified_name, level) below a type."""
    down = materialise(g.linked().where(F.col("kind").isin(*INHERIT_KINDS)).select("source_qname", "target_qname").distinct(), "heirs")
    seen = down.sparkSession.createDataFrame([(qname, 0)], "qualified_name string, level int")
    frontier = seen
    for level in range(1, depth + 1):
        step = down.join(frontier.select(F.col("qualified_name").alias("target_qname")), "target_qname").select(F.col("source_qname").alias("qualified_name")).distinct()
        frontier = materialise(step.join(seen, "qualified_name", "left_anti").withColumn("level", F.lit(level)), "heirs-new")
        seen = materialise(seen.union(frontier), "heirs-seen")
    return seen.where("level > 0")


def member_callers(g: Graph, qname: str) -> DataFrame:
    """Callers of a type: of itself and of the members it contains, each once by its strongest edge."""
    members = g.linked().where((F.col("kind") == "CONTAINS") & (F.col("source_qname") == qname)).select("target_qname")
    targets = members.union(members.sparkSession.createDataFrame([(qname,)], "target_qname string")).distinct()
    hits = g.edges.where(F.col("kind").isin(*CALLER_KINDS)).join(targets, "target_qname", "left_semi")
    return one_a_source(hits).select("source_qname", "target_qname", "file_path", "line", "confidence_tier")


def class_model(g: Graph, qname: str) -> DataFrame:
    """Boxes and lines around a type: (role, source, target) for its parents, subtypes and members."""
    hit = g.linked().where(F.col("kind").isin("CONTAINS", *INHERIT_KINDS)).where((F.col("source_qname") == qname) | (F.col("target_qname") == qname))
    role = F.when(F.col("kind") == "CONTAINS", "member").when(F.col("source_qname") == qname, "parent").otherwise("subtype")
    return hit.select(role.alias("role"), "source_qname", "target_qname").distinct()


def table_model(g: Graph, column_cap: int = 50) -> DataFrame:
    """Tables with their columns and how often each side is read and written."""
    tables = g.nodes.where("kind = 'Table'").select(F.col("qualified_name").alias("table"), "file_path").distinct()
    columns = g.nodes.where("kind = 'Column'").select(C.container().alias("table"), F.col("name")).distinct().groupBy("table").agg(F.array_join(F.slice(F.array_sort(F.collect_list("name")), 1, column_cap), ",").alias("columns"))
    uses = g.linked().where("kind in ('READS', 'WRITES')").select(F.substring_index("target_qname", "::", 1).alias("table"), "kind").groupBy("table").agg(F.count_if(F.col("kind") == "READS").alias("reads"), F.count_if(F.col("kind") == "WRITES").alias("writes"))
    return tables.join(columns, "table", "left").join(uses, "table", "left").na.fill(0, ["reads", "writes"])


def unresolved_near(g: Graph, name: str, path: str, limit: int = 20) -> DataFrame:
    """Unlinked sites of a bare name, those that share most leading directories with a file first."""
    parts = F.split("file_path", "/")
    own = path.split("/")[:-1]
    same = reduce(lambda acc, i: F.when(F.slice(parts, 1, i) == F.array(*map(F.lit, own[:i])), i).otherwise(acc), range(1, len(own) + 1), F.lit(0))
    sites = g.edges.where(F.col("target_qname").isNull() & (F.col("target_raw") == name)).select("source_qname", "file_path", "line").distinct()
    return sites.withColumn("shared", same).orderBy(F.desc("shared"), "file_path", "line", "source_qname").limit(limit)


def owner_of(files: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, owner): the deepest declared directory above each path; `owners` is (dir, owner)."""
    up = files.select("path", F.posexplode(C.dirs("path")).alias("depth", "dir"))
    return up.join(owners, "dir").groupBy("path").agg(F.max_by("owner", "depth").alias("owner"))


def radius_by_module(rows: DataFrame, g: Graph) -> DataFrame:
    """A blast radius rolled up: symbols and best example of each top directory."""
    at = rows.where("not is_seed").join(g.first_nodes().select(F.col("qualified_name").alias("qname"), "file_path"), "qname")
    best = F.min(F.struct((-F.col("score")).alias("s"), "qname")).alias("b")
    return at.groupBy(F.substring_index("file_path", "/", 2).alias("module")).agg(F.count("*").alias("symbols"), F.count_if(F.col("tier") == "RESOLVED").alias("resolved"), best).select("module", "symbols", "resolved", F.col("b.qname").alias("example"))


def types_without_members(g: Graph) -> DataFrame:
    has = g.nodes.where("kind in ('Method', 'Column')").select(C.container().alias("qualified_name")).distinct()
    return g.nodes.where(F.col("kind").isin(*TYPE_KINDS)).select("qualified_name").distinct().join(has, "qualified_name", "left_anti")


def siblings(g: Graph, name: str, kind: str, qname: str) -> DataFrame:
    """Other definitions of the same name and kind."""
    return g.nodes.where((F.col("name") == name) & (F.col("kind") == kind) & (F.col("qualified_name") != qname)).select("qualified_name", "file_path").distinct()


def inbound_kinds(g: Graph, qname: str) -> DataFrame:
    return edges_to(g, [qname]).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("source_qname").alias("sources"))
