"""Keyed lookups, pages, joins and censuses over the three relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierwalk.functions import columns as C
from tierwalk.functions.vocabulary import CALLER_KINDS, IMPACT_KINDS, INHERIT_KINDS, TYPE_KINDS
from tierwalk.sources.graph import Graph

NODE_ORDER = ("qualified_name", "file_path", "line_start", "kind")
EDGE_ORDER = ("source_qname", "kind", "target_raw", "file_path", "line", "confidence_tier")
EDGE_COLUMNS = ("kind", "source_qname", "target_qname", "target_raw", "file_path", "line", "confidence_tier")


# Reads of edges


def edges_to(g: Graph, targets: Sequence[str], kinds: Sequence[str] = (), tier: str | None = None, path: str | None = None, where: Column | None = None, without_tests: bool = False) -> DataFrame:
    """Edges into any of the targets; all filters reach the scan, tests leave by an anti join on their names."""
    out = g.edges.where(F.col("target_qname").isin(*targets))
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    if tier:
        out = out.where(C.tier_is(tier))
    if path:
        out = out.where(C.path_under("file_path", path))
    if where is not None:
        out = out.where(where)
    return without_test_sources(g, out) if without_tests else out


def without_test_sources(g: Graph, edges: DataFrame) -> DataFrame:
    tests = g.nodes.where("is_test").select(F.col("qualified_name").alias("source_qname")).distinct()
    return edges.join(tests, "source_qname", "left_anti")


def one_a_source(edges: DataFrame) -> DataFrame:
    """The strongest, then first edge of each source."""
    order = Window.partitionBy("source_qname").orderBy(C.tier_rank(), "file_path", "line", "kind", "target_raw")
    return edges.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def callers(g: Graph, qname: str, limit: int = 50) -> DataFrame:
    """Sources that call or construct a symbol, strongest tier first."""
    rows = one_a_source(edges_to(g, [qname], CALLER_KINDS)).select(*EDGE_COLUMNS)
    return rows.orderBy(C.tier_rank(), *EDGE_ORDER).limit(limit)


def edges_page(edges: DataFrame, limit: int, offset: int = 0, tier_first: bool = False) -> DataFrame:
    order = [C.tier_rank(), *EDGE_ORDER] if tier_first else EDGE_ORDER
    return edges.select(*EDGE_COLUMNS).orderBy(*order).offset(offset).limit(limit)


def edges_from(g: Graph, qname: str, kinds: Sequence[str] = ()) -> DataFrame:
    out = g.edges.where(F.col("source_qname") == qname)
    return out.where(F.col("kind").isin(*kinds)) if kinds else out


def call_lines(g: Graph, qname: str) -> DataFrame:
    """Sorted lines of the calls of each source and file."""
    return edges_to(g, [qname], CALLER_KINDS).groupBy("source_qname", "file_path").agg(F.array_join(F.array_sort(F.collect_set("line")), ",").alias("lines"))


def tier_census(g: Graph, qname: str) -> DataFrame:
    return edges_to(g, [qname]).groupBy("confidence_tier").agg(F.count("*").alias("n"))


def subtrees_of_callers(g: Graph, qname: str) -> DataFrame:
    return edges_to(g, [qname]).groupBy(C.top_dir().alias("subtree")).agg(F.count("*").alias("n"))


def test_census(g: Graph, qname: str) -> DataFrame:
    """Production and test sources of inbound edges, by the first declaration of the source."""
    first = g.first_nodes().select(F.col("qualified_name").alias("source_qname"), F.col("is_test").alias("t"))
    return edges_to(g, [qname]).join(first, "source_qname", "left").groupBy(F.coalesce("t", F.lit(False)).alias("is_test")).agg(F.count("*").alias("n"), F.countDistinct("source_qname").alias("sources"))


def argument_census(g: Graph, k: int) -> DataFrame:
    """Calls by what stands at an argument's place."""
    word = F.when(C.args_at(k, "absent"), "absent").when(C.args_at(k, "dynamic"), "dynamic").otherwise(F.get("args", F.lit(k - 1)))
    return g.edges.where("kind = 'CALLS' and args is not null").groupBy(word.alias("argument")).agg(F.count("*").alias("n"))


def statements(g: Graph, targets: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Edges onto the targets grouped to statements: best tier and the columns named."""
    hits = g.edges.where(F.col("kind").isin(*kinds)).join(targets.select(F.col("qualified_name").alias("target_qname")).distinct(), "target_qname", "left_semi")
    grouped = hits.groupBy("source_qname", "file_path", "line", "kind").agg(F.array_join(F.array_sort(F.collect_set("target_qname")), ",").alias("targets"), F.min(C.tier_rank()).alias("rank"))
    return grouped.withColumn("confidence_tier", C.tier_of("rank")).drop("rank")


def reads_naming_no_column(g: Graph, table: str) -> DataFrame:
    """Reads of a table with no column of it read by the same source on the same line."""
    reads = g.edges.where("kind = 'READS'")
    named = reads.where(F.col("target_qname").startswith(table + "::")).select("source_qname", "file_path", "line").distinct()
    return reads.where(F.col("target_qname") == table).select("source_qname", "file_path", "line").distinct().join(named, ["source_qname", "file_path", "line"], "left_anti")


def unlinked(g: Graph) -> DataFrame:
    """Unlinked edges by kind and what they name."""
    return g.edges.where("target_qname is null").groupBy("kind", "target_raw").agg(F.count("*").alias("n"))


# Reads of nodes


def batched(g: Graph, names: DataFrame, column: str, limit: int, fold: bool = False) -> DataFrame:
    """The first `limit` nodes of each asked name: (asked, rank and node columns)."""
    key = F.lower(column) if fold else F.col(column)
    asked = names.select(F.col("asked"), (F.lower("asked") if fold else F.col("asked")).alias("key")).distinct()
    order = Window.partitionBy("asked").orderBy(*NODE_ORDER)
    return g.nodes.withColumn("key", key).join(F.broadcast(asked), "key").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("key")


def outline(g: Graph, path: str, limit: int, offset: int = 0) -> DataFrame:
    return g.nodes.where(F.col("file_path") == path).orderBy("line_start", *NODE_ORDER).offset(offset).limit(limit)


def multiply_declared(g: Graph) -> DataFrame:
    """Names declared in several files: count and the first file."""
    return g.nodes.groupBy("qualified_name", "kind").agg(F.count("*").alias("n"), F.min("file_path").alias("first_file")).where("n > 1")


# Joins


def file_pairs(g: Graph) -> DataFrame:
    """Distinct (file, file it links to), declarations of a name in several files fanning out.

    Both sides are dealt out by the name before they are made distinct, so that the join moves neither again.
    """
    declared = g.nodes.select(F.col("qualified_name").alias("target_qname"), F.col("file_path").alias("target_file")).repartition("target_qname").distinct()
    return g.linked().select("file_path", "target_qname").repartition("target_qname").distinct().join(declared, "target_qname").select("file_path", "target_file").distinct()


def module_edges(g: Graph) -> DataFrame:
    return file_pairs(g).where("file_path <> target_file")


def module_edge_tiers(g: Graph) -> DataFrame:
    """File pairs with their strongest tier: pairs of names are reduced before they fan out to files, at either end.

    What is joined by a name is dealt out by it before it is reduced, so that the join does not move it again.
    """
    best = g.linked().select("source_qname", "target_qname", C.tier_rank().alias("rank")).repartition("source_qname").groupBy("source_qname", "target_qname").agg(F.min("rank").alias("rank"))
    at = g.nodes.select("qualified_name", "file_path").repartition("qualified_name").distinct()
    out = best.join(at.toDF("source_qname", "source_file"), "source_qname").select("source_file", "target_qname", "rank")
    out = out.repartition("target_qname").groupBy("source_file", "target_qname").agg(F.min("rank").alias("rank")).join(at.toDF("target_qname", "target_file"), "target_qname")
    out = out.where("source_file <> target_file").groupBy("source_file", "target_file").agg(F.min("rank").alias("rank"))
    return out.withColumn("confidence_tier", C.tier_of("rank")).drop("rank")


def include_neighbours(g: Graph, paths: DataFrame) -> DataFrame:
    links = g.linked().where("kind = 'INCLUDES'").select("source_qname", "target_qname")
    out = links.join(paths.toDF("source_qname"), "source_qname", "left_semi").select(F.col("target_qname").alias("path"))
    return out.union(links.join(paths.toDF("target_qname"), "target_qname", "left_semi").select("source_qname")).distinct()


def dependents(g: Graph, paths: DataFrame) -> DataFrame:
    """Files with an edge onto a name that the given files declare."""
    names = g.nodes.join(paths.toDF("file_path"), "file_path", "left_semi").select(F.col("qualified_name").alias("target_qname")).distinct()
    return g.linked().join(names, "target_qname", "left_semi").select("file_path").distinct()


def cross_language(g: Graph) -> DataFrame:
    """Linked edges from a file of one language onto names declared in another.

    Counted by file as soon as the target's language is known: edges are moved once, and a file's language joins its counts.
    """
    language = g.files.select(F.col("path").alias("file_path"), "language")
    target = g.nodes.join(language, "file_path").select(F.col("qualified_name").alias("target_qname"), F.col("language").alias("target_language")).distinct()
    cells = g.linked().select("kind", "file_path", "target_qname").join(target, "target_qname").groupBy("kind", "file_path", "target_language").agg(F.count("*").alias("n"))
    pairs = cells.join(language.withColumnRenamed("language", "source_language"), "file_path").where("source_language <> target_language")
    return pairs.groupBy("kind", "source_language", "target_language").agg(F.sum("n").alias("n"))


def parents(g: Graph) -> DataFrame:
    """Each type's parents in the order of the inheritance kinds."""
    rank = F.array_position(F.array(*map(F.lit, INHERIT_KINDS)), F.col("kind"))
    found = g.linked().where(F.col("kind").isin(*INHERIT_KINDS)).select("source_qname", F.struct(rank.alias("r"), F.col("target_qname").alias("t")).alias("p")).distinct()
    return found.groupBy("source_qname").agg(F.array_join(F.expr("transform(array_sort(collect_list(p)), x -> x.t)"), ",").alias("parents"))


# Censuses


def counts(g: Graph) -> DataFrame:
    f = g.files.agg(F.count("*").alias("files"), F.count_if("parsed_ok").alias("parsed"), F.count_if(~F.col("parsed_ok")).alias("failed"))
    return f.join(g.nodes.agg(F.count("*").alias("nodes"))).join(g.edges.agg(F.count("*").alias("edges")))


def edge_health(g: Graph) -> DataFrame:
    tier = C.tier_of(C.tier_rank()).alias("confidence_tier")
    return g.edges.groupBy(tier).agg(F.count("*").alias("n"), F.count("target_qname").alias("linked"), F.count_if(F.col("target_qname").isNull()).alias("unlinked"))


def language_census(g: Graph) -> DataFrame:
    """Tiers, links and kinds of the edges of each language, from one grouped scan."""
    language = g.files.select(F.col("path").alias("file_path"), "language")
    cells = g.edges.groupBy("file_path", "kind", "confidence_tier").agg(F.count("*").alias("n"), F.count("target_qname").alias("linked")).join(language, "file_path")
    return cells.groupBy("language").agg(*[F.sum(F.when(F.col("confidence_tier") == t, F.col("n")).otherwise(0)).alias(t.lower()) for t in ("RESOLVED", "HEURISTIC", "DYNAMIC")], F.sum("linked").alias("linked"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def file_kind_counts(g: Graph) -> DataFrame:
    return g.nodes.groupBy("file_path", "kind").agg(F.count("*").alias("n"))


def file_symbol_counts(g: Graph) -> DataFrame:
    return g.nodes.where("kind <> 'File'").groupBy("file_path").agg(F.count("*").alias("symbols"), F.count_if(F.col("kind").isin(*TYPE_KINDS)).alias("classes"))


def hubs(g: Graph, limit: int = 20) -> DataFrame:
    """Files by distinct files that depend on them."""
    pairs = module_edges(g)
    ends = F.array(F.struct(F.col("target_file").alias("file"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("file_path").alias("file"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    both = pairs.select(F.explode(ends).alias("e")).select("e.*")
    return both.groupBy("file").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out")).where("fan_in > 0").orderBy(F.desc("fan_in"), "file").limit(limit)


def largest_classes(g: Graph, limit: int = 20) -> DataFrame:
    """Types by methods of the same file that their name contains."""
    methods = g.nodes.where("kind = 'Method'").groupBy(C.container().alias("qualified_name"), "file_path").agg(F.count("*").alias("methods"))
    types = g.nodes.where(F.col("kind").isin(*TYPE_KINDS)).select("qualified_name", "file_path")
    return types.join(methods, ["qualified_name", "file_path"], "left").na.fill(0).orderBy(F.desc("methods"), "qualified_name", "file_path").limit(limit)


def dependency_edges(g: Graph) -> DataFrame:
    """Distinct linked pairs with their strongest tier, without loops."""
    pairs = g.linked().where("source_qname <> target_qname").groupBy("source_qname", "target_qname").agg(F.min(C.tier_rank()).alias("rank"))
    return pairs.withColumn("confidence_tier", C.tier_of("rank")).drop("rank")


def flow_edges(g: Graph, kinds: Sequence[str] = (*IMPACT_KINDS, "WRITES")) -> DataFrame:
    """Pairs and kinds with the strongest tier and the first line within that tier."""
    best = g.linked().where(F.col("kind").isin(*kinds)).groupBy("source_qname", "target_qname", "kind").agg(F.min(F.struct(C.tier_rank().alias("rank"), "line")).alias("m"))
    return best.select("source_qname", "target_qname", "kind", C.tier_of("m.rank").alias("confidence_tier"), F.col("m.line").alias("line"))


def universe(g: Graph) -> DataFrame:
    return g.nodes.select("qualified_name", "file_path").distinct()


def module_keys(g: Graph) -> DataFrame:
    """Dotted names a path can be imported by: all suffixes of the path without its ending."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    parts = F.split(stem, "/")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return g.files.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
