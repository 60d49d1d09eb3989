"""Nine analytic templates with closed parameters. Rows are cut only after the whole aggregate is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.functions import columns as C
from tierwalk.functions.vocabulary import TYPE_KINDS
from tierwalk.sources.graph import Graph


def _source_language(g: Graph) -> DataFrame:
    return g.files.select(F.col("path").alias("file_path"), F.col("language").alias("source_language"))


def tier_mix(g: Graph) -> DataFrame:
    """Edges by kind, language of source and of target, and tier.

    Only linked edges are moved to their targets, and counted by file there; a file's language joins its counts.
    """
    first = g.first_nodes().join(g.files, F.col("file_path") == F.col("path")).select(F.col("qualified_name").alias("target_qname"), F.col("language").alias("target_language"))
    edges = g.edges.select("kind", "file_path", "target_qname", "confidence_tier")
    by = ["kind", "file_path", "target_language", "confidence_tier", "open"]
    linked = edges.where("target_qname is not null").join(first, "target_qname", "left").withColumn("target_language", F.coalesce("target_language", F.lit("-"))).withColumn("open", F.lit(False))
    rest = edges.where("target_qname is null").withColumn("target_language", F.lit("-")).withColumn("open", F.lit(True))
    cells = linked.groupBy(*by).agg(F.count("*").alias("n")).union(rest.groupBy(*by).agg(F.count("*").alias("n")))
    joined = cells.join(_source_language(g), "file_path")
    out = joined.groupBy("kind", "source_language", "target_language").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("confidence_tier") == "HEURISTIC", F.col("n")).otherwise(0)).alias("heuristic"), F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)).alias("unlinked"))
    return out.withColumn("heuristic_share", C.share("heuristic", "n")).withColumn("unlinked_share", C.share("unlinked", "n"))


def no_referrer(g: Graph, kind: str, prefix: str = "", language: str | None = None) -> DataFrame:
    """Symbols of a kind that nothing but themselves and containment points at, and whether some edge still mentions them."""
    edges = g.edges.where("kind <> 'CONTAINS'")
    if language:
        edges = edges.join(_source_language(g).where(F.col("source_language") == language), "file_path", "left_semi")
    referred = edges.where("target_qname is not null and source_qname <> target_qname").select(F.col("target_qname").alias("qualified_name")).distinct()
    mentioned = edges.select(F.col("target_raw").alias("raw")).where("raw is not null").distinct()
    symbols = g.nodes.where((F.col("kind") == kind) & F.col("file_path").startswith(prefix)).select("qualified_name", "name", "file_path")
    alone = symbols.join(referred, "qualified_name", "left_anti")
    by_name = alone.join(mentioned.withColumnRenamed("raw", "name"), "name", "left_semi").select("qualified_name")
    by_qname = alone.join(mentioned.withColumnRenamed("raw", "qualified_name"), "qualified_name", "left_semi").select("qualified_name")
    marks = by_name.union(by_qname).distinct().withColumn("m", F.lit(True))
    return alone.join(marks, "qualified_name", "left").select("qualified_name", "file_path", F.when(F.col("m"), "no_edge_but_mentioned").otherwise("no_edge_no_mention").alias("evidence"))


def calls_by_module(g: Graph, target_glob: str) -> DataFrame:
    """Calls into names that match a glob, by the caller's two upper directories."""
    hits = g.edges.where("kind = 'CALLS'").where(F.col("target_qname").rlike(C.glob(target_glob)))
    return hits.groupBy(F.substring_index("file_path", "/", 2).alias("module")).agg(F.count("*").alias("calls"), F.countDistinct("source_qname").alias("callers"))


def untested_types(g: Graph) -> DataFrame:
    """Types that no edge from a test reaches; reaching a member reaches what contains it."""
    tests = g.nodes.where("is_test").select(F.col("qualified_name").alias("source_qname")).distinct()
    hit = g.linked().where("kind <> 'CONTAINS'").join(tests, "source_qname", "left_semi").select("target_qname").distinct()
    reached = hit.select(F.explode(F.array_append(C.containers("target_qname"), F.col("target_qname"))).alias("qualified_name")).distinct()
    return g.nodes.where(F.col("kind").isin(*TYPE_KINDS) & ~F.col("is_test")).select("qualified_name", "file_path").join(reached, "qualified_name", "left_anti")


def resolved_share(g: Graph) -> DataFrame:
    calls = g.edges.where("kind = 'CALLS'").groupBy(F.substring_index("file_path", "/", 2).alias("module"))
    out = calls.agg(F.count("*").alias("calls"), F.count_if((F.col("confidence_tier") == "RESOLVED") & F.col("target_qname").isNotNull()).alias("resolved"), F.count_if(F.col("target_qname").isNull()).alias("unlinked"))
    return out.withColumn("share", C.share("resolved", "calls"))


def includes_by_dir(g: Graph) -> DataFrame:
    return g.edges.where("kind = 'INCLUDES'").groupBy(C.top_dir().alias("dir"), "confidence_tier").agg(F.count("*").alias("n"))


def multi_defined(g: Graph) -> DataFrame:
    return g.nodes.where("kind <> 'File'").groupBy("qualified_name", "kind").agg(F.count("*").alias("definitions"), F.min(F.struct("is_test", "file_path")).alias("m")).where("definitions > 1").select("qualified_name", "kind", "definitions", F.col("m.file_path").alias("live_file"))


def variant_pairs(g: Graph, suffix: str) -> DataFrame:
    """Pairs of names where one ends with the suffix and the other is the same without it, and only one is referred to."""
    used = g.linked().where("kind <> 'CONTAINS'").select(F.col("target_qname").alias("qualified_name")).distinct().withColumn("used", F.lit(True))
    names = g.nodes.where("kind in ('Class', 'Method', 'Function')").select("qualified_name").distinct().join(used, "qualified_name", "left").na.fill(False, ["used"])
    long = names.where(F.col("qualified_name").endswith(suffix)).select(F.expr(f"left(qualified_name, length(qualified_name) - {len(suffix)})").alias("stem"), F.col("qualified_name").alias("variant"), F.col("used").alias("variant_used"))
    return long.join(names.withColumnRenamed("qualified_name", "stem"), "stem").where("used <> variant_used").select("stem", "variant", F.col("used").alias("stem_used"), "variant_used")


TEMPLATES = {"tier_mix": tier_mix, "no_referrer": no_referrer, "unreferenced_objects": no_referrer, "calls_by_module": calls_by_module, "untested_classes": untested_types, "resolved_share": resolved_share, "includes_by_dir": includes_by_dir, "multi_defined": multi_defined, "variant_pairs": variant_pairs}


def compute(g: Graph, template: str, **params: str) -> DataFrame:
    """A template by name; unknown names and parameters are refused."""
    if template not in TEMPLATES:
        raise ValueError(f"no template {template!r}; there are {', '.join(TEMPLATES)}")
    allowed = set(TEMPLATES[template].__code__.co_varnames[1 : TEMPLATES[template].__code__.co_argcount])
    if set(params) - allowed:
        raise ValueError(f"{template} takes {sorted(allowed)}")
    return TEMPLATES[template](g, **params)
