"""Changes between two graphs, symbol by symbol and file by file, and incremental replacement of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.functions import columns as C
from tierwalk.operators.relational import module_edges
from tierwalk.sources.graph import Graph


def symbol_snapshot(g: Graph) -> DataFrame:
    """(qualified_name, file_path, name, kind, signature, body): body stands for the distinct outgoing (kind, raw name) of the symbol.

    Their number and two sums of their hashes, whatever the order: a symbol with very many edges is counted in parts.
    """
    said = g.edges.select(F.col("source_qname").alias("qualified_name"), "file_path", "kind", "target_raw").distinct()
    said = said.groupBy("qualified_name", "file_path").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("kind", "target_raw")).alias("x"), F.sum(F.xxhash64("target_raw", "kind") % 1_000_000_007).alias("s"))
    body = said.select("qualified_name", "file_path", F.concat_ws(":", "n", "x", "s").alias("body"))
    return g.nodes.where("kind <> 'File'").select("qualified_name", "file_path", "name", "kind", F.md5(F.concat_ws("|", "kind", "name", F.col("line_start").cast("string")).cast("binary")).alias("signature")).distinct().join(body, ["qualified_name", "file_path"], "left")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qualified_name, file_path, verdict) of every symbol of either snapshot: compared in place first, then by body for moves."""
    b, a = before.alias("b"), after.alias("a")
    same = b.join(a, ["qualified_name", "file_path"], "full_outer").select("qualified_name", "file_path", F.col("b.signature").alias("s1"), F.col("a.signature").alias("s2"), F.col("b.body").alias("b1"), F.col("a.body").alias("b2"))
    verdict = F.when(F.col("s1").isNull(), "added").when(F.col("s2").isNull(), "gone").when(F.col("s1") != F.col("s2"), "signature_changed").when(~F.col("b1").eqNullSafe(F.col("b2")), "body_changed").otherwise("unchanged")
    judged = same.withColumn("verdict", verdict)
    added = judged.where("verdict = 'added' and b2 is not null").groupBy("qualified_name", F.col("b2").alias("b1")).agg(F.count("*").alias("n"))
    moved = judged.where("verdict = 'gone'").join(added, ["qualified_name", "b1"], "left")
    gone = moved.select("qualified_name", "file_path", F.when(F.col("n") == 1, "moved").when(F.col("n") > 1, "unknown").otherwise("removed").alias("verdict"))
    return judged.where("verdict <> 'gone'").select("qualified_name", "file_path", "verdict").union(gone)


def replace_files(g: Graph, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> Graph:
    """The graph with all rows of the given files replaced: anti joins on the file, then the new rows."""
    paths = files.select(F.col("path").alias("file_path")).distinct()
    kept = g.files.join(files.select("path").distinct(), "path", "left_anti")
    return Graph(
        kept.unionByName(files.select(*g.files.columns)),
        g.nodes.join(paths, "file_path", "left_anti").select(*g.nodes.columns).unionByName(nodes.select(*g.nodes.columns)),
        g.edges.join(paths, "file_path", "left_anti").select(*g.edges.columns).unionByName(edges.select(*g.edges.columns)),
    )


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of file tables: added, removed or changed by hash."""
    both = before.select("path", F.col("hash").alias("h1")).join(after.select("path", F.col("hash").alias("h2")), "path", "full_outer")
    return both.where("not h1 <=> h2").select("path", F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "removed").otherwise("changed").alias("change"))


def architecture(g: Graph) -> DataFrame:
    """(section, key, n): files of each top directory, symbols of each kind, dependencies between top directories."""
    files = g.files.groupBy(C.top_dir("path").alias("key")).agg(F.count("*").alias("n")).select(F.lit("layer").alias("section"), "key", "n")
    kinds = g.nodes.groupBy(F.col("kind").alias("key")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("section"), "key", "n")
    pairs = module_edges(g).groupBy(F.concat(C.top_dir("file_path"), F.lit(" -> "), C.top_dir("target_file")).alias("key")).agg(F.count("*").alias("n"))
    return files.union(kinds).union(pairs.select(F.lit("matrix").alias("section"), "key", "n"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(section, key, before, after, change) of what differs between two architectures."""
    both = before.withColumnRenamed("n", "before").join(after.withColumnRenamed("n", "after"), ["section", "key"], "full_outer").where("not `before` <=> `after`")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return both.select("section", "key", "before", "after", change.alias("change"))
