"""References in documents to symbols and files of the graph, and whether they still hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.sources.graph import Graph

#: What stands between single backquotes and looks like a name or a path.
REFERENCE = r"(?<!`)`([A-Za-z_][A-Za-z0-9_./:]{2,200})`(?!`)"


def extract(docs: DataFrame, text: str = "value", key: str = "doc") -> DataFrame:
    """(doc, line, ref): every reference with its line, fenced blocks left out."""
    prose = F.regexp_replace(text, r"(?s)```.*?```", "")
    lines = docs.select(key, F.posexplode(F.split(prose, "\n")).alias("line", "said"))
    return lines.select(F.col(key).alias("doc"), (F.col("line") + 1).alias("line"), F.explode(F.regexp_extract_all("said", F.lit(REFERENCE), F.lit(1))).alias("ref"))


def judge(refs: DataFrame, g: Graph) -> DataFrame:
    """(doc, line, ref, state): ok for one file or name, ambiguous for several, gone for none."""
    names = g.nodes.where("kind <> 'File'").select("qualified_name", "name").distinct()
    known = names.selectExpr("qualified_name as ref", "qualified_name as target").union(names.selectExpr("name as ref", "qualified_name")).union(g.files.selectExpr("path as ref", "path")).distinct()
    n = known.groupBy("ref").agg(F.countDistinct("target").alias("n"))
    return refs.join(n, "ref", "left").select("doc", "line", "ref", F.when(F.col("n") == 1, "ok").when(F.col("n") > 1, "ambiguous").otherwise("gone").alias("state"))
