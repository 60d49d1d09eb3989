"""What a walk may start from: names as asked and names in files, without those that no walk could be attributed to.

A name with several definitions is `ambiguous`, unless declared globs say which one lives; a name that a file brought is
`twinned` if another symbol of its kind has the same last part, since guesses would bring in that one's callers too. A name
that no node has takes the only one that ends with it, or is reported as what `lookups.meaning` says.

Edge cases: names asked twice and names also in an asked file count once; kinds that span files (namespaces) come with a
file only if no other file declares them; no names and no files give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.operators import definitions, lookups
from tierwalk.sources.graph import Graph

SPANNING = ("Namespace",)


def plan(g: Graph, paths: DataFrame, qnames: Sequence[str] = (), globs: Sequence[str] = ()) -> DataFrame:
    """(qname, state, from_path): `walk` for seeds, and why the others are none."""
    spark = g.files.sparkSession
    held = {r.qualified_name for r in g.nodes.where(F.col("qualified_name").isin(*qnames)).select("qualified_name").distinct().collect()} if qnames else set()
    asked, lost = [q for q in dict.fromkeys(qnames) if q in held], []
    for q in dict.fromkeys(qnames):
        if q in held:
            continue
        rows = lookups.meaning(g, q).collect()
        if rows[0].state == "ambiguous":
            sole = [r.qualified_name for r in lookups.bare_subject(g, q).collect() if r.sole]
            rows = rows if not sole else []
            asked += sole
        elif rows[0].state == "resolved_unique":
            asked.append(rows[0].qualified_name)
            rows = []
        lost += [(q, rows[0].state, False)] if rows else []
    named = spark.createDataFrame([(q,) for q in dict.fromkeys(asked)], "qname string").withColumn("from_path", F.lit(False))
    where = g.nodes.groupBy("qualified_name").agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("definitions"))
    mine = g.nodes.join(paths.toDF("file_path"), "file_path", "left_semi").join(where, "qualified_name").where(~F.col("kind").isin(*SPANNING) | (F.col("files") == 1))
    brought = mine.select(F.col("qualified_name").alias("qname")).distinct().join(named, "qname", "left_anti").withColumn("from_path", F.lit(True))
    seeds = named.union(brought)
    several = where.where("definitions > 1").select(F.col("qualified_name").alias("qname"), F.lit(True).alias("several"))
    live = definitions.states(g, globs).where("state = 'live'").select(F.col("qualified_name").alias("qname")).distinct().withColumn("live", F.lit(True))
    # One name and kind under two qualified names: twins of each other.
    kinds = g.nodes.select("name", "kind", F.col("qualified_name").alias("qname")).distinct()
    shared = kinds.groupBy("name", "kind").agg(F.min("qname").alias("a"), F.max("qname").alias("b")).where("a <> b").select("name", "kind")
    twins = kinds.join(shared, ["name", "kind"], "left_semi").select("qname").distinct().withColumn("twin", F.lit(True))
    marked = seeds.join(several, "qname", "left").join(live, "qname", "left").join(twins, "qname", "left")
    decided = F.coalesce(F.col("live") & ~F.col("from_path"), F.lit(False))
    state = F.when(F.col("several") & ~decided, "ambiguous").when(F.col("from_path") & F.coalesce("twin", F.lit(False)), "twinned").otherwise("walk")
    out = marked.select("qname", state.alias("state"), "from_path")
    return out.union(spark.createDataFrame(lost, "qname string, state string, from_path boolean")) if lost else out
