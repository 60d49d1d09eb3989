"""Rows from outside that hang on the graph: records, routes, keyed calls, ignore rules, column attributes, counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierwalk.functions import columns as C
from tierwalk.sources.graph import Graph


def attach(records: DataFrame, g: Graph) -> DataFrame:
    """(id, target, state) of records with `targets` arrays: linked, or dangling where no name or path is meant."""
    each = records.select("id", F.explode("targets").alias("target"))
    known = g.nodes.select(F.col("qualified_name").alias("target")).union(g.files.select("path")).distinct().withColumn("known", F.lit(True))
    return each.join(known, "target", "left").select("id", "target", F.when(F.col("known"), "linked").otherwise("dangling").alias("state"))


def ranked(records: DataFrame, radius: DataFrame, limit: int = 50) -> DataFrame:
    """Records on what a walk met, each once at its nearest carrier; `radius` is (qname, depth)."""
    each = records.select("id", F.explode("targets").alias("qname"))
    near = each.join(radius, "qname").groupBy("id").agg(F.min(F.struct("depth", "qname")).alias("m"))
    return near.select("id", F.col("m.depth").alias("distance"), F.col("m.qname").alias("carrier")).orderBy("distance", "id").limit(limit)


def select(records: DataFrame, wanted: Mapping[str, Sequence[str]], declared: Sequence[str]) -> DataFrame:
    """Records whose attribute map matches every wanted attribute with any of its values; undeclared attributes are refused."""
    if set(wanted) - set(declared):
        raise ValueError(f"declared attributes are {sorted(declared)}")
    out = records
    for name, values in wanted.items():
        out = out.where(F.arrays_overlap(F.col("attributes")[name], F.array(*map(F.lit, values))))
    return out


def match_routes(urls: DataFrame, routes: DataFrame, significant: Sequence[str]) -> DataFrame:
    """(url, route, how): routes by canonical key, then by `*` patterns, the longest pattern first.

    Exact keys are one equi join. Only urls it leaves meet the patterns, on the first path segment, so no cross join is made;
    patterns that start with `*` take part under the empty segment.
    """
    keyed = urls.select("url", C.canonical_url("url", significant).alias("key")).distinct()
    exact = keyed.join(routes.where("not contains(route, '*')").select(F.col("route").alias("key"), "route"), "key").select("url", "route", F.lit("exact").alias("how"))
    rest = keyed.join(exact.select("url"), "url", "left_anti")
    segment = F.split(F.substring_index("key", "?", 1), "/")[1]
    patterns = routes.where("contains(route, '*')").select("route", F.split("route", "/")[1].alias("first"))
    patterns = patterns.withColumn("first", F.when(F.contains(F.col("first"), F.lit("*")), "").otherwise(F.col("first")))
    asked = rest.withColumn("first", F.explode(F.array(segment, F.lit(""))))
    like = F.concat(F.lit("^\\Q"), F.replace(F.col("route"), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E$"))
    hits = asked.join(patterns, "first").where(F.regexp_like("key", like)).groupBy("url").agg(F.max(F.struct(F.length("route").alias("n"), "route")).alias("m"))
    return exact.union(hits.select("url", F.col("m.route"), F.lit("pattern")))


def nearest(names: DataFrame, asked: str, limit: int = 5) -> DataFrame:
    """Names by edit distance to the one asked."""
    return names.select("name").distinct().withColumn("distance", F.levenshtein("name", F.lit(asked))).orderBy("distance", "name").limit(limit)


@dataclass(frozen=True)
class KeyedCall:
    """Calls of `setter` carry a key at argument `arg`; the key fills `template` and gives an edge of `kind`."""

    setter: str
    arg: int
    template: str
    kind: str = "PROVIDES_VIEW_DATA"


def keyed_edges(g: Graph, rule: KeyedCall) -> DataFrame:
    """(kind, source_qname, target_raw, file_path, line) that a rule derives."""
    key = F.get("args", F.lit(rule.arg - 1))
    calls = g.edges.where((F.col("kind") == "CALLS") & F.col("args").isNotNull() & F.col("target_raw").rlike(C.glob(rule.setter))).where(key.isNotNull())
    return calls.select(F.lit(rule.kind).alias("kind"), "source_qname", F.replace(F.lit(rule.template), F.lit("{key}"), key).alias("target_raw"), "file_path", "line").distinct()


def ignored(files: DataFrame, rules: Sequence[str]) -> DataFrame:
    """(path, ignored): the last rule that matches decides; `!` takes back."""
    last = F.lit(None).cast("boolean")
    for rule in rules:
        negated, pattern = rule.startswith("!"), rule.lstrip("!")
        # A rule without an inner slash holds at any depth; one that ends in a slash means what lies beneath.
        glob = pattern if "/" in pattern.rstrip("/") else f"**/{pattern}"
        glob = glob.lstrip("/") + ("**" if glob.endswith("/") else "")
        hit = F.col("path").rlike(C.glob(glob)) | F.col("path").rlike(C.glob(glob.rstrip("/") + "/**"))
        last = F.when(hit, F.lit(not negated)).otherwise(last)
    return files.select("path", F.coalesce(last, F.lit(False)).alias("ignored"))


def census(files: DataFrame, suffixes: Sequence[str], rules: Sequence[str]) -> DataFrame:
    """Files by what becomes of them: kept, or why not. The buckets add up to all files."""
    ending = F.regexp_extract("path", r"\.([^./]*)$", 1)
    bucket = F.when(~ending.isin(*suffixes), "suffix").when(F.col("ignored"), "ignored").otherwise("kept")
    return ignored(files, rules).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def fold_columns(rows: DataFrame) -> DataFrame:
    """Sparse attributes of a column folded into its typed row.

    Rows are (qualified_name, data_type, nullable, identity, primary_key, file_path); names compare without case. The typed
    row (the first by file) takes what it lacks from the sparse ones and records where from; sparse rows leave.
    """
    key = F.lower("qualified_name")
    by = Window.partitionBy("key").orderBy(F.col("data_type").isNull(), "file_path")
    ranked_rows = rows.withColumn("key", key).withColumn("rn", F.row_number().over(by))
    extras = ranked_rows.where("data_type is null").groupBy("key").agg(*[F.max(c).alias(f"x_{c}") for c in ("nullable", "identity", "primary_key")], F.array_sort(F.collect_set("file_path")).alias("extras_from"))
    typed = ranked_rows.where("data_type is not null").join(extras, "key", "left")
    lone = ranked_rows.where("data_type is null").join(ranked_rows.where("data_type is not null").select("key").distinct(), "key", "left_anti")
    columns = ["qualified_name", "data_type", "nullable", "identity", "primary_key", "file_path"]
    folded = typed.select("qualified_name", "data_type", *[F.coalesce(c, f"x_{c}").alias(c) for c in ("nullable", "identity", "primary_key")], "file_path", "extras_from")
    return folded.union(lone.select(*columns, F.lit(None).cast("array<string>")))


def counters(events: DataFrame, key: str, field: str, values: Sequence[str]) -> DataFrame:
    """Counts of each field value a key, as columns: the values are named, so no extra job finds them."""
    return events.groupBy(key).pivot(field, list(values)).count().na.fill(0)
