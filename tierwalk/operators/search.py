"""Ranked text search with exactness bands, and typo correction by bounded edit distance."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwalk.functions import columns as C
from tierwalk.sources.graph import Graph


def _hit(query: str) -> Column:
    q = query.lower()
    if len(q) < 3:
        return F.lower("name").startswith(q) | F.lower("qualified_name").startswith(q)
    return F.lower("name").contains(q) | F.lower("qualified_name").contains(q) | F.lower("file_path").contains(q)


def hits(g: Graph, query: str, kind: str | None = None, namespace: str | None = None, path: str | None = None, without_tests: bool = False) -> DataFrame:
    out = g.nodes.where(_hit(query))
    if kind:
        out = out.where(F.col("kind") == kind)
    if namespace:
        out = out.where(C.in_namespace("qualified_name", namespace))
    if path:
        out = out.where(C.path_under("file_path", path))
    return out.where("not is_test") if without_tests else out


def search(g: Graph, query: str, limit: int = 20, offset: int = 0, **narrow: str) -> DataFrame:
    """Direct matches first, then hits that no direct parent contains, then by length and name: a total order."""
    found = hits(g, query, **narrow).withColumn("direct", C.direct_match(query))
    parents = found.where("direct").select(F.col("qualified_name").alias("parent")).distinct().withColumn("demoted", F.lit(True))
    ranked = found.withColumn("parent", C.container()).join(parents, "parent", "left").withColumn("demoted", F.coalesce("demoted", F.lit(False)))
    return ranked.orderBy(F.desc("direct"), "demoted", F.length("qualified_name"), "qualified_name", "file_path", "kind").select("kind", "name", "qualified_name", "file_path", "direct", "demoted").offset(offset).limit(limit)


def did_you_mean(g: Graph, query: str, kind: str | None = None, limit: int = 5) -> DataFrame:
    """Names within the bound of the query's last part: length and surviving pieces rule out most before the distance is taken."""
    tail = C.name_tail(query).lower()
    bound = C.edit_limit(tail)
    names = g.nodes.where(F.col("kind") == kind) if kind else g.nodes
    low = F.lower("name")
    near = names.where(F.length("name").between(len(tail) - bound, len(tail) + bound)).where(reduce(or_, [low.contains(p) for p in C.edit_pieces(tail, bound)]))
    near = near.select("name").distinct().withColumn("distance", F.levenshtein(F.lower("name"), F.lit(tail), bound)).where("distance >= 0")
    return near.orderBy("distance", "name").limit(limit)


def by_tokens(g: Graph, query: str, limit: int = 5) -> DataFrame:
    """Symbols by how many of the query's words their names hold."""
    text = F.lower(F.concat_ws(" ", "name", "qualified_name"))
    score = reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in C.name_tokens(query)] or [F.lit(0)])
    return g.nodes.where("kind <> 'File'").withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "qualified_name", "file_path", "kind").select("qualified_name", "file_path", "score").limit(limit)


def verdict(g: Graph, query: str, **narrow: str) -> tuple[str, DataFrame]:
    """Why the rows are what they are: ok, substring, another separator, excluded by a filter, near words, or nothing."""
    rows = search(g, query, **narrow)
    top = rows.limit(1).collect()
    if top:
        exact = not rows.where(C.exact_match(query)).isEmpty() or not rows.where("direct").isEmpty()
        return ("ok" if exact else "substring_match"), rows
    other = C.separator_variant(query)
    if other and not search(g, other, **narrow).isEmpty():
        return "separator_normalised", search(g, other, **narrow)
    for name in ("kind", "path"):
        if narrow.get(name) and not hits(g, query, **{k: v for k, v in narrow.items() if k != name}).isEmpty():
            return f"{name}_excluded", rows
    words = by_tokens(g, query)
    return ("token_candidates", words) if not words.isEmpty() else ("no_matches", rows)
