"""Connected components of a link table by alternating large and small stars.

Edge cases: repeated links and links both ways count once; a link of a node to itself is none; an empty table has no
components; a table that does not settle in the given rounds raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.llm.common import materialise


def _least(links: DataFrame) -> DataFrame:
    """(u, m): the least of each node and its neighbours; partial aggregates keep a node of many links cheap."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b): root is the least node it can reach.

    Each round is two joins on a node's key, which adaptive execution splits where a node has very many links, and is
    written to the shared folder. Stars end it after two rounds, chains after about the logarithm of their length.
    """
    at = materialise(links.selectExpr("a as u", "b as v").where("u <> v").distinct(), "links")
    before = None
    for i in range(rounds):
        both = at.union(at.selectExpr("v", "u"))
        large = both.join(_least(both), "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        down = large.selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct()
        small = down.join(_least(down), "u").selectExpr("v as u", "m as v").union(_least(down).selectExpr("u", "m as v"))
        at = materialise(small.where("u <> v").distinct(), f"stars{i}")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return at.selectExpr("u as node", "v as root").union(at.selectExpr("v", "v").distinct())
