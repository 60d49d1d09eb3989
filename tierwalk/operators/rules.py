"""Declared rules: what must not depend on what, what must be reached, and writers that leave a column out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwalk.functions import columns as C
from tierwalk.functions.vocabulary import IMPACT_KINDS
from tierwalk.operators.walks import Steps
from tierwalk.session import materialise
from tierwalk.sources.graph import Graph


@dataclass(frozen=True)
class Forbidden:
    id: str
    sources: Sequence[str]
    forbidden: Sequence[str]
    kinds: Sequence[str] = IMPACT_KINDS
    transitive: bool = False
    depth: int | None = None
    direction: str = "outgoing"


@dataclass(frozen=True)
class Required:
    """Symbols of the sources (of a kind and a name, if given) that must reach one of the required names."""

    id: str
    sources: Sequence[str]
    required: Sequence[str]
    kinds: Sequence[str] = IMPACT_KINDS
    kind: str | None = None
    name: str | None = None
    depth: int = 5


def _matches(column: str, globs: Sequence[str]):
    return F.col(column).rlike("|".join(f"(?:{C.glob(x)})" for x in globs))


#: Source files that walk in one row, a bit each.
WORDS = 4
FILES = 64 * WORDS
#: Names that are sent to all tasks; more are joined.
NAMES = 200_000


def _numbered(files: DataFrame) -> DataFrame:
    """(source_file, chunk, word, bit): a place for each file, without gaps, so that a row of bits is full before the next begins."""
    at = materialise(files.toDF("source_file").distinct().withColumn("id", F.monotonically_increasing_id()), "rule-files")
    at = at.select("source_file", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    starts, before = [], 0
    for r in at.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # as many as tasks wrote them
        starts.append((r.part, before))
        before += r.n
    place = at.join(F.broadcast(at.sparkSession.createDataFrame(starts, "part long, start long")), "part").withColumn("place", F.col("start") + F.col("nth"))
    return place.select("source_file", F.expr(f"place div {FILES}").alias("chunk"), F.expr(f"cast(place % {FILES} div 64 as int)").alias("word"), F.expr("cast(place % 64 as int)").alias("bit"))


def _bits(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(WORDS)]


def _any_bit(prefix: str):
    return reduce(or_, [F.col(c) != 0 for c in _bits(prefix)])


def check(g: Graph, rule: Forbidden) -> DataFrame:
    """(rule, source_file, forbidden_file, verdict): confirmed over RESOLVED edges, else a candidate.

    A transitive rule is walked until nothing new is met. Where it has a depth and more lay beyond it, the source file also
    has a row `incomplete` without a forbidden file. An incoming rule asks who depends on the sources: the same walk over
    the edges backwards.

    All source files walk together: a name is met by sets of files, one bit a file, so that a hop moves a row for hundreds of
    files and not one for each. Edges that end at a name that is neither forbidden nor leads on are left out first, but where
    a depth asks whether there is more.
    """
    if rule.direction not in ("outgoing", "incoming"):
        raise ValueError(f"a rule looks outgoing or incoming, not {rule.direction!r}")
    last = rule.depth if rule.transitive else 1
    at = g.nodes.select(F.col("qualified_name").alias("name"), "file_path")
    ends = ("source_qname", "target_qname") if rule.direction == "outgoing" else ("target_qname", "source_qname")
    edges = g.linked().where(F.col("kind").isin(*rule.kinds)).select(F.col(ends[0]).alias("name"), F.col(ends[1]).alias("to"), (C.tier_rank() == 0).alias("proven"))
    wrong = at.where(_matches("file_path", rule.forbidden)).select("name", F.col("file_path").alias("forbidden_file")).distinct()
    if not rule.transitive or last is None:
        used = wrong.select(F.col("name").alias("to"), F.lit(True).alias("ends")).distinct()
        if rule.transitive:
            on = edges.where("proven").select("to").distinct().join(edges.select(F.col("name").alias("to")).distinct(), "to", "left_semi")
            used = used.union(on.select("to", F.lit(False))).groupBy("to").agg(F.max("ends").alias("ends"))
        used = materialise(used, "rule-names")
        edges = edges.join(F.broadcast(used) if used.count() <= NAMES else used, "to").where("proven or ends").select("name", "to", "proven")
    steps = Steps(edges, "name")
    files = _numbered(at.where(_matches("file_path", rule.sources)).select("file_path"))
    files = materialise(files, "rule-files")
    one = [F.when(F.col("word") == i, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0)).cast("long").alias(c) for i, c in enumerate(_bits("p"))]
    start = at.join(files.withColumnRenamed("source_file", "file_path"), "file_path").select("name", "chunk", *one)
    reach = materialise(_gathered(start, "p"), "rule-reach")
    met = steps.edges.select(F.col("to").alias("name")).distinct()
    seen, hits, hop = materialise(reach.join(met, "name", "left_semi"), "rule-seen"), None, 0
    while hop == 0 or ((last is None or hop < last) and not reach.isEmpty()):
        hop += 1
        new = materialise(_new(steps, reach, seen), "rule-step")
        hits = new if hits is None else hits.union(new)
        reach = new.where(_any_bit("p")).select("name", "chunk", *_bits("p"))
        seen = seen.union(reach)
        if hop % 8 == 0:
            seen, hits = materialise(_gathered(seen, "p"), "rule-seen"), materialise(_gathered(hits, "p", "a"), "rule-hits")
    bad = hits.join(wrong, "name").groupBy("forbidden_file", "chunk").agg(*[F.bit_or(c).alias(c) for c in _bits("p") + _bits("a")])
    out = _files_of(bad, files, "forbidden_file")
    out = out.select(F.lit(rule.id).alias("rule"), "source_file", "forbidden_file", F.when(F.col("proven"), "confirmed").otherwise("candidate").alias("verdict"))
    if not rule.transitive or last is None:
        return out
    beyond = _new(steps, reach, seen).groupBy("chunk").agg(*[F.bit_or(c).alias(c) for c in _bits("p") + _bits("a")])
    return out.union(_files_of(beyond, files).select(F.lit(rule.id), "source_file", F.lit(None).cast("string"), F.lit("incomplete")))


def _gathered(rows: DataFrame, *prefixes: str) -> DataFrame:
    return rows.groupBy("name", "chunk").agg(*[F.bit_or(c).alias(c) for p in prefixes for c in _bits(p)])


def _new(steps: Steps, reach: DataFrame, seen: DataFrame) -> DataFrame:
    """(name, chunk, files that meet it over proven edges, over any) of the next hop, without files that reached it before."""
    step = steps.of(reach, "name", None).select(F.col("to").alias("name"), "chunk", *[F.when(F.col("proven"), F.col(p)).otherwise(F.lit(0)).alias(p) for p in _bits("p")], *[F.col(p).alias(a) for p, a in zip(_bits("p"), _bits("a"), strict=True)])
    held = _gathered(seen, "p").select("name", "chunk", *[F.col(p).alias(s) for p, s in zip(_bits("p"), _bits("s"), strict=True)])
    rest = [F.col(c).bitwiseAND(F.bitwise_not(F.coalesce(s, F.lit(0)))).alias(c) for x in "pa" for c, s in zip(_bits(x), _bits("s"), strict=True)]
    return _gathered(step, "p", "a").join(held, ["name", "chunk"], "left").select("name", "chunk", *rest).where(_any_bit("a"))


def _files_of(rows: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """(keys, source_file, proven) of rows of bits."""
    words = F.array(*[F.struct(F.lit(i).alias("word"), F.col(p).alias("p"), F.col(a).alias("a")) for i, (p, a) in enumerate(zip(_bits("p"), _bits("a"), strict=True))])
    each = rows.select(*keys, "chunk", F.inline(words)).where("a <> 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).where("shiftright(a, bit) & 1L = 1")
    return each.select(*keys, "chunk", "word", "bit", F.expr("shiftright(p, bit) & 1L = 1").alias("proven")).join(files, ["chunk", "word", "bit"]).select(*keys, "source_file", "proven")


def check_required(g: Graph, rule: Required) -> DataFrame:
    """(rule, source_qname, file_path, verdict, open_edges) of the sources that reach no required name over RESOLVED edges.

    `confirmed` where no weaker or open edge was met on the way, else a `candidate`. All sources walk together.
    """
    sources = g.nodes.where(_matches("file_path", rule.sources))
    if rule.kind:
        sources = sources.where(F.col("kind") == rule.kind)
    if rule.name:
        sources = sources.where(F.col("name").rlike(rule.name))
    sources = materialise(sources.groupBy(F.col("qualified_name").alias("source_qname")).agg(F.min("file_path").alias("file_path")), "required")
    edges = g.edges.where(F.col("kind").isin(*rule.kinds))
    proven = materialise(edges.where((C.tier_rank() == 0) & F.col("target_qname").isNotNull()).select(F.col("source_qname").alias("name"), "target_qname").distinct(), "required-edges")
    seen = sources.select("source_qname", F.col("source_qname").alias("name"))
    at = seen
    for _ in range(rule.depth):
        step = at.join(proven, "name").select("source_qname", F.col("target_qname").alias("name")).distinct()
        at = materialise(step.join(seen, ["source_qname", "name"], "left_anti"), "required-step")
        if at.isEmpty():
            break
        seen = seen.union(at)
    reached = seen.where(F.col("name").isin(*rule.required)).select("source_qname").distinct()
    weak = edges.where(F.col("target_qname").isNull() | (C.tier_rank() > 0)).groupBy(F.col("source_qname").alias("name")).agg(F.count("*").alias("n"))
    missed = seen.join(reached, "source_qname", "left_anti").join(weak, "name", "left").groupBy("source_qname").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("open_edges"))
    out = sources.join(missed, "source_qname")
    return out.select(F.lit(rule.id).alias("rule"), "source_qname", "file_path", F.when(F.col("open_edges") == 0, "confirmed").otherwise("candidate").alias("verdict"), "open_edges")


def rule_report(g: Graph, rules: Sequence[Forbidden | Required]) -> DataFrame:
    """(rule, sources, targets, status): a rule with an empty side proves nothing and says so."""
    each = []
    for r in rules:
        targets = g.files.where(_matches("path", r.forbidden)) if isinstance(r, Forbidden) else g.nodes.where(F.col("qualified_name").isin(*r.required)).select("qualified_name").distinct()
        counts = g.files.where(_matches("path", r.sources)).agg(F.count("*").alias("sources")).join(targets.agg(F.count("*").alias("targets")))
        empty = (F.col("sources") == 0) | (F.col("targets") == 0)
        each.append(counts.select(F.lit(r.id).alias("rule"), "sources", "targets", F.when(empty, "matched_no_files").otherwise("checked").alias("status")))
    out = each[0]
    for more in each[1:]:
        out = out.union(more)
    return out


def defaults_by_expression(g: Graph, expression: str, column: str = "default_expr") -> DataFrame:
    """What `column_defaults` counts, for every column whose default is the same expression, in all tables at once."""
    said = F.lit(expression)
    wanted = g.nodes.where("kind = 'Column'").withColumn("said", said).where(C.plain_default(column) == C.plain_default("said"))
    columns = wanted.select("qualified_name", C.container().alias("table")).distinct()
    writes = g.linked().where("kind = 'WRITES'").select("source_qname", "target_qname", F.substring_index("target_qname", "::", 1).alias("table")).distinct()
    writes = materialise(writes.join(columns.select("table").distinct(), "table", "left_semi"), "writes")
    per = writes.groupBy("table", "source_qname").agg(F.max(F.col("target_qname") == F.col("table")).alias("whole"))
    totals = per.groupBy("table").agg(F.count("*").alias("writers"), F.count_if("whole").alias("unmeasured"))
    named = writes.where("target_qname <> table").join(per, ["table", "source_qname"]).groupBy(F.col("target_qname").alias("qualified_name")).agg(F.count("*").alias("named"), F.count_if(~F.col("whole")).alias("measured"))
    out = columns.join(totals, "table", "left").join(named, "qualified_name", "left").na.fill(0)
    return out.select("qualified_name", "writers", "named", "unmeasured", (F.col("writers") - F.col("unmeasured") - F.col("measured")).alias("omitted"))


def column_defaults(g: Graph, table: str) -> DataFrame:
    """For each column of a table: writers, those that name it, those that write the table only, and those that leave it out."""
    columns = g.nodes.where((F.col("kind") == "Column") & F.col("qualified_name").startswith(table + "::")).select("qualified_name").distinct()
    writes = g.linked().where("kind = 'WRITES'").where((F.col("target_qname") == table) | F.col("target_qname").startswith(table + "::")).select("source_qname", "target_qname").distinct()
    per = writes.groupBy("source_qname").agg(F.max(F.col("target_qname") == table).alias("whole"))
    counted = writes.groupBy(F.col("target_qname").alias("qualified_name")).agg(F.count("*").alias("named"))
    grid = columns.join(counted, "qualified_name", "left").na.fill(0)
    named_only = writes.where(F.col("target_qname") != table).join(per.where("not whole"), "source_qname").groupBy(F.col("target_qname").alias("qualified_name")).agg(F.count("*").alias("named_measured"))
    totals = per.agg(F.count("*").alias("writers"), F.count_if("whole").alias("unmeasured"))
    out = grid.join(named_only, "qualified_name", "left").na.fill(0).join(F.broadcast(totals))
    return out.select("qualified_name", "writers", "named", "unmeasured", (F.col("writers") - F.col("unmeasured") - F.col("named_measured")).alias("omitted"))
