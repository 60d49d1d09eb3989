"""Linking of edges that name their target.

Edges that ask the same question (kind, raw name, tier, language, path) are one request. A request asks for keys in
several spaces of names, each under the number of a pass; one join with the names answers all of them, and the answer of
the first pass counts. Where a key has to be unique, two names leave the request for the next pass, and in the end unlinked.

The passes, in order: `path` of a file, `tail` of a path; `exact` name, through aliases; for tables, views and columns
`folded` case, then the bare `table`; the only `function` of a bare name in the language; a `routine` in a language whose
routines fold case; a member `inherited` from a type above; a `chain` of declared types, walked step by step; a member that
a `subtype` declares; the only `method` of a bare name. The last two are guesses and never stronger than HEURISTIC.

Edge cases: DYNAMIC edges name nothing that can be linked, but for two kinds; a site without a language meets the names of
all languages; cycles of aliases or of inheritance end where a name was seen; no open edges give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierwalk.functions import columns as C
from tierwalk.functions.vocabulary import CHAIN_STEPS, DYNAMIC_LINKED, FQN_KINDS, INHERIT_KINDS, PATH_KINDS, SCHEMA_KINDS, SCHEMA_OBJECTS, SUBTYPES, TYPE_OF
from tierwalk.session import materialise
from tierwalk.sources.graph import Graph

KEY = ("kind", "source_qname", "target_raw", "file_path", "line", "confidence_tier")
ASKED = ("kind", "target_raw", "confidence_tier", "language", "path_key")
PASSES = ("path", "tail", "exact", "folded", "table", "column", "column_folded", "function", "routine", "inherited", "chain", "subtype", "method")
#: What an answer is called: the two looks at a bare table's columns are part of its pass, and a routine's case is folded too.
CALLED = {"column": "table", "column_folded": "table", "routine": "folded"}


def ancestry(g: Graph, depth: int = 32) -> DataFrame:
    """(name, ancestor, level) over inheritance, nearest first; cycles end where a name was seen."""
    up = materialise(g.linked().where(F.col("kind").isin(*INHERIT_KINDS)).selectExpr("source_qname as name", "target_qname as ancestor").where("name <> ancestor").distinct(), "parents")
    seen = up.withColumn("level", F.lit(1))
    frontier = seen
    for level in range(2, depth + 1):
        step = frontier.select("name", F.col("ancestor").alias("via")).join(up.toDF("via", "ancestor"), "via").select("name", "ancestor").where("name <> ancestor").distinct()
        frontier = materialise(step.join(seen, ["name", "ancestor"], "left_anti").withColumn("level", F.lit(level)), "ancestors-new")
        if frontier.isEmpty():
            break
        seen = materialise(seen.union(frontier), "ancestors")
    return seen


def _closure(links: DataFrame, seeds: DataFrame, enough: int | None = None) -> DataFrame:
    """(name, other, level, rank) of what each seed reaches over (a, b, rank): itself at level 0, then the nearest level of each.

    Where only the nearest count, a seed that has `enough` others after a whole level goes no further.
    """
    seen = seeds.toDF("name").distinct().select("name", F.col("name").alias("other"), F.lit(0).alias("level"), F.lit(0).alias("rank"))
    frontier, level = seen, 0
    while True:
        level += 1
        step = frontier.select("name", F.col("other").alias("a")).join(links, "a").groupBy("name", F.col("b").alias("other")).agg(F.min("rank").alias("rank"))
        frontier = materialise(step.join(seen.select("name", "other"), ["name", "other"], "left_anti").select("name", "other", F.lit(level).alias("level"), "rank"), "closure")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
        if level % 8 == 0:
            seen = materialise(seen, "closure-seen")
        if enough is not None:
            frontier = frontier.join(seen.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > enough), "name", "left_anti")


class _Closures:
    """Closures over one table of links, each seed's walked once however often it is asked for."""

    def __init__(self, links: DataFrame):
        self.links, self.known = links, None

    def of(self, seeds: DataFrame) -> DataFrame:
        """(receiver, other, level, rank) of these seeds, and of those before."""
        new = seeds.toDF("name").distinct()
        new = materialise(new if self.known is None else new.join(self.known.where("level = 0").select("name"), "name", "left_anti"), "closure-seeds")
        more = _closure(self.links, new)
        self.known = more if self.known is None else materialise(self.known.union(more), "closure-seen")
        return self.known.withColumnRenamed("name", "receiver")


#: Names with one last part, up to which those are gone through that have it, and not all types near a receiver.
SHARED = 64


def _declaring(asked: DataFrame, near: DataFrame, declared: DataFrame) -> DataFrame:
    """(receiver, word), what is near the receiver and what is declared, where `other::word` is a declared `key`.

    Few names have the same last part, so that a request meets those and not every type above or below its receiver. Where more
    than SHARED have it, the types are gone through instead. Both give the same rows.
    """
    columns = ["receiver", "word", *[c for c in near.columns if c != "receiver"], *declared.columns]
    declared = declared.withColumn("last", F.substring_index("key", "::", -1))
    common = declared.groupBy("last").agg(F.count("*").alias("n")).where(F.col("n") > SHARED).select("last", F.lit(True).alias("common"))
    asked = asked.toDF("receiver", "word").distinct().withColumn("last", F.substring_index("word", "::", -1))
    asked = materialise(asked.join(common, "last", "left"), "asked-members")
    rare = asked.where("common is null").join(declared, "last").where("endswith(key, concat('::', word))").withColumn("other", F.expr("left(key, length(key) - length(word) - 2)")).join(near, ["receiver", "other"])
    often = asked.where("common").join(near, "receiver").withColumn("key", F.concat_ws("::", "other", "word")).join(declared.drop("last"), "key")
    return rare.select(*columns).unionByName(often.select(*columns))


def _parents(g: Graph) -> DataFrame:
    """(a, b, rank): what each type inherits from by the name it gives, traits and interfaces after classes."""
    rank = F.array_position(F.array(*map(F.lit, INHERIT_KINDS)), F.col("kind")).cast("int")
    return g.edges.where(F.col("kind").isin(*INHERIT_KINDS)).groupBy(F.col("source_qname").alias("a"), F.coalesce("target_qname", "target_raw").alias("b")).agg(F.min(rank).alias("rank")).where("a <> b")


def aliases(g: Graph) -> DataFrame:
    """(alias, real): where each alias ends; of several targets of one alias the first in order counts."""
    step = g.edges.where("kind = 'ALIASES'").groupBy(F.col("source_qname").alias("alias")).agg(F.min("target_raw").alias("to"))
    step = materialise(step, "aliases")
    at = step.select("alias", F.col("to").alias("real"), F.array("alias", "to").alias("seen"))
    while True:
        on = at.join(step.select(F.col("alias").alias("real"), F.col("to").alias("next")), "real").where("not array_contains(seen, next)")
        moved = materialise(on.select("alias", F.col("next").alias("real"), F.array_append("seen", F.col("next")).alias("seen")), "aliases-on")
        if moved.isEmpty():
            return at.select("alias", "real")
        at = materialise(at.join(moved.select("alias"), "alias", "left_anti").union(moved), "aliases-at")


def preimages(step: DataFrame, keys: DataFrame) -> DataFrame:
    """(key): all that leads to a key over the (alias, key) of `step`."""
    found, at = keys.limit(0), keys
    while True:
        at = materialise(step.join(at, "key", "left_semi").select(F.col("alias").alias("key")).distinct().join(found, "key", "left_anti").join(keys, "key", "left_anti"), "preimages")
        if at.isEmpty():
            return found
        found = found.union(at)


def _path_key() -> Column:
    """The file a path edge names: an include is relative to its file's directory, an import to the root."""
    parts = F.split(F.concat(C.parent_dir("file_path"), F.lit("/"), F.col("target_raw")), "/")
    keep = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    joined = F.array_join(keep, "/")
    included = F.when(F.col("target_raw").startswith("/"), F.col("target_raw")).when(joined == "", ".").otherwise(joined)
    return F.when(F.col("kind") == "INCLUDES", included).when(F.col("kind").isin(*PATH_KINDS), F.col("target_raw")).otherwise("")


def _open(g: Graph, dynamic: bool, within: DataFrame | None) -> DataFrame:
    """KEY and ASKED of the edges that may be linked, in the files of `within` if given."""
    language = g.files.select(F.col("path").alias("file_path"), F.coalesce("language", F.lit("")).alias("language"))
    edges = g.edges.where(F.col("target_qname").isNull() & F.col("kind").isin(*FQN_KINDS, *PATH_KINDS)).select(*KEY)
    edges = (edges if within is None else edges.join(within, "file_path", "left_semi").select(*KEY)).distinct()
    if not dynamic:
        edges = edges.where((F.coalesce("confidence_tier", F.lit("")) != "DYNAMIC") | F.col("kind").isin(*DYNAMIC_LINKED))
    return edges.join(language, "file_path", "left").na.fill("", ["language"]).withColumn("path_key", _path_key())


def _requests(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct requests with an id, and the name to look up: an alias' end, or that of its container."""
    asked = edges.select(*ASKED).distinct().withColumn("c", C.container("target_raw"))
    asked = asked.join(known.select(F.col("alias").alias("target_raw"), F.col("real").alias("whole")), "target_raw", "left").join(known.select(F.col("alias").alias("c"), F.col("real").alias("held")), "c", "left")
    lookup = F.when(F.col("kind") == "ALIASES", F.col("target_raw")).otherwise(F.coalesce("whole", F.concat("held", F.lit("::"), C.member("target_raw")), "target_raw"))
    out = asked.select(*ASKED, lookup.alias("lookup"), F.monotonically_increasing_id().alias("id"))
    return materialise(out.withColumn("container", C.container("lookup")).withColumn("member", C.member("lookup")), "requests")


def _in(column: str, folding: Sequence[str] | None) -> Column:
    return F.lit(True) if folding is None else F.col(column).isin(*folding) if folding else F.lit(False)


class Names:
    """What can be asked for, as (space, key, target) of the keys in question. Outside the `exact` space a key is that of one name alone."""

    def __init__(self, g: Graph, folding: Sequence[str] | None):
        language = g.files.select(F.col("path").alias("file_path"), F.coalesce("language", F.lit("")).alias("language"))
        nodes = g.nodes.select("kind", "name", "qualified_name", "file_path").join(language, "file_path", "left").na.fill("", ["language"])
        low, kind = F.lower("name"), F.col("kind")
        none = F.array().cast("array<struct<space:string,key:string>>")

        def entry(space: str, key: Column) -> Column:
            return F.struct(F.lit(space).alias("space"), key.alias("key"))

        def by_kind(test: Column, *entries: Column) -> Column:
            return F.when(test, F.array(*entries)).otherwise(none)

        parts = F.split("qualified_name", "/")
        tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("tail").alias("space"), F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")).alias("key")))
        entries = F.concat(
            F.array(entry("exact", F.col("qualified_name")), entry("folded", F.lower("qualified_name"))),
            F.when(kind == "File", F.concat(F.array(entry("path", F.col("qualified_name"))), tails)).otherwise(none),
            by_kind(kind.isin("Table", "View"), entry("table", low)),
            by_kind(kind == "Function", entry("function", F.concat_ws("|", "language", "name")), entry("function", F.concat(F.lit("|"), "name"))),
            by_kind((kind == "Function") & _in("language", folding), entry("routine", F.concat_ws("|", F.col("language"), low)), entry("routine", F.lower("qualified_name"))),
            by_kind(kind == "Method", entry("method", F.concat_ws("|", "language", "name")), entry("method", F.concat(F.lit("|"), "name"))),
        )
        self.named = nodes.select("kind", F.col("qualified_name").alias("target"), F.explode(entries).alias("e")).select("kind", "target", "e.*").where("key is not null")
        # Columns of tables whose bare name is the only one of its kind.
        tables = nodes.where("kind = 'Table'").groupBy(low.alias("bare")).agg(F.min("qualified_name").alias("table"), F.max("qualified_name").alias("last")).where("table = last").select("bare", "table")
        columns = nodes.where("kind = 'Column'").select(C.container().alias("table"), C.member().alias("column"), F.col("qualified_name").alias("target")).distinct().join(tables, "table")
        plain = columns.select(F.lit("column").alias("space"), F.concat_ws("::", "bare", "column").alias("key"), "target")
        folded = columns.groupBy(F.concat_ws("::", F.col("bare"), F.lower("column")).alias("key")).agg(F.min("target").alias("target"), F.max("target").alias("last")).where("target = last").select(F.lit("column_folded").alias("space"), "key", "target")
        self.columns = plain.union(folded)

    def of(self, probes: DataFrame) -> DataFrame:
        """The probes with their targets; names that are not asked for leave before anything is grouped."""
        asked = probes.select("space", "key").distinct()
        kind = F.col("kind")
        held = self.named.join(asked, ["space", "key"], "left_semi").groupBy("space", "key").agg(F.min("target").alias("target"), F.max("target").alias("last"), F.count("*").alias("n"), F.max(kind.isin(*SCHEMA_OBJECTS)).alias("schema"))
        held = held.where("target = last and (space <> 'path' or n = 1) and (space <> 'folded' or schema)").select("space", "key", "target")
        return probes.join(held.union(self.columns), ["space", "key"])


def _probe(rows: DataFrame, name: str, space: str, key: Column, where: Column | str, rank: Column | None = None, tier: Column | None = None) -> DataFrame:
    order = F.lit(0) if rank is None else rank
    return rows.where(where).select("id", F.lit(PASSES.index(name)).alias("pass"), order.cast("int").alias("rank"), F.lit(space).alias("space"), key.alias("key"), (F.lit("RESOLVED") if tier is None else tier).alias("floor"))


def _plain_probes(asked: DataFrame, folding: Sequence[str] | None, guesses_only: bool) -> DataFrame:
    """Keys of all requests but those that walk types."""
    kind, tier, member = F.col("kind"), F.col("confidence_tier"), F.col("member")
    guess = F.coalesce(tier, F.lit("RESOLVED")) == "HEURISTIC"
    path, call = kind.isin(*PATH_KINDS), kind == "CALLS"
    bare = call & F.col("container").isNull()
    schema = kind.isin(*SCHEMA_KINDS) | ((kind == "READS") & F.col("container").isNotNull())
    table = F.lower(F.substring_index(F.coalesce(C.container("target_raw"), F.col("target_raw")), ".", -1))
    whole = F.instr("target_raw", "::") == 0
    table = F.when(whole, F.lower("target_raw")).otherwise(table)
    site = F.concat_ws("|", F.col("language"), member)
    qualified = member.rlike(r"[.\\/]")
    probes = [
        _probe(asked, "path", "path", F.col("path_key"), path),
        _probe(asked, "tail", "tail", F.col("target_raw"), path & guess & F.col("target_raw").rlike("^/."), tier=F.lit("HEURISTIC")),
        _probe(asked, "exact", "exact", F.col("lookup"), ~path),
        _probe(asked, "folded", "folded", F.lower("target_raw"), schema),
        _probe(asked, "table", "table", table, schema & whole),
        _probe(asked, "column", "column", F.concat_ws("::", table, C.member("target_raw")), schema & ~whole),
        _probe(asked, "column_folded", "column_folded", F.concat_ws("::", table, F.lower(C.member("target_raw"))), schema & ~whole),
        _probe(asked, "function", "function", site, bare & ~guess),
        _probe(asked, "routine", "routine", F.concat_ws("|", F.col("language"), F.lower(member)), bare & ~qualified & ~guess & _in("language", folding)),
        _probe(asked, "routine", "routine", F.lower(member), bare & qualified),
        _probe(asked, "method", "method", site, bare & (guess | F.lit(not guesses_only)), tier=F.lit("HEURISTIC")),
    ]
    out = probes[0]
    for more in probes[1:]:
        out = out.union(more)
    return out


def _walked(chains: DataFrame, g: Graph, above: _Closures) -> DataFrame:
    """(id, receiver, member, documented, broken) of requests on a chain of declared types, after at most CHAIN_STEPS steps."""
    typed = [c for c in ("declared_type", "doc_type") if c in g.nodes.columns]
    types = g.first_nodes().select(F.col("qualified_name").alias("key"), *[F.col(c) if c in typed else F.lit(None).cast("string").alias(c) for c in ("declared_type", "doc_type")])
    types = materialise(types.where("nullif(declared_type, '') is not null or nullif(doc_type, '') is not null"), "types")
    reference = F.split(F.expr(f"left(container, length(container) - {len(TYPE_OF)})"), r"\(\)::")
    head = F.struct(C.container("head").alias("receiver"), C.member("head").alias("first"))
    at = chains.select("id", "member", reference.alias("r")).select("id", "member", F.col("r")[0].alias("head"), F.expr("slice(r, 2, size(r))").alias("rest"))
    at = at.select("id", "member", F.coalesce(head["receiver"], F.col("head")).alias("receiver"), F.concat(F.array(head["first"]), F.col("rest")).alias("steps"), F.lit(False).alias("documented"))
    at = materialise(at, "chain")
    for _ in range(CHAIN_STEPS):
        going = at.where("receiver is not null and size(steps) > 0")
        if going.isEmpty():
            break
        going = going.withColumn("word", F.col("steps")[0])
        asked = materialise(_declaring(going.select("receiver", "word"), above.of(going.select("receiver")), types), "chain-types")

        def found(column: str, order: str, asked: DataFrame = asked) -> DataFrame:
            said = F.when(F.col(column) == "self", F.col("other")).when(F.col(column) == "static", F.col("receiver")).otherwise(F.col(column))
            return asked.where(f"nullif({column}, '') is not null").groupBy("receiver", "word").agg(F.min(F.struct("level", "rank", "other", said.alias("said"))).alias(order))

        step = going.join(found("declared_type", "sure"), ["receiver", "word"], "left").join(found("doc_type", "told"), ["receiver", "word"], "left")
        step = step.select("id", "member", F.coalesce("sure.said", "told.said").alias("receiver"), F.expr("slice(steps, 2, size(steps))").alias("steps"), (F.col("documented") | (F.col("sure").isNull() & F.col("told").isNotNull())).alias("documented"))
        at = materialise(at.where("receiver is null or size(steps) = 0").unionByName(step), "chain")
    known = g.nodes.select(F.col("qualified_name").alias("receiver")).distinct().withColumn("held", F.lit(True))
    out = at.join(known, "receiver", "left")
    return materialise(out.select("id", "receiver", "member", "documented", (F.col("held").isNull() | (F.size("steps") > 0)).alias("broken")), "chains")


def _answers(g: Graph, folding: Sequence[str] | None, dynamic: bool, guesses_only: bool, within: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(open edges, requests with (target, via, tier), one row for each target)."""
    edges = materialise(_open(g, dynamic, within), "open")
    asked = _requests(edges, aliases(g))
    names, parents = Names(g, folding), materialise(_parents(g), "parents")
    above = _Closures(parents)
    declared = g.nodes.select(F.col("qualified_name").alias("key")).distinct()
    probes = _plain_probes(asked, folding, guesses_only)
    calls = asked.where("kind = 'CALLS' and container is not null")
    own = calls.where(~F.col("container").endswith(TYPE_OF)).select("id", F.col("container").alias("receiver"), "member")
    held = own.select("*", F.lit("inherited").alias("how"), F.lit("RESOLVED").alias("floor"))
    chains = calls.where(F.col("container").endswith(TYPE_OF))
    if not chains.isEmpty():
        walked = _walked(chains, g, above)
        floor = F.when(F.col("documented"), "HEURISTIC").otherwise("RESOLVED")
        held = held.union(walked.where("not broken").select("id", "receiver", "member", F.lit("chain"), floor))
        lost = asked.join(walked.where("broken").select("id"), "id", "left_semi")
        probes = probes.union(_probe(lost, "method", "method", F.concat_ws("|", "language", "member"), F.lit(True), tier=F.lit("HEURISTIC")))
    held = materialise(held, "receivers")
    number = F.when(F.col("how") == "chain", PASSES.index("chain")).otherwise(PASSES.index("inherited"))
    nearest = _declaring(held.select("receiver", "member"), above.of(held.select("receiver")), declared).groupBy("receiver", F.col("word").alias("member")).agg(F.min(F.struct("level", "rank", "other", "key")).alias("m"))
    members = held.join(nearest, ["receiver", "member"]).select("id", number.alias("pass"), F.lit(1).alias("rank"), "floor", F.col("m.key").alias("target"))

    def first(found: DataFrame) -> DataFrame:
        return found.groupBy("id").agg(F.min(F.struct("pass", "rank", "floor", "target")).alias("m")).select("id", "m.pass", "m.floor", "m.target")

    answers = materialise(first(names.of(materialise(probes, "probes")).select("id", "pass", "rank", "floor", "target").union(members)), "answers")
    left = materialise(held.join(answers, "id", "left_anti"), "receivers-left")
    if not left.isEmpty():
        down = _closure(parents.select(F.col("b").alias("a"), F.col("a").alias("b"), "rank"), left.select("receiver"), SUBTYPES).where("level > 0").withColumnRenamed("name", "receiver")
        order = Window.partitionBy("receiver").orderBy("level", "other")
        down = down.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SUBTYPES).select("receiver", "other")
        below = _declaring(left.select("receiver", "member"), down, declared).select("receiver", F.col("word").alias("member"), F.col("key").alias("target"))
        guesses = left.join(below, ["receiver", "member"]).select("id", F.lit(PASSES.index("subtype")).alias("pass"), F.lit("HEURISTIC").alias("floor"), "target").distinct()
        answers = answers.union(guesses)
    tier = C.tier_of(F.greatest(C.tier_rank("confidence_tier"), C.tier_rank("floor")))
    via = F.element_at(F.array(*[F.lit(CALLED.get(p, p)) for p in PASSES]), F.col("pass") + 1)
    extra = F.col("target") > F.min("target").over(Window.partitionBy("id"))
    return edges, asked.join(answers, "id").select(*ASKED, F.col("target"), via.alias("via"), tier.alias("tier"), extra.alias("further"))


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Join on columns that may be null."""
    right = b.select(*[F.col(c).alias(f"r_{c}") if c in columns else F.col(c) for c in b.columns])
    on = None
    for c in columns:
        on = a[c].eqNullSafe(right[f"r_{c}"]) if on is None else on & a[c].eqNullSafe(right[f"r_{c}"])
    return a.join(right, on).drop(*[f"r_{c}" for c in columns])


def resolve(g: Graph, folding: Sequence[str] | None = None, dynamic: bool = False, guesses_only: bool = False) -> DataFrame:
    """(KEY, target, via) of the unlinked edges that a pass links, with the tier the link has; several targets are several rows.

    `folding` names the languages whose routines fold case (all, if not given). With `dynamic`, edges of that tier are linked
    like others; with `guesses_only`, only calls that are guesses already may mean the only method of their name.
    """
    edges, answers = _answers(g, folding, dynamic, guesses_only)
    found = _same(edges, answers, ASKED)
    return found.select(*[F.col("tier").alias(c) if c == "confidence_tier" else F.col(c) for c in KEY], "target", "via")


def linked(g: Graph, folding: Sequence[str] | None = None, guesses_only: bool = False, within: DataFrame | None = None) -> DataFrame:
    """The edges (of the files in `within`, if given) with what `resolve` links, and `extra`: rows for further targets of an edge."""
    edges, answers = _answers(g, folding, False, guesses_only, within)
    found = _same(edges, answers, ASKED).select(*[F.col(c).alias(f"k_{c}") for c in KEY], "target", "tier", "further")
    mine = g.edges if within is None else g.edges.join(within, "file_path", "left_semi").select(*g.edges.columns)
    on = mine["target_qname"].isNull()
    for c in KEY:
        on = on & mine[c].eqNullSafe(found[f"k_{c}"])
    joined = mine.join(found, on, "left")
    changed = {"target_qname": F.coalesce("target_qname", "target"), "confidence_tier": F.coalesce("tier", "confidence_tier")}
    own = [c for c in g.edges.columns if c != "extra"]
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in own], F.coalesce("further", F.lit(False)).alias("extra"))


def apply(g: Graph, folding: Sequence[str] | None = None, guesses_only: bool = False) -> Graph:
    """The graph with what `resolve` links; linked edges keep their raw name, further targets are further edges."""
    return Graph(g.files, g.nodes, linked(g, folding, guesses_only).select(*g.edges.columns))
