"""Point reads and counts: call sites by argument, names by ending, what an asked name means, stamps, status, overview.

Edge cases: what nothing matches gives no rows, and counts give 0; a name that several answer to is never picked; nulls in
a raw name or a target count as unlinked; limits come after a total order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierwalk.functions import columns as C
from tierwalk.functions.vocabulary import BANDS, CALLER_KINDS, INHERIT_KINDS, READ_LATE, ROOT_LAYER, TYPE_KINDS, UNCATEGORISED
from tierwalk.operators import relational as R
from tierwalk.operators.analytics import module_degrees
from tierwalk.operators.walks import Steps, _few
from tierwalk.session import materialise
from tierwalk.sources.graph import Graph

OPEN = "nullif(target_qname, '') is null"


# Call sites


def call_sites(g: Graph, qname: str, args: Mapping[int, str] | None = None, kwargs: Mapping[str, str] | None = None) -> DataFrame:
    """Direct calls of a symbol whose arguments are as asked: a literal, `absent` or `dynamic`, by place or keyword."""
    tests: list[Column] = [C.args_at(k, v) for k, v in (args or {}).items()]
    if "kwargs" in g.edges.columns:
        # A keyword may fill a place by its name, so a call that passed one proves no absence.
        tests += [F.coalesce(F.size("kwargs") <= 0, F.lit(True)) for v in (args or {}).values() if v == "absent"]
        tests += [C.kwargs_at(k, v) for k, v in (kwargs or {}).items()]
    return R.edges_to(g, [qname], CALLER_KINDS, where=reduce(and_, tests) if tests else None).select(*R.EDGE_COLUMNS)


def count_edges(g: Graph, kinds: Sequence[str], by: str = "kind") -> DataFrame:
    """Edges and their distinct sources."""
    return g.edges.where(F.col("kind").isin(*kinds)).groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("source_qname").alias("sources"))


def bare_calls_elsewhere(g: Graph, qname: str, bare: str) -> DataFrame:
    """(n): guessed call sites of a bare name, none of whose rows means the symbol."""
    calls = g.edges.where((F.col("kind") == "CALLS") & (F.col("target_raw") == bare) & (F.col("confidence_tier") == "HEURISTIC"))
    sites = calls.groupBy("source_qname", "file_path", "line").agg(F.count_if(F.col("target_qname") == qname).alias("hits"))
    return sites.where("hits = 0").agg(F.count("*").alias("n"))


def calls_ending_with(g: Graph, suffix: str, limit: int = 50) -> DataFrame:
    return g.edges.where((F.col("kind") == "CALLS") & F.col("target_raw").endswith(suffix)).select(*R.EDGE_COLUMNS).orderBy(*R.EDGE_ORDER).limit(limit)


def open_routine_calls(g: Graph, languages: Sequence[str]) -> DataFrame:
    """(n): calls left open, but for dynamic ones, at sites of the languages, and at others where the last part names one of their functions."""
    language = g.files.select(F.col("path").alias("file_path"), "language")
    mine = F.col("language").isin(*languages)
    routines = g.nodes.where("kind = 'Function'").join(language, "file_path").where(mine).select(F.lower("name").alias("low")).distinct().withColumn("known", F.lit(True))
    calls = g.edges.where(OPEN).where("kind = 'CALLS' and coalesce(confidence_tier, '') <> 'DYNAMIC'").join(language, "file_path", "left")
    low = F.lower(F.regexp_extract("target_raw", r"[.\\/]([^.\\/]+)$", 1))
    return calls.withColumn("low", low).join(routines, "low", "left").where(F.coalesce(mine, F.lit(False)) | F.coalesce("known", F.lit(False))).agg(F.count("*").alias("n"))


def open_relating_to(g: Graph, table: str, kinds: Sequence[str] = ("WRITES",)) -> DataFrame:
    """(n): open edges of the kinds that name a table, bare or qualified, or a member of it."""
    return g.edges.where(OPEN).where(F.col("kind").isin(*kinds) & C.relates_to(table)).agg(F.count("*").alias("n"))


def dynamic_includes(g: Graph) -> DataFrame:
    return g.edges.where(OPEN).where("kind = 'INCLUDES' and confidence_tier = 'DYNAMIC'").agg(F.count("*").alias("n"))


def includes_mentioning(g: Graph, needle: str, limit: int = 50, offset: int = 0) -> DataFrame:
    hits = g.edges.where(OPEN).where("kind = 'INCLUDES'").where(F.lower("target_raw").contains(needle.lower()))
    return hits.select(*R.EDGE_COLUMNS).orderBy(*R.EDGE_ORDER).offset(offset).limit(limit)


def included_files_named(g: Graph, basename: str) -> DataFrame:
    """(path): files of that name that something includes."""
    hit = g.linked().where("kind = 'INCLUDES'").where((F.col("target_qname") == basename) | F.col("target_qname").endswith("/" + basename))
    return hit.select(F.col("target_qname").alias("path")).distinct()


def constructing_at_top_level(g: Graph, qname: str) -> DataFrame:
    """(file_path): files that construct a class outside any function."""
    return g.edges.where((F.col("kind") == "NEW") & (F.col("target_qname") == qname) & (F.col("source_qname") == F.col("file_path"))).select("file_path").distinct()


def importable_keys(g: Graph) -> DataFrame:
    """(key): dotted names that a file, or its directory, can be imported by."""
    own = F.split(F.regexp_replace("path", r"\.[^./]*$", ""), "/")
    both = F.array(own, F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))))
    keys = F.flatten(F.transform(both, lambda p: F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))).otherwise(F.array().cast("array<string>"))))
    return g.files.select(F.explode(keys).alias("key")).where("key <> ''").distinct()


def source_root_hints(g: Graph) -> DataFrame:
    """(n): open imports without a slash that name something indexed under another root."""
    asked = g.edges.where(OPEN).where("kind = 'IMPORTS' and not contains(target_raw, '/')").select(F.col("target_raw").alias("key"))
    return asked.join(importable_keys(g), "key", "left_semi").agg(F.count("*").alias("n"))


def named_from_another_language(g: Graph, raws: Sequence[str], language: str, kinds: Sequence[str] = CALLER_KINDS) -> DataFrame:
    """(raw, how): names that calls of other languages give, as the open target or as a literal argument that ends in them."""
    other = g.edges.where(F.col("kind").isin(*kinds)).join(g.files.where(F.col("language") != language).select(F.col("path").alias("file_path")), "file_path", "left_semi")
    called = other.where(OPEN).where(F.col("target_raw").isin(*raws)).select(F.col("target_raw").alias("raw"), F.lit("called").alias("how"))
    said = other.where("args is not null").select(F.explode("args").alias("said")).where("said is not null").distinct()
    wanted = F.array(*map(F.lit, raws))
    fits = F.filter(wanted, lambda r: (F.col("said") == r) | F.regexp_like("said", F.concat(F.lit(r"[.:@>/\\]\Q"), r, F.lit("\\E$"))))
    argued = said.select(F.explode(fits).alias("raw"), F.lit("argument").alias("how"))
    return called.union(argued).distinct()


# Names


def nodes_ending(g: Graph, name: str, suffix: str, limit: int = 50) -> DataFrame:
    hits = g.nodes.where((F.col("name") == name) & F.col("qualified_name").endswith(suffix))
    return hits.orderBy(*R.NODE_ORDER).limit(limit)


def prefixes_held(g: Graph, prefixes: Sequence[str]) -> DataFrame:
    """(prefix, held): whether a qualified name starts with each; one pass over the names."""
    wanted = F.array(*map(F.lit, prefixes))
    hit = g.nodes.select(F.explode(F.filter(wanted, lambda p: F.col("qualified_name").startswith(p))).alias("prefix")).groupBy("prefix").agg(F.lit(True).alias("held"))
    asked = g.nodes.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    return asked.join(hit, "prefix", "left").na.fill(False, ["held"])


def meaning(g: Graph, asked: str, limit: int = 50) -> DataFrame:
    """(state, qualified_name) of a name the graph holds no exact node for.

    `resolved_unique`: one name ends with it at a boundary; `ambiguous`: several do, each a row; `stored_shorter`: the name
    itself ends with a stored one, which is offered and never taken; `absent`: none of that.
    """
    ends = g.nodes.where(C.ends_at_boundary("qualified_name", asked)).select("qualified_name").distinct()
    found = [r.qualified_name for r in ends.orderBy("qualified_name").limit(limit + 1).collect()]
    spark = g.nodes.sparkSession
    if found:
        state = "resolved_unique" if len(found) == 1 else "ambiguous"
        return spark.createDataFrame([(state, q) for q in found[:limit]], "state string, qualified_name string")
    word = [c.isalnum() or c == "_" for c in asked]
    tails = [asked[i:] for i in range(1, len(asked)) if word[i] and not word[i - 1]]
    held = {r.qualified_name for r in g.nodes.where(F.col("qualified_name").isin(*tails)).select("qualified_name").distinct().collect()} if tails else set()
    shorter = next((t for t in tails if t in held), None)
    return spark.createDataFrame([("stored_shorter", shorter) if shorter else ("absent", None)], "state string, qualified_name string")


def bare_subject(g: Graph, asked: str, kinds: Sequence[str] = ("Table", "Function", "View"), parts: Sequence[str] = ("Column",)) -> DataFrame:
    """(qualified_name, sole): the subjects a bare name may mean.

    `sole` for the one that answers. A node of any other kind with that ending, or a part beside a subject that is no table,
    leaves nobody; several are listed only where one of them is a table.
    """
    rows = g.nodes.where((F.col("name") == asked) & C.ends_at_boundary("qualified_name", asked)).select("kind", "qualified_name").distinct()
    marked = rows.select("qualified_name", F.col("kind").isin(*kinds).alias("subject"), F.col("kind").isin(*parts).alias("part"), (F.col("kind") == "Table").alias("table"))
    facts = marked.agg(F.countDistinct(F.when(F.col("subject"), F.col("qualified_name"))).alias("subjects"), F.max("table").alias("any_table"), F.min(F.col("table") | ~F.col("subject")).alias("all_tables"), F.max("part").alias("any_part"), F.max(~F.col("subject") & ~F.col("part")).alias("other"))
    sole = (F.col("subjects") == 1) & (~F.col("any_part") | F.col("all_tables"))
    return marked.where("subject").join(facts).where(~F.col("other")).where(sole | ((F.col("subjects") > 1) & F.col("any_table"))).select("qualified_name", sole.alias("sole")).distinct()


def twins_first(rows: DataFrame, path: str) -> DataFrame:
    """Definitions with `place`: those in a file of the same name first, where that parts them; then the nearest; then by path."""
    own = path.split("/")[:-1]
    parts = F.split("file_path", "/")
    near = F.lit(0)
    for i in range(1, len(own) + 1):
        near = F.when(F.slice(parts, 1, i) == F.array(*map(F.lit, own[:i])), i).otherwise(near)
    same = F.substring_index("file_path", "/", -1) == path.rsplit("/", 1)[-1]
    every = Window.partitionBy(F.lit(0))
    marked = rows.withColumn("twin", same).withColumn("shared", near)
    twins, n = F.count_if("twin").over(every), F.count("*").over(every)
    marked = marked.withColumn("banded", (twins > 0) & (twins < n) & F.col("twin"))
    return marked.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("banded"), F.desc("shared"), "file_path", "qualified_name"))).drop("twin", "banded")


def latest_versions(rows: DataFrame, version: Column) -> DataFrame:
    """(qualified_name, file_path, place): definitions by version, highest first, where every production one has a version of its
    own and all lie in one directory; other names have no rows. Test copies follow and have no place."""
    by_name = Window.partitionBy("qualified_name")
    marked = rows.withColumn("version", version).withColumn("folder", C.parent_dir("file_path"))
    live = ~F.col("is_test")
    facts = marked.where(live).groupBy("qualified_name").agg(F.count("*").alias("n"), F.countDistinct("version").alias("versions"), F.countDistinct("folder").alias("folders"))
    facts = facts.where("n > 1 and versions = n and folders = 1")
    place = F.when(live, F.row_number().over(by_name.orderBy("is_test", F.desc("version"))))
    return marked.join(facts.select("qualified_name"), "qualified_name", "left_semi").select("qualified_name", "file_path", place.alias("place"))


def constructed_by(g: Graph, constructor: str, names: Sequence[str] = ("__construct", "__init__", "constructor")) -> DataFrame:
    """(source_qname, target_qname, via_subclass): who constructs a class or an heir that inherits its constructor.

    The walk below the class goes over inherited bodies and stops at a class that declares a constructor, or uses a trait that
    does, since that one runs instead.
    """
    owner = constructor.rsplit("::", 1)[0]
    own = g.nodes.where((F.col("kind") == "Method") & F.col("name").isin(*names)).select(C.container().alias("holder")).distinct()
    traits = g.linked().where("kind = 'USES_TRAIT'").where(F.col("target_qname") != owner).join(own, F.col("target_qname") == F.col("holder"), "left_semi").select(F.col("source_qname").alias("holder"))
    stops = materialise(own.union(traits).distinct(), "constructors")
    down = g.linked().where(F.col("kind").isin("EXTENDS", "USES_TRAIT")).select("source_qname", "target_qname").distinct()
    steps = Steps(down, "target_qname")
    seen = g.nodes.sparkSession.createDataFrame([(owner,)], "q string")
    at, few = seen, _few(seen)
    while few != []:
        step = steps.of(at, "q", few).select(F.col("source_qname").alias("q")).distinct().join(stops.withColumnRenamed("holder", "q"), "q", "left_anti")
        at = materialise(step.join(seen, "q", "left_anti"), "heirs")
        seen, few = seen.union(at), _few(at)
    news = g.linked().where("kind = 'NEW'").join(seen.withColumnRenamed("q", "target_qname"), "target_qname", "left_semi")
    return news.select("source_qname", "target_qname", (F.col("target_qname") != owner).alias("via_subclass")).distinct()


def symbol(g: Graph, qname: str) -> DataFrame:
    """(section, value, place): definitions, supertypes, members and columns of a symbol in one table."""
    at = g.nodes.where(F.col("qualified_name") == qname).select(F.lit("definition").alias("section"), F.concat_ws(":", "file_path", "line_start").alias("value"), "kind")
    up = g.edges.where(F.col("kind").isin(*INHERIT_KINDS) & (F.col("source_qname") == qname)).select(F.lit("supertype"), F.coalesce("target_qname", "target_raw"), "kind")
    members = g.nodes.where(C.container() == qname).select(F.lit("member"), "qualified_name", "kind")
    return at.union(up).union(members).distinct()


# Files


def suffixes_with_files(g: Graph, suffixes: Sequence[str]) -> DataFrame:
    """(suffix, n) of the asked endings that files have."""
    return g.files.groupBy(F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("suffix")).agg(F.count("*").alias("n")).where(F.col("suffix").isin(*suffixes))


def files_stamp(g: Graph) -> DataFrame:
    """(stamp): changes whenever a file comes, goes or changes, in whatever order they are read."""
    return g.files.agg(F.concat_ws(":", F.count("*"), F.coalesce(F.sum(F.crc32(F.concat_ws("|", "path", "hash").cast("binary"))), F.lit(0))).alias("stamp"))


def emitted_kinds(g: Graph) -> DataFrame:
    """(language, kind, n): edges a language's files have."""
    language = g.files.select(F.col("path").alias("file_path"), "language")
    return g.edges.groupBy("file_path", "kind").agg(F.count("*").alias("n")).join(language, "file_path").groupBy("language", "kind").agg(F.sum("n").alias("n"))


def languages_without(g: Graph, kinds: Sequence[str]) -> DataFrame:
    """(language) of files whose language has no edge of any of the kinds."""
    has = emitted_kinds(g).where(F.col("kind").isin(*kinds)).select("language").distinct()
    return g.files.select("language").distinct().join(has, "language", "left_anti")


def symbol_shapes(g: Graph) -> DataFrame:
    """(language, kind, n, depth): symbols of each language and how many `::` their names have at most."""
    language = g.files.select(F.col("path").alias("file_path"), "language")
    depth = F.size(F.split("qualified_name", "::")) - 1
    cells = g.nodes.groupBy("file_path", "kind").agg(F.count("*").alias("n"), F.max(depth).alias("depth"))
    return cells.join(language, "file_path").groupBy("language", "kind").agg(F.sum("n").alias("n"), F.max("depth").alias("depth"))


def tier_split(g: Graph) -> DataFrame:
    """(confidence_tier, whole, by_language, agree): the edges of each tier, counted whole and as the sum over languages."""
    cells = g.edges.groupBy("file_path", C.tier_of(C.tier_rank()).alias("confidence_tier")).agg(F.count("*").alias("n"))
    whole = cells.groupBy("confidence_tier").agg(F.sum("n").alias("whole"))
    known = g.files.select(F.col("path").alias("file_path")).distinct()
    parts = cells.join(known, "file_path", "left_semi").groupBy("confidence_tier").agg(F.sum("n").alias("by_language"))
    return whole.join(parts, "confidence_tier", "left").na.fill(0, ["by_language"]).withColumn("agree", F.col("whole") == F.col("by_language"))


def status(g: Graph) -> DataFrame:
    """(section, key, n): files, failures, symbols, edges, links and tiers, by language where they have one."""
    language = g.files.select(F.col("path").alias("file_path"), "language")
    files = g.files.groupBy(F.col("language").alias("key")).agg(F.count("*").alias("n")).select(F.lit("files").alias("section"), "key", "n")
    failed = g.files.where("not parsed_ok").groupBy("language").agg(F.count("*").alias("n")).select(F.lit("failed"), "language", "n")
    nodes = g.nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("nodes"), "kind", "n")
    cells = materialise(g.edges.groupBy("file_path", "kind", C.tier_of(C.tier_rank()).alias("tier")).agg(F.count("*").alias("n"), F.count("target_qname").alias("linked")).join(language, "file_path", "left"), "status")
    kinds = cells.groupBy("kind").agg(F.sum("n").alias("n")).select(F.lit("edges"), "kind", "n")
    tiers = cells.groupBy("tier").agg(F.sum("n").alias("n")).select(F.lit("tier"), "tier", "n")
    linked = cells.groupBy("language").agg(F.sum("linked").alias("n")).select(F.lit("linked"), "language", "n")
    return files.union(failed).union(nodes).union(kinds).union(tiers).union(linked)


# Structure


def layers_by_role(g: Graph) -> DataFrame:
    """(file, layer, rank, method): by responsibility of the path where that gives two layers or more; else by the directories of
    the widest top directory; else by the direction of dependencies."""
    d = materialise(module_degrees(g).withColumn("role", F.coalesce(C.responsibility_layer("name"), F.lit(UNCATEGORISED))), "roles")
    rooted = F.when(F.instr("name", "/") > 0, F.substring_index("name", "/", 1))
    if d.select("role").distinct().limit(2).count() > 1:
        grouped, method = d.withColumn("layer", F.col("role")), "responsibility"
    else:
        mass = d.where("instr(name, '/') > 0").groupBy(rooted.alias("top")).agg(F.sum(F.col("fan_in") + F.col("fan_out")).alias("mass"), F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))
        top = mass.orderBy(F.desc("mass"), F.desc("n"), "top").first()
        grouped = None
        if top is not None:
            # The common directories of the first and the last path in order are common to all between them.
            first, last = top["first"].split("/")[:-1], top["last"].split("/")[:-1]
            common = next((i for i, (a, b) in enumerate(zip(first, last, strict=False)) if a != b), min(len(first), len(last)))
            parts = F.split("name", "/")
            inner = F.when(F.size(parts) - 1 > common, F.get(parts, F.lit(common))).otherwise(F.lit(top["top"]))
            grouped = d.withColumn("layer", F.when(rooted.isNull(), ROOT_LAYER).when(rooted != top["top"], rooted).otherwise(inner))
        if grouped is not None and grouped.select("layer").distinct().limit(2).count() > 1:
            method = "dominant-subtree"
        else:
            present = {r.direction for r in d.select("direction").distinct().collect()}  # of four words
            ranks = {band: i for i, band in enumerate(b for b in BANDS if b in present)}
            rank = reduce(lambda acc, x: F.when(F.col("direction") == x[0], x[1]).otherwise(acc), ranks.items(), F.lit(0))
            return d.select(F.col("name").alias("file"), F.col("direction").alias("layer"), rank.alias("rank"), F.lit("dependency-direction-fallback").alias("method"))
    # Layers are directories or words, not files: their order is one small window.
    net = grouped.groupBy("layer").agg(F.sum(F.col("fan_out") - F.col("fan_in")).alias("net"))
    ranked = net.select("layer", (F.row_number().over(Window.orderBy(F.desc("net"), "layer")) - 1).alias("rank"))
    return grouped.join(ranked, "layer").select(F.col("name").alias("file"), "layer", "rank", F.lit(method).alias("method"))


def overview(g: Graph) -> DataFrame:
    """(section, source, target, n): files of each layer, and dependencies between layers."""
    at = materialise(layers_by_role(g).select("file", "layer"), "layers")
    layers = at.groupBy("layer").agg(F.count("*").alias("n")).select(F.lit("layer").alias("section"), F.col("layer").alias("source"), F.lit(None).cast("string").alias("target"), "n")
    pairs = R.module_edges(g).join(at.toDF("file_path", "source"), "file_path").join(at.toDF("target_file", "target"), "target_file")
    return layers.union(pairs.groupBy("source", "target").agg(F.count("*").alias("n")).select(F.lit("matrix"), "source", "target", "n"))


def depth_from(pairs: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, depth): distance from the entries over (a, b); what they do not reach is one further than the furthest."""
    steps = Steps(pairs.toDF("a", "b").where("a <> b").distinct(), "a")
    seen = materialise(entries.toDF("file").distinct().select("file", F.lit(0).alias("depth")), "depth")
    at, few, hop = seen, _few(seen), 0
    while few != []:
        hop += 1
        step = steps.of(at.select("file"), "file", few).select(F.col("b").alias("file")).distinct()
        at = materialise(step.join(seen, "file", "left_anti").withColumn("depth", F.lit(hop)), "depth-new")
        seen, few = seen.union(at), _few(at)
    last = seen.agg((F.coalesce(F.max("depth"), F.lit(-1)) + 1).alias("beyond"))
    return files.toDF("file").distinct().join(seen, "file", "left").join(last).select("file", F.coalesce("depth", "beyond").alias("depth"))


def entry_seeds(g: Graph, globs: Sequence[str]) -> DataFrame:
    """(qualified_name) declared in files that match an entry pattern."""
    hit = reduce(or_, [F.col("file_path").rlike(C.glob(x)) for x in globs]) if globs else F.lit(False)
    return g.nodes.where(hit).select("qualified_name").distinct()


def unmatched_patterns(g: Graph, globs: Sequence[str]) -> DataFrame:
    """(pattern) of those that no file matches; one pass over the files."""
    hits = g.files.agg(*[F.coalesce(F.max(F.col("path").rlike(C.glob(x))), F.lit(False)).alias(f"p{i}") for i, x in enumerate(globs)])
    rows = F.array(*[F.struct(F.lit(x).alias("pattern"), F.col(f"p{i}").alias("hit")) for i, x in enumerate(globs)])
    return hits.select(F.explode(rows).alias("r")).where("not r.hit").select("r.pattern")


def without_prefixes(flows: DataFrame) -> DataFrame:
    """Flows (`steps` arrays) that are no strict prefix of another: each meets the longer ones on its whole chain."""
    whole = flows.select("*", F.array_join("steps", "\x00").alias("chain"))
    shorter = whole.where("size(steps) > 1").select(F.explode(F.expr("transform(sequence(1, size(steps) - 1), i -> array_join(slice(steps, 1, i), '\x00'))")).alias("chain")).distinct()
    return whole.join(shorter, "chain", "left_anti").drop("chain")


def counterparts(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, counterpart, state): the parallel path in the mirrored directory of each file, for (left_dir, right_dir) pairs.

    `counterpart` or `no_counterpart` for files under a pair, the deepest first, `outside_mirror` for others.
    """
    sides = pairs.select(F.col("left_dir").alias("dir"), F.col("right_dir").alias("other")).union(pairs.select("right_dir", "left_dir"))
    up = files.select("path", F.posexplode(C.dirs("path")).alias("depth", "dir")).join(sides, "dir")
    one = up.groupBy("path").agg(F.max(F.struct("depth", "dir", "other")).alias("m")).select("path", F.concat("m.other", F.expr("substr(path, length(m.dir) + 1)")).alias("candidate"))
    known = files.select(F.col("path").alias("candidate")).distinct().withColumn("held", F.lit(True))
    found = files.select("path").distinct().join(one, "path", "left").join(known, "candidate", "left")
    state = F.when(F.col("candidate").isNull(), "outside_mirror").when(F.col("held"), "counterpart").otherwise("no_counterpart")
    return found.select("path", F.when(F.col("held"), F.col("candidate")).alias("counterpart"), state.alias("state"))


def outside_inbound(g: Graph, pairs: DataFrame) -> DataFrame:
    """(left_dir, right_dir, side, n): files outside both sides of a pair that depend on files of each side."""
    under = g.files.select("path", F.explode(C.dirs("path")).alias("dir"))
    sides = pairs.select("left_dir", "right_dir", F.explode(F.array("left_dir", "right_dir")).alias("dir"))
    at = materialise(under.join(sides, "dir").select("path", "left_dir", "right_dir", F.col("dir").alias("side")), "sides")
    hits = R.file_pairs(g).join(at.withColumnRenamed("path", "target_file"), "target_file")
    inner = at.select(F.col("path").alias("file_path"), "left_dir", "right_dir").distinct()
    counts = hits.join(inner, ["file_path", "left_dir", "right_dir"], "left_anti").groupBy("left_dir", "right_dir", "side").agg(F.count("*").alias("n"))
    return sides.withColumnRenamed("dir", "side").join(counts, ["left_dir", "right_dir", "side"], "left").na.fill(0, ["n"])


def mirror_preference(paths: DataFrame, inbound: DataFrame) -> DataFrame:
    """(path, prefer): 0 outside all mirrors, 1 on the side that more depends on from outside, 2 on the other; ties by name."""
    other = inbound.select("left_dir", "right_dir", F.col("side").alias("other"), F.col("n").alias("theirs"))
    both = inbound.join(other, ["left_dir", "right_dir"]).where("side <> other")
    ranked = both.select(F.col("side").alias("dir"), F.when(F.col("n") > F.col("theirs"), 1).when(F.col("n") < F.col("theirs"), 2).when(F.col("side") <= F.col("other"), 1).otherwise(2).alias("rank"), "left_dir", "right_dir")
    own = paths.select("path").distinct()
    up = own.select("path", F.explode(F.array_append(C.dirs("path"), F.col("path"))).alias("dir")).join(ranked, "dir")
    best = up.groupBy("path").agg(F.min(F.struct((-F.length("dir")).alias("l"), "dir", "left_dir", "right_dir", "rank")).alias("m")).select("path", F.col("m.rank").alias("prefer"))
    return own.join(best, "path", "left").na.fill(0, ["prefer"])


def without_redundant_files(hits: DataFrame) -> DataFrame:
    """Search hits without files whose class is a hit too."""
    types = hits.where(F.col("kind").isin(*TYPE_KINDS)).select("file_path").distinct()
    return hits.where("kind <> 'File'").unionByName(hits.where("kind = 'File'").join(types, "file_path", "left_anti").select(*hits.columns))


def reading_starts(g: Graph, limit: int = 20) -> DataFrame:
    """(file, rank): files that nothing depends on, in the order a reader would start at them."""
    zero = module_degrees(g).where("fan_in = 0").select(F.col("name").alias("file"), C.reading_rank("name").alias("rank"))
    return zero.orderBy("rank", "file").limit(limit)


def working_files(g: Graph, stub_roots: Sequence[str] = (), roots: Sequence[str] = ()) -> DataFrame:
    """(path): files of the working tree, outside stubs and what is read late."""
    out = g.files.select("path")
    if roots:
        out = out.where(reduce(or_, [C.path_under("path", r) for r in roots]))
    for stub in stub_roots:
        out = out.where(~C.path_under("path", stub))
    return out.where(~F.coalesce(C.responsibility_layer("path").isin(*READ_LATE), F.lit(False)))
