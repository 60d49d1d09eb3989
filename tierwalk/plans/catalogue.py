"""All graph queries by name, each over the whole projection of the star schema, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.functions import columns as C
from tierwalk.operators import analytics as A
from tierwalk.operators import compute as T
from tierwalk.operators import definitions as N
from tierwalk.operators import records as X
from tierwalk.operators import relational as R
from tierwalk.operators import resolve as L
from tierwalk.operators import rules as U
from tierwalk.operators import search as S
from tierwalk.operators import snapshots as D
from tierwalk.operators import walks as W
from tierwalk.sources.graph import SQL, Graph, built

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, sql: str | None, f: Callable[[Graph], DataFrame]) -> None:
    """Register a query over the graph; `sql` follows the projection's common tables."""
    QUERIES[name] = lambda spark, sf_dir: f(built(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = SQL + sql


def names(g: Graph, *values: str) -> DataFrame:
    return g.files.sparkSession.createDataFrame([(v,) for v in values], "asked string")


CALLERS = "('CALLS', 'NEW')"
IMPACT = "('CALLS', 'NEW', 'EXTENDS', 'IMPLEMENTS', 'INCLUDES', 'IMPORTS')"
TIER = "CASE {} WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'HEURISTIC' ELSE 'DYNAMIC' END"
COLS = "kind, source_qname, target_qname, target_raw, file_path, line, confidence_tier"
EDGE_ORDER = "source_qname, kind, target_raw, file_path, line, confidence_tier"

# Reads of edges

add("callers", f"""SELECT {COLS} FROM (SELECT * FROM ranked WHERE target_qname = 'part.1' AND kind IN {CALLERS}
    QUALIFY row_number() OVER (PARTITION BY source_qname ORDER BY tr, file_path, line, kind, target_raw) = 1)
        ORDER BY tr, {EDGE_ORDER} LIMIT 50""", lambda g: R.callers(g, "part.1"))  # fmt: skip
add(
    "edges_by_target",
    f"""SELECT {COLS} FROM ranked WHERE target_qname = 'part.2' ORDER BY tr, {EDGE_ORDER} LIMIT 10 OFFSET 5""",
    lambda g: R.edges_page(R.edges_to(g, ["part.2"]), 10, 5, tier_first=True),
)
add(
    "edges_by_targets",
    f"""SELECT {COLS} FROM edges WHERE target_qname IN ('part.3', 'supp.2') AND kind IN {CALLERS} ORDER BY {EDGE_ORDER} LIMIT 40""",
    lambda g: R.edges_page(R.edges_to(g, ["part.3", "supp.2"], R.CALLER_KINDS), 40),
)
add(
    "edges_by_target_tier",
    f"""SELECT {COLS} FROM edges WHERE target_qname = 'part.5' AND confidence_tier = 'HEURISTIC' AND starts_with(file_path, 'sales/')
        ORDER BY {EDGE_ORDER} LIMIT 30""",
    lambda g: R.edges_page(R.edges_to(g, ["part.5"], tier="HEURISTIC", path="sales"), 30),
)
add(
    "edges_without_tests",
    f"""SELECT {COLS} FROM edges WHERE target_qname = 'part.7' AND source_qname NOT IN (SELECT qualified_name FROM nodes WHERE is_test)
        ORDER BY {EDGE_ORDER} LIMIT 100""",
    lambda g: R.edges_page(R.edges_to(g, ["part.7"], without_tests=True), 100),
)
add("edges_by_source", f"SELECT {COLS} FROM edges WHERE source_qname = 'part.10' ORDER BY {EDGE_ORDER} LIMIT 50", lambda g: R.edges_page(R.edges_from(g, "part.10"), 50))
add(
    "edges_matching_kind",
    f"""SELECT {COLS} FROM edges WHERE kind = 'INCLUDES' ORDER BY {EDGE_ORDER} LIMIT 25""",
    lambda g: R.edges_page(g.edges.where("kind = 'INCLUDES'"), 25),
)
add(
    "call_lines_by_source",
    f"""SELECT source_qname, file_path, string_agg(DISTINCT line::VARCHAR, ',' ORDER BY line::VARCHAR) AS lines FROM edges
        WHERE target_qname = 'part.4' AND kind IN {CALLERS} GROUP BY ALL""",
    lambda g: R.call_lines(g, "part.4"),
)
add("tier_census_by_target", "SELECT confidence_tier, count(*) n FROM edges WHERE target_qname = 'part.1' GROUP BY 1", lambda g: R.tier_census(g, "part.1"))
add(
    "edge_subtrees_by_target",
    """SELECT split_part(file_path, '/', 1) subtree, count(*) n FROM edges WHERE target_qname = 'supp.1' GROUP BY 1""",
    lambda g: R.subtrees_of_callers(g, "supp.1"),
)
add(
    "inbound_test_rows",
    """SELECT coalesce(is_test, false) is_test, count(*) n, count(DISTINCT source_qname) sources FROM edges
        LEFT JOIN first_nodes ON source_qname = qualified_name WHERE target_qname = 'supp.3' GROUP BY 1""",
    lambda g: R.test_census(g, "supp.3"),
)
add(
    "argument_census",
    """SELECT CASE WHEN args[2] IS NULL THEN 'dynamic' ELSE args[2] END AS argument, count(*) n FROM edges WHERE kind = 'CALLS' AND args IS NOT NULL
        GROUP BY 1""",
    lambda g: R.argument_census(g, 2),
)
add(
    "write_statements_by_targets",
    f"""SELECT source_qname, file_path, line, kind, string_agg(DISTINCT target_qname, ','
        ORDER BY target_qname) targets, {TIER.format('min(tr)')} confidence_tier FROM ranked
        WHERE kind IN ('WRITES', 'READS') AND target_qname IN (SELECT qualified_name FROM nodes WHERE kind IN ('Table', 'Column')) GROUP BY 1, 2, 3, 4""",
    lambda g: R.statements(g, g.nodes.where("kind in ('Table', 'Column')"), ("WRITES", "READS")),
)
add(
    "reads_naming_no_column",
    """SELECT DISTINCT source_qname, file_path, line FROM edges e WHERE kind = 'READS' AND target_qname = 'evt.view' AND NOT EXISTS (SELECT 1 FROM edges x
        WHERE x.kind = 'READS' AND starts_with(x.target_qname, 'evt.view::') AND x.source_qname = e.source_qname AND x.file_path = e.file_path AND x.line = e.line)""",
    lambda g: R.reads_naming_no_column(g, "evt.view"),
)
add("unlinked_by_target_raw", "SELECT kind, target_raw, count(*) n FROM edges WHERE target_qname IS NULL GROUP BY 1, 2", R.unlinked)

# Reads of nodes

NODES = "kind, name, qualified_name, file_path, line_start, is_test"
add(
    "nodes_by_names",
    f"""SELECT name AS asked, {NODES}, row_number() OVER (PARTITION BY name ORDER BY qualified_name, file_path, line_start, kind)::INT AS rank FROM nodes
        WHERE name IN ('small ring', 'view', 'nation_3') QUALIFY rank <= 4""",
    lambda g: R.batched(g, names(g, "small ring", "view", "nation_3"), "name", 4),
)
add(
    "nodes_by_qualified_names_casefold",
    f"""SELECT a AS asked, {NODES}, row_number() OVER (PARTITION BY a ORDER BY qualified_name, file_path, line_start, kind)::INT AS rank
        FROM nodes, (VALUES ('PART.3'), ('Nation.1')) v(a) WHERE lower(qualified_name) = lower(a) QUALIFY rank <= 3""",
    lambda g: R.batched(g, names(g, "PART.3", "Nation.1"), "qualified_name", 3, fold=True),
)
add(
    "file_outline",
    f"""SELECT {NODES} FROM nodes WHERE file_path = 'events/view.tbl' ORDER BY line_start, qualified_name, file_path, kind LIMIT 20""",
    lambda g: R.outline(g, "events/view.tbl", 20),
)
add("multi_declared", "SELECT qualified_name, kind, count(*) n, min(file_path) first_file FROM nodes GROUP BY 1, 2 HAVING count(*) > 1", R.multiply_declared)
add("node_universe", "SELECT DISTINCT qualified_name, file_path FROM nodes", R.universe)
add(
    "failed_paths",
    """SELECT path FROM files WHERE NOT parsed_ok ORDER BY path LIMIT 20 OFFSET 2""",
    lambda g: g.files.where("not parsed_ok").select("path").orderBy("path").offset(2).limit(20),
)
add("indexed_languages", "SELECT language, count(*) n FROM files GROUP BY 1", lambda g: g.files.groupBy("language").agg(F.count("*").alias("n")))
add(
    "dotted_module_keys",
    r"""SELECT key, count(*) n FROM (SELECT array_to_string(p[i:], '.') AS key FROM (SELECT string_split(regexp_replace(path, '\.[^./]*$', ''), '/') p
        FROM files) x, LATERAL (SELECT unnest(range(1, len(p) + 1)) i) y) GROUP BY 1""",
    R.module_keys,
)

# Joins

PAIRS = ", fp AS (SELECT DISTINCT e.file_path, n.file_path AS target_file FROM edges e JOIN nodes n ON e.target_qname = n.qualified_name), me AS (SELECT * FROM fp WHERE file_path <> target_file) "
add("resolved_edge_file_pairs", PAIRS + "SELECT * FROM fp", R.file_pairs)
add("module_edges", PAIRS + "SELECT * FROM me", R.module_edges)
METIERS = ", st AS MATERIALIZED (SELECT source_qname, target_qname, min(tr) tr FROM ranked WHERE target_qname IS NOT NULL GROUP BY 1, 2), nf AS MATERIALIZED (SELECT DISTINCT qualified_name q, file_path f FROM nodes), sx AS MATERIALIZED (SELECT f source_file, target_qname, min(tr) tr FROM st JOIN nf ON source_qname = q GROUP BY 1, 2), mt AS MATERIALIZED (SELECT source_file, f target_file, min(tr) tr FROM sx JOIN nf ON target_qname = q WHERE source_file <> f GROUP BY 1, 2) "
add("module_edge_tiers", METIERS + f"SELECT source_file, target_file, {TIER.format('tr')} confidence_tier FROM mt", R.module_edge_tiers)
add(
    "include_neighbours",
    """SELECT DISTINCT path FROM (SELECT target_qname path FROM edges WHERE kind = 'INCLUDES' AND source_qname IN (SELECT path FROM files
        WHERE path LIKE 'supply/ASIA/%') UNION SELECT source_qname FROM edges WHERE kind = 'INCLUDES' AND target_qname IN (SELECT path FROM files
        WHERE path LIKE 'supply/ASIA/%'))""",
    lambda g: R.include_neighbours(g, g.files.where("startswith(path, 'supply/ASIA/')").select("path")),
)
add(
    "file_paths_targeting",
    """SELECT DISTINCT file_path FROM edges WHERE target_qname IN (SELECT qualified_name FROM nodes WHERE file_path LIKE 'catalog/Brand_1/%')""",
    lambda g: R.dependents(g, g.files.where("startswith(path, 'catalog/Brand_1/')").select("path")),
)
add(
    "cross_language_edges",
    """SELECT kind, a.language source_language, b.language target_language, count(*) n FROM edges e JOIN files a ON e.file_path = a.path
        JOIN (SELECT DISTINCT qualified_name, language FROM nodes JOIN files ON file_path = path) b ON target_qname = b.qualified_name
        WHERE a.language <> b.language GROUP BY 1, 2, 3""",
    R.cross_language,
)
add(
    "hierarchy_parents",
    """SELECT source_qname, string_agg(target_qname, ',' ORDER BY target_qname) parents FROM (SELECT DISTINCT source_qname, target_qname FROM edges
        WHERE kind = 'EXTENDS') GROUP BY 1""",
    R.parents,
)

# Censuses

add(
    "counts",
    """SELECT (SELECT count(*) FROM files) files, (SELECT count(*) FROM files WHERE parsed_ok) parsed, (SELECT count(*) FROM files
        WHERE NOT parsed_ok) failed, (SELECT count(*) FROM nodes) nodes, (SELECT count(*) FROM edges) edges""",
    R.counts,
)
add("edge_health", "SELECT confidence_tier, count(*) n, count(target_qname) linked, count(*) - count(target_qname) unlinked FROM edges GROUP BY 1", R.edge_health)
add(
    "edge_language_census",
    """SELECT language, count(*) FILTER (confidence_tier = 'RESOLVED') resolved, count(*) FILTER (confidence_tier = 'HEURISTIC') heuristic, count(*) FILTER (confidence_tier = 'DYNAMIC') dynamic, count(target_qname) linked, string_agg(DISTINCT kind, ','
        ORDER BY kind) kinds FROM edges JOIN files ON file_path = path GROUP BY 1""",
    R.language_census,
)
add("node_kind_counts", "SELECT kind, count(*) n FROM nodes GROUP BY 1", lambda g: R.kind_counts(g.nodes))
add("edge_kind_counts", "SELECT kind, count(*) n FROM edges GROUP BY 1", lambda g: R.kind_counts(g.edges))
add("file_kind_counts", "SELECT file_path, kind, count(*) n FROM nodes GROUP BY 1, 2", R.file_kind_counts)
add("file_symbol_counts", "SELECT file_path, count(*) symbols, count(*) FILTER (kind = 'Class') classes FROM nodes WHERE kind <> 'File' GROUP BY 1", R.file_symbol_counts)
add(
    "module_hubs",
    PAIRS + """SELECT i.f AS file, fan_in, coalesce(fan_out, 0) fan_out FROM (SELECT target_file f, count(*) fan_in FROM me GROUP BY 1) i
        LEFT JOIN (SELECT file_path f, count(*) fan_out FROM me GROUP BY 1) o ON i.f = o.f ORDER BY fan_in DESC, file LIMIT 20""",
    R.hubs,
)
add(
    "largest_classes",
    """SELECT c.qualified_name, c.file_path, count(m.name) methods FROM nodes c
       
            LEFT JOIN nodes m ON m.kind = 'Method' AND m.file_path = c.file_path AND split_part(m.qualified_name, '::', 1) = c.qualified_name AND contains(m.qualified_name, '::')
        WHERE c.kind = 'Class' GROUP BY 1, 2 ORDER BY methods DESC, 1, 2 LIMIT 20""",
    R.largest_classes,
)
add(
    "dependency_edges_with_tier",
    f"""SELECT source_qname, target_qname, {TIER.format('min(tr)')} confidence_tier FROM ranked
        WHERE target_qname IS NOT NULL AND source_qname <> target_qname GROUP BY 1, 2""",
    R.dependency_edges,
)
FLOW = f", fe AS (SELECT source_qname, target_qname, kind, min(tr) tr, coalesce(min(line) FILTER (tr = 0), min(line) FILTER (tr = 1), min(line)) line FROM ranked WHERE target_qname IS NOT NULL AND (kind IN {IMPACT} OR kind = 'WRITES') GROUP BY 1, 2, 3) "
add("flow_edges", FLOW + f"SELECT source_qname, target_qname, kind, {TIER.format('tr')} confidence_tier, line FROM fe", R.flow_edges)

# Templates

add("tier_mix", """SELECT e.kind, a.language source_language, coalesce(b.language, '-') target_language, count(*) n, count(*) FILTER (confidence_tier = 'HEURISTIC') heuristic, count(*) FILTER (target_qname IS NULL) unlinked,
    round(count(*) FILTER (confidence_tier = 'HEURISTIC') / count(*), 4) heuristic_share, round(count(*) FILTER (target_qname IS NULL) / count(*), 4) unlinked_share
    FROM edges e JOIN files a ON e.file_path = a.path LEFT JOIN first_nodes f ON target_qname = qualified_name
        LEFT JOIN files b ON f.file_path = b.path GROUP BY 1, 2, 3""", T.tier_mix)  # fmt: skip
ABSENT = "SELECT qualified_name, file_path, CASE WHEN name IN (SELECT target_raw FROM ref) OR qualified_name IN (SELECT target_raw FROM ref) THEN 'no_edge_but_mentioned' ELSE 'no_edge_no_mention' END evidence FROM nodes n WHERE kind = '{kind}' AND NOT EXISTS (SELECT 1 FROM ref WHERE target_qname = n.qualified_name AND source_qname <> n.qualified_name)"
add("no_referrer", ", ref AS (SELECT * FROM edges WHERE kind <> 'CONTAINS') " + ABSENT.format(kind="Class"), lambda g: T.no_referrer(g, "Class"))
add("no_referrer_functions", ", ref AS (SELECT * FROM edges WHERE kind <> 'CONTAINS') " + ABSENT.format(kind="Function"), lambda g: T.no_referrer(g, "Function"))
add("unreferenced_objects", ", ref AS (SELECT e.* FROM edges e JOIN files ON file_path = path WHERE kind <> 'CONTAINS' AND language = 'prt') " + ABSENT.format(kind="Class"), lambda g: T.no_referrer(g, "Class", language="prt"))
add(
    "calls_by_module",
    r"""SELECT split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) AS module, count(*) calls, count(DISTINCT source_qname) callers
        FROM edges WHERE kind = 'CALLS' AND regexp_matches(target_qname, '^part\.1[^/]*$') GROUP BY 1""",
    lambda g: T.calls_by_module(g, "part.1*"),
)
add(
    "untested_classes",
    """SELECT qualified_name, file_path FROM nodes
        WHERE kind = 'Class' AND NOT is_test AND qualified_name NOT IN (SELECT unnest([target_qname, split_part(target_qname, '::', 1)]) FROM edges
        WHERE kind <> 'CONTAINS' AND target_qname IS NOT NULL AND source_qname IN (SELECT qualified_name FROM nodes WHERE is_test))""",
    T.untested_types,
)
add(
    "resolved_share",
    """SELECT split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) AS module, count(*) calls, count(*) FILTER (confidence_tier = 'RESOLVED' AND target_qname IS NOT NULL) resolved, count(*) - count(target_qname) unlinked, round(count(*) FILTER (confidence_tier = 'RESOLVED' AND target_qname IS NOT NULL) / count(*), 4) AS share
        FROM edges WHERE kind = 'CALLS' GROUP BY 1""",
    T.resolved_share,
)
add("includes_by_dir", "SELECT split_part(file_path, '/', 1) dir, confidence_tier, count(*) n FROM edges WHERE kind = 'INCLUDES' GROUP BY 1, 2", T.includes_by_dir)
add(
    "multi_defined",
    """SELECT qualified_name, kind, count(*) definitions, arg_min(file_path, (is_test::INT)::VARCHAR || file_path) live_file FROM nodes WHERE kind <> 'File'
        GROUP BY 1, 2 HAVING count(*) > 1""",
    T.multi_defined,
)
add(
    "variant_pairs",
    """, nm AS (SELECT DISTINCT qualified_name q, qualified_name IN (SELECT target_qname FROM edges
        WHERE kind <> 'CONTAINS' AND target_qname IS NOT NULL) used FROM nodes WHERE kind IN ('Class', 'Method', 'Function'))
        SELECT a.q stem, b.q variant, a.used stem_used, b.used variant_used FROM nm a JOIN nm b ON b.q = a.q || '0' WHERE a.used <> b.used""",
    lambda g: T.variant_pairs(g, "0"),
)

# Search

add("search_nodes", """, h AS (SELECT *, starts_with(lower(name), 'ring') OR starts_with(lower(qualified_name), 'ring') OR lower(qualified_name) LIKE '%::ring' OR lower(qualified_name) LIKE '%.ring' direct
        FROM nodes WHERE contains(lower(name), 'ring') OR contains(lower(qualified_name), 'ring') OR contains(lower(file_path), 'ring'))
    SELECT kind, name, qualified_name, file_path, direct, coalesce(split_part(qualified_name, '::', 1) IN (SELECT qualified_name FROM h
        WHERE direct) AND contains(qualified_name, '::'), false) demoted FROM h
        ORDER BY direct DESC, demoted, length(qualified_name), qualified_name, file_path, kind LIMIT 20""", lambda g: S.search(g, "ring"))  # fmt: skip
add("search_direct", """, h AS (SELECT *, starts_with(lower(name), 'evt.view') OR starts_with(lower(qualified_name), 'evt.view') direct FROM nodes
        WHERE contains(lower(name), 'evt.view') OR contains(lower(qualified_name), 'evt.view') OR contains(lower(file_path), 'evt.view'))
    SELECT kind, name, qualified_name, file_path, direct, coalesce(split_part(qualified_name, '::', 1) IN (SELECT qualified_name FROM h
        WHERE direct) AND contains(qualified_name, '::'), false) demoted FROM h
        ORDER BY direct DESC, demoted, length(qualified_name), qualified_name, file_path, kind LIMIT 20""", lambda g: S.search(g, "evt.view"))  # fmt: skip
add(
    "search_short",
    """SELECT kind, count(*) n FROM nodes WHERE starts_with(lower(name), 're') OR starts_with(lower(qualified_name), 're') GROUP BY 1""",
    lambda g: R.kind_counts(S.hits(g, "re")),
)
add(
    "count_search_nodes",
    """SELECT count(*) n FROM nodes
       
            WHERE kind = 'Class' AND NOT is_test AND (file_path = 'catalog' OR starts_with(file_path, 'catalog/')) AND (contains(lower(name), 'widget') OR contains(lower(qualified_name), 'widget') OR contains(lower(file_path), 'widget'))""",
    lambda g: S.hits(g, "widget", kind="Class", path="catalog", without_tests=True).agg(F.count("*").alias("n")),
)
add(
    "edit_distance_names",
    """SELECT DISTINCT name, levenshtein(lower(name), 'red wigdet')::INT distance FROM nodes WHERE levenshtein(lower(name), 'red wigdet') <= 2
        ORDER BY 2, 1 LIMIT 5""",
    lambda g: S.did_you_mean(g, "red wigdet"),
)
add(
    "token_candidates",
    """SELECT qualified_name, file_path, contains(lower(name || ' ' || qualified_name), 'small')::INT + contains(lower(name || ' ' || qualified_name), 'ring')::INT AS score
        FROM nodes
        WHERE kind <> 'File' AND (contains(lower(name || ' ' || qualified_name), 'small') OR contains(lower(name || ' ' || qualified_name), 'ring'))
        ORDER BY score DESC, qualified_name, file_path, kind LIMIT 5""",
    lambda g: S.by_tokens(g, "smallRing"),
)

# Walks

SEEDS = "qualified_name IN ('part.1', 'supp.4')"
add("impact_radius", f""", w AS (SELECT source_qname, target_qname, confidence_tier tier, CASE kind WHEN 'CALLS' THEN 1.0::DOUBLE WHEN 'NEW' THEN 1.0
        WHEN 'EXTENDS' THEN 0.9 WHEN 'IMPLEMENTS' THEN 0.9 ELSE 0.8 END * 0.7::DOUBLE f FROM edges
        WHERE target_qname IS NOT NULL AND kind IN {IMPACT}),
    s0 AS (SELECT DISTINCT qualified_name q, 1.0::DOUBLE score, 0 depth, 'RESOLVED' tier, true is_seed FROM nodes WHERE {SEEDS}),
    r1 AS (SELECT source_qname q, score * f score, 1 depth, w.tier FROM s0 JOIN w ON target_qname = q),
    x1 AS (SELECT q, max(score) score, 1 depth, max(tier) FILTER (score >= m - 1e-12) tier, max(score) FILTER (tier = 'RESOLVED') proven
        FROM (SELECT *, max(score) OVER (PARTITION BY q) m FROM r1) GROUP BY 1),
    b1 AS (SELECT coalesce(s0.q, x1.q) q, CASE WHEN s0.q IS NULL OR x1.score > s0.score THEN x1.score ELSE s0.score END score, CASE
        WHEN s0.q IS NULL OR x1.score > s0.score THEN x1.depth ELSE s0.depth END depth, CASE
        WHEN s0.q IS NULL OR x1.score > s0.score THEN x1.tier ELSE s0.tier END tier, s0.q IS NOT NULL is_seed, proven FROM s0
        FULL JOIN x1 ON s0.q = x1.q),
    r2 AS (SELECT source_qname q, b1.score * f score, b1.depth + 1 depth, w.tier FROM b1 JOIN w ON target_qname = b1.q
        WHERE proven IS NOT NULL AND abs(proven - b1.score) < 1e-12),
    x2 AS (SELECT q, max(score) score, min(depth) FILTER (score >= m - 1e-12) depth, max(tier) FILTER (score >= m - 1e-12) tier
        FROM (SELECT *, max(score) OVER (PARTITION BY q) m FROM r2 WHERE score >= 0.05) GROUP BY 1)
    SELECT coalesce(b1.q, x2.q) qname, round(CASE WHEN b1.q IS NULL OR x2.score > b1.score THEN x2.score ELSE b1.score END, 9) score, CASE
        WHEN b1.q IS NULL OR x2.score > b1.score THEN x2.depth ELSE b1.depth END depth, CASE
        WHEN b1.q IS NULL OR x2.score > b1.score THEN x2.tier ELSE b1.tier END tier, coalesce(b1.is_seed, false) is_seed FROM b1
        FULL JOIN x2 ON b1.q = x2.q""", lambda g: W.impact(g, g.nodes.where(SEEDS).select("qualified_name"), depth=2, max_nodes=100_000).rows.select("qname", F.round("score", 9).alias("score"), "depth", "tier", "is_seed"))  # fmt: skip
REACH = f", re AS (SELECT DISTINCT source_qname s, target_qname t, confidence_tier tier FROM edges WHERE target_qname IS NOT NULL AND kind IN {IMPACT}), seen AS (SELECT 'cust.7::o' || min(o_orderkey) q FROM orders WHERE o_custkey = 7 UNION SELECT t FROM seen JOIN re ON s = q WHERE tier = 'RESOLVED'), up AS (SELECT q FROM seen UNION SELECT split_part(q, '::', 1) FROM seen WHERE contains(q, '::')) "


def _order_of_7(g: Graph) -> DataFrame:
    return g.nodes.where("kind = 'Method' and startswith(qualified_name, 'cust.7::')").withColumn("k", F.expr("cast(substring_index(qualified_name, '::o', -1) as bigint)")).orderBy("k").limit(1).select("qualified_name")


add(
    "reachable_from",
    REACH + """SELECT q AS qname, 'reached' AS state FROM up UNION SELECT DISTINCT t, 'unproven' FROM seen JOIN re ON s = q
        WHERE tier <> 'RESOLVED' AND t NOT IN (SELECT q FROM up)""",
    lambda g: W.reach(g, _order_of_7(g)).rows.select("qname", "state"),
)
add(
    "find_orphans",
    REACH + f""", un AS (SELECT q FROM up UNION SELECT t FROM seen JOIN re ON s = q WHERE tier <> 'RESOLVED') SELECT DISTINCT qualified_name,
        CASE WHEN qualified_name IN (SELECT t FROM re) THEN 'unreachable_from_roots' ELSE 'no_inbound' END why FROM nodes
        WHERE kind <> 'File' AND qualified_name NOT IN (SELECT q FROM un)""",
    lambda g: W.orphans(g, _order_of_7(g)),
)
add(
    "callers_depth_2",
    f""", c AS (SELECT source_qname s, target_qname t, min(tr) tr FROM ranked WHERE target_qname IS NOT NULL AND kind IN {CALLERS}
        GROUP BY 1, 2), h1 AS (SELECT s, tr FROM c WHERE t = 'supp.5'), h2 AS (SELECT c.s, min(c.tr) tr FROM c JOIN h1 ON c.t = h1.s
        WHERE h1.tr = 0 AND c.s NOT IN (SELECT s FROM h1) GROUP BY 1) SELECT s source_qname, 1 AS hop, {TIER.format('tr')} confidence_tier FROM h1 UNION ALL
        SELECT s, 2, {TIER.format('tr')} FROM h2""",
    lambda g: W.callers_within(g, "supp.5", 2),
)
add(
    "include_graph",
    """, i AS (SELECT DISTINCT source_qname a, target_qname b FROM edges WHERE kind = 'INCLUDES'), u AS (SELECT a, b FROM i UNION SELECT b, a
        FROM i), s AS (SELECT min(a) p FROM i), d1 AS (SELECT DISTINCT b p FROM u WHERE a = (SELECT p FROM s)), d2 AS (SELECT DISTINCT b p FROM u
        WHERE a IN (SELECT p FROM d1) AND b NOT IN (SELECT p FROM d1) AND b <> (SELECT p FROM s)) SELECT p AS path, 1 AS depth FROM d1 UNION ALL SELECT p, 2
        FROM d2""",
    lambda g: W.include_walk(g, g.edges.where("kind = 'INCLUDES'").agg(F.min("source_qname")).first()[0], "both", 2),
)
add("subtree_dependencies", """, side AS (SELECT qualified_name q, bool_or(starts_with(file_path, 'catalog/')) inn, bool_or(NOT starts_with(file_path, 'catalog/')) outt
        FROM nodes GROUP BY 1),
        x AS (SELECT *, starts_with(file_path, 'catalog/') fi FROM edges JOIN side ON target_qname = q)
    SELECT 'inbound' direction, confidence_tier, NOT outt attributable, count(*) n FROM x WHERE NOT fi AND inn GROUP BY ALL UNION ALL
        SELECT 'outbound', confidence_tier, NOT inn, count(*) FROM x WHERE fi AND outt GROUP BY ALL""", lambda g: W.subtree_report(g, "catalog"))  # fmt: skip
add(
    "dynamic_bridges",
    """SELECT file_path, count(*) bridges FROM (SELECT DISTINCT file_path, target_qname FROM edges
        WHERE confidence_tier = 'DYNAMIC' AND target_qname IN (SELECT qualified_name FROM nodes WHERE starts_with(file_path, 'catalog/')) EXCEPT
        SELECT file_path, target_qname FROM edges WHERE confidence_tier = 'RESOLVED') GROUP BY 1""",
    lambda g: W.dynamic_bridges(g, "catalog"),
)
add("candidate_tests", f""", te AS (SELECT source_qname s, target_qname t, min(tr) tr FROM ranked
        WHERE target_qname IS NOT NULL AND kind IN ('CALLS', 'NEW', 'REFERENCES', 'IMPORTS') GROUP BY 1, 2),
        ts AS (SELECT DISTINCT qualified_name q FROM nodes WHERE is_test),
        f0 AS (SELECT DISTINCT qualified_name q FROM nodes WHERE NOT is_test AND starts_with(file_path, 'supply/ASIA/')),
    s1 AS (SELECT s, min(tr) tr FROM te JOIN f0 ON t = q GROUP BY 1),
        f1 AS (SELECT s q FROM s1 WHERE s NOT IN (SELECT q FROM ts) AND s NOT IN (SELECT q FROM f0)),
        s2 AS (SELECT s, min(tr) tr FROM te JOIN f1 ON t = q GROUP BY 1)
    SELECT s source_qname, 1 AS hop, {TIER.format('tr')} confidence_tier FROM s1 WHERE s IN (SELECT q FROM ts) UNION ALL
        SELECT s, 2, {TIER.format('tr')} FROM s2 WHERE s IN (SELECT q FROM ts) AND s NOT IN (SELECT s FROM s1)""", lambda g: W.candidate_tests(g, g.files.where("startswith(path, 'supply/ASIA/')").select("path")))  # fmt: skip


def _path_rows(g: Graph) -> DataFrame:
    status, hops = W.explain_path(g, "part.100", "part.1")
    return g.files.sparkSession.createDataFrame([(status, *h) for h in hops] or [(status, 0, None, None, None, None)], "status string, hop int, source string, target string, kind string, tier string")


add("explain_path", None, _path_rows)

# Resolution

add("resolve_edges", r""", un AS (SELECT DISTINCT kind, source_qname, target_raw, file_path, line, confidence_tier, language FROM edges
        JOIN files ON file_path = path WHERE target_qname IS NULL),
        q AS (SELECT DISTINCT qualified_name n FROM nodes),
        fn AS (SELECT name, language, min(qualified_name) n FROM nodes JOIN files ON file_path = path WHERE kind = 'Function' GROUP BY 1, 2
        HAVING count(DISTINCT qualified_name) = 1)
    SELECT kind, source_qname, target_raw, file_path, line, confidence_tier, coalesce(q.n, fn.n) target, CASE
        WHEN q.n IS NOT NULL THEN 'exact' ELSE 'function' END via FROM un LEFT JOIN q ON target_raw = q.n
        LEFT JOIN fn ON target_raw = fn.name AND un.language = fn.language WHERE coalesce(q.n, fn.n) IS NOT NULL""", lambda g: L.resolve(g, dynamic=True))  # fmt: skip


def _asking(g: Graph) -> Graph:
    """The projection's names with nothing but open edges, asked in a way for each pass; methods tell their type by word or by comment."""
    method = g.nodes.where("kind = 'Method'").select(F.col("qualified_name").alias("m"), F.col("file_path").alias("p"), F.expr("try_cast(substring_index(substr(qualified_name, 6), '::o', 1) as bigint)").alias("k"), F.expr("substring_index(qualified_name, '::', -1)").alias("o"))
    customer = g.nodes.where("kind = 'Class' and startswith(qualified_name, 'cust.')").select(F.col("qualified_name").alias("m"), F.col("file_path").alias("p"), F.expr("cast(substr(qualified_name, 6) as bigint)").alias("k"))
    part = g.edges.where("kind = 'CALLS' and startswith(target_raw, 'price_')").select(F.col("source_qname").alias("m"), F.col("file_path").alias("p"), "target_raw")
    maker = g.nodes.where("kind = 'Class' and startswith(qualified_name, 'supp.')").select(F.col("qualified_name").alias("m"), F.col("file_path").alias("p"))
    found = g.nodes.where("kind = 'Class' and startswith(qualified_name, 'part.')").select(F.expr("concat('supp', substr(qualified_name, 5))").alias("m"), F.col("file_path").alias("part_path"))

    def ask(rows: DataFrame, kind: str, raw: str, line: int, tier: str = "RESOLVED") -> DataFrame:
        return rows.selectExpr(f"'{kind}' as kind", "m as source_qname", "cast(null as string) as target_qname", f"{raw} as target_raw", "p as file_path", f"{line} as line", f"'{tier}' as confidence_tier", "cast(null as array<string>) as args")

    edges = ask(customer, "EXTENDS", "concat('cust.', k div 2)", 0).union(ask(customer.withColumn("m", F.concat(F.lit("nick."), "k")), "ALIASES", "concat('cust.', k)", 0, "DYNAMIC"))
    asked = (
        (method, "CALLS", "concat('nick.', k, '::', o)", "RESOLVED"),
        (method, "CALLS", "concat('cust.', 2 * k, '::', o)", "RESOLVED"),
        (method, "CALLS", "concat('cust.', k div 2, '::', o)", "RESOLVED"),
        (method, "CALLS", "concat(m, '()::', o)", "RESOLVED"),
        (method, "CALLS", "concat(m, '()::', o, '()::', o)", "RESOLVED"),
        (method, "CALLS", "o", "HEURISTIC"),
        (method, "CALLS", "concat('nowhere::x()::', o)", "RESOLVED"),
        (customer, "WRITES", "'EVT.VIEW::VALUE'", "RESOLVED"),
        (customer, "WRITES", "'View'", "RESOLVED"),
        (customer, "WRITES", "'x.CLICK::Props'", "RESOLVED"),
        (part, "CALLS", "target_raw", "RESOLVED"),
        (part, "CALLS", "upper(target_raw)", "RESOLVED"),
        (maker.join(found, "m"), "INCLUDES", "concat('../../../', part_path)", "RESOLVED"),
        (maker, "INCLUDES", "concat('/', substring_index(p, '/', -1))", "HEURISTIC"),
        (method, "CALLS", "m", "DYNAMIC"),
    )
    for line, (rows, kind, raw, tier) in enumerate(asked, 1):
        edges = edges.union(ask(rows, kind, raw, line, tier))
    told = F.expr("kind = 'Method' and try_cast(substr(name, 2) as bigint) % 2 = 0")
    nodes = g.nodes.withColumn("declared_type", F.when((F.col("kind") == "Method") & ~told, "static")).withColumn("doc_type", F.when(told, F.substring_index("qualified_name", "::", 1)))
    return Graph(g.files, nodes, edges)


add("resolve_passes", """, od AS (SELECT o_custkey k, 'o' || o_orderkey o, path p, m, o_orderkey % 2 = 0 told FROM ords),
    a AS (SELECT 'CALLS' AS kind, m AS source_qname, 'nick.' || k || '::' || o AS target_raw, p AS file_path, 1 AS line, 'RESOLVED' AS confidence_tier, m AS target, 'exact' AS via
        FROM od
    UNION ALL SELECT 'CALLS', m, 'cust.' || (2 * k) || '::' || o, p, 2, 'RESOLVED', m, CASE k WHEN 0 THEN 'exact' ELSE 'inherited' END
        FROM od WHERE 2 * k IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'CALLS', m, 'cust.' || (k // 2) || '::' || o, p, 3, CASE k WHEN 0 THEN 'RESOLVED' ELSE 'HEURISTIC' END, m, CASE k
        WHEN 0 THEN 'exact' ELSE 'subtype' END FROM od
    UNION ALL SELECT 'CALLS', m, m || '()::' || o, p, 4, CASE WHEN told THEN 'HEURISTIC' ELSE 'RESOLVED' END, m, 'chain' FROM od
    UNION ALL SELECT 'CALLS', m, m || '()::' || o || '()::' || o, p, 5, CASE WHEN told THEN 'HEURISTIC' ELSE 'RESOLVED' END, m, 'chain' FROM od
    UNION ALL SELECT 'CALLS', m, o, p, 6, 'HEURISTIC', m, 'method' FROM od
    UNION ALL SELECT 'CALLS', m, 'nowhere::x()::' || o, p, 7, 'HEURISTIC', m, 'method' FROM od
    UNION ALL SELECT 'WRITES', 'cust.' || k, 'EVT.VIEW::VALUE', path, 8, 'RESOLVED', 'evt.view::value', 'folded' FROM cust
    UNION ALL SELECT 'WRITES', 'cust.' || k, 'View', path, 9, 'RESOLVED', 'evt.view', 'table' FROM cust
    UNION ALL SELECT 'WRITES', 'cust.' || k, 'x.CLICK::Props', path, 10, 'RESOLVED', 'evt.click::props', 'table' FROM cust
    UNION ALL SELECT 'CALLS', 'part.' || k, 'price_' || type, path, 11, 'RESOLVED', 'fn.price_' || type, 'function' FROM prt
    UNION ALL SELECT 'CALLS', 'part.' || k, upper('price_' || type), path, 12, 'RESOLVED', 'fn.price_' || type, 'folded' FROM prt
    UNION ALL SELECT 'EXTENDS', 'cust.' || k, 'cust.' || (k // 2), path, 0, 'RESOLVED', 'cust.' || (k // 2), 'exact' FROM cust
        WHERE k // 2 IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'INCLUDES', 'supp.' || s.k, '../../../' || t.path, s.path, 13, 'RESOLVED', t.path, 'path' FROM supp s JOIN prt t ON s.k = t.k
    UNION ALL SELECT 'INCLUDES', 'supp.' || k, '/s' || k || '.sup', path, 14, 'HEURISTIC', path, 'tail' FROM supp)
    SELECT * FROM a""", lambda g: L.resolve(_asking(g), folding=["prt"], guesses_only=True))  # fmt: skip
add(
    "ancestry",
    """, an AS (SELECT source_qname AS name, target_qname AS ancestor, 1 AS level FROM edges WHERE kind = 'EXTENDS' UNION ALL
        SELECT an.name, target_qname, level + 1 FROM an JOIN edges ON kind = 'EXTENDS' AND source_qname = ancestor) SELECT name, ancestor, min(level) AS level
        FROM an GROUP BY 1, 2""",
    L.ancestry,
)

# Analytics

DEG = "SELECT u.n AS name, coalesce(i, 0) fan_in, coalesce(o, 0) fan_out, CASE WHEN i > 0 AND o > 0 THEN 'mixed' WHEN o > 0 THEN 'source' WHEN i > 0 THEN 'sink' ELSE 'isolated' END direction FROM u LEFT JOIN (SELECT b, count(*) i FROM p GROUP BY 1) x ON u.n = x.b LEFT JOIN (SELECT a, count(*) o FROM p GROUP BY 1) y ON u.n = y.a"
add("symbol_degrees", ", p AS (SELECT DISTINCT source_qname a, target_qname b FROM edges WHERE target_qname IS NOT NULL AND source_qname <> target_qname), u AS (SELECT qualified_name n FROM nodes UNION SELECT a FROM p UNION SELECT b FROM p) " + DEG, A.symbol_degrees)
MODDEG = PAIRS + ", p AS (SELECT file_path a, target_file b FROM me), u AS (SELECT path n FROM files UNION SELECT a FROM p UNION SELECT b FROM p), deg AS (" + DEG + ") "
add("module_degrees", MODDEG + "SELECT * FROM deg", A.module_degrees)
add(
    "assign_layers",
    MODDEG + """, l AS (SELECT *, split_part(name, '/', 1) layer
        FROM deg), k AS (SELECT layer, row_number() OVER (ORDER BY sum(fan_out - fan_in) DESC, layer)::INT AS rank FROM l GROUP BY 1)
        SELECT name AS file, layer, rank FROM l JOIN k USING (layer)""",
    A.layers,
)
add(
    "cross_layer_edges",
    PAIRS + """SELECT split_part(file_path, '/', 1) source_layer, split_part(target_file, '/', 1) target_layer, count(*) n FROM me
        WHERE split_part(file_path, '/', 1) <> split_part(target_file, '/', 1) GROUP BY 1, 2""",
    A.cross_layer,
)
add(
    "classify_reachability",
    MODDEG + """SELECT CASE WHEN t THEN 'test' WHEN fan_out > 0 THEN 'entry' ELSE 'isolated' END bucket, count(*) n, min(name) first_file FROM deg
        LEFT JOIN (SELECT file_path, bool_or(is_test) t FROM nodes GROUP BY 1) ON name = file_path WHERE fan_in = 0 GROUP BY 1""",
    A.reachability,
)
add("find_mirror_subtrees", """, sp AS (SELECT string_split(path, '/') p FROM files),
        sb AS (SELECT array_to_string(p[1:i - 1], '/') parent, p[i] child, array_to_string(p[i + 1:], '/') rel
        FROM sp, LATERAL (SELECT unnest(range(1, len(p))) i) y),
        sz AS (SELECT parent, child, count(*) n FROM sb GROUP BY 1, 2),
    pr AS (SELECT a.parent, a.child ca, b.child cb, count(*) AS shared FROM sb a
        JOIN sb b ON a.parent = b.parent AND a.rel = b.rel AND a.child < b.child GROUP BY 1, 2, 3 HAVING count(*) >= 25)
    SELECT CASE WHEN parent = '' THEN '' ELSE parent || '/' END || ca left_dir, CASE
        WHEN parent = '' THEN '' ELSE parent || '/' END || cb right_dir, shared, round(shared / (x.n + y.n - shared), 3) AS overlap FROM pr
        JOIN sz x USING (parent) JOIN sz y USING (parent) WHERE x.child = ca AND y.child = cb AND round(shared / (x.n + y.n - shared), 3) >= 0.3""", A.mirrors)  # fmt: skip
add("find_business_modules", """, sp AS (SELECT string_split(path, '/') p FROM files),
        pd AS (SELECT array_to_string(p[1:i], '/') dir, count(*) n FROM sp, LATERAL (SELECT unnest(range(1, len(p))) i) y GROUP BY 1
        HAVING count(*) >= 3),
        ch AS (SELECT *, CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') ELSE '' END container FROM pd),
    wd AS (SELECT container FROM ch WHERE container <> '' GROUP BY 1 HAVING count(*) >= 4),
        tp AS (SELECT container FROM wd a WHERE NOT EXISTS (SELECT 1 FROM wd b WHERE starts_with(a.container, b.container || '/')))
    SELECT lower(split_part(dir, '/', -1)) AS module, sum(n)::BIGINT files, count(*) dirs FROM ch JOIN tp USING (container) GROUP BY 1""", A.modules)  # fmt: skip
add("symbol_tree", """, sp AS (SELECT string_split(file_path, '/') p FROM nodes WHERE kind <> 'File') SELECT array_to_string(p[1:i], '/') dir, count(*) symbols
        FROM sp, LATERAL (SELECT unnest(range(1, len(p))) i) y GROUP BY 1 HAVING count(*) >= 10""", A.tree)
add("assign_communities", METIERS + """, rp AS (SELECT source_file a, target_file b FROM mt WHERE tr = 0),
        e1 AS (SELECT a, b FROM rp UNION SELECT b, a FROM rp),
        c1 AS (SELECT DISTINCT a n, a r FROM e1 WHERE a NOT IN (SELECT a FROM e1 WHERE b < a) UNION SELECT b, r FROM c1 JOIN e1 ON a = n),
        l1 AS (SELECT n, min(r) r FROM c1 GROUP BY 1),
        al AS (SELECT path n FROM files WHERE path NOT IN (SELECT n FROM l1)),
    hp AS (SELECT source_file a, target_file b FROM mt WHERE tr = 1 AND source_file IN (SELECT n FROM al) AND target_file IN (SELECT n
        FROM al)),
        e2 AS (SELECT a, b FROM hp UNION SELECT b, a FROM hp),
        c2 AS (SELECT DISTINCT a n, a r FROM e2 WHERE a NOT IN (SELECT a FROM e2 WHERE b < a) UNION SELECT b, r FROM c2 JOIN e2 ON a = n),
        l2 AS (SELECT n, min(r) r FROM c2 GROUP BY 1)
    SELECT n AS file, r AS community FROM l1 UNION ALL SELECT n, r FROM l2 UNION ALL SELECT n, n FROM al WHERE n NOT IN (SELECT n FROM l2)""", A.communities)  # fmt: skip
add("guided_tour", None, A.tour)
add("trace_flows", f"""{FLOW}, s0 AS (SELECT 'cust.' || c_custkey q FROM customer WHERE c_custkey < 20),
        r AS (SELECT q AS seed, q AS name, 0 AS step FROM s0 UNION SELECT seed, target_qname, step + 1 FROM r JOIN fe ON source_qname = name
        WHERE kind <> 'WRITES' AND tr = 0 AND step < 3),
        m AS (SELECT seed, name, min(step) step FROM r GROUP BY 1, 2),
        h AS (SELECT seed, target_qname sink, (step + 1)::INT steps, tr FROM m JOIN fe ON source_qname = name WHERE kind = 'WRITES')
    SELECT seed, sink, min(steps) steps, {TIER.format("arg_min(tr, steps * 10 + tr)")} confidence_tier FROM h GROUP BY 1, 2""", lambda g: A.flows(g, g.nodes.where("kind = 'Class' and startswith(qualified_name, 'cust.') and try_cast(substr(qualified_name, 6) as int) < 20").select("qualified_name")))  # fmt: skip
# The same over every customer; tests hold it against a walk in plain Python.
add("trace_flows_all", None, lambda g: A.flows(g, g.nodes.where("kind = 'Class' and startswith(qualified_name, 'cust.')").select("qualified_name")))

# Rules

RULE = U.Forbidden("sales-not-supply", ["sales/**"], ["supply/ASIA/**"], ("CALLS", "NEW"))
add(
    "check_architecture_rules",
    f"""SELECT DISTINCT 'sales-not-supply' AS rule, a.file_path source_file, b.file_path forbidden_file,
        CASE WHEN min(tr) = 0 THEN 'confirmed' ELSE 'candidate' END verdict FROM ranked e JOIN nodes a ON e.source_qname = a.qualified_name
        JOIN nodes b ON e.target_qname = b.qualified_name
        WHERE e.kind IN {CALLERS} AND starts_with(a.file_path, 'sales/') AND starts_with(b.file_path, 'supply/ASIA/') GROUP BY 2, 3""",
    lambda g: U.check(g, RULE),
)
add(
    "check_architecture_rules_transitive",
    f""", ce AS MATERIALIZED (SELECT source_qname s, target_qname t, min(tr) tr FROM ranked WHERE target_qname IS NOT NULL AND kind IN {CALLERS}
        GROUP BY 1, 2), r AS (SELECT DISTINCT file_path f, qualified_name q FROM nodes WHERE starts_with(file_path, 'sales/') UNION SELECT f, t FROM r
        JOIN ce ON s = q WHERE tr = 0) SELECT 'sales-not-supply' AS rule, f source_file, b.file_path forbidden_file,
        CASE WHEN min(tr) = 0 THEN 'confirmed' ELSE 'candidate' END verdict FROM r JOIN ce ON s = q JOIN nodes b ON t = b.qualified_name
        WHERE starts_with(b.file_path, 'supply/ASIA/') GROUP BY 2, 3""",
    lambda g: U.check(g, replace(RULE, transitive=True)),
)
add("check_column_defaults", """, wr AS (SELECT DISTINCT source_qname s, target_qname t FROM edges
        WHERE kind = 'WRITES' AND (target_qname = 'evt.click' OR starts_with(target_qname, 'evt.click::'))),
        wh AS (SELECT s FROM wr WHERE t = 'evt.click')
    SELECT qualified_name, (SELECT count(DISTINCT s) FROM wr) writers, (SELECT count(*) FROM wr
        WHERE t = qualified_name) named, (SELECT count(*) FROM wh) unmeasured, (SELECT count(DISTINCT s) FROM wr) - (SELECT count(*)
        FROM wh) - (SELECT count(*) FROM wr WHERE t = qualified_name AND s NOT IN (SELECT s FROM wh)) omitted FROM nodes
        WHERE kind = 'Column' AND starts_with(qualified_name, 'evt.click::')""", lambda g: U.column_defaults(g, "evt.click"))  # fmt: skip

# Snapshots


def _later(g: Graph) -> Graph:
    """A changed copy: some files gone, some lines moved, some edges dropped."""
    gone = F.col("file_path").startswith("supply/EUROPE/")
    nodes = g.nodes.where(~gone).withColumn("line_start", F.when(F.col("file_path").startswith("catalog/Brand_2/"), F.col("line_start") + 1).otherwise(F.col("line_start")))
    return Graph(g.files.where("not startswith(path, 'supply/EUROPE/')"), nodes, g.edges.where(~gone & ~((F.col("kind") == "IMPORTS") & F.col("file_path").startswith("catalog/Brand_3/"))))


add("symbol_changes", """, has AS (SELECT DISTINCT source_qname q, file_path f FROM edges), im AS (SELECT DISTINCT source_qname q FROM edges WHERE kind = 'IMPORTS')
    SELECT DISTINCT qualified_name, file_path, CASE WHEN starts_with(file_path, 'supply/EUROPE/') THEN 'removed'
        WHEN starts_with(file_path, 'catalog/Brand_2/') THEN 'signature_changed'
        WHEN starts_with(file_path, 'catalog/Brand_3/') AND qualified_name IN (SELECT q FROM im) THEN 'body_changed' ELSE 'unchanged' END verdict
        FROM nodes WHERE kind <> 'File'""", lambda g: D.compare(D.symbol_snapshot(g), D.symbol_snapshot(_later(g))))  # fmt: skip
add("changed_files", "SELECT path, 'removed' AS change FROM files WHERE starts_with(path, 'supply/EUROPE/')", lambda g: D.changed(g.files, _later(g).files))
add(
    "replace_file_rows",
    """SELECT kind, count(*) n FROM nodes WHERE NOT starts_with(file_path, 'supply/EUROPE/') OR kind = 'File' GROUP BY 1""",
    lambda g: R.kind_counts(D.replace_files(g, *(lambda f: (f, g.nodes.join(f.select(F.col("path").alias("file_path")), "file_path", "left_semi").where("kind = 'File'"), g.edges.limit(0)))(g.files.where("startswith(path, 'supply/EUROPE/')"))).nodes),
)

LATER = ", lf AS (SELECT * FROM files WHERE NOT starts_with(path, 'supply/EUROPE/')), ln AS (SELECT * FROM nodes WHERE NOT starts_with(file_path, 'supply/EUROPE/')), le AS (SELECT * FROM edges WHERE NOT starts_with(file_path, 'supply/EUROPE/') AND NOT (kind = 'IMPORTS' AND starts_with(file_path, 'catalog/Brand_3/'))), nd AS MATERIALIZED (SELECT DISTINCT qualified_name q, file_path f FROM nodes), ld AS MATERIALIZED (SELECT DISTINCT qualified_name q, file_path f FROM ln) "
ARCH = "SELECT 'layer' AS section, split_part(path, '/', 1) AS key, count(*) n FROM {f} GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM {n} GROUP BY 2 UNION ALL SELECT 'matrix', split_part(a, '/', 1) || ' -> ' || split_part(b, '/', 1), count(*) FROM (SELECT DISTINCT file_path a, f b FROM (SELECT DISTINCT file_path, target_qname FROM {e} WHERE target_qname IS NOT NULL) JOIN {d} ON target_qname = q) WHERE a <> b GROUP BY 2"
add(
    "diff_architecture",
    LATER + f""", b AS ({ARCH.format(f='files', n='nodes', e='edges', d='nd')}), a AS ({ARCH.format(f='lf', n='ln', e='le', d='ld')})
        SELECT coalesce(b.section, a.section) AS section, coalesce(b.key, a.key) AS key, b.n AS before, a.n AS after,
        CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b
        FULL JOIN a ON a.section = b.section AND a.key = b.key WHERE a.n IS DISTINCT FROM b.n""",
    lambda g: D.diff(D.architecture(g), D.architecture(_later(g))),
)

# Tables of their own

QUERIES["canonical_routes"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy(C.canonical_url("url", ["page"]).alias("route")).agg(F.count("*").alias("n"))
ORACLE_SQL["canonical_routes"] = r"SELECT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || CASE WHEN regexp_matches(url, '[?&]page=[^&#]*') THEN '?' || regexp_extract(url, '[?&](page=[^&#]*)', 1) ELSE '' END AS route, count(*) n FROM pages GROUP BY 1"
QUERIES["estimate_tokens"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").agg(F.sum(C.estimate_tokens("text")).alias("tokens"))
ORACLE_SQL["estimate_tokens"] = "SELECT lang, sum(ceil(length(text) / 4))::BIGINT tokens FROM documents GROUP BY 1"

# Definitions and models

add(
    "find_implementations",
    """SELECT DISTINCT source_qname qualified_name, e.kind, n.file_path FROM edges e LEFT JOIN first_nodes n ON source_qname = qualified_name
        WHERE e.kind = 'EXTENDS' AND target_qname = 'part.3'""",
    lambda g: N.implementations(g, "part.3"),
)
add(
    "descendants",
    """, ds AS (SELECT 'part.2' AS q, 0 AS level UNION ALL SELECT source_qname, level + 1 FROM ds JOIN edges ON kind = 'EXTENDS' AND target_qname = q
        WHERE level < 4) SELECT q qualified_name, min(level) AS level FROM ds WHERE level > 0 GROUP BY 1""",
    lambda g: N.descendants(g, "part.2"),
)
add(
    "find_references_of_class",
    f""", tg AS (SELECT 'cust.5' q UNION SELECT target_qname FROM edges WHERE kind = 'CONTAINS' AND source_qname = 'cust.5')
        SELECT source_qname, target_qname, file_path, line, confidence_tier FROM ranked WHERE kind IN {CALLERS} AND target_qname IN (SELECT q FROM tg)
        QUALIFY row_number() OVER (PARTITION BY source_qname ORDER BY tr, file_path, line, kind, target_raw) = 1""",
    lambda g: N.member_callers(g, "cust.5"),
)
add(
    "class_diagram",
    """SELECT DISTINCT
        CASE WHEN kind = 'CONTAINS' THEN 'member' WHEN source_qname = 'part.4' THEN 'parent' ELSE 'subtype' END AS role, source_qname, target_qname FROM edges
        WHERE kind IN ('CONTAINS', 'EXTENDS') AND 'part.4' IN (source_qname, target_qname) AND target_qname IS NOT NULL""",
    lambda g: N.class_model(g, "part.4"),
)
add(
    "er_model",
    """SELECT t.qualified_name AS table, t.file_path, (SELECT string_agg(name, ',' ORDER BY name) FROM nodes c
        WHERE c.kind = 'Column' AND split_part(c.qualified_name, '::', 1) = t.qualified_name) columns, (SELECT count(*) FROM edges
        WHERE kind = 'READS' AND split_part(target_qname, '::', 1) = t.qualified_name) reads, (SELECT count(*) FROM edges
        WHERE kind = 'WRITES' AND split_part(target_qname, '::', 1) = t.qualified_name) writes FROM nodes t WHERE kind = 'Table'""",
    N.table_model,
)
add(
    "unresolved_callers_by_proximity",
    """SELECT DISTINCT source_qname, file_path, line,
        CASE WHEN starts_with(file_path, 'catalog/Brand_7/') THEN 2 WHEN starts_with(file_path, 'catalog/') THEN 1 ELSE 0 END AS shared FROM edges
        WHERE target_qname IS NULL AND target_raw = 'price_economy' ORDER BY shared DESC, file_path, line, source_qname LIMIT 20""",
    lambda g: N.unresolved_near(g, "price_economy", "catalog/Brand_7/p1.prt"),
)
add("definition_states", """, df AS (SELECT DISTINCT qualified_name, file_path, is_test, CASE WHEN starts_with(file_path, 'supply/') THEN 0 END AS rk
        FROM (SELECT 'x.' || name AS qualified_name, file_path, is_test, kind FROM nodes) WHERE kind = 'Class'),
        m AS (SELECT *, count(*) OVER w n, count(*) FILTER (NOT is_test) OVER w prod, count(*) FILTER (NOT is_test AND rk = 0) OVER w wins
        FROM df WINDOW w AS (PARTITION BY qualified_name))
    SELECT qualified_name, file_path, CASE WHEN is_test AND prod > 0 THEN 'test_copy' WHEN prod = 1 THEN 'live'
        WHEN wins = 1 AND rk = 0 THEN 'live' WHEN wins = 1 THEN 'superseded' ELSE 'unranked' END state FROM m WHERE n > 1""", lambda g: N.states(Graph(g.files, g.nodes.where("kind = 'Class'").withColumn("qualified_name", F.concat(F.lit("x."), "name")), g.edges), ["supply/**"]))  # fmt: skip
add(
    "module_owner",
    """SELECT path, CASE WHEN starts_with(path, 'sales/ASIA/') THEN 'asia' ELSE 'sales' END AS owner FROM files WHERE starts_with(path, 'sales/')""",
    lambda g: N.owner_of(g.files, g.files.sparkSession.createDataFrame([("sales", "sales"), ("sales/ASIA", "asia")], "dir string, owner string")),
)
add(
    "types_without_members",
    """SELECT DISTINCT qualified_name FROM nodes WHERE kind = 'Class' AND qualified_name NOT IN (SELECT split_part(qualified_name, '::', 1) FROM nodes
        WHERE kind IN ('Method', 'Column'))""",
    N.types_without_members,
)
add(
    "sibling_definitions",
    """SELECT DISTINCT qualified_name, file_path FROM nodes WHERE name = 'small ring' AND kind = 'Class' AND qualified_name <> 'part.0'""",
    lambda g: N.siblings(g, "small ring", "Class", "part.0"),
)
add(
    "inbound_kinds",
    """SELECT kind, count(*) n, count(DISTINCT source_qname) sources FROM edges WHERE target_qname = 'supp.6' GROUP BY 1""",
    lambda g: N.inbound_kinds(g, "supp.6"),
)
add("impact_modules", f""", s1 AS (SELECT source_qname q, max(CASE kind WHEN 'CALLS' THEN 1.0 WHEN 'NEW' THEN 1.0 WHEN 'EXTENDS' THEN 0.9
        WHEN 'IMPLEMENTS' THEN 0.9 ELSE 0.8 END * 0.7) score FROM edges WHERE target_qname = 'part.1' AND kind IN {IMPACT} GROUP BY 1),
    s2 AS (SELECT q, score, max(confidence_tier) tier FROM s1 JOIN edges ON source_qname = q AND target_qname = 'part.1' AND abs(CASE kind
        WHEN 'CALLS' THEN 1.0 WHEN 'NEW' THEN 1.0 WHEN 'EXTENDS' THEN 0.9
        WHEN 'IMPLEMENTS' THEN 0.9 ELSE 0.8 END * 0.7 - score) < 1e-9 AND kind IN {IMPACT} GROUP BY 1, 2)
   
        SELECT split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) AS module, count(*) symbols, count(*) FILTER (tier = 'RESOLVED') resolved, arg_min(q, printf('%.6f', 1 - score) || q) example
        FROM s2 JOIN first_nodes ON q = qualified_name GROUP BY 1""", lambda g: N.radius_by_module(W.impact(g, g.nodes.where("qualified_name = 'part.1'").select("qualified_name"), depth=1, max_nodes=100_000).rows, g))  # fmt: skip

# Rows from outside

add(
    "keyed_calls",
    r"""SELECT DISTINCT 'PROVIDES_VIEW_DATA' AS kind, source_qname, 'view::' || args[1] target_raw, file_path, line FROM edges
        WHERE kind = 'CALLS' AND args IS NOT NULL AND regexp_matches(target_raw, '^part\.2[^/]*$') AND args[1] IS NOT NULL""",
    lambda g: X.keyed_edges(g, X.KeyedCall("part.2*", 1, "view::{key}")),
)
add(
    "collection_census",
    """SELECT
        CASE WHEN language NOT IN ('crm', 'prt') THEN 'suffix'
            WHEN starts_with(path, 'catalog/') AND NOT starts_with(path, 'catalog/lib/') THEN 'ignored' ELSE 'kept' END bucket, count(*) n
        FROM files GROUP BY 1""",
    lambda g: X.census(g.files, ["crm", "prt"], ["catalog/", "!catalog/lib/"]),
)
add(
    "record_targets",
    """SELECT 'r' || (k % 50) AS id, 'part.' || k AS target, 'linked' AS state FROM prt WHERE k < 60 UNION ALL
        SELECT 'r' || (k % 50), 'none.' || k, 'dangling' FROM prt WHERE k < 60""",
    lambda g: X.attach(g.nodes.where("kind = 'Class' and startswith(qualified_name, 'part.') and try_cast(substr(qualified_name, 6) as int) < 60").selectExpr("concat('r', try_cast(substr(qualified_name, 6) as int) % 50) as id", "array(qualified_name, concat('none.', substr(qualified_name, 6))) as targets"), g),
)
add(
    "record_targets_all",
    """SELECT 'r' || (k % 50) AS id, 'part.' || k AS target, 'linked' AS state FROM prt UNION ALL SELECT 'r' || (k % 50), 'none.' || k, 'dangling' FROM prt""",
    lambda g: X.attach(g.nodes.where("kind = 'Class' and startswith(qualified_name, 'part.')").selectExpr("concat('r', try_cast(substr(qualified_name, 6) as int) % 50) as id", "array(qualified_name, concat('none.', substr(qualified_name, 6))) as targets"), g),
)
QUERIES["route_matches"] = lambda spark, sf_dir: X.match_routes(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url"), spark.createDataFrame([("/fr/*",), ("/de/*",), ("/fr/1*",)], "route string"), ["page"])
ORACLE_SQL["route_matches"] = r"SELECT DISTINCT url, CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]*/fr/1') THEN '/fr/1*' WHEN regexp_matches(url, '^[a-z]+://[^/?#]*/fr/') THEN '/fr/*' ELSE '/de/*' END AS route, 'pattern' AS how FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/?#]*/(fr|de)/')"
QUERIES["event_counters"] = lambda spark, sf_dir: X.counters(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_type", ["click", "error", "view"])
ORACLE_SQL["event_counters"] = "SELECT user_id, count(*) FILTER (event_type = 'click') click, count(*) FILTER (event_type = 'error') error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1"
