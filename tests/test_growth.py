"""What keeps jobs in proportion to their input: how often tables are moved, and nothing held in one place."""

from contextlib import contextmanager

import duckdb
from pyspark.sql.classic.dataframe import DataFrame

from tierwalk.operators import analytics, compute, lookups, relational, resolve, rules, walks
from tierwalk.plans.catalogue import QUERIES
from tierwalk.sources.graph import EDGES, FILES, NODES, SQL, TABLES, Graph, built, project, raw_schema
from tierwalk.streaming.incremental import Store

DIR = "/root/testdata/sf0.001"


@contextmanager
def nothing_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_are_moved_once_and_edges_are_not_moved_to_be_written(spark):
    with nothing_broadcast(spark):
        plan = project(spark, DIR).edges._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.splitlines() if "FileScan" in line and "lineitem.parquet" in line]
    assert len(reads) == 3  # the lines themselves, and the least part and supplier
    assert sum("Exchange hashpartitioning" in line and "o_orderkey" in line for line in plan.splitlines()) == 2  # lines and orders
    assert not any("Exchange hashpartitioning" in line and "target" in line for line in plan.splitlines())


def test_repeated_and_unknown_values_project_as_in_sql(spark, tmp_path):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE TABLE {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    duck.execute("INSERT INTO lineitem SELECT * FROM lineitem WHERE l_orderkey < 300")
    duck.execute("INSERT INTO lineitem SELECT * REPLACE (NULL AS l_tax, NULL AS l_quantity, 'X' AS l_returnflag, NULL AS l_linestatus) FROM lineitem WHERE l_orderkey < 90")
    duck.execute("INSERT INTO lineitem SELECT * REPLACE (NULL AS l_linenumber) FROM lineitem WHERE l_orderkey < 60")
    duck.execute("INSERT INTO events SELECT * FROM events WHERE event_id < 90")
    duck.execute("INSERT INTO events SELECT * REPLACE (NULL AS value) FROM events WHERE event_id < 50")
    for t in TABLES:
        duck.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    columns = "kind, source_qname, target_qname, target_raw, file_path, line, confidence_tier, args"
    want = duck.execute(f"{SQL} SELECT {columns} FROM edges").fetchall()
    got = project(spark, str(tmp_path)).edges.select(*columns.split(", ")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def planted(spark, nodes, edges):
    """A graph of (name, path) and (source, target, tier) calls."""
    paths = sorted({p for _, p in nodes})
    return Graph(
        spark.createDataFrame([(p, "x", "h", True) for p in paths], FILES),
        spark.createDataFrame([("Method", n, n, p, 1, False) for n, p in nodes], NODES),
        spark.createDataFrame([("CALLS", a, b, b, "f", 1, tier, None) for a, b, tier in edges], EDGES),
    )


def test_source_files_of_a_rule_walk_in_one_row(spark, monkeypatch):
    n, shared = 300, 40
    nodes = [(f"a{i}", f"src/{i}.x") for i in range(n)] + [(f"m{j}", "mid.x") for j in range(shared)] + [(f"z{j}", f"bad/{j}.x") for j in range(shared)] + [("leaf", "leaf.x")]
    edges = [(f"a{i}", f"m{j}", "RESOLVED") for i in range(n) for j in range(shared) if (i + j) % 3]
    edges += [(f"m{j}", f"z{j}", "RESOLVED" if j % 2 else "HEURISTIC") for j in range(shared)] + [("a0", "leaf", "RESOLVED"), ("z1", "m2", "RESOLVED")]
    rows = []
    write = rules.materialise

    def counted(df, label):
        out = write(df, label)
        if label in ("rule-step", "rule-seen"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(rules, "materialise", counted)
    g = planted(spark, nodes, edges)
    got = {(r.source_file, r.forbidden_file, r.verdict) for r in rules.check(g, rules.Forbidden("r", ["src/**"], ["bad/**"], ("CALLS",), transitive=True)).collect()}
    want = {(f"src/{i}.x", f"bad/{j}.x", "confirmed" if j % 2 else "candidate") for i in range(n) for j in range(shared) if (i + j) % 3}
    want |= {(f"src/{i}.x", "bad/2.x", "candidate") for i in range(n) if (i + 1) % 3}  # over z1
    assert got == want
    assert max(rows) < n * shared / 10
    cut = rules.check(g, rules.Forbidden("r", ["src/**"], ["bad/**"], ("CALLS",), transitive=True, depth=1)).collect()
    assert {(r.source_file, r.forbidden_file, r.verdict) for r in cut} == {(f"src/{i}.x", None, "incomplete") for i in range(n)}


def test_requests_meet_the_types_that_declare_a_member_and_not_all_above(spark, monkeypatch):
    deep, asked = 8, 100
    names = [f"T{i}" for i in range(deep)] + [f"T0::m{j}" for j in range(asked)] + [f"T{deep - 1}::low"]
    nodes = spark.createDataFrame([("Method" if "::" in n else "Class", n.split("::")[-1], n, "a.x", 1, False) for n in names], NODES)
    up = [("EXTENDS", f"T{i}", f"T{i - 1}") for i in range(1, deep)]
    calls = [("CALLS", "s", f"T{deep - 1}::m{j}") for j in range(asked)] + [("CALLS", "s", "T0::low")]
    edges = spark.createDataFrame([(k, s, None, r, "a.x", i, "RESOLVED", None) for i, (k, s, r) in enumerate(up + calls)], EDGES)
    g = Graph(spark.createDataFrame([("a.x", "x", "h", True)], FILES), nodes, edges)
    rows, write = [], resolve.materialise

    def counted(df, label):
        out = write(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(resolve, "materialise", counted)
    want = {(f"T{deep - 1}::m{j}", f"T0::m{j}", "inherited") for j in range(asked)} | {("T0::low", f"T{deep - 1}::low", "subtype")}

    def found():
        return {(r.target_raw, r.target, r.via) for r in resolve.resolve(g).where("kind = 'CALLS'").collect()}

    assert found() == want
    assert max(rows) < 3 * asked
    monkeypatch.setattr(resolve, "SHARED", 0)  # every member gone through by the types near its receiver
    assert found() == want


def test_the_whole_reading_order_leaves_nothing_out_and_holds_nothing_at_the_driver(spark, monkeypatch):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(6)]
    cycles = [("c2", "r0"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("r1", "s0"), ("s0", "s1"), ("s1", "s0"), ("s1", "c5"), ("t0", "t1"), ("t1", "t0")]
    fan = [("wide", f"leaf{i}") for i in range(9)] + [("c0", "leaf0")]
    pairs = chain + cycles + fan
    g = planted(spark, [(n, n) for n in sorted({x for p in pairs for x in p} | {"alone"})], [])
    g = Graph(g.files, g.nodes, spark.createDataFrame([("CALLS", a, b, b, a, 1, "RESOLVED", None) for a, b in pairs], EDGES))
    collected, collect = [], DataFrame.collect

    def counted(self):
        rows = collect(self)
        collected.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    order = analytics.tour(g, None)
    assert max(collected) < 10
    rows = collect(order.orderBy("stop"))
    assert [r.stop for r in rows] == list(range(len(rows))) and sorted(r.file for r in rows) == sorted(r.path for r in collect(g.files))
    part = {r.file: r.component for r in rows}
    assert {f: p for f, p in part.items() if f != p} == {"r1": "r0", "r2": "r0", "s1": "s0", "t1": "t0"}
    stop = {r.file: r.stop for r in rows}
    assert all(stop[a] < stop[b] for a, b in pairs if part[a] != part[b]) and not any(r.truncated for r in rows)
    assert rows[0].file == "wide"  # entries first, the widest first
    collected.clear()
    monkeypatch.setattr(analytics, "ORDERED", 4)
    some = collect(analytics.tour(g, 12))
    assert len(some) == 12 and all(r.truncated for r in some) and max(collected) <= 12
    collected.clear()
    QUERIES["reading_order_is_whole"](spark, DIR)
    assert max(collected, default=0) < 10


def moves_of_edges(df):
    """How many exchanges stand above a read of the edges, one over another."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    most, above = 0, []
    for line in lines:
        depth = next((i for i, c in enumerate(line) if c.isalpha()), 0)
        above = [(d, x) for d, x in above if d < depth] + [(depth, line)]
        if "FileScan" in line and "/edges" in line:
            most = max(most, sum("Exchange hashpartitioning" in x for _, x in above))
    return most


def test_edges_are_moved_to_their_targets_and_files_join_counts(spark):
    g = built(spark, DIR)
    with nothing_broadcast(spark):
        assert moves_of_edges(relational.file_pairs(g)) == 2
        assert moves_of_edges(relational.module_edge_tiers(g)) == 3
        for cells in (relational.cross_language(g), compute.tier_mix(g)):
            plan = cells._jdf.queryExecution().optimizedPlan().toString()
            scan = next(line for line in plan.splitlines() if "Join" in line)  # the outermost join has counts below
            assert "file_path" in scan and "Aggregate" in plan[plan.index(scan) :]
            assert moves_of_edges(cells) == 4  # edges, their counts, counts to files, counts of languages
        assert moves_of_edges(lookups.tier_split(g)) == 3  # counts by file alone


def test_a_store_takes_files_as_rows_as_it_takes_them_as_objects(spark, tmp_path):
    nodes = [("Class", "A", "A", "a.x"), ("Method", "go", "A::go", "a.x"), ("Class", "B", "B", "b.x"), ("Function", "f", "f", "c.x"), ("Function", "g", "g", "d.x")]
    edges = [("CALLS", "B", "A::go", "b.x"), ("EXTENDS", "B", "A", "b.x"), ("CALLS", "f", "B::go", "c.x"), ("CALLS", "f", "g", "c.x"), ("CALLS", "g", "f", "d.x")]

    def part(hashes):
        files = spark.createDataFrame([(p, "x", h, True) for p, h in hashes.items()], FILES)
        held = spark.createDataFrame([(k, n, q, p, 1, False) for k, n, q, p in nodes if p in hashes], NODES)
        return Graph(files, held, spark.createDataFrame([(k, s, None, r, p, 1, "RESOLVED", None) for k, s, r, p in edges if p in hashes], EDGES))

    def objects(hashes, removed):
        rows = [(p, "x", h, True, [(k, n, q, 1, False) for k, n, q, at in nodes if at == p], [(k, s, None, r, 1, "RESOLVED", None) for k, s, r, at in edges if at == p], False) for p, h in hashes.items()]
        return spark.createDataFrame(rows + [(p, None, None, None, None, None, True) for p in removed], raw_schema() + ", removed boolean")

    rows, whole = Store(spark, str(tmp_path / "rows"), 4), Store(spark, str(tmp_path / "objects"), 4)
    for batch, (hashes, removed) in enumerate([({"a.x": "1", "b.x": "1", "c.x": "1"}, []), ({"a.x": "1", "d.x": "1"}, ["b.x"])]):
        gone = spark.createDataFrame([(p,) for p in removed], "path string")
        assert rows.replace(part(hashes), gone, batch) == whole.apply(objects(hashes, removed), batch) == (3, 2)[batch]
        assert rows.replace(part(hashes), gone, batch) == 0  # not twice
        one, other = ({tuple(r[:7]) for r in s.graph().edges.collect()} for s in (rows, whole))
        assert one == other and any(e[2] for e in one)
    assert ("CALLS", "f", "g", "g", "c.x", 1, "RESOLVED") in one and ("CALLS", "f", None, "B::go", "c.x", 1, "RESOLVED") in one


def test_hops_of_candidate_tests_do_not_move_the_edges(spark, monkeypatch):
    plans, write = [], walks.materialise

    def seen(df, label):
        if label == "tests-step":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(walks, "materialise", seen)
    with nothing_broadcast(spark):
        assert QUERIES["candidate_tests"](spark, DIR).count()
    assert len(plans) == 2
    assert all(sum("Exchange hashpartitioning(source_qname" in line for line in p.split("== Initial Plan ==")[-1].splitlines()) == 1 for p in plans)
    assert all("SelectedBucketsCount" in p for p in plans)
