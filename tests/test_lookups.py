"""Column helpers and point reads on rows whose answers are known by hand."""

import pytest
from pyspark.sql import functions as F

from tierwalk.answers import clamp_limit, clamp_subjects
from tierwalk.functions import columns as C
from tierwalk.operators import lookups, rules, walks
from tests.test_planted import graph, seeds


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_keyword_arguments(spark):
    rows = [({"a": "1", "b": None},), ({},), (None,)]
    for name, selector, want in (("a", "1", [True, False, False]), ("b", "dynamic", [True, False, False]), ("c", "absent", [True, True, False]), ("a", "absent", [False, True, False]), ("a", "dynamic", [False, False, False])):
        assert [bool(x) for x in one(spark, rows, "kwargs map<string,string>", C.kwargs_at(name, selector))] == want, (name, selector)


def test_tails_of_includes(spark):
    rows = [("x.php",), ("../lib/X.php",), ("dirname(__FILE__) . '/lib/x.php'",), ("other/x.php",), ("long_x.php",), ("..",), ("\\lib\\x.php",)]
    assert one(spark, rows, "raw string", C.tail_fits("raw", "src/Lib/x.php")) == [True, True, True, False, False, False, True]


def test_defaults_compare_as_expressions(spark):
    rows = [("(user_name())",), ("[USER_NAME]()",), ("user_name ( )",), ("((1))",), ("(1)+(2)",), ("'N'",), ("('n')",), ("(')')",)]
    assert one(spark, rows, "d string", C.plain_default("d")) == ["user_name()", "user_name()", "user_name()", "1", "(1)+(2)", "'N'", "'n'", "')'"]


def test_responsibilities_of_paths(spark):
    rows = [("src/controllers/A.php",), ("src/repositories/A.php",), ("tests/controller/A.php",), ("src/a.php",), ("a.php",), ("public/index.php",), ("vendor/lib/a.php",)]
    assert one(spark, rows, "p string", C.responsibility_layer("p")) == ["HTTP / Entry", "Domain / Data", "HTTP / Entry", None, None, None, "Shared Library"]
    assert one(spark, rows, "p string", C.names_test("p")) == [False, False, True, False, False, False, False]
    rank = one(spark, rows, "p string", C.reading_rank("p"))
    assert rank[0] == rank[5] == 0 and rank[1] == 2 and rank[3] == rank[4] == 8 and rank[2] == 9 and rank[6] == 11


def test_raw_names_that_mean_a_table(spark):
    rows = [("dbo.Trans",), ("trans::id",), ("x.TRANS",), ("x.trans::id",), ("transit",), ("dbo.transit::id",)]
    assert one(spark, rows, "target_raw string", C.relates_to("dbo.Trans")) == [True, True, True, True, False, False]
    assert one(spark, [("a.b",), ("a_b",), ("b",), ("xb",)], "q string", C.ends_at_boundary("q", "b")) == [True, False, True, False]


def test_limits_say_what_they_cut():
    assert clamp_limit(None, 50) == (50, False) and clamp_limit(80, 50) == (50, True) and clamp_limit(0, 50) == (1, False)
    assert clamp_subjects(["a", "b", "a", "c"], 2) == (["a", "b"], ["c"])


def test_twins_come_before_neighbours(spark):
    rows = spark.createDataFrame([("m", "a/b/other.php"), ("n", "z/same.php"), ("o", "q/x.php")], "qualified_name string, file_path string")
    got = {r.file_path: r.place for r in lookups.twins_first(rows, "a/b/same.php").collect()}
    assert got == {"z/same.php": 1, "a/b/other.php": 2, "q/x.php": 3}


def test_versions_rank_only_where_they_decide(spark):
    rows = [("T", "m/1.2.sql", False), ("T", "m/1.10.sql", False), ("T", "tests/T.sql", True), ("U", "m/1.sql", False), ("U", "n/2.sql", False), ("V", "m/1.sql", False)]
    table = spark.createDataFrame(rows, "qualified_name string, file_path string, is_test boolean")
    from tierwalk.operators import definitions

    got = {(r.qualified_name, r.file_path): r.place for r in lookups.latest_versions(table, definitions.version("file_path", r"([0-9.]+)\.sql$")).collect()}
    assert got == {("T", "m/1.10.sql"): 1, ("T", "m/1.2.sql"): 2, ("T", "tests/T.sql"): None}


def test_heirs_construct_by_an_inherited_constructor(spark):
    nodes = [("Class", x, x, "a.php", False) for x in ("A", "B", "C", "D", "E", "Tr")] + [("Method", "__construct", f"{x}::__construct", "a.php", False) for x in ("A", "C", "Tr")]
    edges = [("EXTENDS", "B", "A", "RESOLVED", "a.php"), ("EXTENDS", "C", "A", "RESOLVED", "a.php"), ("EXTENDS", "D", "C", "RESOLVED", "a.php"), ("EXTENDS", "E", "B", "RESOLVED", "a.php"), ("USES_TRAIT", "E", "Tr", "RESOLVED", "a.php")]
    edges += [("NEW", f"f{x}", x, "RESOLVED", "a.php") for x in "ABCDE"]
    got = {(r.source_qname, r.via_subclass) for r in lookups.constructed_by(graph(spark, nodes, edges), "A::__construct").collect()}
    assert got == {("fA", False), ("fB", True)}


def test_flows_that_others_contain_go(spark):
    rows = spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],), (["b"],), (["a", "x"],)], "steps array<string>")
    assert sorted(r.steps for r in lookups.without_prefixes(rows).collect()) == [["a", "b", "c"], ["a", "x"], ["b"]]


def test_files_of_hit_classes_go(spark):
    rows = spark.createDataFrame([("File", "a.php", "a.php"), ("Class", "A", "a.php"), ("File", "b.php", "b.php")], "kind string, name string, file_path string")
    assert sorted(r.name for r in lookups.without_redundant_files(rows).collect()) == ["A", "b.php"]


def test_seeds_beyond_the_budget_are_counted(spark):
    nodes = [("Class", x, x, "a.php", False) for x in "ABCD"]
    g = graph(spark, nodes, [("CALLS", "A", "B", "RESOLVED", "a.php")])
    walk = walks.impact(g, seeds(spark, "A", "B", "C", "D"), max_nodes=3)
    assert walk.truncated and walk.seeds_dropped == 1 and walk.rows.count() == 3


def test_rules_have_two_directions(spark):
    g = graph(spark, [("Class", x, x, f"{x}.php", False) for x in "ABC"], [("CALLS", "A", "B", "RESOLVED", "A.php"), ("CALLS", "B", "C", "RESOLVED", "B.php")])
    got = rules.check(g, rules.Forbidden("x", ["C.php"], ["A.php"], transitive=True, direction="incoming")).collect()
    assert [(r.source_file, r.forbidden_file, r.verdict) for r in got] == [("C.php", "A.php", "confirmed")]
    with pytest.raises(ValueError):
        rules.check(g, rules.Forbidden("x", ["C.php"], ["A.php"], direction="sideways"))
    need = rules.Required("r", ["*.php"], ["C"], name="^[AB]$")
    assert rules.check_required(g, need).count() == 0
    assert [r.source_qname for r in rules.check_required(g, rules.Required("r", ["*.php"], ["A"], name="^[AB]$")).collect()] == ["B"]


def test_stamps_follow_files_and_not_their_order(spark):
    g = graph(spark, [("Class", x, x, f"{x}.php", False) for x in "AB"], [])
    again = type(g)(g.files.orderBy(F.desc("path")), g.nodes, g.edges)
    fewer = type(g)(g.files.where("path <> 'A.php'"), g.nodes, g.edges)
    stamp = [lookups.files_stamp(x).first()[0] for x in (g, again, fewer)]
    assert stamp[0] == stamp[1] != stamp[2]
