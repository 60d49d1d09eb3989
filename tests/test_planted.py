"""Small planted graphs whose answers are known by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tierwalk.answers import page
from tierwalk.functions import columns as C
from tierwalk.operators import analytics, compute, definitions, doc_refs, records, relational, resolve, rules, search, snapshots, walks
from tierwalk.plans.catalogue import QUERIES
from tierwalk.sources import python_files
from tierwalk.sources.graph import EDGES, FILES, NODES, Graph, built, from_jsonl, from_rows, load, save
from tierwalk.streaming.incremental import Store, follow


def graph(spark, nodes, edges):
    files = sorted({n[3] for n in nodes} | {e[4] for e in edges})
    full = [(k, s, t, t, f, i, tier, None) for i, (k, s, t, tier, f) in enumerate(edges)]
    return Graph(spark.createDataFrame([(f, "x", f, True) for f in files], FILES), spark.createDataFrame([(k, n, q, f, 1, t) for k, n, q, f, t in nodes], NODES), spark.createDataFrame(full, EDGES))


@pytest.fixture(scope="module")
def chain(spark):
    nodes = [("Class", x, x, f"{x}.php", x == "T") for x in ("A", "B", "C", "D", "Maybe", "T")] + [("Method", "m", "C::m", "C.php", False)]
    edges = [("CALLS", "A", "B", "RESOLVED", "A.php"), ("CALLS", "B", "C::m", "RESOLVED", "B.php"), ("CALLS", "A", "Maybe", "HEURISTIC", "A.php"), ("CALLS", "Maybe", "D", "RESOLVED", "M.php"), ("EXTENDS", "T", "B", "RESOLVED", "T.php"), ("CONTAINS", "C", "C::m", "RESOLVED", "C.php")]
    return graph(spark, nodes, edges)


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "q string")


def test_impact_scores_by_kind_and_hop(spark, chain):
    got = {r.qname: (round(r.score, 4), r.depth) for r in walks.impact(chain, seeds(spark, "C::m"), depth=2).rows.collect()}
    assert got == {"C::m": (1.0, 0), "B": (0.7, 1), "A": (0.49, 2), "T": (0.441, 2)}
    assert "T" not in {r.qname for r in walks.impact(chain, seeds(spark, "C::m"), without_tests=True).rows.collect()}


def test_impact_reports_weak_tiers_without_expanding_them(spark, chain):
    walk = walks.impact(chain, seeds(spark, "D"), depth=3)
    assert {(r.qname, r.tier) for r in walk.rows.collect()} == {("D", "RESOLVED"), ("Maybe", "RESOLVED"), ("A", "HEURISTIC")}
    assert walk.skipped == 1


def test_impact_budget_cuts_by_score(spark, chain):
    walk = walks.impact(chain, seeds(spark, "C::m"), depth=2, max_nodes=2)
    assert [r.qname for r in walk.rows.orderBy(F.desc("score")).collect()] == ["C::m", "B"]
    assert walk.truncated


def test_reach_keeps_containers_and_unproven_apart(spark, chain):
    rows = {(r.qname, r.state) for r in walks.reach(chain, seeds(spark, "A")).rows.collect()}
    assert rows == {("A", "reached"), ("B", "reached"), ("C::m", "reached"), ("C", "reached"), ("Maybe", "unproven")}
    assert walks.reach(chain, seeds(spark, "A"), depth=1).depth_exhausted


def test_orphans_say_why(spark, chain):
    assert {(r.qualified_name, r.why) for r in walks.orphans(chain, seeds(spark, "A")).collect()} == {("D", "unreachable_from_roots"), ("T", "no_inbound")}


def test_paths(chain):
    status, hops = walks.explain_path(chain, "A", "C::m")
    assert status == "path" and [h[2] for h in hops] == ["B", "C::m"]
    assert walks.explain_path(chain, "A", "D")[0] == "unproven"
    assert walks.explain_path(chain, "D", "A")[0] == "no_path"
    assert walks.explain_path(chain, "A", "nowhere")[0] == "unknown"
    assert walks.explain_path(chain, "A", "A") == ("path", [])


def test_required(chain):
    assert walks.required(chain, "A", ["C::m"]) == (True, 0)
    assert walks.required(chain, "A", ["D"]) == (False, 1)


def test_page_says_what_it_cut(chain):
    a = page(chain.nodes, ["qualified_name"], 2)
    assert (a.total_count, a.truncated, a.reason) == (7, True, "ok")
    assert page(chain.nodes.limit(0), ["qualified_name"], 2, measured=False).reason == "not_measured"


def test_resolution_never_picks_among_several(spark):
    nodes = [("Function", "one", "m.one", "a.x", False), ("Function", "two", "m.two", "a.x", False), ("Function", "two", "n.two", "b.x", False), ("Class", "P", "P", "a.x", False), ("Method", "go", "P::go", "a.x", False), ("Class", "K", "K", "b.x", False)]
    g = graph(spark, nodes, [("EXTENDS", "K", "P", "RESOLVED", "b.x")])
    raws = ["one", "two", "M.ONE", "K::go", "go", "nobody"]
    g = Graph(g.files, g.nodes, g.edges.union(spark.createDataFrame([("CALLS", "s", None, r, "b.x", i, "RESOLVED", None) for i, r in enumerate(raws)], EDGES)))
    got = {r.target_raw: (r.target, r.via, r.confidence_tier) for r in resolve.resolve(g).collect()}
    assert got == {"one": ("m.one", "function", "RESOLVED"), "M.ONE": ("m.one", "folded", "RESOLVED"), "K::go": ("P::go", "inherited", "RESOLVED"), "go": ("P::go", "method", "HEURISTIC")}
    assert resolve.apply(g).edges.where("target_qname is null").count() == 2


def test_links_of_every_pass(spark):
    nodes = [
        ("Class", "Base", "Base", "b.x", False), ("Method", "go", "Base::go", "b.x", False), ("Class", "Kid", "Kid", "k.x", False), ("Method", "only", "Kid::only", "k.x", False),
        ("Class", "Twin", "Twin", "k.x", False), ("Method", "only", "Twin::only", "k.x", False), ("Class", "Site", "Site", "s.x", False), ("Method", "base", "Site::base", "s.x", False),
        ("Method", "self", "Base::self", "b.x", False), ("Table", "Trans", "dbo.Trans", "t.q", False), ("Column", "Id", "dbo.Trans::Id", "t.q", False), ("Table", "Old", "a.Old", "t.q", False),
        ("Table", "Old", "b.Old", "t.q", False), ("File", "u.x", "lib/u.x", "lib/u.x", False), ("File", "v.x", "lib/v.x", "lib/v.x", False), ("File", "v.x", "app/v.x", "app/v.x", False), ("Function", "Insert", "dbo.Insert", "t.q", False),
    ]
    g = graph(spark, nodes, [])
    files = spark.createDataFrame([(f, "sql" if f == "t.q" else "x", f, True) for f in ("b.x", "k.x", "s.x", "t.q", "lib/u.x", "lib/v.x", "app/v.x", "lib/w.x", "none")], FILES)
    types = {"Site::base": ("Base", None), "Base::self": ("static", None), "Kid::only": (None, "Base")}
    from pyspark.sql import types as T

    typed = g.nodes.withColumn("declared_type", F.lit(None).cast(T.StringType())).withColumn("doc_type", F.lit(None).cast(T.StringType()))
    for name, (said, told) in types.items():
        typed = typed.withColumn("declared_type", F.when(F.col("qualified_name") == name, said).otherwise(F.col("declared_type"))).withColumn("doc_type", F.when(F.col("qualified_name") == name, told).otherwise(F.col("doc_type")))
    asked = [
        ("EXTENDS", "Kid", "Base", "k.x", "RESOLVED"), ("EXTENDS", "Twin", "Base", "k.x", "RESOLVED"), ("ALIASES", "Aka2", "Aka", "s.x", "RESOLVED"), ("ALIASES", "Aka", "Base", "s.x", "RESOLVED"), ("ALIASES", "Loop", "Loop2", "s.x", "RESOLVED"), ("ALIASES", "Loop2", "Loop", "s.x", "RESOLVED"),
        ("CALLS", "s", "Aka2::go", "s.x", "RESOLVED"), ("NEW", "s", "Aka2", "s.x", "RESOLVED"), ("CALLS", "s", "Loop::go", "s.x", "RESOLVED"), ("CALLS", "s", "Kid::go", "s.x", "RESOLVED"), ("CALLS", "s", "Base::only", "s.x", "RESOLVED"),
        ("CALLS", "s", "Site::base()::self()::go", "s.x", "RESOLVED"), ("CALLS", "s", "Kid::only()::go", "s.x", "RESOLVED"), ("CALLS", "s", "Site::base()::only", "s.x", "RESOLVED"), ("CALLS", "s", "Site::nothing()::go", "s.x", "RESOLVED"), ("CALLS", "s", "Vendor::go", "s.x", "RESOLVED"),
        ("CALLS", "s", "go", "s.x", "HEURISTIC"), ("CALLS", "s", "go", "s.x", "RESOLVED"), ("CALLS", "s", "only", "s.x", "HEURISTIC"), ("CALLS", "s", "go", "t.q", "HEURISTIC"), ("CALLS", "s", "insert", "t.q", "RESOLVED"), ("CALLS", "s", "DBO.insert", "s.x", "HEURISTIC"),
        ("WRITES", "s", "DBO.trans", "s.x", "RESOLVED"), ("WRITES", "s", "other.trans::ID", "s.x", "HEURISTIC"), ("READS", "s", "trans::id", "s.x", "RESOLVED"), ("READS", "s", "trans", "s.x", "RESOLVED"), ("WRITES", "s", "old", "s.x", "RESOLVED"),
        ("INCLUDES", "lib/w.x", "u.x", "lib/w.x", "RESOLVED"), ("INCLUDES", "lib/w.x", ".././app/v.x", "lib/w.x", "RESOLVED"), ("INCLUDES", "lib/w.x", "/v.x", "lib/w.x", "HEURISTIC"), ("INCLUDES", "lib/w.x", "/app/v.x", "lib/w.x", "HEURISTIC"), ("IMPORTS", "lib/w.x", "lib/u.x", "lib/w.x", "RESOLVED"), ("CALLS", "s", "Base::go", "s.x", "DYNAMIC"),
    ]
    edges = spark.createDataFrame([(k, s, None, r, f, i, t, None) for i, (k, s, r, f, t) in enumerate(asked)], EDGES)
    rows = resolve.resolve(Graph(files, typed, edges), folding=["sql"], guesses_only=True).where("kind not in ('EXTENDS', 'ALIASES')").collect()
    got = sorted((asked[r.line][0], r.target_raw, asked[r.line][4], r.target, r.via, r.confidence_tier) for r in rows)
    assert got == sorted([
        ("CALLS", "Aka2::go", "RESOLVED", "Base::go", "exact", "RESOLVED"), ("NEW", "Aka2", "RESOLVED", "Base", "exact", "RESOLVED"), ("CALLS", "Kid::go", "RESOLVED", "Base::go", "inherited", "RESOLVED"),
        ("CALLS", "Base::only", "RESOLVED", "Kid::only", "subtype", "HEURISTIC"), ("CALLS", "Base::only", "RESOLVED", "Twin::only", "subtype", "HEURISTIC"), ("CALLS", "Site::base()::self()::go", "RESOLVED", "Base::go", "chain", "RESOLVED"),
        ("CALLS", "Kid::only()::go", "RESOLVED", "Base::go", "chain", "HEURISTIC"), ("CALLS", "Site::base()::only", "RESOLVED", "Kid::only", "subtype", "HEURISTIC"), ("CALLS", "Site::base()::only", "RESOLVED", "Twin::only", "subtype", "HEURISTIC"),
        ("CALLS", "Site::nothing()::go", "RESOLVED", "Base::go", "method", "HEURISTIC"), ("CALLS", "go", "HEURISTIC", "Base::go", "method", "HEURISTIC"), ("CALLS", "insert", "RESOLVED", "dbo.Insert", "folded", "RESOLVED"), ("CALLS", "DBO.insert", "HEURISTIC", "dbo.Insert", "folded", "HEURISTIC"),
        ("WRITES", "DBO.trans", "RESOLVED", "dbo.Trans", "folded", "RESOLVED"), ("WRITES", "other.trans::ID", "HEURISTIC", "dbo.Trans::Id", "table", "HEURISTIC"), ("READS", "trans::id", "RESOLVED", "dbo.Trans::Id", "table", "RESOLVED"),
        ("INCLUDES", "u.x", "RESOLVED", "lib/u.x", "path", "RESOLVED"), ("INCLUDES", ".././app/v.x", "RESOLVED", "app/v.x", "path", "RESOLVED"), ("INCLUDES", "/app/v.x", "HEURISTIC", "app/v.x", "tail", "HEURISTIC"), ("IMPORTS", "lib/u.x", "RESOLVED", "lib/u.x", "path", "RESOLVED"),
    ])


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)]
    got = {r.node: r.root for r in analytics.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[200 + i] for i in range(30)} == {100}


def test_strong_components_come_after_what_they_use():
    assert analytics.tarjan(["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")]) == [["d"], ["b", "c"], ["a"]]


def test_templates_are_closed(chain):
    with pytest.raises(ValueError):
        compute.compute(chain, "anything")
    with pytest.raises(ValueError):
        compute.compute(chain, "no_referrer", where="1=1")
    assert compute.compute(chain, "no_referrer", kind="Class").count() == 3


def test_search_verdicts(chain):
    assert search.verdict(chain, "Maybe")[0] == "ok"
    assert search.verdict(chain, "ayb")[0] == "substring_match"
    assert search.verdict(chain, "C.m")[0] == "separator_normalised"
    assert search.verdict(chain, "Maybe", kind="Method")[0] == "kind_excluded"
    assert search.verdict(chain, "zzzz")[0] == "no_matches"
    assert [r.name for r in search.did_you_mean(chain, "Mabye").collect()] == []
    assert [r.name for r in search.did_you_mean(chain, "Maybee").collect()] == ["Maybe"]


def test_helpers():
    import re

    assert re.match(C.glob("src/**/*.py"), "src/a/b.py") and not re.match(C.glob("src/*.py"), "src/a/b.py")
    assert C.edit_pieces("abcdef", 2) == ["ab", "cd", "ef"] and C.name_tail("A\\B::c") == "c"
    assert C.name_tokens("parseHttpHeader_with") == ["parse", "http", "header"]


def test_symbol_moves(spark):
    cols = "qualified_name string, file_path string, name string, kind string, signature string, body string"
    before = spark.createDataFrame([("a", "x", "a", "F", "1", "h1"), ("b", "x", "b", "F", "1", "h2"), ("c", "x", "c", "F", "1", None)], cols)
    after = spark.createDataFrame([("a", "y", "a", "F", "1", "h1"), ("b", "x", "b", "F", "2", "h2"), ("d", "y", "d", "F", "1", "h4")], cols)
    got = {(r.qualified_name, r.file_path): r.verdict for r in snapshots.compare(before, after).collect()}
    assert got == {("a", "x"): "moved", ("a", "y"): "added", ("b", "x"): "signature_changed", ("c", "x"): "removed", ("d", "y"): "added"}


def lines(files):
    return "\n".join(json.dumps({"path": p, "language": "x", "hash": h, "nodes": [{"kind": "Function", "name": n, "qualified_name": f"{p}.{n}", "line_start": 1} for n in names], "edges": [{"kind": "CALLS", "source_qname": f"{p}.{names[0]}", "target_raw": t, "line": 1} for t in calls]}) for p, h, names, calls in files)


def content(g):
    return [sorted(map(tuple, df.select(*cols).collect()), key=repr) for df, cols in ((g.files, ["path", "hash"]), (g.nodes, ["qualified_name", "file_path"]), (g.edges, ["source_qname", "target_qname", "target_raw"]))]


def test_incremental_equals_full(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    (source / "1.json").write_text(lines([("a", "h1", ["f", "f"], ["g"]), ("b", "h2", ["g"], [])]))
    follow(spark, str(source), root, str(tmp_path / "cp")).awaitTermination()
    (source / "2.json").write_text(lines([("a", "h3", ["f", "k"], ["g", "nobody"])]))
    follow(spark, str(source), root, str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "full.json").write_text(lines([("a", "h3", ["f", "k"], ["g", "nobody"]), ("b", "h2", ["g"], [])]))
    store = Store(spark, root)
    assert content(store.graph()) == content(resolve.apply(from_jsonl(spark, str(tmp_path / "full.json"))))
    version = store.pointer()
    assert store.apply(spark.read.schema("path string, language string, hash string, parsed_ok boolean, nodes array<struct<kind:string,name:string,qualified_name:string,line_start:int,is_test:boolean>>, edges array<struct<kind:string,source_qname:string,target_qname:string,target_raw:string,line:int,confidence_tier:string,args:array<string>>>").json(str(source / "2.json")), version[1] + 1) == 0
    assert store.pointer() == version


def as_rows(state):
    """JSON lines of {path: (hash, [names], [(kind, raw)])}; no state is a removal."""
    out = []
    for path, held in state.items():
        if held is None:
            out.append({"path": path, "removed": True})
            continue
        h, names, asked = held
        nodes = [{"kind": k, "name": q.split("::")[-1].split(".")[-1], "qualified_name": q, "line_start": 1} for k, q in names]
        out.append({"path": path, "language": "x", "hash": h, "nodes": nodes, "edges": [{"kind": k, "source_qname": s, "target_raw": r, "line": i, "confidence_tier": t} for i, (k, s, r, t) in enumerate(asked)]})
    return "\n".join(map(json.dumps, out))


@pytest.mark.parametrize("seed", [2])
def test_any_edits_equal_a_full_build(spark, tmp_path, seed):
    import random

    from tierwalk.sources.graph import raw_schema

    rng, store, state = random.Random(seed), Store(spark, str(tmp_path / "store"), buckets=4), {}
    names = [("Function", "m.one"), ("Function", "n.one"), ("Class", "Base"), ("Class", "Kid"), ("Method", "Base::go"), ("Method", "Kid::run"), ("Table", "db.Trans"), ("Column", "db.Trans::id"), ("Method", "Kid::go")]
    asks = [("CALLS", "s", "m.one", "RESOLVED"), ("CALLS", "s", "one", "RESOLVED"), ("CALLS", "s", "Kid::go", "RESOLVED"), ("CALLS", "s", "Base::run", "RESOLVED"), ("EXTENDS", "Kid", "Base", "RESOLVED"), ("CALLS", "s", "go", "HEURISTIC"), ("CALLS", "s", "Aka::go", "RESOLVED"), ("ALIASES", "Aka", "Base", "DYNAMIC"), ("WRITES", "s", "DB.trans::ID", "RESOLVED"), ("WRITES", "s", "x.trans::id", "RESOLVED"), ("INCLUDES", "s", "b.x", "RESOLVED")]
    for batch in range(4):
        edits = {}
        for path in rng.sample([f"{c}.x" for c in "abcdef"], 3):
            if path in state and rng.random() < 0.3:
                edits[path] = None
                del state[path]
            else:
                state[path] = edits[path] = (f"h{batch}", [("File", path), *rng.sample(names, rng.randint(0, 4))], rng.sample(asks, rng.randint(0, 5)))
        (tmp_path / f"{batch}.json").write_text(as_rows(edits))
        assert store.apply(spark.read.schema(raw_schema() + ", removed boolean").json(str(tmp_path / f"{batch}.json")), batch) == len(edits)
        (tmp_path / f"full{batch}.json").write_text(as_rows(state))
        full = resolve.apply(from_jsonl(spark, str(tmp_path / f"full{batch}.json")))
        got, want = store.graph(), full
        assert content(got) == content(want), batch
        assert sorted((r.target_raw, r.confidence_tier, r.target_qname or "") for r in got.edges.collect()) == sorted((r.target_raw, r.confidence_tier, r.target_qname or "") for r in want.edges.collect())
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("v")]) <= 8


def test_a_removed_definition_unlinks_what_named_it(spark, tmp_path):
    from tierwalk.sources.graph import raw_schema

    store = Store(spark, str(tmp_path / "store"), buckets=8)
    first = {"a.x": ("1", [("Function", "m.f")], []), "b.x": ("1", [], [("CALLS", "b", "m.f", "RESOLVED")]), "c.x": ("1", [], [("CALLS", "c", "other", "RESOLVED")])}
    for batch, (state, want) in enumerate([(first, "m.f"), ({"a.x": ("2", [], [])}, None), ({"d.x": ("1", [("Function", "m.f")], [])}, "m.f"), ({"d.x": None}, None)]):
        (tmp_path / f"{batch}.json").write_text(as_rows(state))
        store.apply(spark.read.schema(raw_schema() + ", removed boolean").json(str(tmp_path / f"{batch}.json")), batch)
        assert {(r.target_raw, r.target_qname) for r in store.graph().edges.collect()} == {("m.f", want), ("other", None)}


def test_snapshot_versions_are_checked(spark, chain, tmp_path):
    save(chain, str(tmp_path / "s"))
    assert content(load(spark, str(tmp_path / "s"))) == content(chain)
    spark.createDataFrame([("version", "0")], "key string, value string").write.mode("overwrite").json(str(tmp_path / "s/meta"))
    with pytest.raises(ValueError):
        load(spark, str(tmp_path / "s"))


def test_python_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/m.py").write_text("import os\nclass A(B):\n    def go(self):\n        return os.getcwd()\n")
    (tmp_path / "src/bad.py").write_text("def (:\n")
    g = from_rows(python_files.read(spark, str(tmp_path / "src")))
    assert {r.qualified_name for r in g.nodes.where("kind <> 'File'").collect()} == {"m.A", "m.A::go"}
    assert {(r.kind, r.target_raw) for r in g.edges.collect()} >= {("IMPORTS", "os"), ("EXTENDS", "B"), ("CALLS", "os.getcwd")}
    assert [r.path for r in g.files.where("not parsed_ok").collect()] == ["bad.py"]


def test_document_references(spark, chain):
    docs = spark.createDataFrame([("d", "See `Maybe` and `C::m`.\n```\n`A.php`\n```\n`nothing` `B.php`")], "doc string, value string")
    assert {(r.ref, r.state) for r in doc_refs.judge(doc_refs.extract(docs), chain).collect()} == {("Maybe", "ok"), ("C::m", "ok"), ("nothing", "gone"), ("B.php", "ok")}


def test_ignore_rules_last_match_wins(spark):
    files = spark.createDataFrame([(p,) for p in ("a.log", "x/a.log", "keep/a.log", "build/o.c", "src/build/o.c", "src/a.c")], "path string")
    got = {r.path for r in records.ignored(files, ["*.log", "!keep/*.log", "build/"]).where("ignored").collect()}
    assert got == {"a.log", "x/a.log", "build/o.c", "src/build/o.c"}


def test_sparse_columns_fold_into_typed_ones(spark):
    cols = "qualified_name string, data_type string, nullable boolean, identity boolean, primary_key boolean, file_path string"
    rows = spark.createDataFrame([("T::A", "int", True, None, None, "1.sql"), ("t::a", None, False, True, None, "2.sql"), ("T::B", None, True, None, None, "2.sql")], cols)
    got = {r.qualified_name: (r.nullable, r.identity, r.extras_from) for r in records.fold_columns(rows).collect()}
    assert got == {"T::A": (True, True, ["2.sql"]), "T::B": (True, None, None)}


def test_records_filter_attach_and_rank(spark, chain):
    rows = spark.createDataFrame([("r1", ["A", "nowhere"], {"team": ["x", "y"]}), ("r2", ["B"], {"team": ["z"]})], "id string, targets array<string>, attributes map<string,array<string>>")
    assert [r.id for r in records.select(rows, {"team": ["y"]}, ["team"]).collect()] == ["r1"]
    with pytest.raises(ValueError):
        records.select(rows, {"size": ["1"]}, ["team"])
    assert {(r.target, r.state) for r in records.attach(rows, chain).collect()} == {("A", "linked"), ("nowhere", "dangling"), ("B", "linked")}
    radius = spark.createDataFrame([("A", 2), ("B", 1)], "qname string, depth int")
    assert [(r.id, r.distance) for r in records.ranked(rows, radius).collect()] == [("r2", 1), ("r1", 2)]


def test_rules_tell_confirmed_from_candidate(spark, chain):
    got = {(r.source_file, r.forbidden_file): r.verdict for r in rules.check(chain, rules.Forbidden("x", ["A.php"], ["C.php", "Maybe.php"], transitive=True)).collect()}
    assert got == {("A.php", "C.php"): "confirmed", ("A.php", "Maybe.php"): "candidate"}
    assert rules.check(chain, rules.Forbidden("x", ["A.php"], ["C.php"])).count() == 0


def test_definitions(spark):
    nodes = [("Class", "K", "K", "tests/K.php", True), ("Class", "K", "K", "src/K.php", False), ("Class", "M", "M", "old/1.2/M.php", False), ("Class", "M", "M", "new/M.php", False)]
    g = graph(spark, nodes, [])
    got = {(r.qualified_name, r.file_path): r.state for r in definitions.states(g, ["new/**", "old/**"]).collect()}
    assert got == {("K", "tests/K.php"): "test_copy", ("K", "src/K.php"): "live", ("M", "new/M.php"): "live", ("M", "old/1.2/M.php"): "superseded"}
    v = spark.createDataFrame([("db/1.2.0.sql",), ("db/1.10.sql",)], "p string").select(definitions.version("p", r"([0-9.]+)\.sql$").alias("v"))
    assert sorted(r.v for r in v.collect()) == [[1, 2], [1, 10]]


def plain_flows(edges, starts):
    out = {}
    for e in edges:
        out.setdefault(e.source_qname, []).append(e)
    found, rank = {}, ("RESOLVED", "HEURISTIC", "DYNAMIC").index
    for seed in starts:
        seen, at, step = {seed}, [seed], 0
        while at:
            step += 1
            go = [e for name in at for e in out.get(name, ())]
            for e in go:
                if e.kind == "WRITES":
                    key, new = (seed, e.target_qname), (step, rank(e.confidence_tier))
                    found[key] = min(found.get(key, new), new)
            at = list({e.target_qname for e in go if e.kind != "WRITES" and e.confidence_tier == "RESOLVED"} - seen)
            seen.update(at)
    return found


def as_found(rows):
    return {(r.seed, r.sink): (r.steps, ("RESOLVED", "HEURISTIC", "DYNAMIC").index(r.confidence_tier)) for r in rows.collect()}


def test_flows_have_no_limit_of_hops(spark):
    names = [f"n{i}" for i in range(11)]
    edges = [("CALLS", a, b, "RESOLVED", "a.x") for a, b in zip(names, names[1:], strict=False)]
    edges += [("CALLS", "n9", "n2", "RESOLVED", "a.x"), ("WRITES", "n10", "T", "HEURISTIC", "a.x"), ("WRITES", "n5", "T::c", "RESOLVED", "a.x"), ("CALLS", "n3", "weak", "HEURISTIC", "a.x"), ("WRITES", "weak", "U", "RESOLVED", "a.x")]
    g = graph(spark, [("Function", n, n, "a.x", False) for n in (*names, "weak")], edges)
    got = as_found(analytics.flows(g, seeds(spark, "n0", "n9")))
    assert got == {("n0", "T"): (11, 1), ("n0", "T::c"): (6, 0), ("n9", "T"): (2, 1), ("n9", "T::c"): (5, 0)}
    assert got == plain_flows(relational.flow_edges(g).collect(), ["n0", "n9"])


def test_flows_of_all_customers(spark):
    g = built(spark, "/root/testdata/sf0.01")
    starts = [r.qualified_name for r in g.nodes.where("kind = 'Class' and startswith(qualified_name, 'cust.')").collect()]
    want = plain_flows(relational.flow_edges(g).collect(), starts)
    assert as_found(QUERIES["trace_flows_all"](spark, "/root/testdata/sf0.01")) == want
    assert len({seed for seed, _ in want}) > 20


def test_tour_expands_from_files_without_inbound_edges(spark):
    # Twelve wide files lead to single leaves; a root leads down a chain; a cycle hangs on nothing.
    wide = [(f"w{i:02}", f"leaf{i:02}_{j}") for i in range(12) for j in range(3)]
    chain = [("root", "c1"), ("root", "c2"), ("root", "c3"), ("root", "c4"), ("c1", "d1"), ("d1", "e1"), ("e1", "c2"), ("y", "z"), ("z", "y")]
    pairs = wide + chain
    files = sorted({f for p in pairs for f in p})
    g = graph(spark, [("Function", f, f, f, False) for f in files], [("CALLS", a, b, "RESOLVED", a) for a, b in pairs])
    rows = analytics.tour(g, 12).orderBy("stop").collect()
    # A quarter of 12 are seeds; they expand by path to the budget.
    assert [r.file for r in rows] == ["root", "w00", "w01", "c1", "c2", "c3", "c4", "leaf00_0", "leaf00_1", "leaf00_2", "leaf01_0", "leaf01_1"]
    assert all(r.truncated for r in rows)
    whole = analytics.tour(g, 100).collect()
    stop = {r.file: r.stop for r in whole}
    assert sorted(stop) == files and not any(r.truncated for r in whole)
    assert all(stop[a] < stop[b] for a, b in pairs if {a, b} != {"y", "z"})
    assert {r.component for r in whole if r.file in ("y", "z")} == {"y"}


def test_transitive_rules_have_no_limit_of_hops(spark):
    names = [f"n{i}" for i in range(11)]
    g = graph(spark, [("Function", n, n, f"{n}.x", False) for n in names], [("CALLS", a, b, "RESOLVED", f"{a}.x") for a, b in [*zip(names, names[1:], strict=False), ("n9", "n2")]])

    def found(**more):
        return {(r.forbidden_file, r.verdict) for r in rules.check(g, rules.Forbidden("x", ["n0.x"], ["n4.x", "n10.x"], transitive=True, **more)).collect()}

    assert found() == found(depth=11) == {("n4.x", "confirmed"), ("n10.x", "confirmed")}
    assert found(depth=4) == {("n4.x", "confirmed"), (None, "incomplete")}
