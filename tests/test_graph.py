import random
import shutil

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattisym.functions import text as X
from lattisym.functions.porter import stem
from lattisym.operators import definitions, edits, lookup, reach, relations, search
from lattisym.operators.resolve import resolve_calls
from lattisym.plans import bench, envelope, store

NODE = "kind string, name string, qualified_name string, file_path string, line_start int, line_end int, signature string, docstring string, parent_name string, decorators array<string>, children array<string>, file_hash string"
EDGE = "kind string, source_qualified string, target_qualified string, raw_target string, file_path string, line int"


def nodes(spark, *names, **how):
    rows = []
    for k, qn in enumerate(names):
        path, _, name = qn.partition("::")
        parent, _, short = name.rpartition(".")
        rows.append((how.get("kind", "function"), short, qn, path, k + 1, k + 2, f"def {short}()", how.get("doc"), parent or None, how.get("decorators", []), [], "h"))
    return spark.createDataFrame(rows, NODE)


def edges(spark, *rows, kind="CALLS"):
    return spark.createDataFrame([(r[3] if len(r) > 3 else kind, r[0], r[1], r[1], r[2] if len(r) > 2 else r[0].partition("::")[0], k) for k, r in enumerate(rows)], EDGE)


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


def impact(spark, n, e, seed, depth, most=200):
    return {(x.qualified_name.split("::")[1], x.depth) for x in reach.impact_radius(n, e, seeds(spark, seed), depth, most).collect()}


def test_impact_chain_diamond_cycle(spark):
    n = nodes(spark, "f::A", "f::B", "f::C")
    chain = edges(spark, ("f::A", "f::B"), ("f::B", "f::C"))
    assert impact(spark, n, chain, "f::C", 1) == {("B", 1)}
    assert impact(spark, n, chain, "f::C", 3) == {("B", 1), ("A", 2)}
    assert impact(spark, n, edges(spark, ("f::A", "f::C"), ("f::B", "f::C")), "f::C", 1) == {("A", 1), ("B", 1)}
    assert impact(spark, n, edges(spark, ("f::A", "f::B"), ("f::B", "f::A"), ("f::A", "f::A")), "f::A", 9) == {("B", 1)}
    assert impact(spark, n, chain, "f::nowhere", 3) == set()
    assert impact(spark, n, chain, "f::C", 3, 1) == {("B", 1)}


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6))
def test_reach_against_plain_search(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(12), rng.randrange(12)) for _ in range(18)}
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string")
    got = {(x.seed, x.node): x.depth for x in reach.reach(df, spark.createDataFrame([("0", "0"), ("5", "5")], "seed string, node string"), 3).collect()}
    want = {}
    for s in (0, 5):
        seen = {s: 0}
        layer = {s}
        for hop in (1, 2, 3):
            layer = {b for a, b in pairs if a in layer} - set(seen)
            seen |= {x: hop for x in layer}
        want |= {(str(s), str(k)): v for k, v in seen.items()}
    assert got == want


def test_resolution(spark):
    n = nodes(spark, "a/x.py::go", "b/y.py::go", "b/y.py::only", "m/near.py::pick", "m/far.py::pick")
    e = edges(spark, ("c.py::f", "only"), ("c.py::f", "b.go"), ("c.py::g", "go"), ("c.py::h", "none"), ("d.py::f", "json.only"), ("d.py::f", "near.pick"), ("c.py", "a/x.py::go", "c.py", "IMPORTS"))
    got = {(x.source_qualified, x.raw_target): x.target_qualified for x in resolve_calls(e, n).collect()}
    assert got["c.py::f", "only"] == "b/y.py::only" and got["c.py::f", "b.go"] == "b/y.py::go"
    assert got["c.py::g", "go"] == "a/x.py::go"  # by the import
    assert got["c.py::h", "none"] == "none" and got["d.py::f", "json.only"] == "b/y.py::only"  # a lone candidate is taken whatever the hint
    assert got["d.py::f", "near.pick"] == "m/near.py::pick"
    bare = edges(spark, ("z.py::f", "go"))
    assert resolve_calls(bare, n).first().target_qualified == "go"
    same = edges(spark, ("z.py::f", "x.only"), ("z.py::f", "only")).withColumn("line", F.lit(1))
    assert resolve_calls(same, n).count() == 1
    tested = edges(spark, ("t.py::test_a", "only"), kind="TESTED_BY")
    assert resolve_calls(tested, n).first().target_qualified == "only"
    assert resolve_calls(tested, n, ("CALLS", "TESTED_BY")).first().target_qualified == "b/y.py::only"


def test_tests_of(spark):
    n = nodes(spark, "s.py::deep", "s.py::mid", "t.py::test_mid", "t.py::test_deep")
    e = edges(spark, ("s.py::mid", "s.py::deep"), ("t.py::test_mid", "s.py::mid", "t.py", "TESTED_BY"), ("t.py::test_deep", "s.py::deep", "t.py", "TESTED_BY"))
    got = {(x.name, x.indirect) for x in reach.transitive_tests(n, e, seeds(spark, "s.py::deep"), 2).collect()}
    assert got == {("test_deep", False), ("test_mid", True)}


def test_dead_code(spark):
    n = nodes(spark, "a.py::used", "a.py::lost", "a.py::main", "a.py::on_x", "tests/b.py::x", "conftest.py::c", "a.py::__call__").unionByName(nodes(spark, "w.py::page", decorators=["app.route('/')"]))
    assert [x.name for x in relations.dead_code(n, edges(spark, ("a.py::lost", "a.py::used"))).collect()] == ["lost"]
    assert [x.name for x in relations.dead_code(nodes(spark, "test_dir/a.py::f", "x/test_a.py::g"), edges(spark, ("q", "q"))).collect()] == ["f"]


def test_usages(spark):
    n = nodes(spark, "a.py::f", "b.py::g", "tests/t.py::test_f")
    e = edges(spark, ("b.py::g", "a.py::f"), ("b.py::g", "f"), ("tests/t.py::test_f", "f", "tests/t.py", "TESTED_BY"), ("x.py::q", "a.py::f", "x.py", "IMPORTS"))
    target = n.where("name = 'f'")
    got = [(x.file_path, x.kind, x.context) for x in relations.usages(n, e, target).collect()]
    assert got == [("b.py", "reference", "def g()"), ("tests/t.py", "test", "def test_f()")]
    assert relations.usages(n, e, target, include_tests=False).count() == 1 and relations.usages(n, e, target, scope="tests/").count() == 1
    assert relations.usages(n, e, target, kind="call").count() == 0 and relations.usages(n, e, target, limit=1).count() == 1


def test_module_files(spark):
    imports = spark.createDataFrame([("pkg.a",), ("pkg",), ("deep.b",), ("os",), ("x.c",)], "module string")
    files = spark.createDataFrame([("pkg/a.py",), ("src/pkg/a.py",), ("src/pkg/__init__.py",), ("q/b.py",), ("c.py",), ("z/c.py",)], "file_path string")
    got = {x.module: x.resolved for x in relations.module_files(imports, files).collect()}
    assert got == {"pkg.a": "pkg/a.py", "pkg": "src/pkg/__init__.py", "deep.b": "q/b.py", "x.c": "c.py"}


def test_locate_and_search(spark):
    n = nodes(spark, "a.py::Box/Lid.close", "a.py::close", "b.py::closer", doc="shut the Door")
    n = n.withColumn("name", F.when(F.col("name") == "close", "close").otherwise(F.col("name")))
    assert lookup.locate(n, "Lid/close").count() == 1 and lookup.locate(n, "/Lid/close").count() == 0 and lookup.locate(n, "/Box/Lid/close").count() == 1
    assert lookup.locate(n, "close").count() == 2 and lookup.locate(n, "/close").count() == 1 and lookup.locate(n, "CLOSE", match="substring").count() == 3
    assert lookup.search_symbols(n, "Lid/close").count() == 1 and lookup.search_symbols(n, "Box/Lid/close").count() == 1
    assert [(x.name, x.score) for x in search.search(n, "close").collect()] == [("close", 100), ("close", 100), ("closer", 80)]
    assert search.search(n, "door").first().score == 20 and search.search(n, "zzz").count() == 0


def test_full_text(spark):
    n = nodes(spark, "a.py::parse_files", "b.py::other")
    assert [x.name for x in search.search_fts(n, "parsing file").collect()] == ["parse_files"]
    assert search.search_fts(n, "unknownword").count() == 0 and [x.name for x in search.search_fts(n, "the").collect()] == ["other"]
    assert [stem(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "happy", "controll", "adjustable", "sky")] == ["caress", "poni", "relat", "hop", "agre", "happi", "control", "adjust", "sky"]


def test_text_functions(spark):
    df = spark.createDataFrame([("a\x00b\tc" + "x" * 300, "one\r\ntwo\rthree\n")], "n string, t string")
    row = df.select(X.sanitize_name(F.col("n")).alias("n"), X.lines(F.col("t")).alias("l"), X.lines(F.lit("")).alias("e"), X.content_hash(F.lit("é")).alias("h")).first()
    assert row.n.startswith("ab\tcxx") and len(row.n) == 256 and row.l == ["one", "two", "three"] and row.e == []
    import fnmatch
    import hashlib
    import re

    assert row.h == "sha256:" + hashlib.sha256("é".encode()).hexdigest()[:16]
    for p in ("*.py", "a/?/[!x]*.go", "x.[ab]", "a[b"):
        for s in ("a/b.py", "a/b/c.go", "a/b/x.go", "x.a", "x.c", "a[b"):
            assert bool(re.match(X.glob_to_regex(p), s)) == fnmatch.fnmatchcase(s, p), (p, s)


@pytest.mark.parametrize(
    ("code", "position", "want"),
    [
        ("def n():\n  x", "after", "class A:\n    def f(self):\n        pass\n\n    def n():\n      x\n    y = 1\n"),
        ("def n():\n  x", "before", "class A:\n    def n():\n      x\n\n    def f(self):\n        pass\n    y = 1\n"),
    ],
)
def test_insert(spark, code, position, want):
    src = "class A:\n    def f(self):\n        pass\n    y = 1\n"
    rows = spark.createDataFrame([("a.py", src, 2, 3, code)], "file_path string, source string, line_start int, line_end int, new_code string")
    got = edits.insert_symbol(rows, position).first()
    assert got.source == want


def test_insert_with_blank_lines_and_replace(spark):
    rows = spark.createDataFrame([("a.py", "def f():\n    pass\n\ndef g():\n    pass\n", 1, 2, "def n(): ...")], "file_path string, source string, line_start int, line_end int, new_code string")
    got = edits.insert_symbol(rows).first()
    assert got.source == "def f():\n    pass\n\ndef n(): ...\ndef g():\n    pass\n" and (got.first_line, got.last_line, got.lines_added) == (4, 4, 1)
    rows = rows.withColumnRenamed("new_code", "new_body").withColumn("new_body", F.lit("  def f(x):\n\n      y\n z"))
    got = edits.replace_body(rows).first()
    assert got.source == "def f(x):\n\n    y\nz\n\ndef g():\n    pass\n" and (got.lines_removed, got.lines_added, got.last_line) == (2, 4, 4)
    with pytest.raises(ValueError, match="hash mismatch"):
        edits.check_hash("sha256:a", "sha256:b")


def test_edits_of_empty_files(spark):
    """An empty file has no lines: new code is all of it; a null source stays null."""
    rows = spark.createDataFrame([("a", "", 1, 1, "x\n y"), ("b", None, 1, 1, "x")], "file_path string, source string, line_start int, line_end int, new_body string")
    assert {x.file_path: x.source for x in edits.replace_body(rows).collect()} == {"a": "x\n y\n", "b": None}
    rows = rows.withColumnRenamed("new_body", "new_code")
    assert {x.file_path: x.source for x in edits.insert_symbol(rows).collect()} == {"a": "\nx\n y\n", "b": None}
    assert {x.file_path: x.source for x in edits.insert_symbol(rows, "before").collect()} == {"a": "x\n y\n\n", "b": None}


SOURCES = {"a.py": "def f():\n    return g()\n", "b.py": "def g():\n    return 1\n", "bad.py": "def (\n"}


def frame(spark, files):
    return spark.createDataFrame(sorted(files.items()), "file_path string, source string")


def test_build_refresh_store(spark, tmp_path):
    g = store.build(frame(spark, SOURCES))
    assert {x.target_qualified for x in g.edges.collect()} == {"b.py::g"} and g.files.where("parse_error is not null").count() == 1
    assert store.refresh(g, frame(spark, SOURCES)) is g
    place = (tmp_path / "state").as_uri()
    with pytest.raises(FileNotFoundError):
        store.load(spark, place)
    store.save(spark, g, place, "/p")
    assert store.metadata(spark, place)["project_root"] == "/p"
    later = {"a.py": SOURCES["a.py"], "b.py": "def h():\n    return 1\n", "c.py": "def new(): pass\n"}
    assert {x.file_path: x.status for x in store.diff(g.files, store.hashes(frame(spark, later))).collect()} == {"a.py": "same", "b.py": "changed", "bad.py": "deleted", "c.py": "added"}
    fresh = store.refresh(store.load(spark, place), frame(spark, later))
    assert {x.qualified_name for x in fresh.nodes.collect()} == {"a.py::f", "b.py::h", "c.py::new"}
    assert {x.target_qualified for x in fresh.edges.collect()} == {"g"}  # the callee is gone, so the call is bare again
    assert lookup.body(fresh.nodes, fresh.sources, "h").first().body == "def h():\n    return 1"
    assert store.remove_files(g, frame(spark, {"a.py": ""})).nodes.count() == 1
    store.save(spark, fresh, place)
    assert store.load(spark, place).nodes.count() == 3


def rows(df, *columns):
    return sorted(str([x[c] for c in columns or sorted(df.columns)]) for x in df.collect())


def test_incremental_refresh_is_a_full_one(spark, tmp_path):
    """After random changes the refreshed and stored graph is the graph of a build, though only touched buckets are written."""
    rng = random.Random(4)
    names = [f"f{k}" for k in range(8)]
    brings = lambda: "".join(f"import {rng.choice(('p1.m1', 'm2', 'new', 'p3.new', 'p2', 'pk.sub'))}\n" for _ in range(2))
    code = lambda: brings() + "".join(f"def {n}():\n    {rng.choice(names)}()\n    x.{rng.choice(names)}()\n\n" for n in rng.sample(names, rng.randrange(1, 3)))
    files = {f"p{k}/m{k}.py": code() for k in range(12)}
    place = (tmp_path / "state").as_uri()
    store.save(spark, store.build(frame(spark, files)), place, buckets=6)
    for turn in range(2):
        files.pop(rng.choice(sorted(files)))
        files[f"p{turn}/new.py"] = code()
        files[f"pk/sub/__init__.py" if turn % 2 else "p2/__init__.py"] = code()
        files[rng.choice(sorted(files))] = code()
        store.save(spark, store.refresh(store.load(spark, place), frame(spark, files)), place)
        got, want = store.load(spark, place), store.build(frame(spark, files))
        key = ("kind", "source_qualified", "target_qualified", "file_path", "line")
        assert rows(got.edges, *key) == rows(want.edges, *key) and rows(got.nodes) == rows(want.nodes.select(*got.nodes.columns)) and rows(got.sources) == rows(want.sources)
        assert rows(got.files, "file_path", "content_hash") == rows(want.files, "file_path", "content_hash")
        assert rows(got.grams) == rows(search.grams(got.nodes)) and rows(got.imports) == rows(relations.file_imports(want.files).select(*got.imports.columns))
        assert store.totals(got) == {"total_nodes": want.nodes.count(), "total_edges": want.edges.count(), "total_files": want.files.count()}
        assert rows(got.postings) == rows(search.postings(got.nodes)) and rows(got.pairs.select("a", "b").distinct()) == rows(reach.both_ways(want.edges))
        one = {x.qualified_name for x in reach.impact_radius(got.nodes, got.edges, got.nodes.limit(1).select(F.col("qualified_name").alias("seed")), pairs=got.pairs).collect()}
        assert one == {x.qualified_name for x in reach.impact_radius(got.nodes, got.edges, got.nodes.limit(1).select(F.col("qualified_name").alias("seed"))).collect()}


def test_refresh_shares_untouched_buckets(spark, tmp_path):
    files = {f"m{k}.py": f"def f{k}():\n    pass\n" for k in range(30)}
    place = (tmp_path / "state").as_uri()
    first = store.save(spark, store.build(frame(spark, files)), place, buckets=10)
    files["m3.py"] = "def f3():\n    return 1\n"
    second = store.save(spark, store.refresh(store.load(spark, place), frame(spark, files)), place)
    held = store.manifest(spark, place, second)["tables"]["nodes"]
    assert sorted(held.values()).count(second) == 1 and set(held.values()) == {first, second} and store.load(spark, place).nodes.count() == 30
    for k in range(3):  # snapshots that nobody needs any more go
        last = store.save(spark, store.build(frame(spark, files)), place)
    left = {p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("snapshot-")}
    assert last in left and len(left) == 2 and first not in left
    assert sorted(p.name for p in (tmp_path / "state" / "states").iterdir() if not p.name.startswith(".")) == ["000000000004", "000000000005"]


def test_writers_that_meet(spark, tmp_path):
    """The second of two writers is refused and leaves nothing; redone on the new state both changes are there; folders of a writer at work stay."""
    place = (tmp_path / "state").as_uri()
    files = {f"m{k}.py": f"def f{k}():\n    pass\n" for k in range(12)}
    store.save(spark, store.build(frame(spark, files)), place, buckets=6)
    one, two = store.load(spark, place), store.load(spark, place)
    working = tmp_path / "state" / "snapshot-working"
    working.mkdir()
    store.save(spark, store.refresh(one, frame(spark, files | {"m1.py": "def one(): pass\n"})), place)
    late = store.refresh(two, frame(spark, files | {"m2.py": "def two(): pass\n"}))
    with pytest.raises(store.ConflictingWrite):
        store.save(spark, late, place)
    names = lambda: {x.name for x in store.load(spark, place).nodes.collect()}
    assert "one" in names() and "two" not in names()
    # both write, neither has seen the other: the state that is there first stays
    real, met = store._put, []

    def slow(spark, path, text):
        if not met:
            met.append(1)
            store.update(spark, place, lambda g: store.refresh(g, frame(spark, files | {"m1.py": "def one(): pass\n", "m3.py": "def three(): pass\n"})))
        return real(spark, path, text)

    store._put = slow
    try:
        put = frame(spark, {"m2.py": "def two(): pass\n"})
        change = lambda g: store.apply(g, put.selectExpr("file_path", "'changed' status"), put)
        before = {p.name for p in (tmp_path / "state").iterdir()}
        assert store.update(spark, place, change)
    finally:
        store._put = real
    assert {"one", "two", "three"} <= names() and len(names()) == 12
    assert working.exists() and len([p for p in (tmp_path / "state").iterdir() if p.name not in before]) <= 2


def test_refresh_reads_what_it_touches(spark, tmp_path):
    """A change of one file opens its own buckets, and row groups that may hold its names: not the tables."""
    files = {f"d{k}/m{k}.py": f"def f{k}():\n    f{(k + 1) % 90}()\n" for k in range(90)}
    place = (tmp_path / "state").as_uri()
    store.save(spark, store.build(frame(spark, files)), place, buckets=12)
    g = store.load(spark, place)
    put = frame(spark, {"d7/m7.py": "def g7():\n    f9()\n"})
    change = put.selectExpr("file_path", "'changed' status")
    new = store.apply(g, change, put)
    assert len(new.dirty) <= 2  # the file's own bucket and that of the caller of f7
    opened = {p.rsplit("bucket=", 1)[1].split("/")[0] for t in ("nodes", "edges", "files", "imports") for p in store._part(g, t, new.dirty).inputFiles()}
    assert {int(b) for b in opened} == set(new.dirty)
    store.save(spark, new, place)
    got = store.load(spark, place)
    want = store.build(frame(spark, files | {"d7/m7.py": "def g7():\n    f9()\n"}))
    assert rows(got.nodes) == rows(want.nodes.select(*got.nodes.columns)) and rows(got.edges) == rows(want.edges.select(*got.edges.columns))


def test_parts_of_names_by_stored_runs(spark):
    """Every way to look for parts gives with the index what it gives without; parts too short for the index are looked for in all nodes."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abAB_é") for _ in range(rng.randrange(1, 7)))
    code = {f"{word()}/{word()}{k}.py": "".join(f'def {word()}{j}():\n    """{word()} {word()}"""\n\n' for j in range(3)) for k in range(12)}
    nodes = store.build(frame(spark, code)).nodes
    index = search.grams(nodes)
    for _ in range(25):
        q = "".join(rng.choice("abAB_é0") for _ in range(rng.randrange(1, 5)))
        assert rows(search.search(nodes, q, None, index)) == rows(search.search(nodes, q, None))
        assert rows(lookup.locate(nodes, q, match="substring", index=index)) == rows(lookup.locate(nodes, q, match="substring"))
        assert rows(search.search_like(nodes, f"{q} {q[:3]}", index)) == rows(search.search_like(nodes, f"{q} {q[:3]}"))
    assert search.search_like(nodes, " ", index).count() == 0 == lookup.locate(nodes, "none of these", match="substring", index=index).count()


def test_definitions_over_imports(spark):
    """Chains over __init__ files and stars end where the name is defined; circles and dead ends give null; the last import of a name counts."""
    g = store.build(frame(spark, {
        "pkg/__init__.py": "from pkg.api import thing\nfrom pkg.star import *\n", "pkg/api.py": "from pkg.core import thing\n", "pkg/core.py": "def thing(): pass\n",
        "pkg/star.py": "from pkg.deep import *\n", "pkg/deep.py": "class Deep:\n    def thing(self): pass\n", "use.py": "from pkg import thing, Deep\n", "two.py": "from pkg.core import thing\nfrom pkg.other import thing\n",
        "pkg/other.py": "def thing(): pass\n", "round1.py": "from round2 import *\n", "round2.py": "from round1 import *\n", "own.py": "from pkg import thing\ndef thing(): pass\n",
    }))
    imports = relations.file_imports(g.files)
    asks = [("use.py", "thing"), ("use.py", "Deep"), ("two.py", "thing"), ("round1.py", "thing"), ("own.py", "thing"), ("pkg/deep.py", "thing"), ("no.py", "thing"), ("use.py", None), ("use.py", "thing")]
    got = {(x.file_path, x.name): (x.qualified_name, x.hops) for x in definitions.definitions(g.nodes, imports, spark.createDataFrame(asks, "file_path string, name string")).collect()}
    assert got == {
        ("use.py", "thing"): ("pkg/core.py::thing", 3), ("use.py", "Deep"): ("pkg/deep.py::Deep", 3), ("two.py", "thing"): ("pkg/other.py::thing", 1), ("round1.py", "thing"): (None, None),
        ("own.py", "thing"): ("own.py::thing", 0), ("pkg/deep.py", "thing"): (None, None), ("no.py", "thing"): (None, None),
    }
    found = lookup.search_symbols(g.nodes, "thing")
    assert [x.qualified_name for x in definitions.definition(g.nodes, imports, found, "two.py", "thing").collect()] == ["pkg/other.py::thing"]
    assert definitions.definition(g.nodes, imports, found, "round1.py", "thing").count() == found.count()


def test_tree_as_a_data_source(spark, tmp_path):
    """The same rows as reading the tree; conditions on paths choose folders; a stream takes what is new, also after a restart."""
    import os
    import time

    from lattisym.sources.project import read_tree
    from lattisym.sources.tree import SourceTree, _Reader, prefix
    from lattisym.streaming.refresh import stream_into

    root = tmp_path / "tree"
    for path, text in {"a.py": "def a(): pass\n", "b.txt": "no", "x/c.py": "def c(): pass\n", "x/venv/d.py": "no", "y/z/e.go": "package e\n", "y/f.ts": "\udcff", ".git/g.py": "no"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text.encode("utf-8", "surrogateescape"))
    spark.dataSource.register(SourceTree)
    read = lambda: spark.read.format("source_tree").load(root.as_uri())
    assert rows(read(), "file_path", "source") == rows(read_tree(spark, str(root)), "file_path", "source") and read().count() == 4
    some = lambda df: [rows(df.where(c), "file_path") for c in ("file_path = 'x/c.py'", "startswith(file_path, 'y/')", "file_path in ('a.py', 'y/f.ts', 'no')", "file_path > 'b'")]
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "true")
        pushed = spark.read.format("source_tree").option("pushdown", "true").load(str(root))
        assert some(pushed) == some(read_tree(spark, str(root))) and [len(x) for x in some(pushed)] == [1, 2, 2, 3]
    finally:
        spark.conf.set(key, before)
    assert rows(spark.read.format("source_tree").option("prefix", "y/z").load(str(root)), "file_path") == ["['y/z/e.go']"]
    reader = _Reader({"path": str(root)})
    reader.only, reader.exact = ["y/"], False
    assert [p.value[0] for p in reader.partitions()] == ["", "y"] and [x.base_name for x in reader.infos(prefix("y"))] == ["f.ts", "e.go"]
    reader.only, reader.exact = ["x/c.py"], True
    assert [p.value[0] for p in reader.partitions()] == ["x"]
    past = time.time() - 100
    for folder, _, names in os.walk(root):
        for n in names:
            os.utime(f"{folder}/{n}", (past, past))
    stream = lambda: stream_into(spark.readStream.format("source_tree").option("settle", "0").load(str(root)), (tmp_path / "state").as_uri(), str(tmp_path / "cp")).awaitTermination()
    stream()
    names = lambda: {x.name for x in store.load(spark, (tmp_path / "state").as_uri()).nodes.collect()}
    assert names() == {"a", "c"}
    (root / "x/c.py").write_text("def later(): pass\n")
    time.sleep(0.1)
    stream()
    assert names() == {"a", "later"}
    (root / "empty").mkdir()
    assert spark.read.format("source_tree").load(str(root / "empty")).count() == 0


def test_failed_write_leaves_the_old_state(spark, tmp_path, monkeypatch):
    place = (tmp_path / "state").as_uri()
    store.save(spark, store.build(frame(spark, SOURCES)), place)

    def fail(*args):
        raise RuntimeError("out of disk")

    monkeypatch.setattr(store, "_put", fail)
    with pytest.raises(RuntimeError):
        store.save(spark, store.build(frame(spark, {"z.py": "def z(): pass\n"})), place)
    assert {x.name for x in store.load(spark, place).nodes.collect()} == {"f", "g"}


def test_older_and_broken_stores(spark, tmp_path):
    """The first layout is migrated, with equal edges made one; what cannot be read is built anew; an index of older tools goes."""
    state, root = tmp_path / "state", tmp_path / "root"
    place, name = state.as_uri(), "snapshot-old"
    g = store.build(frame(spark, SOURCES))
    for t in ("nodes", "files", "sources"):
        getattr(g, t).write.parquet(f"{place}/{name}/{t}")
    g.edges.union(g.edges).write.parquet(f"{place}/{name}/edges")
    spark.createDataFrame([("schema_version", "1"), ("project_root", "/p")], "key string, value string").write.parquet(f"{place}/{name}/metadata")
    (state / "CURRENT").write_text(name)
    assert store.load(spark, place).edges.count() == g.edges.count() and store.load(spark, place).postings is None
    assert store.migrate(spark, place) and not store.migrate(spark, place)
    new = store.load(spark, place)
    assert new.edges.count() == g.edges.count() and new.postings.where("token = 'g'").count() > 0 and store.metadata(spark, place) == {"schema_version": "3", "project_root": "/p"}
    root.mkdir()
    (root / "a.py").write_text("def f(): pass\n")
    (root / "pyproject.toml").write_text("")
    assert not (state / "CURRENT").exists() and not (state / name).exists()
    for text in ("snapshot-gone", "{"):
        (state / "states" / "000000000009").write_text(text)
        (state / "states" / ".000000000009.crc").unlink(missing_ok=True)
        (state / "index.json").write_text("{}")
        assert [x.name for x in store.load_or_build(spark, str(root), place).nodes.collect()] == ["f"] and not (state / "index.json").exists()
        shutil.rmtree(state / "states")
        store.save(spark, store.build(frame(spark, SOURCES)), place)
    (state / store.current(spark, place) / "manifest.json").write_text("{")
    (state / store.current(spark, place) / ".manifest.json.crc").unlink(missing_ok=True)
    assert [x.name for x in store.load_or_build(spark, str(root), place).nodes.collect()] == ["f"]


def test_reach_on_the_driver_and_beyond(spark):
    rng = random.Random(7)
    pairs = spark.createDataFrame([(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(110)], "a string, b string")
    start = spark.createDataFrame([("x", "n1"), ("x", "n2"), ("y", "n3"), ("y", "n3")], "seed string, node string")
    want = rows(reach.reach(pairs, start, 4))
    for small in (0, 2, 5, 20):
        assert rows(reach.reach(pairs, start, 4, small)) == want
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(reach, "HUB", 3)  # most nodes in several rows
        assert rows(reach.reach(pairs, start, 4, -1)) == want
    near = reach._neighbours(pairs)
    assert near.where(F.expr("near <> array_sort(near)")).count() == 0
    one = spark.createDataFrame([("hub", f"n{k}") for k in range(5000)], "a string, b string")
    cut = reach._neighbours(one).collect()
    assert len(cut) == 5 and max(len(x.near) for x in cut) < 1500 and sum(len(x.near) for x in cut) == 5000
    assert len(want) > 30 and reach.reach(pairs, start.limit(0), 4).count() == 0 == reach.reach(pairs, start.limit(0), 4, -1).count()


def test_stored_postings_answer_like_a_scan(spark):
    nodes = store.build(frame(spark, {"pkg/parse_files.py": "def parse_file_name():\n    pass\n\nclass FileParser:\n    def parse(self):\n        pass\n", "pkg/other.py": "def file_parse_file():\n    pass\n"})).nodes
    index = search.postings(nodes)
    for query in ("parse", "file", "parse_file", "file_name pkg", "file_file", "parse parse", "other.py", "nothing", "", "parse_file file_parse", "__"):
        want = rows(search.search_text(nodes, query, ("name", "qualified_name", "file_path")), "qualified_name")
        held = search.holders(index, query)
        assert (rows(held, "qualified_name") if held is not None else []) == want


def test_table_functions(spark):
    from lattisym.operators.extract import register

    register(spark)
    frame(spark, SOURCES).createOrReplaceTempView("code")
    assert {tuple(x) for x in spark.sql("SELECT c.file_path, s.name FROM code c, LATERAL parse_symbols(c.file_path, c.source) s").collect()} == {("a.py", "f"), ("b.py", "g")}
    assert spark.sql("SELECT e.target FROM code c, LATERAL parse_edges(c.file_path, c.source) e").first().target == "g"


def test_streamed_refresh(spark, tmp_path):
    from lattisym.streaming.refresh import stream_into

    place, inbox = (tmp_path / "state").as_uri(), str(tmp_path / "in")
    schema = "file_path string, source string, version int"
    spark.createDataFrame([("a.py", "def f(): pass\n", 1), ("a.py", "def g(): pass\n", 2), ("b.py", "def h(): pass\n", 1)], schema).write.parquet(inbox)
    changes = spark.readStream.schema(schema).parquet(inbox)
    stream_into(changes, place, str(tmp_path / "cp")).awaitTermination()
    assert {x.name for x in store.load(spark, place).nodes.collect()} == {"g", "h"}
    spark.createDataFrame([("b.py", None, 3)], schema).write.mode("append").parquet(inbox)
    stream_into(changes, place, str(tmp_path / "cp")).awaitTermination()
    assert {x.name for x in store.load(spark, place).nodes.collect()} == {"g"}


def test_stream_with_state(spark, tmp_path):
    """Versions out of order, over micro-batches and a restart, give the graph of the newest ones; texts that don't differ and late versions change nothing."""
    from lattisym.streaming.refresh import ROCKS, stream_into

    place, inbox = (tmp_path / "state").as_uri(), str(tmp_path / "in")
    schema = "file_path string, source string, version int"
    versions = [[("a.py", "def a3(): pass\n", 3), ("a.py", "def a1(): pass\n", 1), ("b.py", "def b1(): pass\n", 1)], [("a.py", "def a2(): pass\n", 2), ("b.py", None, 5), ("c.py", "def c(): pass\n", 1)], [("b.py", "def b4(): pass\n", 4), ("c.py", "def c(): pass\n", 9), ("c.py", "def d(): pass\n", 8)]]
    wanted, states = [{"a3", "b1"}, {"a3", "c"}, {"a3", "c"}], []
    before = spark.conf.get(ROCKS[0], None)
    for some, want in zip(versions, wanted, strict=True):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream_into(spark.readStream.schema(schema).parquet(inbox), place, str(tmp_path / "cp"), stateful=True).awaitTermination()
        assert {x.name for x in store.load(spark, place).nodes.collect()} == want
        states.append(store.current(spark, place))
    assert states[1] == states[2] and spark.conf.get(ROCKS[0], None) == before


def test_rubrics_and_envelopes(spark, tmp_path):
    ok = envelope.success("locate", [{"name": "f", "line": 3}])
    assert ok.startswith("ok: true\ncommand: locate\nresult:") and "truncated: true" in envelope.success("usages", [], 50, 50)
    assert bench.judge({"type": "exact-match", "expected": {"name": "f"}}, [ok]) and not bench.judge({"type": "exact-match", "expected": {"name": "g"}}, [ok])
    assert bench.judge({"type": "must-contain", "expected_items": ["name", "f"]}, [ok]) and bench.judge({"type": "must-contain-any", "expected_items": ["zz", "f"]}, [ok])
    assert bench.judge({"type": "min-count", "min_results": 1}, [ok]) and not bench.judge({"type": "min-count", "min_results": 2}, [ok])
    assert not bench.judge({"type": "exact-match", "expected": {}}, [envelope.failure("x", "no")]) and not bench.judge({"type": "odd"}, [ok])
    q = {"id": "q", "archetype": "find", "commands": ["locate f"], "rubric": {"type": "min-count", "min_results": 1}}
    r = bench.run_query(q, lambda _: ok)
    assert r["correct"] and "1 of 1 correct" in bench.report([r])
    path = bench.save_baseline([r], tmp_path / "base")
    bench.save_baseline([r], tmp_path / "base")
    assert bench.load_baseline(path) == [r] and [x.name for x in path.parent.iterdir()] == ["current.yaml"]


def test_commands_on_disk(spark, tmp_path):
    import argparse

    from lattisym.cli import answer, parser
    from lattisym.plans import guide
    from lattisym.plans.commands import Project
    from lattisym.sources.project import IgnoreRules, discover, find_project_root

    (tmp_path / "pkg").mkdir()
    (tmp_path / "pyproject.toml").write_text("")
    (tmp_path / ".gitignore").write_text("gen/\n*.tmp.py\n!keep.tmp.py\n")
    (tmp_path / "gen").mkdir()
    (tmp_path / "gen/x.py").write_text("x = 1\n")
    (tmp_path / "pkg/a.py").write_text("from pkg.b import g\n\ndef f():\n    return g()\n")
    (tmp_path / "pkg/b.py").write_text("def g():\n    return 1\n")
    assert find_project_root(tmp_path / "pkg") == tmp_path.resolve() and discover(tmp_path) == ["pkg/a.py", "pkg/b.py"]
    rules = IgnoreRules(["/build", "**/out/*.ts", "[ab].go"])
    assert rules.ignores("build/x.py") and not rules.ignores("s/build/x") and rules.ignores("s/out/q.ts") and rules.ignores("d/a.go")
    p = Project(spark, tmp_path)
    run = lambda *a, code="": answer(p, parser().parse_args(list(a)), code)
    assert "pkg/a.py" in run("files") and "def f()" in run("files", "--summary") and "line: 3" in run("locate", "f")
    assert "pkg/a.py" in run("usages", "g") and "imported_by:\n  - file: pkg/a.py" in run("imports", "pkg/b.py")
    assert "total_affected: 1" in run("blast-radius", "g", "--file", "pkg/b.py") and "symbol: f" in run("dead-code") and "covered: false" in run("test-coverage", "g")
    assert "total_files: 2" in run("overview") and "name: g" in run("search", "g") and "ok: false" in run("outline", "no.py")
    assert p.body("g", asked_in="pkg/a.py")["file"] == "pkg/b.py" == p.body("g", asked_in="no.py")["file"] and "def g()" in run("body", "g", "--asked-in", "pkg/a.py")
    h = p.body("g")["content_hash"]
    assert "hash mismatch" in run("replace-body", "g", "--expect-hash", "sha256:0", code="def g(): pass")
    assert "lines_added: 2" in run("replace-body", "g", "--expect-hash", h, code="def g(x):\n    return f2(x)")
    assert (tmp_path / "pkg/b.py").read_text() == "def g(x):\n    return f2(x)\n"
    assert "inserted_range" in run("insert-symbol", "--after", "g", code="def f2(x):\n    return x")
    assert "ok: false" in run("insert-symbol", code="x") and "pkg/b.py" in run("usages", "f2") and "python" in run("init")
    assert guide.lookup("nope") is None and guide.lookup("body")["command"] == "body"
    assert isinstance(parser(), argparse.ArgumentParser)
