"""What must hold on large code bases, seen in the plans of small ones."""

import pyarrow as pa
import pytest
from oracle import DATA

from lattisym import queries
from lattisym.operators import definitions, extract, lookup, reach, relations, search
from lattisym.operators.resolve import resolve_calls
from lattisym.plans.corpus import source_files

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_that_grows_with_the_graph_is_broadcast(spark):
    """All tables here are far below Spark's threshold, as its estimates of a large graph's compressed tables are."""
    g = queries.graph(spark, str(DATA))
    seeds = g.nodes.select(g.nodes.qualified_name.alias("seed"))
    for df in (
        resolve_calls(g.edges, g.nodes),
        relations.dead_code(g.nodes, g.edges),
        relations.file_importance(g.nodes, g.edges),
        relations.file_imports(g.files),
        relations.usages(g.nodes, g.edges, g.nodes, limit=None),
        lookup.file_records(g.nodes, g.files),
        lookup.nodes_named(g.nodes, g.nodes),
        lookup.bodies(g.nodes, g.sources),
        reach.reach(g.pairs.select("a", "b"), seeds.withColumn("node", seeds.seed), 1, small=1),
        definitions.definitions(g.nodes, g.imports, g.nodes.select("file_path", "name")),
    ):
        assert "BroadcastExchange" not in plan(df)


def test_files_are_dealt_to_all_cores_before_they_are_parsed(spark):
    """The tables that make the files are one split each; their files must not be parsed by one task."""
    files = source_files(spark, str(DATA)).coalesce(1)
    assert extract.parse_files(files).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_stems_of_a_batch(spark):
    """Nulls, empty lists and repeated words, against the stemmer itself; each distinct word of a batch is one Python object at most."""
    rows = [["running", "runs", "running"], None, [], ["ponies", None]]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, words array<string>").coalesce(1)
    got = {x.k: x.s for x in df.select("k", search._stems("words").alias("s")).collect()}
    assert got == {0: ["run", "run", "run"], 1: None, 2: [], 3: ["poni", None]}
    assert "ArrowEvalPython" in plan(df.select(search._stems("words")))


def test_runs_are_distinct_within_a_file(spark):
    rows = [("a.py", "abcd", "a.py::abcd", None), ("a.py", "bcde", "a.py::bcde", "ABCD"), ("b.py", "ab", "b.py::ab", "")]
    nodes = spark.createDataFrame(rows, "file_path string, name string, qualified_name string, docstring string")
    want = set()
    for path, *fields in rows:
        for field, text in zip(("name", "qualified_name", "docstring"), fields, strict=True):
            low = (text or "").lower()
            want |= {(low[k : k + 3], field, path) for k in range(len(low) - 2)}
    got = [tuple(x) for x in search.grams(nodes).select("gram", "field", "file_path").collect()]
    assert sorted(got) == sorted(want)


def test_queries_that_read_no_stored_graph_build_none(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("the whole graph was built")

    monkeypatch.setattr(queries, "graph", refuse)
    for name in ("store_load_or_build", "store_refreshed_imports", "index_build"):
        assert queries.QUERIES[name](spark, str(DATA)).count() > 0


def test_a_word_is_stemmed_once_a_batch(monkeypatch):
    asked = []
    monkeypatch.setattr(search, "stem", lambda w: asked.append(w) or w)
    words = pa.array([["a", "b", "a"], ["b"], None, ["a"]])
    assert search._stems.func(words).to_pylist() == words.to_pylist() and sorted(asked) == ["a", "b"]


def test_definition_lookup_broadcasts_no_imports(spark, monkeypatch):
    monkeypatch.setattr(definitions, "definitions", lambda nodes, imports, asks: imports)
    assert "BroadcastExchange" not in plan(queries.QUERIES["definition_lookup"](spark, str(DATA)))
