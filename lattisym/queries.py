"""The registered queries of the code graph, each with DuckDB SQL that predicts its rows from the tables alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions.joins import shuffled
from .operators import definitions, edits, extract, lookup, reach, relations, search
from .operators.reach import shared_folder
from .operators.resolve import resolve_calls
from .plans import bench, store
from .plans.corpus import GO_SQL, GRAPH_SQL, TYPESCRIPT_SQL, go_files, shape_files, source_files, typescript_files

Query = Callable[[SparkSession, str], DataFrame]

_graphs: dict[tuple, store.Graph] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """What names the graphs of a folder: the application, and size and time of the tables that they're made of, so a changed table gives a new graph."""
    out = [spark.sparkContext.applicationId, sf_dir]
    for t in ("region", "nation", "customer", "supplier"):
        fs, p = store._fs(spark, f"{sf_dir}/{t}.parquet")
        out += sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(p))
    return tuple(out)


def graph(spark: SparkSession, sf_dir: str) -> store.Graph:
    """The stored graph of the synthetic code base, built once per application and state of the tables, as an index is; queries scan its Parquet tables."""
    key = _state(spark, sf_dir)
    if key not in _graphs:
        place = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
        store.save(spark, store.build(source_files(spark, sf_dir), keep=_cut), place)
        _graphs[key] = store.load(spark, place)
    return _graphs[key]


_tested: dict[tuple, DataFrame] = {}


def tested_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's edges with the targets of tests resolved too (a build option), stored once likewise."""
    key = _state(spark, sf_dir)
    if key not in _tested:
        g, place = graph(spark, sf_dir), f"{shared_folder(spark)}/tested-{uuid.uuid4().hex}"
        resolve_calls(g.edges, g.nodes, ("CALLS", "TESTED_BY")).write.parquet(place)
        _tested[key] = spark.read.parquet(place)
    return _tested[key]


_others: dict[tuple, store.Graph] = {}


def other_graph(spark: SparkSession, sf_dir: str, language: str) -> store.Graph:
    """The stored graph of the Go or TypeScript code base, built once likewise."""
    key = (*_state(spark, sf_dir), language)
    if key not in _others:
        place = f"{shared_folder(spark)}/{language}-{uuid.uuid4().hex}"
        files = {"go": go_files, "typescript": typescript_files}[language](spark, sf_dir)
        store.save(spark, store.build(files, keep=_cut), place)
        _others[key] = store.load(spark, place)
    return _others[key]


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flat(nodes: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, "|").alias(c)
    return nodes.select("kind", "name", "qualified_name", "file_path", "line_start", "line_end", "signature", "docstring", "parent_name", joined("decorators"), joined("children"))


NODE_COLUMNS = "kind, name, qualified_name, file_path, line_start, line_end, signature, docstring, parent_name, decorators, children"
NAMED = "file_path, name, kind, line_start AS line, signature, docstring, parent_name AS parent"

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, over_graph: bool = True, stored: bool | None = None):
    """Register a function of (graph, spark, sf_dir) with its SQL, which begins with the common tables of the graph if it is over one. Only if it reads the stored graph is that built."""
    stored = over_graph if stored is None else stored

    def put(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(graph(spark, sf_dir) if stored else None, spark, sf_dir)
        if sql is not None:
            ORACLE[name] = (GRAPH_SQL + sql) if over_graph else sql
        return f

    return put


# --- extraction and resolution ---------------------------------------------------------------------------------------


@query(f"SELECT {NODE_COLUMNS} FROM named")
def extract_symbols(g, spark, d):
    return _flat(g.nodes)


@query("SELECT file_path, CAST(imports.at AS INTEGER) AS ord, module, names, CAST(line AS INTEGER) AS line, false AS is_relative FROM imports")
def extract_imports(g, spark, d):
    return g.files.select("file_path", F.posexplode("imports").alias("ord", "i")).select("file_path", "ord", "i.module", F.array_join("i.names", "|").alias("names"), "i.line", "i.is_relative")


@query("SELECT kind, source_qualified, raw_target, file_path, CAST(line AS INTEGER) AS line FROM edges")
def extract_edges(g, spark, d):
    return g.edges.select("kind", "source_qualified", "raw_target", "file_path", "line")


@query(f"SELECT 'nodes' AS part, CAST(count(*) AS BIGINT) AS n FROM named UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'files', count(*) FROM files", stored=False)
def index_build(g, spark, d):
    """A whole build from source files: parse, resolve, count."""
    made = store.build(source_files(spark, d), keep=_cut)
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(made.nodes, "nodes").unionByName(count(made.edges, "edges")).unionByName(count(made.files, "files"))


_EDGES = "SELECT kind, source_qualified, raw_target, target_qualified, file_path, CAST(line AS INTEGER) AS line FROM edges"
_IMPORTS = "SELECT file_path, CAST(imports.at AS INTEGER) AS ord, module, names, CAST(line AS INTEGER) AS line, is_relative FROM imports"


def _edge_rows(g: store.Graph) -> DataFrame:
    return g.edges.select("kind", "source_qualified", "raw_target", "target_qualified", "file_path", "line")


def _import_rows(g: store.Graph) -> DataFrame:
    return g.files.select("file_path", F.posexplode("imports").alias("ord", "i")).select("file_path", "ord", "i.module", F.array_join("i.names", "|").alias("names"), "i.line", "i.is_relative")


@query(GO_SQL + f"SELECT {NODE_COLUMNS} FROM named", over_graph=False)
def extract_symbols_go(g, spark, d):
    return _flat(other_graph(spark, d, "go").nodes)


@query(GO_SQL + _EDGES, over_graph=False)
def extract_edges_go(g, spark, d):
    """Raw and resolved targets of calls, tests and imports."""
    return _edge_rows(other_graph(spark, d, "go"))


@query(GO_SQL + _IMPORTS, over_graph=False)
def extract_imports_go(g, spark, d):
    return _import_rows(other_graph(spark, d, "go"))


@query(TYPESCRIPT_SQL + f"SELECT {NODE_COLUMNS} FROM named", over_graph=False)
def extract_symbols_typescript(g, spark, d):
    return _flat(other_graph(spark, d, "typescript").nodes)


@query(TYPESCRIPT_SQL + _EDGES, over_graph=False)
def extract_edges_typescript(g, spark, d):
    """Raw and resolved targets of calls, tests and imports."""
    return _edge_rows(other_graph(spark, d, "typescript"))


@query(TYPESCRIPT_SQL + _IMPORTS, over_graph=False)
def extract_imports_typescript(g, spark, d):
    return _import_rows(other_graph(spark, d, "typescript"))


_SHAPES = "WITH r AS (SELECT 'shapes/shape_' || r_regionkey || '.py' AS f, CAST(r_regionkey AS VARCHAR) AS k FROM region) "


@query(
    _SHAPES
    + """SELECT f AS file_path, v.* REPLACE (replace(v.name, '#', k) AS name, replace(v.qn, '#', k) AS qn, replace(v.signature, '#', k) AS signature, replace(v.parent_name, '#', k) AS parent_name, replace(v.decorators, '#', k) AS decorators) FROM r, (VALUES
('variable', 'LIMIT', 'LIMIT', 6, 6, 'LIMIT: int', NULL, NULL, '', ''), ('variable', 'LEFT', 'LEFT', 7, 7, 'LEFT = ...', NULL, NULL, '', ''), ('variable', 'RIGHT', 'RIGHT', 7, 7, 'RIGHT = ...', NULL, NULL, '', ''),
('class', 'Outer_#', 'Outer_#', 11, 22, '@decorate(#)' || chr(10) || 'class Outer_#(Base, meta.Kind)', repeat('x', 200) || '...', NULL, 'decorate(#)', ''),
('class', 'Inner', 'Outer_#.Inner', 16, 22, 'class Inner', NULL, 'Outer_#', '', 'run|size'),
('method', 'run', 'Outer_#/Inner.run', 17, 18, 'async def run(b: int = 1, *args: str, c, d = ''x'', **kw) -> list[int]', NULL, 'Outer_#/Inner', '', ''),
('method', 'size', 'Outer_#/Inner.size', 21, 22, 'def size(self)', NULL, 'Outer_#/Inner', 'property', ''),
('function', 'outer', 'outer', 25, 28, 'def outer(x = [1, 2], y)', NULL, NULL, '', '')) v(kind, name, qn, line_start, line_end, signature, docstring, parent_name, decorators, children)""",
    over_graph=False,
)
def extract_shapes(g, spark, d):
    """Every shape of symbol and parameter: annotated and chained assignments, bases, decorators, long docstrings, nested classes, async, positional-only and keyword-only parameters."""
    nodes = _flat(extract.nodes_of(extract.parse_files(shape_files(spark, d))))
    return nodes.withColumn("qn", F.substring_index("qualified_name", "::", -1)).drop("qualified_name")


@query(
    _SHAPES
    + """SELECT v.kind, f || replace(v.source, '#', k) AS source_qualified, CASE WHEN starts_with(v.target, '::') THEN f ELSE '' END || replace(v.target, '#', k) AS raw_target, f AS file_path, v.line FROM r, (VALUES
('IMPORTS', '', 'a.b', 2), ('IMPORTS', '', 'd', 2), ('IMPORTS', '', 'pkg', 4), ('CALLS', '::Outer_#/Inner.run', 'pkg.T', 18), ('CALLS', '::Outer_#/Inner.run', 'go', 18), ('CALLS', '::Outer_#/Inner.run', '::Outer_#/Inner.run', 18),
('CALLS', '::Outer_#/Inner.run', 'e', 18), ('CALLS', '::outer', 'hidden', 28)) v(kind, source, target, line)""",
    over_graph=False,
)
def extract_shape_edges(g, spark, d):
    """Imports with aliases, calls by an imported alias, of an attribute, of a method of the same file, of a nested function."""
    return extract.edges_of(extract.parse_files(shape_files(spark, d))).select("kind", "source_qualified", "raw_target", "file_path", "line")


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'go' ELSE 'typescript' END AS language, CAST(count(*) AS BIGINT) AS files FROM nation GROUP BY 1 UNION ALL SELECT 'python', count(*) FROM region", over_graph=False)
def extract_dispatch(g, spark, d):
    """Files of three languages and of one that no backend reads, parsed together; the language of each."""
    even = F.expr("cast(regexp_extract(file_path, '([0-9]+)', 1) as int) % 2 = 0")
    go = go_files(spark, d).where(even & F.col("file_path").rlike("^geo/.*[0-9][.]go$"))
    ts = typescript_files(spark, d).where(~even & F.col("file_path").rlike("^web/nation_[0-9]+[.]ts$"))
    py = source_files(spark, d).where("startswith(file_path, 'geo/region')")
    odd = py.select(F.concat("file_path", F.lit(".txt")).alias("file_path"), "source")
    parsed = extract.parse_files(go.unionByName(ts).unionByName(py).unionByName(odd)).where("parse_error is null")
    return parsed.groupBy(X.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("files"))


@query(
    "SELECT 'geo/nation_' || n_nationkey || '.go' AS file_path, n_nationkey % 2 = 1 AS broken, CAST(1 AS INTEGER) AS symbols FROM nation UNION ALL SELECT 'web/nation_' || n_nationkey || '.ts', n_nationkey % 3 = 1, 1 FROM nation UNION ALL SELECT 'geo/region_' || r_regionkey || '.py', r_regionkey % 2 = 1, CASE WHEN r_regionkey % 2 = 1 THEN 0 ELSE 2 END FROM region",
    over_graph=False,
)
def extract_errors(g, spark, d):
    """Go files whose last bracket is cut off and TypeScript files with a piece of a function at the end (what can be read is kept), Python files that don't parse (nothing is), and whole ones."""
    key = F.regexp_extract("file_path", "([0-9]+)[.]", 1).cast("int")
    broken = lambda files, where, new: files.withColumn("source", F.when(where, new).otherwise(F.col("source")))
    go = broken(go_files(spark, d).where(F.col("file_path").rlike("^geo/.*[0-9][.]go$")), key % 2 == 1, F.regexp_replace("source", "[}]\\s*$", ""))
    ts = broken(typescript_files(spark, d).where(F.col("file_path").rlike("^web/nation_[0-9]+[.]ts$")), key % 3 == 1, F.concat("source", F.lit("function late(\n")))
    py = broken(source_files(spark, d).where("startswith(file_path, 'geo/region')"), key % 2 == 1, F.concat("source", F.lit("def (\n")))
    parsed = extract.parse_files(go.unionByName(ts).unionByName(py))
    return parsed.select("file_path", F.col("parse_error").isNotNull().alias("broken"), F.size("symbols").alias("symbols"))


@query("SELECT kind, source_qualified, target_qualified, file_path, CAST(line AS INTEGER) AS line FROM edges")
def resolve_bare_calls(g, spark, d):
    return resolve_calls(g.edges, g.nodes).select("kind", "source_qualified", "target_qualified", "file_path", "line")


@query("SELECT kind, source_qualified, target_qualified, file_path, CAST(line AS INTEGER) AS line FROM tested WHERE kind = 'TESTED_BY'")
def resolve_tests(g, spark, d):
    return resolve_calls(g.edges, g.nodes, ("CALLS", "TESTED_BY")).where("kind = 'TESTED_BY'").select("kind", "source_qualified", "target_qualified", "file_path", "line")


_PARTS = """
WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS name, 'lib/m' || (p_size % 7) || '/part_' || p_partkey || '.py' AS home FROM part),
calls AS (SELECT DISTINCT 'm' || (p_size % 7) AS hint, split_part(p_name, ' ', 1) AS name FROM part)
"""


def _part_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as symbols named by their first word, one file each in one of seven modules; a call of every (module, name)."""
    parts = _table(spark, d, "part").select("p_partkey", F.element_at(F.split("p_name", " "), 1).alias("name"), F.concat(F.lit("m"), F.col("p_size") % 7).alias("hint"))
    home = F.concat(F.lit("lib/"), F.col("hint"), F.lit("/part_"), F.col("p_partkey"), F.lit(".py"))
    nodes = parts.select("name", home.alias("file_path"), F.concat(home, F.lit("::"), "name").alias("qualified_name"))
    target = F.concat("hint", F.lit("."), "name")
    edge = parts.select("hint", "name").distinct().select(F.lit("CALLS").alias("kind"), F.concat(F.lit("user::"), target).alias("source_qualified"), target.alias("target_qualified"), target.alias("raw_target"), F.concat(F.lit("use_"), "hint", F.lit(".py")).alias("file_path"), F.lit(1).alias("line"))
    return nodes, edge, parts


@query(
    _PARTS
    + """, c AS (SELECT calls.hint, calls.name, count(p.name) AS n, count_if(contains(p.home, calls.hint)) AS nh, min(p.home) AS one, min(CASE WHEN contains(p.home, calls.hint) THEN p.home END) AS oneh FROM calls LEFT JOIN p ON p.name = calls.name GROUP BY ALL)
SELECT hint || '.' || name AS raw_target, CASE WHEN n = 1 THEN one || '::' || name WHEN nh = 1 THEN oneh || '::' || name ELSE hint || '.' || name END AS target_qualified FROM c""",
    over_graph=False,
)
def resolve_with_hint(g, spark, d):
    nodes, edge, _ = _part_graph(spark, d)
    return resolve_calls(edge, nodes).select("raw_target", "target_qualified")


@query(
    _PARTS
    + """, c AS (SELECT calls.hint, calls.name, count(p.name) AS n, count_if(p.p_partkey % 5 = 0) AS ni, min(p.home) AS one, min(CASE WHEN p.p_partkey % 5 = 0 THEN p.home END) AS onei FROM (SELECT DISTINCT 'm0' AS hint, name FROM calls) calls LEFT JOIN p ON p.name = calls.name GROUP BY ALL)
SELECT name AS raw_target, CASE WHEN n = 1 THEN one || '::' || name WHEN ni = 1 THEN onei || '::' || name ELSE name END AS target_qualified FROM c""",
    over_graph=False,
)
def resolve_via_imports(g, spark, d):
    """Bare names, and a caller whose imports are the parts with a key divisible by five."""
    nodes, _, parts = _part_graph(spark, d)
    edge = parts.select("name").distinct().select(F.lit("CALLS").alias("kind"), F.concat(F.lit("user::"), "name").alias("source_qualified"), F.col("name").alias("target_qualified"), F.col("name").alias("raw_target"), F.lit("use.py").alias("file_path"), F.lit(1).alias("line"))
    imported = nodes.where(F.regexp_extract("file_path", r"part_(\d+)", 1).cast("long") % 5 == 0)
    return resolve_calls(edge, nodes, imports=imported.select(F.lit("use.py").alias("file_path"), F.col("file_path").alias("imported"))).select("raw_target", "target_qualified")


# --- files, outlines, symbols ----------------------------------------------------------------------------------------


@query("SELECT file_path FROM files")
def files_list(g, spark, d):
    return lookup.list_files(g.files)


@query("SELECT file_path FROM files WHERE starts_with(file_path, 'geo/')")
def files_prefix(g, spark, d):
    return lookup.list_files(g.files, prefix="geo/")


@query("SELECT file_path FROM files WHERE file_path GLOB '*tion_1[0-4].p?'")
def files_glob(g, spark, d):
    return lookup.list_files(g.files, glob="*tion_1[0-4].p?")


_SUMMARY = "SELECT file_path, string_agg(signature, ' ; ' ORDER BY line_start, qualified_name) AS signatures FROM named WHERE parent_name IS NULL {} GROUP BY file_path"


@query(_SUMMARY.format(""))
def files_summary(g, spark, d):
    return lookup.summarize_files(g.nodes).select("file_path", F.array_join("signatures", " ; ").alias("signatures"))


@query(_SUMMARY.format("AND NOT regexp_matches(file_path, 'test_|tests/|test/|_test\\.|\\.test\\.|\\.spec\\.|conftest\\.py') AND NOT starts_with(name, '_') AND starts_with(file_path, 'supply/')"))
def files_summary_filtered(g, spark, d):
    return lookup.summarize_files(g.nodes, prefix="supply/", no_tests=True, no_private=True).select("file_path", F.array_join("signatures", " ; ").alias("signatures"))


@query("SELECT file_path, CAST(count(*) AS BIGINT) AS n_symbols, (SELECT CAST(count(*) AS BIGINT) FROM imports i WHERE i.file_path = named.file_path) AS n_imports FROM named GROUP BY file_path")
def file_records(g, spark, d):
    r = lookup.file_records(g.nodes, g.files)
    return r.select("file_path", F.size("symbols").cast("long").alias("n_symbols"), F.size("imports").cast("long").alias("n_imports"))


_OUTLINE = "SELECT name, kind, line_start AS line, signature, nullif(docstring, '') AS docstring, nullif(children, '') AS children, nullif(decorators, '') AS decorators FROM named WHERE file_path = '{}' {}"


def _outline(df: DataFrame) -> DataFrame:
    return df.select("name", "kind", "line", "signature", "docstring", F.array_join("children", "|").alias("children"), F.array_join("decorators", "|").alias("decorators"))


@query(_OUTLINE.format("crm/customer_1.py", ""))
def outline_full(g, spark, d):
    return _outline(lookup.outline(g.nodes, "crm/customer_1.py", depth="full"))


@query(_OUTLINE.format("supply/supplier_1.py", "AND parent_name IS NULL AND kind = 'function'"))
def outline_kind(g, spark, d):
    return _outline(lookup.outline(g.nodes, "supply/supplier_1.py", depth="top", kind="function"))


@query(f"SELECT {NAMED} FROM named WHERE name = 'nation_3'")
def locate_exact(g, spark, d):
    return lookup.locate(g.nodes, "nation_3").select("file_path", "name", "kind", "line", "signature", "docstring", "parent")


@query(f"SELECT {NAMED} FROM named WHERE contains(lower(name), 'omer_12') AND kind = 'class'")
def locate_substring(g, spark, d):
    return lookup.locate(g.nodes, "OMER_12", kind="class", match="substring", index=g.grams)


@query(f"SELECT {NAMED} FROM named WHERE name = 'locate' AND parent_name = 'Customer_7'")
def locate_path(g, spark, d):
    return lookup.locate(g.nodes, "Customer_7/locate")


@query(f"SELECT {NAMED} FROM named WHERE name = 'locate' AND parent_name IS NULL")
def locate_anchored(g, spark, d):
    return lookup.locate(g.nodes, "/locate")


@query(f"SELECT {NODE_COLUMNS} FROM named WHERE name = '_score' AND (parent_name = 'Customer_9' OR parent_name LIKE '%/Customer_9')")
def search_symbols(g, spark, d):
    return _flat(lookup.search_symbols(g.nodes, "Customer_9/_score"))


@query("SELECT qualified_name, line_start, line_end, CASE WHEN name = 'locate' THEN '    def locate(self):' || chr(10) || '        return nation_' || c_nationkey || '()' ELSE '    def _score(self):' || chr(10) || '        return ' || c_custkey END AS body FROM named JOIN customer ON file_path = 'crm/customer_' || c_custkey || '.py' WHERE kind = 'method'")
def body_slice(g, spark, d):
    return lookup.bodies(g.nodes.where("kind = 'method'"), g.sources).select("qualified_name", "line_start", "line_end", "body")


@query("SELECT doc_id, 'sha256:' || sha256(text)[1:16] AS content_hash FROM documents", over_graph=False)
def content_hash(g, spark, d):
    return _table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, substr(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), 1, 256) AS name FROM documents", over_graph=False)
def sanitize_names(g, spark, d):
    return _table(spark, d, "documents").select("doc_id", X.sanitize_name(F.col("text")).alias("name"))


@query("SELECT (SELECT CAST(count(*) AS BIGINT) FROM named) AS total_nodes, (SELECT CAST(count(*) AS BIGINT) FROM edges) AS total_edges, (SELECT CAST(count(*) AS BIGINT) FROM files) AS total_files")
def stats(g, spark, d):
    return lookup.stats(g.nodes, g.edges, g.files)


@query("SELECT DISTINCT n.qualified_name, n.kind FROM named n JOIN edges e ON e.target_qualified = n.qualified_name")
def nodes_by_names(g, spark, d):
    return lookup.nodes_named(g.nodes, g.edges.select(F.col("target_qualified").alias("qualified_name"))).select("qualified_name", "kind")


# --- search ----------------------------------------------------------------------------------------------------------

_SCORE = "CASE WHEN lower(name) = '{0}' THEN 100 WHEN starts_with(lower(name), '{0}') THEN 80 WHEN contains(lower(name), '{0}') THEN 60 WHEN contains(lower(coalesce(docstring, '')), '{0}') THEN 20 ELSE 0 END"


@query("SELECT * FROM (SELECT CAST(" + _SCORE.format("nation_1") + f" AS INTEGER) AS score, {NAMED} FROM named) WHERE score > 0 ORDER BY score DESC, file_path, line, name LIMIT 20")
def search_ranked(g, spark, d):
    return search.search(g.nodes, "Nation_1", index=g.grams)


@query("SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'the') AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'ing')", over_graph=False)
def search_all_words(g, spark, d):
    return search.search_text(_table(spark, d, "documents").select("doc_id", "text"), "The ing", ("text",), stemmed=False).select("doc_id")


@query(None, over_graph=False)
def search_stemmed(g, spark, d):
    return search.search_text(_table(spark, d, "documents").select("doc_id", "text"), "The ing", ("text",)).select("doc_id")


_HAS = "contains(' ' || array_to_string(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), ' ') || ' ', ' {} ')"


def _fts(*words: str) -> str:
    """Words that stemming leaves as they are, as phrases in one of the fields."""
    return " AND ".join("(" + " OR ".join(_HAS.format(f, w) for f in ("name", "qualified_name", "file_path")) + ")" for w in words)


@query(f"SELECT {NODE_COLUMNS} FROM named WHERE {_fts('customer 12', 'crm')} ORDER BY file_path, line_start, qualified_name LIMIT 20")
def search_fts_two_words(g, spark, d):
    return _flat(search.search_fts(g.nodes, "customer_12 CRM", index=g.postings))


@query(f"SELECT {NODE_COLUMNS} FROM named WHERE {_fts('nation 3')} ORDER BY file_path, line_start, qualified_name LIMIT 20")
def search_fts(g, spark, d):
    return _flat(search.search_fts(g.nodes, "nation_3", index=g.postings))


@query("SELECT qualified_name FROM named WHERE contains(lower(qualified_name), 'cust') AND (contains(lower(name), 'loc') OR contains(lower(qualified_name), 'loc'))")
def search_like(g, spark, d):
    return search.search_like(g.nodes, "Cust LOC", g.grams).select("qualified_name")


@query("SELECT 'name' AS field, CAST(count(*) AS BIGINT) AS n FROM named WHERE lower(name) LIKE 'nation\\_%' ESCAPE '\\'")
def postings_count(g, spark, d):
    return g.postings.where("token = 'nation' and field = 'name' and position = 0").agg(F.lit("name").alias("field"), F.count("*").alias("n"))


# --- usages, imports, analyses ----------------------------------------------------------------------------------------

_USES = """SELECT t.qualified_name AS target, e.file_path, CAST(e.line AS INTEGER) AS line, CASE WHEN e.kind = 'TESTED_BY' THEN 'test' ELSE 'reference' END AS kind, coalesce(s.signature, '') AS context
FROM named t JOIN tested e ON e.target_qualified IN (t.qualified_name, t.name) LEFT JOIN named s ON s.qualified_name = e.source_qualified WHERE e.kind IN ('CALLS', 'TESTED_BY') AND {}"""
_NATIONS = "t.kind = 'function' AND starts_with(t.file_path, 'geo/')"


def _uses(g: store.Graph, edges: DataFrame, keep: str, **how) -> DataFrame:
    return relations.usages(g.nodes, edges, g.nodes.where(keep), limit=None, **how)


@query(_USES.format("true"))
def usages_all(g, spark, d):
    return _uses(g, tested_edges(spark, d), "true")


@query(_USES.format(_NATIONS + " AND NOT starts_with(e.file_path, 'tests/')"))
def usages_no_tests(g, spark, d):
    return _uses(g, tested_edges(spark, d), "kind = 'function' and startswith(file_path, 'geo/')", include_tests=False)


@query(_USES.format(_NATIONS + " AND starts_with(e.file_path, 'supply/')"))
def usages_scoped(g, spark, d):
    return _uses(g, tested_edges(spark, d), "kind = 'function' and startswith(file_path, 'geo/')", scope="supply/")


@query(_USES.format(_NATIONS + " AND e.kind = 'TESTED_BY'"))
def usages_tests(g, spark, d):
    return _uses(g, tested_edges(spark, d), "kind = 'function' and startswith(file_path, 'geo/')", kind="test")


@query("SELECT file_path, module, resolved FROM imports WHERE resolved IS NOT NULL")
def imports_resolved(g, spark, d):
    """All imports, resolved anew from all paths, as a build does."""
    return relations.file_imports(g.files).where("resolved is not null").select("file_path", "module", "resolved")


@query("SELECT file_path, module, resolved FROM imports WHERE resolved IS NOT NULL")
def imports_forward(g, spark, d):
    return g.imports.where("resolved is not null").select("file_path", "module", "resolved")


@query("SELECT module, names, resolved IS NULL AS external FROM imports WHERE file_path = 'geo/nation_2.py'")
def imports_external(g, spark, d):
    return relations.imports_of(g.files, "geo/nation_2.py", include_external=True, stored=g.imports).select("module", F.array_join("names", "|").alias("names"), "external")


@query("SELECT resolved, file_path, module, names FROM imports WHERE resolved IS NOT NULL")
def imports_reverse(g, spark, d):
    return relations.imported_by(g.files, g.imports).select("resolved", "file_path", "module", F.array_join("names", "|").alias("names"))


_BLAST = """, u AS (SELECT DISTINCT a, b FROM (SELECT source_qualified AS a, target_qualified AS b FROM edges UNION ALL SELECT target_qualified, source_qualified FROM edges) WHERE a <> b),
seed AS (SELECT qualified_name AS s FROM named WHERE name LIKE 'region\\_%' ESCAPE '\\' {}),
h1 AS (SELECT DISTINCT s, b AS n FROM seed JOIN u ON u.a = s), h2 AS (SELECT DISTINCT s, b AS n FROM h1 JOIN u ON u.a = n), h3 AS (SELECT DISTINCT s, b AS n FROM h2 JOIN u ON u.a = n),
reached AS (SELECT s, n, min(d) AS depth FROM (SELECT s, n, 1 AS d FROM h1 UNION ALL SELECT s, n, 2 FROM h2 UNION ALL SELECT s, n, 3 FROM h3) WHERE n <> s GROUP BY s, n)
SELECT s AS seed, qualified_name, CAST(depth AS INTEGER) AS depth, kind, file_path FROM reached JOIN named ON n = qualified_name"""


def _blast(g: store.Graph, seeds: DataFrame) -> DataFrame:
    return reach.impact_radius(g.nodes, g.edges, seeds, 3, None, g.pairs).select("seed", "qualified_name", "depth", "kind", "file_path")


@query(_BLAST.format("AND name = 'region_0'"))
def blast_radius(g, spark, d):
    return _blast(g, g.nodes.where("name = 'region_0'").select(F.col("qualified_name").alias("seed")))


@query(_BLAST.format(""))
def blast_radius_all_regions(g, spark, d):
    return _blast(g, g.nodes.where("name like 'region\\_%'").select(F.col("qualified_name").alias("seed")))


@query(_BLAST.format("") + " QUALIFY row_number() OVER (PARTITION BY s ORDER BY depth, qualified_name) <= 20")
def blast_radius_limited(g, spark, d):
    """The nearest 20 nodes of each seed."""
    seeds = g.nodes.where("name like 'region\\_%'").select(F.col("qualified_name").alias("seed"))
    return reach.impact_radius(g.nodes, g.edges, seeds, 3, 20, g.pairs).select("seed", "qualified_name", "depth", "kind", "file_path")


_TESTS = """, start AS (SELECT * FROM named WHERE {0}), callers AS (SELECT qualified_name AS seed, qualified_name AS n, 0 AS d FROM start UNION ALL SELECT t.qualified_name, e.source_qualified, 1 FROM start t JOIN edges e ON e.target_qualified = t.qualified_name AND e.kind = 'CALLS'
UNION ALL SELECT t.qualified_name, f.source_qualified, 2 FROM start t JOIN edges e ON e.target_qualified = t.qualified_name AND e.kind = 'CALLS' JOIN edges f ON f.target_qualified = e.source_qualified AND f.kind = 'CALLS'),
tests AS (SELECT seed, t.source_qualified AS test, min(d) > 0 AS indirect FROM callers JOIN tested t ON t.target_qualified = n AND t.kind = 'TESTED_BY' GROUP BY ALL)"""


@query(
    _BLAST.split("SELECT s AS seed, qualified_name, CAST(depth")[0].format("")
    + _TESTS.format("name LIKE 'region\\_%' ESCAPE '\\'")
    + """, f AS (SELECT s AS seed, qualified_name, depth, file_path FROM reached JOIN named ON n = qualified_name)
SELECT seed, 'affected' AS part, qualified_name AS item, CAST(depth AS INTEGER) AS distance FROM f UNION ALL SELECT seed, 'file', file_path, CAST(min(depth) AS INTEGER) FROM f GROUP BY seed, file_path
UNION ALL SELECT seed, 'test', test, CAST(indirect AS INTEGER) FROM tests"""
)
def blast_radius_report(g, spark, d):
    """The composed command for all regions: affected nodes, their files, tests that reach the seed."""
    seeds = g.nodes.where("name like 'region\\_%'").select(F.col("qualified_name").alias("seed"))
    return reach.blast_report(g.nodes, tested_edges(spark, d), seeds, 3, 2, None, g.pairs)


@query(
    _TESTS.format("kind = 'function'")
    + " SELECT qualified_name AS seed, CAST(count(test) AS BIGINT) AS total_tests, CAST(coalesce(count_if(NOT indirect), 0) AS BIGINT) AS direct_tests, count(test) > 0 AS covered FROM named LEFT JOIN tests ON seed = qualified_name WHERE kind = 'function' GROUP BY 1"
)
def test_coverage_report(g, spark, d):
    return reach.coverage(g.nodes, tested_edges(spark, d), g.nodes.where("kind = 'function'").select(F.col("qualified_name").alias("seed")))


@query(
    """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations)
SELECT a.conv_id || ':0' AS seed, b.conv_id || ':' || b.turn AS node, CAST(b.turn AS INTEGER) AS depth FROM (SELECT DISTINCT conv_id FROM t WHERE turn = 0) a JOIN t b USING (conv_id) WHERE b.turn <= 3 AND (SELECT count(*) FROM t c WHERE c.conv_id = b.conv_id AND c.turn <= b.turn) = b.turn + 1""",
    over_graph=False,
)
def blast_radius_chain(g, spark, d):
    turns = _table(spark, d, "conversations").select("conv_id", "turn").distinct()
    name = lambda turn: F.concat("conv_id", F.lit(":"), turn)
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    pairs = turns.join(after, ["conv_id", "turn"], "left_semi").select(name(F.col("turn")).alias("a"), name(F.col("turn") + 1).alias("b"))
    start = turns.where("turn = 0").select(name(F.col("turn")).alias("seed"), name(F.col("turn")).alias("node"))
    return reach.reach(pairs, start, 3).select("seed", "node", "depth")


_DEAD = """SELECT qualified_name, file_path, line_start FROM named n WHERE kind IN ('function', 'method') AND NOT regexp_matches(name, '^(handle_|on_|test_)') AND NOT (starts_with(name, '__') AND ends_with(name, '__')) AND NOT starts_with(file_path, 'tests/') AND NOT contains(file_path, '/test_')
AND NOT contains(decorators, 'app.route') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'CALLS' AND e.target_qualified = n.qualified_name) {}"""


@query(_DEAD.format("AND name <> 'main'"))
def dead_code(g, spark, d):
    return relations.dead_code(g.nodes, g.edges).select("qualified_name", "file_path", "line_start")


_RULES = ("test_x", "__init__", "handle_x", "on_x", "setUp", "main", "constructor", "plain", "caller", "__odd", "cli", "register", "plain_too")


def _rule_sql(column: str) -> str:
    return "CASE p_partkey % 13 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_RULES)) + f" END AS {column}"


@query(
    f"""WITH p AS (SELECT p_partkey AS k, {_rule_sql('name')}, CASE p_partkey % 5 WHEN 0 THEN 'lib/m.py' WHEN 1 THEN 'tests/m.py' WHEN 2 THEN 'lib/test_m.py' WHEN 3 THEN 'lib/conftest.py' ELSE 'src/m.py' END AS file_path,
CASE p_partkey % 3 WHEN 0 THEN 'cached' WHEN 1 THEN 'app.route(1)' ELSE '' END AS decorator, p_partkey % 7 = 0 AS called, CASE p_partkey % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'class' ELSE 'function' END AS kind FROM part)
SELECT file_path || '::' || name || '_' || k AS qualified_name FROM p WHERE kind <> 'class' AND name IN ('plain', 'caller', '__odd', 'plain_too') AND file_path IN ('lib/m.py', 'src/m.py') AND decorator <> 'app.route(1)' AND NOT called""",
    over_graph=False,
)
def dead_code_rules(g, spark, d):
    """Each rule of the analysis over nodes made of part: names, prefixes, test files, decorators, kinds, calls."""
    part = _table(spark, d, "part")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % n + 1).cast("int"))
    name, home = pick(_RULES, 13), pick(("lib/m.py", "tests/m.py", "lib/test_m.py", "lib/conftest.py", "src/m.py"), 5)
    nodes = part.select(
        pick(("method", "class", "function", "function"), 4).alias("kind"), name.alias("name"), F.concat(home, F.lit("::"), name, F.lit("_"), "p_partkey").alias("qualified_name"), home.alias("file_path"),
        F.col("p_partkey").cast("int").alias("line_start"), F.filter(F.array(pick(("cached", "app.route(1)", ""), 3)), lambda x: x != "").alias("decorators"), "p_partkey",
    )
    edges = nodes.where("p_partkey % 7 = 0").select(F.lit("CALLS").alias("kind"), F.col("qualified_name").alias("target_qualified"))
    return relations.dead_code(nodes, edges).select("qualified_name")


@query(_DEAD.format("AND file_path = 'supply/supplier_2.py'"))
def dead_code_file(g, spark, d):
    return relations.dead_code(g.nodes, g.edges, "supply/supplier_2.py").select("qualified_name", "file_path", "line_start")


@query("SELECT t.target_qualified AS seed, t.source_qualified AS qualified_name, false AS indirect FROM tested t WHERE t.kind = 'TESTED_BY'")
def test_coverage_direct(g, spark, d):
    return reach.transitive_tests(g.nodes, tested_edges(spark, d), g.nodes.select(F.col("qualified_name").alias("seed")), 0).select("seed", "qualified_name", "indirect")


@query("SELECT DISTINCT e.target_qualified AS seed, t.source_qualified AS qualified_name, true AS indirect FROM edges e JOIN tested t ON t.target_qualified = e.source_qualified WHERE e.kind = 'CALLS' AND t.kind = 'TESTED_BY' AND starts_with(e.target_qualified, 'geo/region')")
def test_coverage_transitive(g, spark, d):
    return reach.transitive_tests(g.nodes, tested_edges(spark, d), g.nodes.where("name like 'region\\_%'").select(F.col("qualified_name").alias("seed")), 2).select("seed", "qualified_name", "indirect")


# --- overview ---------------------------------------------------------------------------------------------------------


@query("SELECT regexp_extract(file_path, '^.*/') AS directory, CAST(count(DISTINCT file_path) AS BIGINT) AS files, CAST(count_if(kind = 'class') AS BIGINT) AS classes, CAST(count_if(kind IN ('function', 'method')) AS BIGINT) AS functions FROM named WHERE NOT starts_with(file_path, 'tests/') GROUP BY 1")
def overview_structure(g, spark, d):
    return relations.overview_structure(g.nodes)


@query("SELECT n.file_path, CAST(count(*) AS BIGINT) AS importance FROM named n JOIN edges e ON e.target_qualified = n.qualified_name GROUP BY 1 ORDER BY importance DESC, n.file_path LIMIT 7")
def overview_key_files(g, spark, d):
    return relations.key_files(g.nodes, g.edges).select("file_path", "importance")


@query(
    """SELECT * FROM (SELECT n.file_path, CAST(count(*) AS BIGINT) AS importance FROM named n JOIN edges e ON e.target_qualified = n.qualified_name GROUP BY 1 ORDER BY importance DESC, n.file_path LIMIT 7) k JOIN
(SELECT file_path, coalesce(array_to_string((list(name ORDER BY line_start, name) FILTER (kind = 'class'))[1:5], '|'), '') AS classes, coalesce(array_to_string((list(name ORDER BY line_start, name) FILTER (kind = 'function' AND NOT starts_with(name, '_')))[1:5], '|'), '') AS functions FROM named GROUP BY 1) USING (file_path)"""
)
def overview_key_members(g, spark, d):
    joined = lambda c: F.array_join(c, "|").alias(c)
    return relations.key_files(g.nodes, g.edges).select("file_path", "importance", joined("classes"), joined("functions"))


@query("SELECT file_path, name AS symbol FROM named WHERE name IN ('main', '__main__', 'create_app', 'app', 'cli', 'run', 'start') ORDER BY file_path LIMIT 5")
def overview_entry_points(g, spark, d):
    return relations.entry_points(g.nodes)


@query("SELECT DISTINCT CASE WHEN ends_with(file_path, '.py') THEN 'python' END AS language FROM named")
def overview_languages(g, spark, d):
    return relations.languages(g.nodes)


@query("SELECT unnest(['go', 'python', 'typescript']) AS language", over_graph=False)
def overview_languages_mixed(g, spark, d):
    return relations.languages(graph(spark, d).nodes.unionByName(other_graph(spark, d, "go").nodes).unionByName(other_graph(spark, d, "typescript").nodes))


@query("SELECT CAST(count(*) AS BIGINT) AS total_files, (SELECT CAST(count(*) AS BIGINT) FROM named) AS total_symbols, (SELECT CAST(count(*) AS BIGINT) FROM edges) AS total_edges, CAST(count_if(starts_with(file_path, 'tests/')) AS BIGINT) AS test_files, CAST(count_if(NOT starts_with(file_path, 'tests/')) AS BIGINT) AS source_files FROM files")
def overview_totals(g, spark, d):
    return relations.overview_totals(g.nodes, g.edges)


# --- maintenance and edits ----------------------------------------------------------------------------------------------


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files, and a later state: every seventh gone, every fifth changed, every eleventh new."""
    docs = _table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), "doc_id").alias("file_path"), F.col("text").alias("source"))
    old = docs.where("doc_id % 11 <> 0")
    new = docs.where("doc_id % 7 <> 0").withColumn("source", F.when(F.col("doc_id") % 5 == 0, F.concat("source", F.lit("!"))).otherwise(F.col("source")))
    return old.drop("doc_id"), new.drop("doc_id")


@query(
    """SELECT 'doc/' || doc_id AS file_path, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'same' END AS status FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 7 = 0)""",
    over_graph=False,
)
def refresh_diff(g, spark, d):
    old, new = _versions(spark, d)
    return store.diff(store.hashes(old), store.hashes(new))


@query("SELECT 'doc/' || doc_id AS file_path, 'sha256:' || sha256(text || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END)[1:16] AS content_hash FROM documents WHERE doc_id % 7 <> 0", over_graph=False)
def refresh_apply(g, spark, d):
    old, new = _versions(spark, d)
    a, b = store.hashes(old), store.hashes(new)
    change = store.diff(a, b).where("status <> 'same'")
    return store.replace_files(a, change, b.join(change, "file_path", "left_semi"))


@query("SELECT file_path, CAST(count(*) AS BIGINT) AS n FROM named WHERE NOT starts_with(file_path, 'supply/') GROUP BY 1 UNION ALL SELECT 'supply/supplier_1.py', 1")
def refresh_graph(g, spark, d):
    """The graph after all supplier files but one are gone, and that one is rewritten: only it is parsed."""
    sources = g.sources.where("not startswith(file_path, 'supply/') or file_path = 'supply/supplier_1.py'")
    sources = sources.withColumn("source", F.when(F.col("file_path") == "supply/supplier_1.py", "def alone():\n    pass\n").otherwise(F.col("source")))
    return store.refresh(g, sources).nodes.groupBy("file_path").agg(F.count("*").alias("n"))


_refreshed: dict[tuple, store.Graph] = {}


def _saved_refresh(spark: SparkSession, d: str) -> store.Graph:
    """The geo files, stored in four buckets; then every fifth nation goes, regions get a function more, and only that is written; what a reader then loads."""
    key = _state(spark, d)
    if key not in _refreshed:
        place, files = f"{shared_folder(spark)}/refreshed-{uuid.uuid4().hex}", source_files(spark, d).where("startswith(file_path, 'geo/')")
        number, region = F.regexp_extract("file_path", "([0-9]+)", 1), F.col("file_path").startswith("geo/region")
        store.save(spark, store.build(files, keep=_cut), place, "geo", buckets=4)
        later = files.where(region | (number.cast("int") % 5 != 0))
        later = later.withColumn("source", F.when(region, F.concat("source", F.lit("\n\ndef extra_"), number, F.lit("():\n    return 0\n"))).otherwise(F.col("source")))
        store.save(spark, store.refresh(store.load(spark, place), later, keep=_cut), place, "geo")
        _refreshed[key] = store.load(spark, place)
    return _refreshed[key]


_LATER = "starts_with(file_path, 'geo/') AND (starts_with(file_path, 'geo/region') OR CAST(regexp_extract(file_path, '([0-9]+)', 1) AS INTEGER) % 5 <> 0)"


@query(f"SELECT file_path, name, kind FROM named WHERE {_LATER} UNION ALL SELECT 'geo/region_' || r_regionkey || '.py', 'extra_' || r_regionkey, 'function' FROM region", stored=False)
def store_refreshed_nodes(g, spark, d):
    return _saved_refresh(spark, d).nodes.select("file_path", "name", "kind")


@query(f"SELECT kind, source_qualified, target_qualified, CAST(line AS INTEGER) AS line FROM edges WHERE {_LATER}", stored=False)
def store_refreshed_edges(g, spark, d):
    return _saved_refresh(spark, d).edges.select("kind", "source_qualified", "target_qualified", "line")


@query(f"SELECT DISTINCT a, b FROM (SELECT source_qualified AS a, target_qualified AS b FROM edges WHERE {_LATER} UNION ALL SELECT target_qualified, source_qualified FROM edges WHERE {_LATER}) WHERE a <> b", stored=False)
def store_refreshed_pairs(g, spark, d):
    """The stored pairs of neighbours after a refresh (a bucket may repeat a pair of another)."""
    return _saved_refresh(spark, d).pairs.select("a", "b").distinct()


@query(
    f"SELECT gram, field, file_path FROM (SELECT DISTINCT unnest(list_transform(range(1, len(x) - 1), lambda i: substr(x, i, 3))) AS gram, field, file_path FROM (SELECT file_path, 'name' AS field, lower(name) AS x FROM named WHERE {_LATER} UNION ALL SELECT 'geo/region_' || r_regionkey || '.py', 'name', 'extra_' || r_regionkey FROM region))",
    stored=False,
)
def store_refreshed_grams(g, spark, d):
    """The stored runs of the names after a refresh."""
    return _saved_refresh(spark, d).grams.where("field = 'name'").select("gram", "field", "file_path")


@query(f"SELECT file_path, module, resolved FROM imports WHERE {_LATER}", stored=False)
def store_refreshed_imports(g, spark, d):
    """The stored imports after a refresh, with the files that they mean."""
    return _saved_refresh(spark, d).imports.select("file_path", "module", "resolved")


@query(f"SELECT (SELECT CAST(count(*) AS BIGINT) FROM named WHERE {_LATER}) + (SELECT count(*) FROM region) AS total_nodes, (SELECT CAST(count(*) AS BIGINT) FROM edges WHERE {_LATER}) AS total_edges, (SELECT CAST(count(*) AS BIGINT) FROM files WHERE {_LATER}) AS total_files", stored=False)
def store_totals(g, spark, d):
    """Totals of a refreshed graph from the counts that the refresh kept: no table is read."""
    found = store.totals(_saved_refresh(spark, d))
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{c} long" for c in found))


_written: dict[tuple, store.Graph] = {}


def _two_writers(spark: SparkSession, d: str) -> store.Graph:
    """The region files, changed by two writers that began from the same state: one adds nations, the other a function to each region; the slower one is refused and tries again."""
    key = _state(spark, d)
    if key not in _written:
        place, files = f"{shared_folder(spark)}/writers-{uuid.uuid4().hex}", source_files(spark, d)
        regions, nations = files.where("startswith(file_path, 'geo/region')"), files.where("startswith(file_path, 'geo/nation')")
        store.save(spark, store.build(regions, keep=_cut), place, "geo", buckets=4)
        number = F.regexp_extract("file_path", "([0-9]+)", 1)
        more = regions.withColumn("source", F.concat("source", F.lit("\n\ndef extra_"), number, F.lit("():\n    return 0\n")))
        turns: list[int] = []

        def slower(old: store.Graph) -> store.Graph:
            turns.append(1)
            if len(turns) == 1:  # while this one is at work, the other one is done
                store.update(spark, place, lambda g: store.refresh(g, g.sources.unionByName(nations), keep=_cut), "geo")
            return store.refresh(old, old.sources.join(more, "file_path", "left_anti").unionByName(more), keep=_cut)

        store.update(spark, place, slower, "geo")
        if len(turns) != 2:
            raise RuntimeError("the second writer was not refused")
        _written[key] = store.load(spark, place)
    return _written[key]


@query("SELECT file_path, name, kind FROM named WHERE starts_with(file_path, 'geo/') UNION ALL SELECT 'geo/region_' || r_regionkey || '.py', 'extra_' || r_regionkey, 'function' FROM region", stored=False)
def store_two_writers(g, spark, d):
    return _two_writers(spark, d).nodes.select("file_path", "name", "kind")


@query("SELECT kind, source_qualified, target_qualified, CAST(line AS INTEGER) AS line FROM edges WHERE starts_with(file_path, 'geo/')", stored=False)
def store_two_writers_edges(g, spark, d):
    return _two_writers(spark, d).edges.select("kind", "source_qualified", "target_qualified", "line")


@query("SELECT file_path, name FROM named WHERE starts_with(file_path, 'app/') OR (starts_with(file_path, 'geo/nation') AND CAST(regexp_extract(file_path, '([0-9]+)', 1) AS INTEGER) % 3 = 0)", stored=False)
def store_load_or_build(g, spark, d):
    """Built at the first call (app and nation files), refreshed by the second, when two thirds of the nations are gone."""
    place = f"{shared_folder(spark)}/loaded-{uuid.uuid4().hex}"
    files = source_files(spark, d).where("startswith(file_path, 'app/') or startswith(file_path, 'geo/nation')")
    store.load_or_build_from(spark, files, place)
    kept = files.where("startswith(file_path, 'app/') or cast(regexp_extract(file_path, '([0-9]+)', 1) as int) % 3 = 0")
    return store.load_or_build_from(spark, kept, place).nodes.select("file_path", "name")


@query("SELECT kind, source_qualified, target_qualified, file_path, CAST(line AS INTEGER) AS line FROM edges WHERE starts_with(file_path, 'app/') OR starts_with(file_path, 'geo/')", stored=False)
def store_migrated_edges(g, spark, d):
    """A graph of the first layout, whole tables in which every edge stands twice, brought to the present one."""
    place, name = f"{shared_folder(spark)}/migrated-{uuid.uuid4().hex}", "snapshot-first"
    made = store.build(source_files(spark, d).where("startswith(file_path, 'app/') or startswith(file_path, 'geo/')"), keep=_cut)
    for table, rows in {"nodes": made.nodes, "edges": made.edges.unionByName(made.edges), "files": made.files, "sources": made.sources}.items():
        rows.write.parquet(f"{place}/{name}/{table}")
    spark.createDataFrame([("schema_version", "1"), ("project_root", "geo")], "key string, value string").write.parquet(f"{place}/{name}/metadata")
    store._overwrite(spark, f"{place}/CURRENT", name)
    store.migrate(spark, place)
    return store.load(spark, place).edges.select("kind", "source_qualified", "target_qualified", "file_path", "line")


_CHAIN = """WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part), f AS (SELECT k, 'lib/f' || k || '.py' AS here, 'n' || (k % 5) AS name FROM p),
own AS (SELECT here, name, CAST(k % 100 AS INTEGER) AS line, here || '::' || name AS q FROM f WHERE k % 4 = 0),
named AS (SELECT a.here, a.name, b.here AS next FROM f a JOIN f b ON b.k = a.k // 2 WHERE a.k % 4 <> 0 AND a.k % 3 <> 0),
stars AS (SELECT a.here, b.here AS next FROM f a JOIN f b ON b.k = a.k // 3 WHERE a.k % 3 = 0 UNION SELECT a.here, b.here FROM f a JOIN f b ON b.k = CASE a.k % 7 WHEN 3 THEN a.k + 1 WHEN 4 THEN a.k - 1 END),
walk AS (SELECT here AS file_path, name, here, [here] AS path FROM f
  UNION ALL SELECT w.file_path, w.name, s.next, list_append(w.path, s.next) FROM walk w JOIN (SELECT here, name, next FROM named UNION ALL SELECT s.here, n.name, s.next FROM stars s CROSS JOIN (SELECT DISTINCT name FROM f) n ANTI JOIN named m ON m.here = s.here AND m.name = n.name) s ON s.here = w.here AND s.name = w.name
  WHERE NOT list_contains(w.path, s.next) AND NOT EXISTS (SELECT 1 FROM own o WHERE o.here = w.here AND o.name = w.name)),
ends AS (SELECT w.file_path, w.name, o.q, CAST(len(w.path) - 1 AS INTEGER) AS hops, row_number() OVER (PARTITION BY w.file_path, w.name ORDER BY len(w.path), o.here, o.line) AS r FROM walk w JOIN own o ON o.here = w.here AND o.name = w.name)
SELECT f.here AS file_path, f.name, e.q AS qualified_name, e.hops FROM f LEFT JOIN ends e ON e.file_path = f.here AND e.name = f.name AND e.r = 1"""


@query(_CHAIN, over_graph=False)
def definition_lookup(g, spark, d):
    """Files made of part that pass names on, by name and by star imports, some in circles; every file asks for a name."""
    part = _table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    path = lambda k: F.concat(F.lit("lib/f"), k.cast("string"), F.lit(".py"))
    name, k = F.concat(F.lit("n"), (F.col("k") % 5).cast("string")), F.col("k")
    nodes = part.where("k % 4 = 0").select(path(k).alias("file_path"), name.alias("name"), F.concat(path(k), F.lit("::"), name).alias("qualified_name"), (k % 100).cast("int").alias("line_start"), F.lit(None).cast("string").alias("parent_name"))
    known = part.select(path(k).alias("resolved"))
    bring = lambda rows, to, what: rows.select(path(k).alias("file_path"), F.lit(0).alias("at"), F.array(what).alias("names"), path(to).alias("resolved")).join(shuffled(known), "resolved")
    imports = bring(part.where("k % 4 <> 0 and k % 3 <> 0"), F.floor(k / 2), name).unionByName(bring(part.where("k % 3 = 0"), F.floor(k / 3), F.lit("*")))
    imports = imports.unionByName(bring(part.where("k % 7 in (3, 4)"), F.when(k % 7 == 3, k + 1).otherwise(k - 1), F.lit("*")))
    return definitions.definitions(nodes, imports, part.select(path(k).alias("file_path"), name.alias("name")))


@query("SELECT 'region_' || r_regionkey AS key, CASE WHEN r_regionkey = 1 THEN 'put' ELSE r_name END AS value FROM region UNION ALL SELECT 'new', 'put'", over_graph=False)
def store_metadata(g, spark, d):
    table = _table(spark, d, "region").select(F.concat(F.lit("region_"), "r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return store.put_metadata(table, region_1="put", new="put")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1", over_graph=False)
def upsert_nodes(g, spark, d):
    rows = _table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("ord"), "event_id", "value")
    return extract.upsert(rows, ["user_id", "event_type"], "ord").drop("ord")


@query("SELECT DISTINCT event_type AS kind, 'u' || user_id AS source_qualified, CAST(user_id % 10 AS VARCHAR) AS target_qualified, 'f' AS file_path, CAST(event_id % 3 AS INTEGER) AS line FROM events", over_graph=False)
def dedupe_edges(g, spark, d):
    e = _table(spark, d, "events")
    rows = e.select(F.col("event_type").alias("kind"), F.concat(F.lit("u"), "user_id").alias("source_qualified"), (F.col("user_id") % 10).cast("string").alias("target_qualified"), F.lit("f").alias("file_path"), (F.col("event_id") % 3).cast("int").alias("line"))
    return extract.dedupe_edges(rows)


_LINES = "WITH l AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10)) AS lines, CASE WHEN text = '' THEN [] ELSE lines END AS x, coalesce(regexp_extract(x[1], '^\\s*'), '') AS i FROM documents) "


def _edit_rows(spark: SparkSession, d: str, code: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("source"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit("new one\n  inner").alias(code))


@query(_LINES + "SELECT CAST(doc_id AS VARCHAR) AS file_path, CASE WHEN x IS NOT NULL THEN sha256(array_to_string(list_concat([i || 'new one', i || '  inner'], x[2:]), chr(10)) || chr(10)) END AS sha, 1 AS lines_removed, 2 AS lines_added FROM l", over_graph=False)
def replace_body(g, spark, d):
    return edits.replace_body(_edit_rows(spark, d, "new_body")).select("file_path", F.sha2("source", 256).alias("sha"), "lines_removed", "lines_added")


@query(
    _LINES
    + "SELECT CAST(doc_id AS VARCHAR) AS file_path, CASE WHEN x IS NOT NULL THEN sha256(array_to_string(CASE WHEN len(x) > 1 AND trim(x[2]) = '' THEN list_concat(x[1:2], list_concat([i || 'new one', i || '  inner'], x[3:])) ELSE list_concat(x[1:1], list_concat(['', i || 'new one', i || '  inner'], x[2:])) END, chr(10)) || chr(10)) END AS sha FROM l",
    over_graph=False,
)
def insert_symbol(g, spark, d):
    return edits.insert_symbol(_edit_rows(spark, d, "new_code"), "after").select("file_path", F.sha2("source", 256).alias("sha"))


@query(
    _LINES
    + "SELECT CAST(doc_id AS VARCHAR) AS file_path, CASE WHEN x IS NOT NULL THEN sha256(array_to_string(list_concat([i || 'new one', i || '  inner', ''], x), chr(10)) || chr(10)) END AS sha, 3 AS lines_added FROM l",
    over_graph=False,
)
def insert_symbol_before(g, spark, d):
    return edits.insert_symbol(_edit_rows(spark, d, "new_code"), "before").select("file_path", F.sha2("source", 256).alias("sha"), "lines_added")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS holds FROM documents", over_graph=False)
def hash_guard(g, spark, d):
    """Edits planned on the present state, on another one, and without an expectation."""
    docs = _table(spark, d, "documents")
    other = F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat("text", F.lit("!")), 256), 1, 16))
    expected = F.when(F.col("doc_id") % 3 == 0, X.content_hash(F.col("text"))).when(F.col("doc_id") % 3 == 1, other)
    return docs.select("doc_id", edits.hash_holds(F.col("text"), expected).alias("holds"))


# --- benchmarks --------------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id AS id, CASE WHEN d.doc_id % 2 = 0 THEN contains(text, 'the') AND contains(text, 'ing') ELSE contains(text, 'que') OR contains(text, 'ung') END AS correct FROM documents d", over_graph=False)
def rubric_eval(g, spark, d):
    docs = _table(spark, d, "documents")
    outputs = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("output"))
    even = F.col("doc_id") % 2 == 0
    rubrics = docs.select(F.col("doc_id").alias("id"), F.when(even, "must-contain").otherwise("must-contain-any").alias("type"), F.when(even, F.array(F.lit("the"), F.lit("ing"))).otherwise(F.array(F.lit("que"), F.lit("ung"))).alias("items"))
    return bench.rubric_table(outputs, rubrics)


@query("SELECT file_path AS id, CASE WHEN starts_with(file_path, 'crm/') THEN bool_or(name = 'locate' AND kind = 'method') ELSE count(*) >= 3 END AS correct FROM named GROUP BY file_path")
def rubric_eval_rows(g, spark, d):
    """exact-match and min-count over the symbols of each file."""
    row = F.create_map(F.lit("name"), "name", F.lit("kind"), "kind")
    outputs = g.nodes.groupBy(F.col("file_path").alias("id")).agg(F.collect_list(row).alias("rows"))
    exact = F.col("id").startswith("crm/")
    wanted = F.create_map(F.lit("name"), F.lit("locate"), F.lit("kind"), F.lit("method"))
    return bench.rubric_table(outputs, outputs.select("id", F.when(exact, "exact-match").otherwise("min-count").alias("type"), wanted.alias("expected"), F.lit(3).alias("min_results")))


@query("SELECT l.doc_id AS id, CAST(n_chars - 100 * quality AS BIGINT) AS byte_delta, CASE WHEN quality = 1 AND toxic = 0 THEN 'REGRESSION' WHEN quality = 0 AND toxic = 1 THEN 'FIXED' ELSE 'same' END AS verdict FROM labels l JOIN documents d ON d.doc_id = l.doc_id", over_graph=False)
def baseline_compare(g, spark, d):
    labels, docs = _table(spark, d, "labels"), _table(spark, d, "documents")
    now = labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("output_bytes"), (F.col("toxic") == 1).alias("correct"))
    base = labels.select(F.col("doc_id").alias("id"), (100 * F.col("quality")).cast("long").alias("output_bytes"), (F.col("quality") == 1).alias("correct"))
    return bench.compare(now, base)
