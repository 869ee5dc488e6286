"""Synthetic code bases made from the test tables, so that every graph query has rows that SQL can predict.

Each row of region, nation, customer and supplier becomes a Python file; even nations get a test file, regions an entry point. Others become Go and TypeScript files. Built by
column expressions.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(rows: DataFrame, path: str, body: list[str]) -> DataFrame:
    """One file per row; {column} in path and lines stands for the row's value, a doubled brace for itself."""

    def fill(text: str):
        parts = []
        for literal, column, *_ in Formatter().parse(text):
            parts.append(F.lit(literal))
            if column:
                parts.append(F.col(column).cast("string"))
        return F.concat(*parts)

    return rows.select(fill(path).alias("file_path"), fill("\n".join(body) + "\n").alias("source"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, source) of the synthetic code base."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    region, nation = read("region"), read("nation")
    geo = _files(region, "geo/region_{r_regionkey}.py", ['"""Region file."""', "LIMIT_{r_regionkey} = {r_regionkey}", "", "", "def region_{r_regionkey}():", '    """Region {r_name}."""', "    return LIMIT_{r_regionkey}"])
    nations = _files(
        nation,
        "geo/nation_{n_nationkey}.py",
        ["import os", "from geo.region_{n_regionkey} import region_{n_regionkey}", "", "", "def nation_{n_nationkey}(scale: int = 1) -> int:", '    """Nation {n_name}."""', "    return region_{n_regionkey}() * scale"],
    )
    apps = _files(region, "app/main_{r_regionkey}.py", ["from geo.region_{r_regionkey} import region_{r_regionkey}", "", "", "def main():", "    return region_{r_regionkey}()", "", "", "def locate():", "    return {r_regionkey}"])
    tests = _files(nation.where("n_nationkey % 2 = 0"), "tests/test_nation_{n_nationkey}.py", ["from geo.nation_{n_nationkey} import nation_{n_nationkey}", "", "", "def test_nation_{n_nationkey}():", "    assert nation_{n_nationkey}()"])
    customers = _files(
        read("customer"),
        "crm/customer_{c_custkey}.py",
        ["from geo.nation_{c_nationkey} import nation_{c_nationkey}", "", "", "class Customer_{c_custkey}:", '    """Segment {c_mktsegment}."""', "", "    def locate(self):", "        return nation_{c_nationkey}()", "", "    def _score(self):", "        return {c_custkey}"],
    )
    suppliers = _files(
        read("supplier"),
        "supply/supplier_{s_suppkey}.py",
        ["from geo import nation_{s_nationkey}", "import json", "", "", '@app.route("/supplier/{s_suppkey}")', "def serve_{s_suppkey}(request, *args, **kwargs):", "    return nation_{s_nationkey}.nation_{s_nationkey}()", "", "", "def handle_{s_suppkey}(event):", "    return event", "", "", "def orphan_{s_suppkey}():", "    return json.dumps({s_suppkey})"],
    )
    return geo.unionByName(apps).unionByName(nations).unionByName(tests).unionByName(customers).unionByName(suppliers)


def go_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, source) of a Go code base: a file per supplier and nation, tests of the even nations."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation")
    nations = _files(nation, "geo/nation_{n_nationkey}.go", ["package geo", "", 'import "strings"', "", "// Name of a nation.", "func Name_{n_nationkey}() string {{", '\treturn strings.ToLower("{n_name}")', "}}"])
    tests = _files(nation.where("n_nationkey % 2 = 0"), "geo/nation_{n_nationkey}_test.go", ["package geo", "", 'import "testing"', "", "func TestName_{n_nationkey}(t *testing.T) {{", "\tName_{n_nationkey}()", "}}", "", "func helper_{n_nationkey}() {{", "\tName_{n_nationkey}()", "}}"])
    suppliers = _files(
        read("supplier"),
        "svc/supplier_{s_suppkey}.go",
        [
            "package svc", "", "import (", '\t"fmt"', '\t"example.com/geo"', ")", "", "// Limit of one.", "const Limit_{s_suppkey} = {s_suppkey}", "",
            "type Supplier_{s_suppkey} struct {{", "\tID int", "}}", "", "type Greeter_{s_suppkey} interface {{", "\tGreet() string", "}}", "",
            "// Make one.", "func New_{s_suppkey}(id int) *Supplier_{s_suppkey} {{", "\treturn &Supplier_{s_suppkey}{{ID: id}}", "}}", "",
            "func (s *Supplier_{s_suppkey}) Greet() string {{", "\tother := New_{s_suppkey}(s.ID)", "\treturn fmt.Sprint(other.ID, geo.Name_{s_nationkey}())", "}}",
        ],
    )
    return nations.unionByName(tests).unionByName(suppliers)


def typescript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, source) of a TypeScript code base: a file per customer and nation, tests of the even nations."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation")
    nations = _files(nation, "web/nation_{n_nationkey}.ts", ["/** Nation {n_name}. */", "export function nation_{n_nationkey}(id: number): string {{", "  return String(id);", "}}"])
    tests = _files(nation.where("n_nationkey % 2 = 0"), "web/nation_{n_nationkey}.test.ts", ["import {{ nation_{n_nationkey} }} from './nation_{n_nationkey}';", "", "function testNation_{n_nationkey}(): void {{", "  nation_{n_nationkey}(1);", "}}"])
    customers = _files(
        read("customer"),
        "web/customer_{c_custkey}.tsx",
        [
            "import {{ nation_{c_nationkey}, other as more }} from './nation_{c_nationkey}';", "import * as fs from 'fs';", "",
            "/** Segment {c_mktsegment}. */", "export class Customer_{c_custkey} extends Base {{", "  /** Loads it. */", "  load(id: number): string {{", "    return nation_{c_nationkey}(id);", "  }}", "",
            "  private save_{c_custkey}(): void {{", "    fs.write(this.load({c_custkey}));", "  }}", "}}", "",
            "export interface View_{c_custkey} {{", "  id: number;", "}}", "", 'export type Kind_{c_custkey} = "a" | "b";', "", "export const MAX_{c_custkey} = {c_custkey};", "",
            "export const show_{c_custkey} = (x: number): string => {{", "  return nation_{c_nationkey}(x);", "}};",
        ],
    )
    return nations.unionByName(tests).unionByName(customers)


def shape_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, source): a Python file per region with every shape of symbol, parameter and import."""
    body = [
        '"""Shapes."""', "import a.b as c, d", "from . import near", "from .pkg import Thing as T, Other", "",
        "LIMIT: int = {r_regionkey}", "LEFT = RIGHT = {r_regionkey}", "", "",
        "@decorate({r_regionkey})", "class Outer_{r_regionkey}(Base, meta.Kind):", '    """' + "x" * 210 + '"""', "", "    field: int = 0", "",
        "    class Inner:", "        async def run(self, a, /, b: int = 1, *args: str, c, d='x', **kw) -> list[int]:", "            return T(), near.go(), self.run(), d.e()", "",
        "        @property", "        def size(self):", "            return 0", "", "",
        "def outer(x=[1, 2], *, y):", "    def hidden():", "        pass", "    return hidden()",
    ]
    return _files(spark.read.parquet(f"{sf_dir}/region.parquet"), "shapes/shape_{r_regionkey}.py", body)


#: What the graph of these files is, in SQL over the tables: files, nodes, raw edges and edges with calls resolved.
GRAPH_SQL = r"""
WITH nodes AS (
  SELECT 'variable' AS kind, 'LIMIT_' || r_regionkey AS name, 'geo/region_' || r_regionkey || '.py' AS file_path, 2 AS line_start, 2 AS line_end, 'LIMIT_' || r_regionkey || ' = ...' AS signature, NULL AS docstring, NULL AS parent_name, '' AS decorators, '' AS children FROM region
  UNION ALL SELECT 'function', 'region_' || r_regionkey, 'geo/region_' || r_regionkey || '.py', 5, 7, 'def region_' || r_regionkey || '()', 'Region ' || r_name || '.', NULL, '', '' FROM region
  UNION ALL SELECT 'function', 'main', 'app/main_' || r_regionkey || '.py', 4, 5, 'def main()', NULL, NULL, '', '' FROM region
  UNION ALL SELECT 'function', 'locate', 'app/main_' || r_regionkey || '.py', 8, 9, 'def locate()', NULL, NULL, '', '' FROM region
  UNION ALL SELECT 'function', 'nation_' || n_nationkey, 'geo/nation_' || n_nationkey || '.py', 5, 7, 'def nation_' || n_nationkey || '(scale: int = 1) -> int', 'Nation ' || n_name || '.', NULL, '', '' FROM nation
  UNION ALL SELECT 'function', 'test_nation_' || n_nationkey, 'tests/test_nation_' || n_nationkey || '.py', 4, 5, 'def test_nation_' || n_nationkey || '()', NULL, NULL, '', '' FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT 'class', 'Customer_' || c_custkey, 'crm/customer_' || c_custkey || '.py', 4, 11, 'class Customer_' || c_custkey, 'Segment ' || c_mktsegment || '.', NULL, '', 'locate|_score' FROM customer
  UNION ALL SELECT 'method', 'locate', 'crm/customer_' || c_custkey || '.py', 7, 8, 'def locate(self)', NULL, 'Customer_' || c_custkey, '', '' FROM customer
  UNION ALL SELECT 'method', '_score', 'crm/customer_' || c_custkey || '.py', 10, 11, 'def _score(self)', NULL, 'Customer_' || c_custkey, '', '' FROM customer
  UNION ALL SELECT 'function', 'serve_' || s_suppkey, 'supply/supplier_' || s_suppkey || '.py', 6, 7, 'def serve_' || s_suppkey || '(request, *args, **kwargs)', NULL, NULL, 'app.route(''/supplier/' || s_suppkey || ''')', '' FROM supplier
  UNION ALL SELECT 'function', 'handle_' || s_suppkey, 'supply/supplier_' || s_suppkey || '.py', 10, 11, 'def handle_' || s_suppkey || '(event)', NULL, NULL, '', '' FROM supplier
  UNION ALL SELECT 'function', 'orphan_' || s_suppkey, 'supply/supplier_' || s_suppkey || '.py', 14, 15, 'def orphan_' || s_suppkey || '()', NULL, NULL, '', '' FROM supplier
), named AS (
  SELECT *, file_path || '::' || coalesce(parent_name || '.', '') || name AS qualified_name FROM nodes
), imports AS (
  SELECT 'geo/nation_' || n_nationkey || '.py' AS file_path, 0 AS at, 'os' AS module, '' AS names, 1 AS line, NULL AS resolved FROM nation
  UNION ALL SELECT 'app/main_' || r_regionkey || '.py', 0, 'geo.region_' || r_regionkey, 'region_' || r_regionkey, 1, 'geo/region_' || r_regionkey || '.py' FROM region
  UNION ALL SELECT 'geo/nation_' || n_nationkey || '.py', 1, 'geo.region_' || n_regionkey, 'region_' || n_regionkey, 2, 'geo/region_' || n_regionkey || '.py' FROM nation
  UNION ALL SELECT 'tests/test_nation_' || n_nationkey || '.py', 0, 'geo.nation_' || n_nationkey, 'nation_' || n_nationkey, 1, 'geo/nation_' || n_nationkey || '.py' FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT 'crm/customer_' || c_custkey || '.py', 0, 'geo.nation_' || c_nationkey, 'nation_' || c_nationkey, 1, 'geo/nation_' || c_nationkey || '.py' FROM customer
  UNION ALL SELECT 'supply/supplier_' || s_suppkey || '.py', 0, 'geo', 'nation_' || s_nationkey, 1, NULL FROM supplier
  UNION ALL SELECT 'supply/supplier_' || s_suppkey || '.py', 1, 'json', '', 2, NULL FROM supplier
), edges AS (
  SELECT 'IMPORTS' AS kind, file_path AS source_qualified, module AS raw_target, module AS target_qualified, file_path, line FROM imports
  UNION ALL SELECT 'CALLS', 'app/main_' || r_regionkey || '.py::main', 'geo.region_' || r_regionkey || '.region_' || r_regionkey, 'geo/region_' || r_regionkey || '.py::region_' || r_regionkey, 'app/main_' || r_regionkey || '.py', 5 FROM region
  UNION ALL SELECT 'CALLS', 'geo/nation_' || n_nationkey || '.py::nation_' || n_nationkey, 'geo.region_' || n_regionkey || '.region_' || n_regionkey, 'geo/region_' || n_regionkey || '.py::region_' || n_regionkey, 'geo/nation_' || n_nationkey || '.py', 7 FROM nation
  UNION ALL SELECT 'TESTED_BY', 'tests/test_nation_' || n_nationkey || '.py::test_nation_' || n_nationkey, 'geo.nation_' || n_nationkey || '.nation_' || n_nationkey, 'geo.nation_' || n_nationkey || '.nation_' || n_nationkey, 'tests/test_nation_' || n_nationkey || '.py', 5 FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT 'CALLS', 'crm/customer_' || c_custkey || '.py::Customer_' || c_custkey || '.locate', 'geo.nation_' || c_nationkey || '.nation_' || c_nationkey, 'geo/nation_' || c_nationkey || '.py::nation_' || c_nationkey, 'crm/customer_' || c_custkey || '.py', 8 FROM customer
  UNION ALL SELECT 'CALLS', 'supply/supplier_' || s_suppkey || '.py::serve_' || s_suppkey, 'geo.nation_' || s_nationkey, 'geo/nation_' || s_nationkey || '.py::nation_' || s_nationkey, 'supply/supplier_' || s_suppkey || '.py', 7 FROM supplier
  UNION ALL SELECT 'CALLS', 'supply/supplier_' || s_suppkey || '.py::serve_' || s_suppkey, 'route', 'route', 'supply/supplier_' || s_suppkey || '.py', 5 FROM supplier
  UNION ALL SELECT 'CALLS', 'supply/supplier_' || s_suppkey || '.py::orphan_' || s_suppkey, 'dumps', 'dumps', 'supply/supplier_' || s_suppkey || '.py', 15 FROM supplier
), tested AS (
  SELECT kind, source_qualified, CASE WHEN kind = 'TESTED_BY' THEN regexp_replace(raw_target, '^geo\.(nation_\d+)\.nation_\d+$', 'geo/\1.py::\1') ELSE target_qualified END AS target_qualified, file_path, line FROM edges
), files AS (SELECT DISTINCT file_path FROM named)
"""

#: The same for the Go and the TypeScript files: nodes with their qualified names, imports, edges with raw and resolved targets.
_REST = """
), named AS (
  SELECT *, file_path || '::' || coalesce(parent_name || '.', '') || name AS qualified_name FROM nodes
), edges AS (
  SELECT 'IMPORTS' AS kind, file_path AS source_qualified, module AS raw_target, module AS target_qualified, file_path, line FROM imports
  UNION ALL SELECT * FROM calls
)
"""
GO_SQL = r"""
WITH s AS (SELECT 'svc/supplier_' || s_suppkey || '.go' AS f, CAST(s_suppkey AS VARCHAR) AS k, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier),
n AS (SELECT 'geo/nation_' || n_nationkey || '.go' AS f, 'geo/nation_' || n_nationkey || '_test.go' AS test, CAST(n_nationkey AS VARCHAR) AS k, n_nationkey % 2 = 0 AS even FROM nation),
imports AS (
  SELECT f AS file_path, 0 AS at, 'strings' AS module, '' AS names, 3 AS line, false AS is_relative FROM n
  UNION ALL SELECT test, 0, 'testing', '', 3, false FROM n WHERE even
  UNION ALL SELECT f, 0, 'fmt', '', 4, false FROM s UNION ALL SELECT f, 1, 'example.com/geo', '', 5, false FROM s
), calls AS (
  SELECT 'CALLS' AS kind, f || '::Name_' || k AS source_qualified, 'strings.ToLower' AS raw_target, 'strings.ToLower' AS target_qualified, f AS file_path, 7 AS line FROM n
  UNION ALL SELECT 'TESTED_BY', test || '::TestName_' || k, 'Name_' || k, 'Name_' || k, test, 6 FROM n WHERE even
  UNION ALL SELECT 'CALLS', test || '::helper_' || k, 'Name_' || k, f || '::Name_' || k, test, 10 FROM n WHERE even
  UNION ALL SELECT 'CALLS', f || '::Supplier_' || k || '.Greet', f || '::New_' || k, f || '::New_' || k, f, 25 FROM s
  UNION ALL SELECT 'CALLS', f || '::Supplier_' || k || '.Greet', 'fmt.Sprint', 'fmt.Sprint', f, 26 FROM s
  UNION ALL SELECT 'CALLS', f || '::Supplier_' || k || '.Greet', 'geo.Name_' || nation, 'geo/nation_' || nation || '.go::Name_' || nation, f, 26 FROM s
), nodes AS (
  SELECT 'function' AS kind, 'Name_' || k AS name, f AS file_path, 6 AS line_start, 8 AS line_end, 'func Name_' || k || '() string' AS signature, 'Name of a nation.' AS docstring, NULL AS parent_name, '' AS decorators, '' AS children FROM n
  UNION ALL SELECT 'function', 'TestName_' || k, test, 5, 7, 'func TestName_' || k || '(t *testing.T)', NULL, NULL, '', '' FROM n WHERE even
  UNION ALL SELECT 'function', 'helper_' || k, test, 9, 11, 'func helper_' || k || '()', NULL, NULL, '', '' FROM n WHERE even
  UNION ALL SELECT 'variable', 'Limit_' || k, f, 9, 9, 'Limit_' || k || ' = ' || k, 'Limit of one.', NULL, '', '' FROM s
  UNION ALL SELECT 'class', 'Supplier_' || k, f, 11, 13, 'type Supplier_' || k || ' struct', NULL, NULL, '', 'Greet' FROM s
  UNION ALL SELECT 'interface', 'Greeter_' || k, f, 15, 17, 'type Greeter_' || k || ' interface', NULL, NULL, '', '' FROM s
  UNION ALL SELECT 'function', 'New_' || k, f, 20, 22, 'func New_' || k || '(id int) *Supplier_' || k, 'Make one.', NULL, '', '' FROM s
  UNION ALL SELECT 'method', 'Greet', f, 24, 27, 'func (s *Supplier_' || k || ') Greet() string', NULL, 'Supplier_' || k, '', '' FROM s
""" + _REST
TYPESCRIPT_SQL = r"""
WITH c AS (SELECT 'web/customer_' || c_custkey || '.tsx' AS f, CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer),
n AS (SELECT 'web/nation_' || n_nationkey || '.ts' AS f, 'web/nation_' || n_nationkey || '.test.ts' AS test, CAST(n_nationkey AS VARCHAR) AS k, n_name, n_nationkey % 2 = 0 AS even FROM nation),
imports AS (
  SELECT test AS file_path, 0 AS at, './nation_' || k AS module, 'nation_' || k AS names, 1 AS line, true AS is_relative FROM n WHERE even
  UNION ALL SELECT f, 0, './nation_' || nation, 'nation_' || nation || '|other', 1, true FROM c UNION ALL SELECT f, 1, 'fs', '', 2, false FROM c
), calls AS (
  SELECT 'CALLS' AS kind, f || '::nation_' || k AS source_qualified, 'String' AS raw_target, 'String' AS target_qualified, f AS file_path, 3 AS line FROM n
  UNION ALL SELECT 'TESTED_BY', test || '::testNation_' || k, 'nation_' || k, 'nation_' || k, test, 4 FROM n WHERE even
  UNION ALL SELECT 'CALLS', f || '::Customer_' || k || '.load', 'nation_' || nation, 'web/nation_' || nation || '.ts::nation_' || nation, f, 8 FROM c
  UNION ALL SELECT 'CALLS', f || '::Customer_' || k || '.save_' || k, 'fs.write', 'fs.write', f, 12 FROM c
  UNION ALL SELECT 'CALLS', f || '::Customer_' || k || '.save_' || k, f || '::Customer_' || k || '.load', f || '::Customer_' || k || '.load', f, 12 FROM c
  UNION ALL SELECT 'CALLS', f || '::show_' || k, 'nation_' || nation, 'web/nation_' || nation || '.ts::nation_' || nation, f, 25 FROM c
), nodes AS (
  SELECT 'function' AS kind, 'nation_' || k AS name, f AS file_path, 2 AS line_start, 4 AS line_end, 'function nation_' || k || '(id: number): string' AS signature, 'Nation ' || n_name || '.' AS docstring, NULL AS parent_name, '' AS decorators, '' AS children FROM n
  UNION ALL SELECT 'function', 'testNation_' || k, test, 3, 5, 'function testNation_' || k || '(): void', NULL, NULL, '', '' FROM n WHERE even
  UNION ALL SELECT 'class', 'Customer_' || k, f, 5, 14, 'class Customer_' || k || ' extends Base', 'Segment ' || segment || '.', NULL, '', 'load|save_' || k FROM c
  UNION ALL SELECT 'method', 'load', f, 7, 9, 'load(id: number): string', 'Loads it.', 'Customer_' || k, '', '' FROM c
  UNION ALL SELECT 'method', 'save_' || k, f, 11, 13, 'save_' || k || '(): void', NULL, 'Customer_' || k, '', '' FROM c
  UNION ALL SELECT 'interface', 'View_' || k, f, 16, 18, 'interface View_' || k, NULL, NULL, '', '' FROM c
  UNION ALL SELECT 'type', 'Kind_' || k, f, 20, 20, 'type Kind_' || k || ' = "a" | "b"', NULL, NULL, '', '' FROM c
  UNION ALL SELECT 'variable', 'MAX_' || k, f, 22, 22, 'MAX_' || k || ' = ...', NULL, NULL, '', '' FROM c
  UNION ALL SELECT 'function', 'show_' || k, f, 24, 26, 'const show_' || k || ' = (x: number): string', NULL, NULL, '', '' FROM c
""" + _REST
