from textwrap import dedent

import pytest

from lattisym.operators import go_source, python_source, typescript_source
from lattisym.operators.extract import get_language, parse_source, supported_extensions

PY = dedent('''
    import json
    from pkg.models import User as U, Item
    from . import near
    LIMIT = 3
    names: list = []

    @dataclass
    class Box(Base, metaclass=Meta):
        """A box."""
        size: int = 0

        def put(self, a, b: int = 1, *rest, key=None, **kw) -> None:
            return helper(U(a).save())

        class Lid:
            def close(self):
                self.put()

    async def helper(x):
        return [json.dumps(y) for y in x]

    if True:
        def hidden(): ...
''').lstrip("\n")  # fmt: skip


def by_name(found):
    return {s["name"]: s for s in found["symbols"]}


def edges(found, kind="CALLS"):
    return {(e["source"].split("::")[-1], e["target"]) for e in found["edges"] if e["kind"] == kind}


def test_python_symbols():
    s = by_name(python_source.parse("a/b.py", PY))
    assert list(s) == ["LIMIT", "names", "Box", "put", "Lid", "close", "helper"]
    assert s["Box"]["signature"] == "@dataclass\nclass Box(Base)" and s["Box"]["docstring"] == "A box."
    assert s["Box"]["children"] == ["put"] and s["Lid"]["children"] == ["close"]
    assert s["put"]["signature"] == "def put(self, a, b: int = 1, *rest, key = None, **kw) -> None"
    assert s["put"]["kind"] == "method" and s["close"]["parent"] == "Box/Lid"
    assert s["helper"]["signature"] == "async def helper(x)" and s["names"]["signature"] == "names: list"


def test_python_edges():
    found = python_source.parse("a/b.py", PY)
    assert edges(found) == {("Box.put", "a/b.py::helper"), ("Box.put", "pkg.models.U"), ("Box.put", "save"), ("Box/Lid.close", "a/b.py::Box.put"), ("helper", "dumps")}
    assert ("Lid.close", "a/b.py::Box.put") in edges(python_source.parse("a/b.py", PY, mirror=True))
    assert [(i["module"], i["names"], i["is_relative"]) for i in found["imports"]] == [("json", [], False), ("pkg.models", ["User", "Item"], False), ("", ["near"], True)]
    assert {e["target"] for e in found["edges"] if e["kind"] == "IMPORTS"} == {"json", "pkg.models"}


def test_python_tests_and_errors():
    found = python_source.parse("tests/test_x.py", "def test_a():\n    go()\ndef util():\n    go()\n")
    assert edges(found, "TESTED_BY") == {("test_a", "go")} and edges(found) == {("util", "go")}
    broken = python_source.parse("x.py", "def (:\n")
    assert broken["symbols"] == [] and broken["parse_error"]
    long = by_name(python_source.parse("x.py", 'def f():\n    """' + "d" * 300 + '"""\n'))
    assert long["f"]["docstring"] == "d" * 200 + "..."


GO = dedent("""
    package srv
    import "fmt"
    import (
        alias "net/http"
        "os"
    )
    // Limit of things.
    var Limit = 3
    const (
        A = 1
        B = 2
    )
    // Server serves.
    type Server struct {
        addr string
    }
    type Run interface { Go() error }
    type ID int
    func New(a string) *Server {
        return &Server{addr: a}
    }
    func (s *Server) Start(f func() error) (interface{}, error) {
        s.log("x")
        http.Get(New("y").addr)
        return nil, f()
    }
    func (s *Server) log(m string) { fmt.Println(m) }
""").lstrip("\n")  # fmt: skip


def test_go():
    found = go_source.parse("s/srv.go", GO)
    s = by_name(found)
    assert [(x["name"], x["kind"]) for x in found["symbols"]] == [("Limit", "variable"), ("A", "variable"), ("B", "variable"), ("Server", "class"), ("Run", "interface"), ("ID", "type"), ("New", "function"), ("Start", "method"), ("log", "method")]
    assert s["Server"]["children"] == ["Start", "log"] and s["Server"]["docstring"] == "Server serves." and s["Start"]["parent"] == "Server"
    assert s["New"]["signature"] == "func New(a string) *Server" and s["Limit"]["signature"] == "Limit = 3"
    assert [i["module"] for i in found["imports"]] == ["fmt", 'alias "net/http', "os"]
    assert edges(found) == {("Server.Start", "s/srv.go::Server.log"), ("Server.Start", "http.Get"), ("Server.Start", "s/srv.go::New"), ("Server.Start", "f"), ("Server.log", "fmt.Println")}
    assert go_source.parse("a.go", " \n")["symbols"] == [] and go_source.parse("a.go", "func f() {\n g(\n")["parse_error"]
    test = go_source.parse("s/a_test.go", "func TestX(t *T) { New() }\nfunc help() { New() }\n")
    assert edges(test, "TESTED_BY") == {("TestX", "New")} and edges(test) == {("help", "New")}
    assert go_source.parse("a.go", "func f() { g() }", mirror=True)["edges"][0]["source"] == "f"


TSX = dedent("""
    import React, { useState, type Ref as R } from 'react';
    import * as all from "./all";
    /** A user
     * of things. */
    export interface User { id: number }
    export type Role = "a" | "b";
    export default class Page extends Base<User> implements View {
      private count = 0;
      constructor(a: string) { super(); this.load(a); }
      /** Load it. */
      async load(id: string): Promise<{ ok: boolean }> {
        const r = /a"b{/.exec(id);
        return fetch<User>(`x${call(id)}`).then((u) => new Thing(u));
      }
      get size(): number { return this.items.length; }
    }
    export const View = (p: Props) => {
      if (p.x) { helper(); }
      return <Card title="it's"><Row /></Card>;
    };
    const LIMIT = 3, other = { run() { return 1; } };
    function helper(): void { LIMIT; }
""").lstrip("\n")  # fmt: skip


def test_typescript():
    found = typescript_source.parse("src/page.tsx", TSX)
    s = by_name(found)
    assert [(x["name"], x["kind"]) for x in found["symbols"]] == [("User", "interface"), ("Role", "type"), ("Page", "class"), ("load", "method"), ("size", "method"), ("View", "function"), ("LIMIT", "variable"), ("other", "variable"), ("helper", "function")]
    assert s["User"]["docstring"] == "A user of things." and s["load"]["docstring"] == "Load it."
    assert s["Page"]["signature"] == "class Page extends Base<User> implements View" and s["Page"]["children"] == ["load", "size"]
    assert s["load"]["signature"] == "load(id: string): Promise<{ ok: boolean }>" and s["View"]["signature"] == "const View = (p: Props)"
    assert s["Role"]["signature"] == 'type Role = "a" | "b"' and s["helper"]["signature"] == "function helper(): void"
    assert [(i["module"], i["names"]) for i in found["imports"]] == [("react", ["React", "useState", "Ref"]), ("./all", [])]
    got = edges(found)
    assert {("Page.constructor", "src/page.tsx::Page.load"), ("Page.load", "fetch"), ("Page.load", "Thing"), ("View", "src/page.tsx::helper"), ("View", "Card"), ("View", "Row")} <= got
    assert not any(t in ("super", "if", "run") for _, t in got)
    test = typescript_source.parse("src/a.test.ts", "function testA() { go(); }\nfunction b() { go(); }\n")
    assert edges(test, "TESTED_BY") == {("testA", "go")} and edges(test) == {("b", "go")}


def test_dispatch():
    assert supported_extensions() == [".py", ".go", ".ts", ".tsx"] and get_language("a/b.tsx") == "typescript"
    with pytest.raises(ValueError, match="unsupported"):
        parse_source("a.rb", "")


def test_typescript_calls_with_type_arguments():
    long = " | ".join(f"T{k}" for k in range(40))
    calls = ["a<Map<string, X>>(v)", f"b<{long}>(v)", "c<{ k: X; m?: Y[] }>(v)", "d<(x: X) => Y, 'lit'>(v)", "e<X extends Y ? A : B>(v)", "g<Map<string, Set<Array<X>>>>(v)"]
    source = "function f(v: any, i: number, n: number) {\n" + "".join(f"  {c};\n" for c in calls) + "  if (i < n && h > (v)) { return i < n ? i : j > (v); }\n}\n"
    got = [x["target"] for x in typescript_source.parse("x.ts", source)["edges"] if x["kind"] == "CALLS"]
    assert sorted(got) == ["a", "b", "c", "d", "e", "g"]
