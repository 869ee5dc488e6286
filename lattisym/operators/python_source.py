"""Symbols, imports and edges of Python files, from the standard library's syntax trees."""

from __future__ import annotations

import ast

#: Deeper nesting than this is not followed.
DEEPEST = 180
DOCSTRING = 200


def _docstring(node: ast.AST) -> str | None:
    match getattr(node, "body", None):
        case [ast.Expr(value=ast.Constant(value=str(text))), *_]:
            text = text.strip()
            return text if len(text) <= DOCSTRING else text[:DOCSTRING] + "..."
    return None


def _parameters(a: ast.arguments) -> str:
    """Parameters as the index shows them: positional-only ones and a lone star are left out."""

    def one(arg: ast.arg, default: ast.AST | None = None, stars: str = "") -> str:
        kind = f": {ast.unparse(arg.annotation)}" if arg.annotation else ""
        return f"{stars}{arg.arg}{kind}" + (f" = {ast.unparse(default)}" if default is not None else "")

    gap = len(a.args) - len(a.defaults)
    out = [one(x, a.defaults[k - gap] if 0 <= k - gap < len(a.defaults) else None) for k, x in enumerate(a.args)]
    if a.vararg:
        out.append(one(a.vararg, stars="*"))
    out += [one(x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    if a.kwarg:
        out.append(one(a.kwarg, stars="**"))
    return ", ".join(out)


def _symbol(node, kind: str, name: str, signature: str, parent: str | None, decorators: list[str]) -> dict:
    return {
        "name": name, "kind": kind, "line": node.lineno, "end_line": node.end_lineno or node.lineno, "signature": signature,
        "docstring": _docstring(node) if kind != "variable" else None, "parent": parent, "children": [], "decorators": decorators,
    }


def _symbols(body_of: ast.AST, parent: str | None, owner: dict | None, out: list[dict], level: int) -> None:
    if level > DEEPEST:
        return
    for node in ast.iter_child_nodes(body_of):
        match node:
            case ast.ClassDef():
                decorators = [ast.unparse(d) for d in node.decorator_list]
                bases = ", ".join(ast.unparse(b) for b in node.bases)
                head = f"@{', @'.join(decorators)}\n" if decorators else ""
                made = _symbol(node, "class", node.name, f"{head}class {node.name}{f'({bases})' if bases else ''}", parent, decorators)
                # members of a class defined twice are listed with the first definition
                first = next((s for s in out if s["name"] == node.name and s["parent"] == parent), made)
                out.append(made)
                _symbols(node, f"{parent}/{node.name}" if parent else node.name, first, out, level + 1)
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                head = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
                back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
                signature = f"{head} {node.name}({_parameters(node.args)}){back}"
                out.append(_symbol(node, "method" if parent else "function", node.name, signature, parent, [ast.unparse(d) for d in node.decorator_list]))
                if owner is not None and node.name not in owner["children"]:
                    owner["children"].append(node.name)
            case ast.Assign() if parent is None:
                out += [_symbol(node, "variable", t.id, f"{t.id} = ...", None, []) for t in node.targets if isinstance(t, ast.Name)]
            case ast.AnnAssign(target=ast.Name(id=name)) if parent is None:
                out.append(_symbol(node, "variable", name, f"{name}: {ast.unparse(node.annotation)}", None, []))


def _imports(tree: ast.Module) -> tuple[list[dict], dict[str, str]]:
    """The import rows of a module, and the module that each name it binds comes from."""
    rows, bound = [], {}
    for node in tree.body:
        match node:
            case ast.Import(names=names):
                rows += [{"module": a.name, "names": [], "line": node.lineno, "is_relative": False} for a in names]
                bound.update((a.asname or a.name, a.name) for a in names)
            case ast.ImportFrom(module=module, names=names, level=level):
                rows.append({"module": module or "", "names": [a.name for a in names], "line": node.lineno, "is_relative": level > 0})
                bound.update((a.asname or a.name, module) for a in names if module)
    return rows, bound


def _callee(call: ast.Call) -> str | None:
    return call.func.id if isinstance(call.func, ast.Name) else getattr(call.func, "attr", None)


def is_test_file(path: str) -> bool:
    name = path.rpartition("/")[2]
    return name.startswith("test_") or name.endswith("_test.py")


def _functions(node: ast.AST, path: str | None, level: int, mirror: bool):
    """(owner path, function) of every function directly in a module or class."""
    if level > DEEPEST:
        return
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.ClassDef):
            yield from _functions(child, child.name if mirror or path is None else f"{path}/{child.name}", level + 1, mirror)
        elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield path, child


def parse(path: str, source: str, mirror: bool = False) -> dict:
    """Symbols, imports and edges of one file; a file that does not parse gives its error alone.

    mirror: sources of edges name the innermost class only, so that methods of nested classes don't meet their nodes.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return {"symbols": [], "imports": [], "edges": [], "parse_error": f"{type(e).__name__}: {e}"}
    symbols: list[dict] = []
    _symbols(tree, None, None, symbols, 0)
    imports, module_of = _imports(tree)
    here = {s["name"]: f"{path}::{s['parent'] + '.' if s['parent'] else ''}{s['name']}" for s in symbols if s["kind"] != "variable"}
    edges = [{"kind": "IMPORTS", "source": path, "target": i["module"], "line": i["line"]} for i in imports if i["module"]]
    test = is_test_file(path)
    for owner, function in _functions(tree, None, 0, mirror):
        kind = "TESTED_BY" if test and function.name.startswith("test_") else "CALLS"
        source_name = f"{path}::{owner + '.' if owner else ''}{function.name}"
        for call in ast.walk(function):
            if isinstance(call, ast.Call) and (name := _callee(call)):
                target = here.get(name) or (f"{module_of[name]}.{name}" if name in module_of else name)
                edges.append({"kind": kind, "source": source_name, "target": target, "line": call.lineno})
    return {"symbols": symbols, "imports": imports, "edges": edges, "parse_error": None}
