"""Symbols, imports and edges of TypeScript files (.ts, .tsx), from tokens."""

from __future__ import annotations

import re

from .scanner import TS, Token, chain_start, end_line, resolve_name, scan

# Words of TypeScript that are no called names, and those that can stand before a member's name.
KEYWORDS = frozenset("async await break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof interface let new of return static super switch throw try type typeof var void while with yield".split())
MODIFIERS = frozenset("public private protected static async override readonly abstract declare get set accessor *".split())
_TEST = re.compile(r"\.(?:test|spec)\.(?:ts|tsx|js)$")
#: A brace after one of these opens an object type, not a body.
_TYPE_GOES_ON = frozenset(": | & < , => [ ( = extends is keyof typeof".split())
#: A line that ends or starts with one of these goes on.
_JOINS = frozenset("= + - * / % & | ? : , . => && || ?? === !== == != < > ( [ { ?.".split())


def is_test_file(path: str) -> bool:
    return bool(_TEST.search(path)) or path.rpartition("/")[2].startswith("test_") or "/__tests__/" in path


def clean_doc(comment: str | None) -> str | None:
    """The text of a /** */ comment on one line, else null."""
    if not comment or not comment.startswith("/**"):
        return None
    rows = (re.sub(r"^\s*\*?\s?", "", x).strip() for x in comment[3:].removesuffix("*/").split("\n"))
    return " ".join(x for x in rows if x) or None


class _File:
    def __init__(self, path: str, text: str, mirror: bool):
        self.path, self.text, self.mirror = path, text, mirror
        every, self.fine = scan(text, TS)
        self.tokens: list[Token] = []
        self.comment: dict[int, str] = {}
        number: dict[int, int] = {}
        for k, t in enumerate(every):
            if t.kind == "comment":
                if t.text.startswith("/**"):
                    self.comment[len(self.tokens)] = t.text
            else:
                number[k] = len(self.tokens)
                self.tokens.append(t)
        for t in self.tokens:
            t.mate = number.get(t.mate, -1)
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.functions: list[tuple[str, int, int]] = []

    def at(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def slice(self, a: int, b: int) -> str:
        """Source from token a up to and with token b."""
        return self.text[self.tokens[a].start : self.tokens[b].end] if a <= b else ""

    def add(self, name: str, kind: str, first: int, last: int, signature: str, doc: int, parent: str | None = None) -> None:
        t = self.tokens
        self.symbols.append({"name": name, "kind": kind, "line": t[first].line, "end_line": end_line(t[last]), "signature": signature, "docstring": clean_doc(self.comment.get(doc)), "parent": parent, "children": [], "decorators": []})

    def statement_end(self, k: int) -> int:
        """Index of the last token of the statement at k: a semicolon, or a line end that nothing carries on."""
        t = self.tokens
        while k < len(t):
            if t[k].text == ";":
                return k
            if t[k].mate > k:
                k = t[k].mate
            if k + 1 >= len(t) or t[k + 1].text in (")", "]", "}"):
                return k
            if t[k + 1].line > end_line(t[k]) and t[k].text not in _JOINS and t[k + 1].text not in _JOINS:
                return k
            k += 1
        return len(t) - 1

    def generics(self, k: int) -> int:
        """The index behind type parameters that start at k, if any do."""
        if self.at(k) != "<":
            return k
        depth = 0
        for p in range(k, min(k + 400, len(self.tokens))):
            depth += (self.at(p) == "<") - (self.at(p) == ">")
            if not depth:
                return p + 1
        return k

    def signature(self, k: int) -> tuple[str, int, int] | None:
        """(parameters and return type, index of the body's brace, its end) of a function whose parameters start at k."""
        if self.at(k) != "(" or self.tokens[k].mate < 0:
            return None
        close = self.tokens[k].mate
        p = close + 1
        if self.at(p) == ":":
            while p < len(self.tokens) and not (self.at(p) == "{" and self.at(p - 1) not in _TYPE_GOES_ON):
                if self.at(p) in (";", "=") or (self.tokens[p].line > end_line(self.tokens[p - 1]) and self.at(p - 1) not in _JOINS and self.at(p) not in _JOINS and self.at(p) != "{"):
                    return None
                p = (self.tokens[p].mate if self.tokens[p].mate > p else p) + 1
        if self.at(p) != "{" or self.tokens[p].mate < 0:
            return None
        back = self.slice(close + 1, p - 1)
        return self.slice(k, close) + back, p, self.tokens[p].mate

    def run(self) -> None:
        k = 0
        while k < len(self.tokens):
            k = self.top(k, k)

    def top(self, k: int, doc: int) -> int:
        t, word = self.tokens, self.at(k)
        if t[k].kind != "name":
            return (t[k].mate if t[k].mate > k else k) + 1
        if word == "export":
            nxt = k + 1
            while self.at(nxt) in ("default", "declare"):
                nxt += 1
            if self.at(nxt) in ("function", "async", "class", "interface", "type", "const", "let"):
                return self.top(nxt, doc)
            return self.statement_end(k) + 1
        if word == "import" and self.at(k + 1) not in ("(", "."):
            return self.import_(k)
        head = k + 1 if word == "async" and self.at(k + 1) == "function" else k
        if self.at(head) == "function":
            p = head + 1 + (self.at(head + 1) == "*")
            if p < len(t) and t[p].kind == "name" and (made := self.signature(self.generics(p + 1))):
                text, body, last = made
                self.add(t[p].text, "function", k, last, f"function {t[p].text}{text}", doc)
                self.functions.append((t[p].text, body, last))
                return last + 1
            return self.statement_end(k) + 1
        if word == "class" and k + 1 < len(t):
            return self.class_(k, doc)
        if word == "interface" and k + 1 < len(t) and t[k + 1].kind == "name":
            p = k + 2
            while p < len(t) and self.at(p) != "{":
                p += 1
            last = t[p].mate if p < len(t) and t[p].mate > 0 else len(t) - 1
            self.add(t[k + 1].text, "interface", k, last, f"interface {t[k + 1].text}", doc)
            return last + 1
        if word == "type" and k + 1 < len(t) and t[k + 1].kind == "name" and (self.at(k + 2) in ("=", "<")):
            last = self.statement_end(k)
            self.add(t[k + 1].text, "type", k, last, self.slice(k, last).rstrip(";").strip(), doc)
            return last + 1
        if word in ("const", "let") and self.at(k + 1) != "enum":
            last = self.statement_end(k)
            self.lexical(k, last, doc)
            return last + 1
        return self.statement_end(k) + 1

    def import_(self, k: int) -> int:
        last = self.statement_end(k)
        names, module, p = [], None, k + 1
        while p <= last:
            t = self.tokens[p]
            if t.kind == "string":
                module = t.text.strip("'\"")
            elif t.text == "{":
                for q in range(p + 1, t.mate):
                    if self.tokens[q].kind == "name" and self.at(q - 1) in ("{", ",") + (("type",) if self.at(q - 2) in ("{", ",") else ()) and not (self.at(q) == "type" and self.tokens[q + 1].kind == "name" and self.at(q + 1) != "as"):
                        names.append(self.at(q))
                p = t.mate
            elif t.kind == "name" and t.text not in ("from", "type") and self.at(p - 1) in ("import", ",", "type"):
                names.append(t.text)
            p += 1
        if module:
            self.imports.append({"module": module, "names": names, "line": self.tokens[k].line, "is_relative": module.startswith(".")})
        return last + 1

    def class_(self, k: int, doc: int) -> int:
        t, name, p = self.tokens, self.at(k + 1), self.generics(k + 2)
        first = p
        while p < len(t) and self.at(p) != "{":
            p = (t[p].mate if t[p].mate > p else p) + 1
        if p >= len(t) or t[p].mate < 0:
            return k + 1
        last = t[p].mate
        heritage = self.slice(first, p - 1)
        self.add(name, "class", k, last, f"class {name}{' ' + heritage if heritage else ''}", doc)
        owner = next(s for s in self.symbols if s["name"] == name and s["kind"] == "class")
        q = p + 1
        while q < last:
            start = q
            while self.at(q).startswith("@") and q < last:  # decorators
                q += 1
                if self.at(q) == "(":
                    q = t[q].mate + 1
            begin = q
            while self.at(q) in MODIFIERS and self.at(q + 1) not in ("(", "=", ":", ";", "?", "<"):
                q += 1
            made = self.signature(self.generics(q + 1)) if t[q].kind in ("name", "string") else None
            if made:
                text, body, end = made
                member = self.at(q)
                self.functions.append((f"{name}.{member}", body, end))
                if member != "constructor":
                    self.add(member, "method", begin, end, member + text, start, name)
                    if member not in owner["children"]:
                        owner["children"].append(member)
                q = end + 1
            else:
                q = max(self.statement_end(q), start) + 1
        return last + 1

    def lexical(self, k: int, last: int, doc: int) -> None:
        t, p = self.tokens, k + 1
        end = last - 1 if self.at(last) == ";" else last
        while p <= end:
            name = p
            q = p
            while q <= end and self.at(q) not in ("=", ","):
                q = (t[q].mate if t[q].mate > q else q) + 1
            value = q + 1 if self.at(q) == "=" else None
            stop = q
            while stop <= end and self.at(stop) != ",":
                stop = (t[stop].mate if t[stop].mate > stop else stop) + 1
            stop = min(stop, end + 1)
            label = self.slice(name, t[name].mate) if t[name].mate > name else self.at(name)
            arrow = self.arrow(value, stop) if value is not None else False
            if arrow:
                text = self.slice(value, stop - 1).split("{")[0].strip().rstrip("=>").strip()
                self.add(label, "function", k, last, f"const {label} = {text}", doc)
                self.functions.append((label, value, stop - 1))
            else:
                self.add(label, "variable", k, last, f"{label} = ...", doc)
            p = stop + 1

    def arrow(self, k: int, stop: int) -> bool:
        if self.at(k) == "async" and self.at(k + 1) != "=>":
            k += 1
        k = self.generics(k)
        if k >= stop:
            return False
        if self.tokens[k].kind == "name":
            return self.at(k + 1) == "=>"
        if self.at(k) != "(" or self.tokens[k].mate < 0:
            return False
        p = self.tokens[k].mate + 1
        if self.at(p) == ":":
            while p < stop and self.at(p) not in ("=>", ";"):
                p = (self.tokens[p].mate if self.tokens[p].mate > p else p) + 1
        return p < stop and self.at(p) == "=>"

    def angles(self) -> dict[int, int]:
        """The index of the opening < of each > that may close type arguments, nested ones included."""
        out, stack, extends = {}, [], -1
        for k, x in enumerate(self.tokens):
            inside = bool(stack) and self.at(stack[-1]) == "<"
            if x.kind in ("name", "number", "string"):
                extends = k if x.text == "extends" else extends
            elif x.text in ("<", "(", "[", "{"):
                stack.append(k)
            elif x.text == ">":
                if inside:
                    out[k] = stack.pop()
            elif x.text in (")", "]", "}"):
                while stack and self.at(stack.pop()) == "<":
                    pass
            elif x.text not in (",", "|", "&", ".", "=>") and not (x.text in ("?", ":") and inside and extends > stack[-1]):
                while stack and self.at(stack[-1]) == "<":
                    stack.pop()
        return out

    def edges(self) -> list[dict]:
        t = self.tokens
        angles = self.angles()
        here = {s["name"]: f"{self.path}::{s['parent'] + '.' if s['parent'] else ''}{s['name']}" for s in self.symbols if s["kind"] in ("function", "method", "class", "interface")}
        out = [{"kind": "IMPORTS", "source": self.path, "target": i["module"], "line": i["line"]} for i in self.imports]
        jsx = self.path.endswith(".tsx")
        for name, first, last in self.functions:
            short = name.rpartition(".")[2]
            kind = "TESTED_BY" if is_test_file(self.path) and short.startswith(("test", "Test")) else "CALLS"
            source = name if self.mirror else f"{self.path}::{name}"
            put = lambda target, k: out.append({"kind": kind, "source": source, "target": target, "line": t[k].line})  # noqa: B023, E731
            for k in range(first, last + 1):
                if t[k].text == "new" and k + 1 <= last and t[k + 1].kind == "name" and self.at(k + 2) not in (".", "?."):
                    put(resolve_name(self.at(k + 1), here), k)
                elif jsx and t[k].text == "<" and k + 1 <= last and self.at(k + 1)[:1].isupper() and (t[k - 1].kind not in ("name", "number") or t[k - 1].text in KEYWORDS) and self.at(k - 1) not in (")", "]"):
                    put(here.get(self.at(k + 1), self.at(k + 1)), k)
                elif t[k].text == "(" and k > first:
                    p = k - 1
                    if t[p].text == ">":  # type arguments
                        if angles.get(p, first) <= first:
                            continue
                        p = angles[p] - 1
                    if t[p].kind != "name" or t[p].text in KEYWORDS and t[p - 1].text not in (".", "?."):
                        continue
                    start = chain_start(t, p, (".", "?."), KEYWORDS)
                    if start is None or self.at(start - 1) in ("new", "function") or (start == p and t[k].mate > 0 and self.at(t[k].mate + 1) == "{"):
                        continue
                    put(resolve_name(self.slice(start, p), here), start)
        return out


def parse(path: str, source: str, mirror: bool = False) -> dict:
    """Symbols, imports and edges of one file. What can be read of a broken file is kept, with an error.

    mirror: sources of edges are bare names, without the file.
    """
    if not source.strip():
        return {"symbols": [], "imports": [], "edges": [], "parse_error": None}
    file = _File(path, source, mirror)
    file.run()
    return {"symbols": file.symbols, "imports": file.imports, "edges": file.edges(), "parse_error": None if file.fine else "SyntaxError: unbalanced brackets"}
