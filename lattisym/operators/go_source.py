"""Symbols, imports and edges of Go files, from tokens."""

from __future__ import annotations

from .scanner import GO, Token, chain_start, end_line, resolve_name, scan

# The keywords of Go.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


def is_test_file(path: str) -> bool:
    return path.endswith("_test.go")


class _File:
    def __init__(self, path: str, text: str, mirror: bool):
        self.path, self.text, self.mirror = path, text, mirror
        every, self.fine = scan(text, GO)
        # comments are looked up by the token that follows them
        self.tokens: list[Token] = []
        self.comment: dict[int, str] = {}
        number: dict[int, int] = {}
        for k, t in enumerate(every):
            if t.kind == "comment":
                self.comment[len(self.tokens)] = t.text
            else:
                number[k] = len(self.tokens)
                self.tokens.append(t)
        for t in self.tokens:
            t.mate = number.get(t.mate, -1)
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.functions: list[tuple[str, int, int]] = []  # name with receiver, first and last token of the body

    def doc(self, k: int) -> str | None:
        text = self.comment.get(k, "").strip().removeprefix("//").strip()
        return text or None

    def add(self, name: str, kind: str, first: int, last: int, signature: str, doc: int, parent: str | None = None) -> None:
        t = self.tokens
        self.symbols.append({"name": name, "kind": kind, "line": t[first].line, "end_line": end_line(t[last]), "signature": signature, "docstring": self.doc(doc), "parent": parent, "children": [], "decorators": []})

    def end_of_line(self, k: int) -> int:
        """Index of the last token of the statement that starts at k: brackets are skipped, a new line ends it."""
        t = self.tokens
        while True:
            if t[k].mate > k:
                k = t[k].mate
            if k + 1 >= len(t) or t[k + 1].text == ";" or (t[k + 1].line > end_line(t[k]) and t[k].text not in (",", "=", "+", "-", "*", "/", "|", "&&", "||", ".", "(", "{", "[")) or t[k + 1].text in (")", "}"):
                return k
            k += 1

    def run(self) -> None:
        t, k = self.tokens, 0
        while k < len(t):
            word = t[k].text if t[k].kind == "name" else ""
            if word == "func":
                k = self.function(k)
            elif word in ("import", "type", "var", "const") and k + 1 < len(t):
                k = self.declaration(k, word)
            else:
                k = (t[k].mate if t[k].mate > k else k) + 1

    def declaration(self, k: int, word: str) -> int:
        t = self.tokens
        if t[k + 1].text == "(" and t[k + 1].mate > 0:
            close, p = t[k + 1].mate, k + 2
            while p < close:
                if t[p].text == ";":
                    p += 1
                    continue
                last = min(self.end_of_line(p), close - 1)
                self.spec(word, p, last, k, close)
                p = last + 1
            return close + 1
        last = self.end_of_line(k + 1)
        self.spec(word, k + 1, last, k, last)
        return last + 1

    def spec(self, word: str, p: int, last: int, first: int, final: int) -> None:
        t = self.tokens
        text = self.text[t[p].start : t[last].end]
        if word == "import":
            self.imports.append({"module": text.strip('"'), "names": [], "line": t[p].line, "is_relative": False})
        elif word == "type":
            body = p + 1
            if body <= last and t[body].text == "[" and t[body].mate + 1 <= last and t[body].mate > body + 1 and t[t[body].mate + 1].text in ("struct", "interface"):
                body = t[body].mate + 1  # type parameters
            what = t[body].text if body <= last else ""
            kind = {"struct": "class", "interface": "interface"}.get(what, "type")
            head = f"type {t[p].text} {what}" if kind != "type" else f"type {text.split('{')[0].strip()}"
            self.add(t[p].text, kind, first, final, head, first)
        elif t[p].kind == "name":
            self.add(t[p].text, "variable", p, last, text, first)

    def function(self, k: int) -> int:
        t, p, receiver = self.tokens, k + 1, None
        if p < len(t) and t[p].text == "(" and t[p].mate > 0:
            words = self.text[t[p].end : t[t[p].mate].start].split()
            receiver = words[-1].lstrip("*") if words else None
            p = t[p].mate + 1
        if p >= len(t) or t[p].kind != "name":
            return k + 1
        name, p = t[p].text, p + 1
        if p < len(t) and t[p].text == "[" and t[p].mate > 0:
            p = t[p].mate + 1
        if p >= len(t) or t[p].text != "(" or t[p].mate < 0:
            return k + 1
        p = last = t[p].mate
        body = None
        while p + 1 < len(t) and t[p + 1].line == end_line(t[p]):
            p += 1
            if t[p].text == "{" and t[p - 1].text not in ("interface", "struct"):
                body = p
                break
            if t[p].mate > p:
                p = t[p].mate
            last = p
        if body is not None:
            last = t[body].mate if t[body].mate > 0 else len(t) - 1
            self.functions.append((f"{receiver}.{name}" if receiver else name, body, last))
        self.add(name, "method" if receiver else "function", k, last, self.text[t[k].start : t[last].end].split("{")[0].strip(), k, receiver)
        return last + 1

    def edges(self) -> list[dict]:
        t = self.tokens
        here = {s["name"]: f"{self.path}::{s['parent'] + '.' if s['parent'] else ''}{s['name']}" for s in self.symbols if s["kind"] in ("function", "method", "class", "interface")}
        out = [{"kind": "IMPORTS", "source": self.path, "target": i["module"], "line": i["line"]} for i in self.imports]
        for name, first, last in self.functions:
            kind = "TESTED_BY" if is_test_file(self.path) and name.rpartition(".")[2].startswith("Test") else "CALLS"
            source = name if self.mirror else f"{self.path}::{name}"
            for k in range(first + 1, last + 1):
                if t[k].text != "(" or t[k - 1].kind != "name" or t[k - 1].text in KEYWORDS:
                    continue
                start = chain_start(t, k - 1, (".",), KEYWORDS)
                if start is None or t[start - 1].text in ("func", "]"):
                    continue
                out.append({"kind": kind, "source": source, "target": resolve_name(self.text[t[start].start : t[k - 1].end], here), "line": t[start].line})
        return out


def parse(path: str, source: str, mirror: bool = False) -> dict:
    """Symbols, imports and edges of one file. What can be read of a broken file is kept, with an error.

    mirror: sources of edges are bare names, without the file.
    """
    if not source.strip():
        return {"symbols": [], "imports": [], "edges": [], "parse_error": None}
    file = _File(path, source, mirror)
    file.run()
    types = {s["name"]: s for s in file.symbols if s["kind"] in ("class", "interface")}
    for s in file.symbols:
        if s["kind"] == "method" and s["parent"] in types and s["name"] not in types[s["parent"]]["children"]:
            types[s["parent"]]["children"].append(s["name"])
    return {"symbols": file.symbols, "imports": file.imports, "edges": file.edges(), "parse_error": None if file.fine else "SyntaxError: unbalanced brackets"}
