"""Tokens of brace languages: names, numbers, strings, comments and punctuation, with lines and matching brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass

OPEN, CLOSE = "([{", ")]}"


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, comment, punct
    text: str
    start: int
    end: int
    line: int
    mate: int = -1  # index of the matching bracket


_GO = r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\.)*')|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<punct>:=|<-|&&|\|\||[^\s\w])"""
_TS = r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<name>[#@]?[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)|(?P<punct>=>|\?\.|\.\.\.|===?|!==?|&&|\|\||\?\?|[^\s\w])"""
GO, TS = re.compile(_GO, re.S), re.compile(_TS, re.S)

#: After these a slash starts a regular expression.
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => && || ?? === !== == != + - * % < > return typeof case in of void delete throw new".split())
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


def _template_end(text: str, at: int) -> int:
    """The end of a template string that starts at `at`; holes may hold further templates."""
    k, depth = at + 1, 0
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 1
        elif depth == 0 and c == "`":
            return k + 1
        elif text.startswith("${", k) and depth == 0:
            depth, k = 1, k + 1
        elif depth and c in "{}":
            depth += 1 if c == "{" else -1
        elif depth and c == "`":
            k = _template_end(text, k) - 1
        k += 1
    return len(text)


def scan(text: str, rules: re.Pattern) -> tuple[list[Token], bool]:
    """All tokens, and whether every bracket has its mate."""
    out: list[Token] = []
    at, line, counted, last = 0, 1, 0, ""
    stack: list[int] = []
    fine = True
    while at < len(text):
        if rules is TS and text[at] == "`":
            start, end, kind = at, _template_end(text, at), "string"
        elif rules is TS and text[at] == "/" and (not last or last in _BEFORE_REGEX) and (m := _REGEX.match(text, at)):
            start, end, kind = at, m.end(), "string"
        elif text[at].isspace():
            at += 1
            continue
        else:
            m = rules.match(text, at)
            if not m:
                at += 1
                continue
            start, end, kind = at, m.end(), m.lastgroup
        line += text.count("\n", counted, start)
        counted = start
        token = Token(kind, text[start:end], start, end, line)
        if kind == "punct" and token.text in OPEN:
            stack.append(len(out))
        elif kind == "punct" and token.text in CLOSE:
            if stack and OPEN.index(out[stack[-1]].text) == CLOSE.index(token.text):
                token.mate = stack.pop()
                out[token.mate].mate = len(out)
            else:
                fine = False
        out.append(token)
        if kind != "comment":
            last = token.text
        at = end
    return out, fine and not stack


def end_line(token: Token) -> int:
    return token.line + token.text.count("\n")


def chain_start(tokens: list[Token], k: int, dots: tuple[str, ...], keywords: frozenset[str]) -> int | None:
    """Index where the member chain that ends with the name at k starts: a, a.b, a().b, a[0].b."""
    start = k
    while start >= 2 and tokens[start - 1].text in dots:
        p = start - 2
        while tokens[p].text in (")", "]") and tokens[p].mate > 0 and (tokens[tokens[p].mate - 1].kind == "name" and tokens[tokens[p].mate - 1].text not in keywords or tokens[tokens[p].mate - 1].text in (")", "]")):
            p = tokens[p].mate - 1
        if tokens[p].text in (")", "]", "}") and tokens[p].mate >= 0:
            p = tokens[p].mate
        elif tokens[p].kind not in ("name", "string", "number"):
            return None
        start = p
    return start


def resolve_name(name: str, here: dict[str, str]) -> str:
    """A called name as a qualified one, if the file defines it or its last segment."""
    return here.get(name) or here.get(name.rpartition(".")[2]) or name
