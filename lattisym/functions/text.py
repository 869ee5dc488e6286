"""Column expressions on paths, names and source text. All stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and their languages.
LANGUAGES = {".py": "python", ".go": "go", ".ts": "typescript", ".tsx": "typescript"}


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16))


def sanitize_name(name: Column) -> Column:
    """Without control characters (tab, newline and carriage return stay), at most 256 characters."""
    return F.substring(F.regexp_replace(name, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""), 1, 256)


def qualified_name(file_path: Column, parent: Column, name: Column) -> Column:
    return F.concat(file_path, F.lit("::"), F.when(parent.isNotNull(), F.concat(sanitize_name(parent), F.lit("."))).otherwise(F.lit("")), sanitize_name(name))


def is_bare(target: Column) -> Column:
    return ~target.contains("::")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for ext, name in LANGUAGES.items():
        out = F.when(path.endswith(ext), name).otherwise(out)
    return out


def is_caller_test(path: Column) -> Column:
    """Test files as usages see them."""
    return path.startswith("test_") | path.contains("/test_") | path.startswith("tests/")


def is_uncalled_test(path: Column) -> Column:
    """Test files as dead code sees them: the file's own name counts, not that of its first directory."""
    return base_name(path).startswith("test_") | path.contains("/test_") | path.startswith("tests/")


def any_part(path: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in parts:
        out = out | path.contains(x)
    return out


# Parts of a path that mark tests in file lists, in the overview and directories that the overview skips.
LISTED_TESTS = ("test_", "tests/", "test/", "_test.", ".test.", ".spec.", "conftest.py")
COUNTED_TESTS = ("test_", "_test.", ".test.", ".spec.", "conftest", "tests/", "test/")
SKIPPED_DIRECTORIES = ("test/", "tests/", "test_", "fixture")


def is_listed_test(path: Column) -> Column:
    return any_part(path, LISTED_TESTS)


def is_counted_test(path: Column) -> Column:
    return any_part(path, COUNTED_TESTS)


def glob_to_regex(pattern: str) -> str:
    """A Java regex for a shell pattern over a whole path; * crosses slashes."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", k + 1 + (pattern[k : k + 1] == "!"))) > 0:
            body = pattern[k:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            k = end + 1
        else:
            out.append(re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", c))
    return "^(?s:" + "".join(out) + ")$"


def lines(text: Column) -> Column:
    """The lines of a text: any line end counts, a final one adds no line."""
    flat = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n$", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(flat, "\n", -1))


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(F.regexp_replace(line, "\t", " ")))
