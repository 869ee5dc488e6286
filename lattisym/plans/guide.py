"""The command catalogue: what each command does, its options, an example."""

from __future__ import annotations

GUIDE = {
    "overview": "Structural questions about Python, Go and TypeScript code, answered from a stored graph of symbols, calls, imports and tests.",
    "workflow": "Map with 'files --summary', read a file's skeleton with 'outline', find with 'locate' or 'search', read with 'body', trace with 'usages' and 'imports', judge with 'blast-radius' and 'test-coverage', then edit with 'replace-body --expect-hash'.",
    "commands": {
        "files": {"description": "List source files, or with --summary the signatures of their top-level symbols.", "options": ["--glob", "--path", "--summary", "--no-tests", "--no-private"], "example": "files --path src/ --summary"},
        "overview": {"description": "Directories, most depended-on files, entry points, languages and totals.", "options": [], "example": "overview"},
        "outline": {"description": "Classes, functions, signatures and docstrings of a file.", "options": ["--depth top|full", "--kind"], "example": "outline src/app.py --depth full"},
        "locate": {"description": "Where a symbol is defined, by name path; a leading slash anchors it at the top.", "options": ["--kind", "--file", "--match exact|substring"], "example": "locate Server/start"},
        "usages": {"description": "Who calls or tests a symbol.", "options": ["--path", "--kind", "--limit", "--no-tests"], "example": "usages parse_file --no-tests"},
        "imports": {"description": "What a file imports and which files import it.", "options": ["--depth", "--include-external"], "example": "imports src/app.py"},
        "body": {"description": "Source of one symbol, with the hash of its file.", "options": ["--file"], "example": "body Server/start"},
        "search": {"description": "Ranked search over names and docstrings.", "options": ["--limit"], "example": "search parse"},
        "help": {"description": "This catalogue, or one command of it.", "options": ["COMMAND"], "example": "help locate"},
        "replace-body": {"description": "Replace a symbol's source by standard input, indented to fit.", "options": ["--file", "--expect-hash"], "example": "replace-body Server/start --expect-hash sha256:..."},
        "insert-symbol": {"description": "Insert standard input before or after a symbol.", "options": ["--after", "--before", "--file", "--expect-hash"], "example": "insert-symbol --after Server/start"},
        "blast-radius": {"description": "What a change of a symbol can affect, and the tests that cover it.", "options": ["--depth"], "example": "blast-radius Server/start --depth 2"},
        "dead-code": {"description": "Functions and methods that nothing calls.", "options": ["--file"], "example": "dead-code"},
        "test-coverage": {"description": "Tests that reach a symbol directly or through its callers.", "options": ["--depth"], "example": "test-coverage Server/start"},
        "init": {"description": "Append the command guide to an agent guide file and report the project's languages.", "options": [], "example": "init"},
        "benchmark": {"description": "Run benchmark queries with rubrics, or compare with a saved baseline.", "options": ["run [--query ID]", "compare FILE"], "example": "benchmark run"},
    },
}


def lookup(command: str | None = None) -> dict | None:
    """The whole catalogue, one command of it, or None for an unknown one."""
    if command is None:
        return GUIDE
    found = GUIDE["commands"].get(command)
    return None if found is None else {"command": command, **found}
