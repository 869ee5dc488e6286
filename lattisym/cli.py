"""Command line: `python -m lattisym.cli [--project DIR] COMMAND ...`; answers are YAML envelopes."""

from __future__ import annotations

import argparse
import shlex
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import bench, envelope, guide
from .plans.commands import Project
from .sources.project import find_project_root


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lattisym")
    top.add_argument("--project")
    top.add_argument("--state", help="where the graph is stored (default: .lattisym in the project)")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *names: str, **options):
        p = sub.add_parser(name)
        for x in names:
            p.add_argument(x)
        for key, how in options.items():
            p.add_argument("--" + key.replace("_", "-"), **how)
        return p

    text, flag = {"default": None}, {"action": "store_true"}
    add("files", glob=text, path=text, summary=flag, no_tests=flag, no_private=flag)
    add("overview")
    add("outline", "file", depth={"choices": ["top", "full"], "default": "top"}, kind={"choices": ["class", "function", "method", "variable", "import"]})
    add("locate", "name", kind={"choices": ["class", "function", "method", "variable"]}, file=text, match={"choices": ["exact", "substring"], "default": "exact"})
    add("usages", "name", path=text, kind={"choices": ["call", "import", "assignment", "reference", "definition"]}, limit={"type": int, "default": 50}, no_tests=flag)
    add("imports", "file", depth={"type": int, "default": 1}, include_external=flag)
    add("body", "name", file=text, asked_in=text)
    add("search", "query", limit={"type": int, "default": 20})
    add("replace-body", "name", file=text, expect_hash=text)
    add("insert-symbol", after=text, before=text, file=text, expect_hash=text)
    add("blast-radius", "name", depth={"type": int, "default": 3}, file=text)
    add("dead-code", file=text)
    add("test-coverage", "name", depth={"type": int, "default": 2}, file=text)
    add("init")
    add("help").add_argument("topic", nargs="?")
    p = add("benchmark", "action", queries={"default": "benchmarks/queries"}, query=text, save=text)
    p.add_argument("file", nargs="?")
    return top


def answer(project: Project, args: argparse.Namespace, code: str = "") -> str:
    """The envelope of one parsed command."""
    name = args.command
    options = {k: v for k, v in vars(args).items() if k not in ("command", "project", "state")}
    try:
        if name == "insert-symbol":
            if (args.after is None) == (args.before is None):
                raise ValueError("Give exactly one of --after and --before")
            result = project.insert_symbol(args.after or args.before, code, "after" if args.after else "before", args.file, args.expect_hash)
        elif name == "replace-body":
            result = project.replace_body(args.name, code, args.file, args.expect_hash)
        else:
            result = getattr(project, name.replace("-", "_"))(**options)
        if name == "usages" and len(result) >= args.limit:
            return envelope.success(name, result, len(result), args.limit)
        return envelope.success(name, result)
    except Exception as e:  # every failure is an envelope
        return envelope.failure(name, str(e))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "help":
        found = guide.lookup(args.topic)
        print(envelope.success("help", found) if found else envelope.failure("help", f"Unknown command: {args.topic}", "Run 'help' for all commands"))
        return int(found is None)
    spark = SparkSession.builder.appName("lattisym").getOrCreate()
    project = Project(spark, args.project or find_project_root(Path.cwd()), args.state)
    if args.command == "benchmark":
        queries = [q for q in bench.load_queries(args.queries) if args.query in (None, q["id"])]
        results = [bench.run_query(q, lambda c: answer(project, parser().parse_args(shlex.split(c)))) for q in queries]
        if args.action == "compare":
            now, base = (spark.createDataFrame([{k: r[k] for k in ("id", "output_bytes", "correct")} for r in rows]) for rows in (results, bench.load_baseline(args.file)))
            rows = bench.compare(now, base).orderBy("id").collect()
            print("\n".join(f"{x.id:<20} {x.byte_delta:>+10} {x.verdict:>12}" for x in rows) + f"\n\nRegressions: {sum(x.verdict == 'REGRESSION' for x in rows)}")
        else:
            print(bench.report(results))
            if args.save:
                bench.save_baseline(results, Path(args.save).parent, Path(args.save).stem)
        return 0
    out = answer(project, args, sys.stdin.read() if args.command in ("replace-body", "insert-symbol") else "")
    print(out)
    return int(out.startswith("ok: false"))


if __name__ == "__main__":
    sys.exit(main())
