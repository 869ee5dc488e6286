"""The commands over a project on disk: each gives plain data for the envelope."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import definitions, edits, lookup, reach, relations, search
from . import store

MARK = "<!-- lattisym guide -->"


def _rows(df: DataFrame) -> list[dict]:
    return [x.asDict(recursive=True) for x in df.collect()]


class Project:
    """A project's stored graph and the commands on it."""

    def __init__(self, spark: SparkSession, root: str | Path, place: str | None = None):
        self.spark, self.root = spark, Path(root).resolve()
        self.place = place or (self.root / ".lattisym").as_uri()
        self.graph = store.load_or_build(spark, str(self.root), self.place)

    def _known(self, file: str) -> None:
        if lookup.file_names(self.graph.nodes, self.graph.files).where(F.col("file_path") == file).isEmpty():
            raise FileNotFoundError(f"the graph has no file {file!r}")

    def _first(self, name: str, file: str | None = None) -> DataFrame:
        found = lookup.first_candidate(self.graph.nodes, name, file)
        if found.isEmpty():
            raise ValueError(f"no symbol {name!r} in the graph")
        return found

    def files(self, glob=None, path=None, summary=False, no_tests=False, no_private=False) -> list:
        if not summary:
            return [x.file_path for x in lookup.list_files(lookup.file_names(self.graph.nodes, self.graph.files), path, glob).collect()]
        rows = lookup.summarize_files(self.graph.nodes, path, glob, no_tests, no_private).orderBy("file_path").collect()
        return [{"file": x.file_path, "symbols": list(x.signatures)} for x in rows]

    def outline(self, file: str, depth: str = "top", kind: str | None = None) -> dict:
        self._known(file)
        rows = _rows(lookup.outline(self.graph.nodes, file, depth, kind).drop("parent_name"))
        imports = self.graph.files.where(F.col("file_path") == file).select(F.explode("imports").alias("i")).select("i.*")
        return {"file": file, "symbols": [{k: v for k, v in x.items() if v} for x in rows], "imports": _rows(imports)}

    def locate(self, name: str, kind=None, file=None, match: str = "exact") -> list[dict]:
        return _rows(lookup.locate(self.graph.nodes, name, kind, file, match, self.graph.grams).withColumnRenamed("file_path", "file"))

    def body(self, name: str, file: str | None = None, asked_in: str | None = None) -> dict:
        """The source of the first candidate, or of the one that a file's imports lead to (`asked_in`)."""
        found = lookup.search_symbols(self.graph.nodes, name)
        found = found.where(F.col("file_path") == file) if file else found
        if asked_in:
            found = definitions.definition(self.graph.nodes, self.graph.imports, found, asked_in, name)
        rows = _rows(lookup.bodies(found.orderBy(*lookup.ORDER).limit(1), self.graph.sources))
        if not rows:
            raise ValueError(f"no symbol {name!r} in the graph")
        x = rows[0]
        return {"file": x["file_path"], "line": x["line_start"], "end_line": x["line_end"], "name": x["name"], "kind": x["kind"], "source": x["body"], "content_hash": x["content_hash"]}

    def usages(self, name: str, path=None, kind=None, limit: int = 50, no_tests: bool = False) -> list[dict]:
        first = lookup.first_candidate(self.graph.nodes, name)
        rows = relations.usages(self.graph.nodes, self.graph.edges, first, path, kind, not no_tests, limit)
        return _rows(rows.drop("target").withColumnRenamed("file_path", "file"))

    def imports(self, file: str, depth: int = 1, include_external: bool = False) -> dict:
        self._known(file)
        own = [{"module": x.module, "file": x.resolved, "names": list(x.names)} | ({"external": True} if x.external else {}) for x in relations.imports_of(self.graph.files, file, include_external, self.graph.imports).collect()]
        back = relations.imported_by(self.graph.files, self.graph.imports).where(F.col("resolved") == file).orderBy("file_path")
        return {"file": file, "imports": own, "imported_by": [{"file": x.file_path, "module": x.module, "names": list(x.names)} for x in back.collect()]}

    def search(self, query: str, limit: int = 20) -> list[dict]:
        return _rows(search.search(self.graph.nodes, query, limit, self.graph.grams).drop("score").withColumnRenamed("file_path", "file"))

    def overview(self) -> dict:
        n, e = self.graph.nodes, self.graph.edges
        return _rows(relations.overview_totals(n, e))[0] | {
            "languages": [x.language for x in relations.languages(n).collect()],
            "structure": _rows(relations.overview_structure(n)),
            "key_files": _rows(relations.key_files(n, e).withColumnRenamed("file_path", "file")),
            "entry_points": _rows(relations.entry_points(n).withColumnRenamed("file_path", "file")),
        }

    def _tests(self, seeds: DataFrame, depth: int) -> list[dict]:
        rows = reach.transitive_tests(self.graph.nodes, self.graph.edges, seeds, depth).orderBy("indirect", "qualified_name")
        return _rows(rows.select("name", F.col("file_path").alias("file"), "indirect"))

    def blast_radius(self, name: str, depth: int = 3, file: str | None = None) -> dict:
        first = self._first(name, file)
        seeds = first.select(F.col("qualified_name").alias("seed"))
        found = reach.impact_radius(self.graph.nodes, self.graph.edges, seeds, depth, pairs=self.graph.pairs).orderBy("depth", "qualified_name")
        rows = _rows(found.select(F.col("name").alias("symbol"), F.col("file_path").alias("file"), F.col("line_start").alias("line"), "depth", "kind"))
        return {"symbol": name, "file": first.first().file_path, "affected": rows, "affected_files": sorted({x["file"] for x in rows}), "tests": self._tests(seeds, 2), "total_affected": len(rows)}

    def dead_code(self, file: str | None = None) -> list[dict]:
        rows = relations.dead_code(self.graph.nodes, self.graph.edges, file)
        return _rows(rows.select(F.col("name").alias("symbol"), F.col("file_path").alias("file"), F.col("line_start").alias("line"), "kind", F.col("parent_name").alias("parent")))

    def test_coverage(self, name: str, depth: int = 2, file: str | None = None) -> dict:
        first = self._first(name, file)
        tests = self._tests(first.select(F.col("qualified_name").alias("seed")), depth)
        return {"symbol": name, "file": first.first().file_path, "tests": tests, "total_tests": len(tests), "covered": bool(tests)}

    def _edit(self, name: str, file: str | None, expect: str | None, code: str, column: str, run) -> tuple[dict, dict]:
        x = edits.one_candidate(self.graph.nodes, name, file)
        path = self.root / x.file_path
        if not path.exists():
            raise ValueError(f"{x.file_path!r} is in the graph but no longer on disk")
        text = path.read_text(encoding="utf-8", errors="replace")
        rows = self.spark.createDataFrame([(x.file_path, text, x.line_start, x.line_end, code)], f"file_path string, source string, line_start int, line_end int, {column} string")
        edits.check_hash(rows.select(X.content_hash(F.col("source"))).first()[0], expect)
        made = run(rows, x, text).first().asDict()
        path.write_text(made.pop("source"), encoding="utf-8")
        self.graph = store.load_or_build(self.spark, str(self.root), self.place)
        return made, x.asDict()

    def replace_body(self, name: str, code: str, file: str | None = None, expect_hash: str | None = None) -> dict:
        if not code.strip():
            raise ValueError("an empty body would delete the symbol")
        made, x = self._edit(name, file, expect_hash, code, "new_body", lambda rows, *_: edits.replace_body(rows))
        return {"file": x["file_path"], "symbol": name, "lines_removed": made["lines_removed"], "lines_added": made["lines_added"], "new_range": [made["first_line"], made["last_line"]]}

    def insert_symbol(self, anchor: str, code: str, position: str = "after", file: str | None = None, expect_hash: str | None = None) -> dict:
        if not code.strip():
            raise ValueError("there is no code to insert")

        def run(rows, x, text):
            above = len(x.decorators or []) if position == "before" else 0  # decorators stay with their symbol
            return edits.insert_symbol(rows.withColumn("line_start", F.col("line_start") - above), position)

        made, x = self._edit(anchor, file, expect_hash, code, "new_code", run)
        return {"file": x["file_path"], "anchor": anchor, "position": position, "lines_added": made["lines_added"], "inserted_range": [made["first_line"], made["last_line"]]}

    def init(self, guide: str = "AGENTS.md") -> dict:
        """Append the guide to the project's agent guide unless it is there."""
        from .guide import GUIDE

        path = self.root / guide
        text = path.read_text() if path.exists() else ""
        if MARK not in text:
            path.write_text(text + ("\n" if text else "") + f"{MARK}\n{GUIDE['overview']}\n\n{GUIDE['workflow']}\n")
        return {"file": guide, "added": MARK not in text, "languages": [x.language for x in relations.languages(self.graph.nodes).collect()]}
