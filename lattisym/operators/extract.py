"""Extraction: one row per source file to nodes, edges and file rows.

Each file is parsed once, in the task that holds it; arrays come back and are exploded by Spark. Parsing is chosen by extension.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import LANGUAGES
from ..schema import PARSED
from .go_source import parse as parse_go
from .python_source import parse as parse_python
from .typescript_source import parse as parse_typescript

#: The backends by extension. Functions, not modules: they travel to the executors by value.
BACKENDS = {".py": parse_python, ".go": parse_go, ".ts": parse_typescript, ".tsx": parse_typescript}


def supported_extensions() -> list[str]:
    return list(BACKENDS)


def get_language(path: str) -> str:
    """The language of a path; ValueError for an extension that no backend reads."""
    ext = "." + path.rpartition("/")[2].rpartition(".")[2]
    if ext not in BACKENDS:
        raise ValueError(f"unsupported file type: {path}")
    return LANGUAGES[ext]


def parse_source(path: str, source: str, mirror: bool = False) -> dict:
    """Symbols, imports, edges and parse_error of one file."""
    get_language(path)
    return BACKENDS["." + path.rpartition("/")[2].rpartition(".")[2]](path, source, mirror)


_IMPORT = pa.struct([("module", pa.string()), ("names", pa.list_(pa.string())), ("line", pa.int32()), ("is_relative", pa.bool_())])
_SYMBOL = pa.struct([(n, t) for n, t in (("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("docstring", pa.string()), ("parent", pa.string()), ("children", pa.list_(pa.string())), ("decorators", pa.list_(pa.string())))])
_EDGE = pa.struct([("kind", pa.string()), ("source", pa.string()), ("target", pa.string()), ("line", pa.int32())])


def _unique(found: dict) -> dict:
    """Of several definitions of one name in a file the last stays, of equal edges one. Keys hold the file, so no shuffle is needed for either."""
    symbols = {(s["parent"], s["name"]): s for s in found["symbols"]}
    edges = {(e["kind"], e["source"], e["target"], e["line"]): e for e in found["edges"]}
    return found | {"symbols": list(symbols.values()), "edges": list(edges.values())}


def _parser(mirror: bool):
    def run(batches):
        for batch in batches:
            paths, sources = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for first in range(0, len(paths), 256):
                some = list(zip(paths[first : first + 256], sources[first : first + 256], strict=True))
                found = [_unique(parse_source(p, s, mirror)) for p, s in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _ in some], pa.string()),
                        pa.array(["sha256:" + hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()[:16] for _, s in some], pa.string()),
                        pa.array([f["parse_error"] for f in found], pa.string()),
                        pa.array([f["imports"] for f in found], pa.list_(_IMPORT)),
                        pa.array([f["symbols"] for f in found], pa.list_(_SYMBOL)),
                        pa.array([f["edges"] for f in found], pa.list_(_EDGE)),
                    ],
                    names=["file_path", "content_hash", "parse_error", "imports", "symbols", "edges"],
                )

    return run


#: Tasks for each core that files are dealt to before they are parsed.
WAVES = 3


def parse_files(files: DataFrame, mirror: bool = False) -> DataFrame:
    """files(file_path, source) to one parsed row per file (see schema.PARSED).

    Parsing takes far longer than a shuffle of the texts, and many small files may come from one split of a table: they are dealt to all cores first.
    """
    known = F.lit(False)
    for ext in BACKENDS:
        known = known | F.col("file_path").endswith(ext)
    tasks = WAVES * files.sparkSession.sparkContext.defaultParallelism
    return files.where(known).select("file_path", "source").repartition(tasks, "file_path").mapInArrow(_parser(mirror), PARSED)


def nodes_of(parsed: DataFrame) -> DataFrame:
    """Symbol nodes, one per qualified name. No shuffle: files are parsed to unique names."""
    rows = parsed.select("file_path", "content_hash", F.explode("symbols").alias("s"))
    return rows.select(
        F.col("s.kind").alias("kind"),
        X.sanitize_name(F.col("s.name")).alias("name"),
        X.qualified_name(F.col("file_path"), F.col("s.parent"), F.col("s.name")).alias("qualified_name"),
        "file_path",
        F.col("s.line").alias("line_start"),
        F.col("s.end_line").alias("line_end"),
        F.col("s.signature").alias("signature"),
        F.col("s.docstring").alias("docstring"),
        X.sanitize_name(F.col("s.parent")).alias("parent_name"),
        F.col("s.decorators").alias("decorators"),
        F.col("s.children").alias("children"),
        F.col("content_hash").alias("file_hash"),
    )


def upsert(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key that comes last in `order`: one grouped maximum, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return last.select(*key, "__row.*").select(*rows.columns)


def edges_of(parsed: DataFrame) -> DataFrame:
    """Raw edges, each (kind, source, target, file, line) once. No shuffle: files are parsed to unique edges."""
    rows = parsed.select("file_path", F.explode("edges").alias("e"))
    return rows.select(F.col("e.kind").alias("kind"), F.col("e.source").alias("source_qualified"), F.col("e.target").alias("target_qualified"), F.col("e.target").alias("raw_target"), "file_path", F.col("e.line").alias("line"))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Edges with one row for each (kind, source_qualified, target_qualified, file_path, line)."""
    key = ["kind", "source_qualified", "target_qualified", "file_path", "line"]
    rest = [c for c in edges.columns if c not in key]
    return edges.groupBy(*key).agg(*(F.min(c).alias(c) for c in rest)).select(*edges.columns) if rest else edges.distinct()


def files_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_path", "content_hash", "parse_error", "imports")


class _Symbols:
    def eval(self, path: str, source: str):
        for s in parse_source(path, source or "")["symbols"]:
            yield s["name"], s["kind"], s["line"], s["end_line"], s["signature"], s["docstring"], s["parent"]


class _Edges:
    def eval(self, path: str, source: str):
        for e in parse_source(path, source or "")["edges"]:
            yield e["kind"], e["source"], e["target"], e["line"]


def register(spark) -> None:
    """Make the extractors SQL table functions: parse_symbols(path, source) and parse_edges(path, source), for LATERAL joins."""
    symbols = F.udtf(_Symbols, returnType="name string, kind string, line int, end_line int, signature string, docstring string, parent string")
    edges = F.udtf(_Edges, returnType="kind string, source string, target string, line int")
    spark.udtf.register("parse_symbols", symbols)
    spark.udtf.register("parse_edges", edges)
