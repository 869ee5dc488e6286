"""Lookups on the graph tables: files, outlines, symbols by name path, bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.joins import shuffled
from .search import may_hold

#: The fixed order in which "the first candidate" is meant.
ORDER = ("file_path", "line_start", "qualified_name")


def node(nodes: DataFrame, qualified_name: str) -> DataFrame:
    return nodes.where(F.col("qualified_name") == qualified_name)


def nodes_of_file(nodes: DataFrame, file_path: str) -> DataFrame:
    return nodes.where(F.col("file_path") == file_path)


def edges_to(edges: DataFrame, target: str) -> DataFrame:
    return edges.where(F.col("target_qualified") == target)


def nodes_named(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """The nodes whose qualified_name is in names(qualified_name)."""
    return nodes.join(shuffled(names.select("qualified_name")), "qualified_name", "left_semi")


def file_names(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Files that have nodes or a file row."""
    return nodes.select("file_path").union(files.select("file_path")).distinct()


def file_records(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """One record per file: its symbols (in order of line), imports, error and hash."""
    symbols = nodes.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("line_start", "qualified_name", "kind", "name", "signature", "parent_name"))).alias("symbols"))
    return file_names(nodes, files).join(shuffled(symbols), "file_path", "left").join(shuffled(files), "file_path", "left")


def stats(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row: total_nodes, total_edges, total_files."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    # three one-row tables
    return count(nodes, "total_nodes").join(count(edges, "total_edges"), F.lit(True)).join(count(file_names(nodes, files), "total_files"), F.lit(True))


def list_files(files: DataFrame, prefix: str | None = None, glob: str | None = None) -> DataFrame:
    out = files.select("file_path").distinct()
    if prefix:
        out = out.where(F.col("file_path").startswith(prefix))
    if glob:
        out = out.where(F.col("file_path").rlike(X.glob_to_regex(glob)))
    return out.orderBy("file_path")


def summarize_files(nodes: DataFrame, prefix: str | None = None, glob: str | None = None, no_tests: bool = False, no_private: bool = False) -> DataFrame:
    """(file_path, signatures): signatures of the top-level symbols in order; files without any are left out."""
    top = nodes.where("parent_name is null")
    if prefix:
        top = top.where(F.col("file_path").startswith(prefix))
    if glob:
        top = top.where(F.col("file_path").rlike(X.glob_to_regex(glob)))
    if no_tests:
        top = top.where(~X.is_listed_test(F.col("file_path")))
    if no_private:
        top = top.where(~F.col("name").startswith("_"))
    in_order = F.array_sort(F.collect_list(F.struct("line_start", "qualified_name", "signature")))
    return top.groupBy("file_path").agg(in_order.alias("s")).select("file_path", F.transform("s", lambda x: x["signature"]).alias("signatures"))


def outline(nodes: DataFrame, file_path: str, depth: str = "top", kind: str | None = None) -> DataFrame:
    """(name, kind, line, signature, docstring, children, decorators) of a file; empty texts and lists are null."""
    out = nodes_of_file(nodes, file_path)
    if depth == "top":
        out = out.where("parent_name is null")
    if kind:
        out = out.where(F.col("kind") == kind)
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return out.select("name", "kind", F.col("line_start").alias("line"), "signature", F.nullif(F.col("docstring"), F.lit("")).alias("docstring"), some("children"), some("decorators"), "parent_name").orderBy("line", "name")


def _ends_with(path: Column, parts: list[str], whole: bool) -> Column:
    have = F.split(path, "/")
    if whole:
        return have == F.array(*map(F.lit, parts))
    return (F.size(have) >= len(parts)) & (F.slice(have, F.greatest(F.size(have) - len(parts) + 1, F.lit(1)), len(parts)) == F.array(*map(F.lit, parts)))


def locate(nodes: DataFrame, path: str, kind: str | None = None, file_path: str | None = None, match: str = "exact", index: DataFrame | None = None) -> DataFrame:
    """Where a symbol is defined. `Class/method` names a path, a leading slash anchors it at the top; a single name can match as a substring. `index` are the stored runs of the nodes."""
    anchored, parts = path.startswith("/"), path.lstrip("/").split("/")
    if len(parts) == 1:
        if match == "substring":
            nodes = may_hold(nodes, [(parts[0].lower(), ("name",))], index)
        keep = F.lower("name").contains(parts[0].lower()) if match == "substring" else F.col("name") == parts[0]
        if anchored:
            keep = keep & F.col("parent_name").isNull()
    else:
        keep = (F.col("name") == parts[-1]) & F.col("parent_name").isNotNull() & _ends_with(F.col("parent_name"), parts[:-1], anchored)
    if kind:
        keep = keep & (F.col("kind") == kind)
    if file_path:
        keep = keep & (F.col("file_path") == file_path)
    return nodes.where(keep).select("file_path", F.col("line_start").alias("line"), "kind", "name", "signature", "docstring", F.col("parent_name").alias("parent")).orderBy("file_path", "line")


def search_symbols(nodes: DataFrame, path: str) -> DataFrame:
    """Candidates for a name path as the analyses take it: name; parent and name (the parent's last part is enough); or the whole path."""
    parts = path.split("/")
    keep = F.col("name") == parts[-1]
    if len(parts) == 2:
        keep = keep & ((F.col("parent_name") == parts[0]) | F.col("parent_name").endswith("/" + parts[0]))
    elif len(parts) > 2:
        keep = keep & (F.col("parent_name") == "/".join(parts[:-1]))
    return nodes.where(keep).orderBy(*ORDER)


def first_candidate(nodes: DataFrame, path: str, file_path: str | None = None) -> DataFrame:
    found = search_symbols(nodes, path)
    return (found.where(F.col("file_path") == file_path) if file_path else found).limit(1)


def body(nodes: DataFrame, sources: DataFrame, path: str, file_path: str | None = None) -> DataFrame:
    """(file_path, qualified_name, name, kind, line_start, line_end, body, content_hash) of the first candidate; sources(file_path, source)."""
    return bodies(first_candidate(nodes, path, file_path), sources)


def bodies(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """The source lines of each node."""
    out = nodes.join(shuffled(sources.select("file_path", "source")), "file_path")
    text = F.array_join(F.slice(X.lines(F.col("source")), F.col("line_start"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0))), "\n")
    return out.select("file_path", "qualified_name", "name", "kind", "line_start", "line_end", text.alias("body"), X.content_hash(F.col("source")).alias("content_hash"))
