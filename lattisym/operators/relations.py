"""Usages, imports, dead code and the project overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.joins import shuffled

# Names, prefixes and decorator parts of functions that something outside the code base calls.
ENTRY_NAMES = ("main", "__main__", "__init__", "setup", "teardown", "setUp", "tearDown", "cli", "app", "run", "start", "configure", "register")
ENTRY_PREFIXES = ("handle_", "on_", "test_")
FRAMEWORK_DECORATORS = (
    "property", "abstractmethod", "staticmethod", "classmethod", "app.route", "app.get", "app.post", "app.put", "app.delete",
    "cli.command", "click.command", "click.group", "pytest.fixture", "fixture", "override", "overrides",
)
# Symbol names that the overview takes for entry points.
OVERVIEW_ENTRIES = ("main", "__main__", "create_app", "app", "cli", "run", "start")


def usages(nodes: DataFrame, edges: DataFrame, targets: DataFrame, scope: str | None = None, kind: str | None = None, include_tests: bool = True, limit: int | None = 50) -> DataFrame:
    """(target, file_path, line, kind, context): who calls or tests each target(qualified_name, name), by its full or its bare name; each source once, by its first edge."""
    want = targets.select(F.col("qualified_name").alias("target"), F.explode(F.array("qualified_name", "name")).alias("key"), F.col("qualified_name").alias("__full"))
    hits = edges.where(F.col("kind").isin("CALLS", "TESTED_BY")).join(shuffled(want), F.col("target_qualified") == F.col("key"))
    first = F.min(F.struct((F.col("key") != F.col("__full")).alias("bare"), "file_path", "line", "kind"))
    one = hits.groupBy("target", "source_qualified").agg(first.alias("e")).select("target", "source_qualified", "e.file_path", "e.line", F.when(F.col("e.kind") == "TESTED_BY", "test").otherwise("reference").alias("kind"))
    if scope:
        one = one.where(F.col("file_path").startswith(scope))
    if not include_tests:
        one = one.where(~X.is_caller_test(F.col("file_path")))
    if kind:
        one = one.where(F.col("kind") == kind)
    context = nodes.select(F.col("qualified_name").alias("source_qualified"), "signature")
    out = one.join(shuffled(context), "source_qualified", "left").select("target", "file_path", "line", "kind", F.coalesce("signature", F.lit("")).alias("context")).orderBy("target", "file_path", "line", "context")
    return out if limit is None else out.limit(limit)


def module_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(module, resolved) for each distinct module of imports(module): the project file it means, if any.

    Tried in order: a/b.py, a/b/__init__.py, b.py, each as a whole path, then as the end of one. The end match is an equi-join: every file gives all
    suffixes of its path that a module can ask for.
    """
    modules = imports.select("module").distinct()
    path = F.translate("module", ".", "/")
    tried = F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")), F.concat(F.substring_index("module", ".", -1), F.lit(".py")))
    want = modules.select("module", F.posexplode(tried).alias("turn", "suffix"))
    parts = F.split("file_path", "/")
    suffixes = files.select("file_path").distinct().select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("suffix"))
    # of the files with one suffix only the best matters, so popular file names are one row each before the join
    best = suffixes.groupBy("suffix").agg(F.min(F.struct((F.col("file_path") != F.col("suffix")).alias("inner"), "file_path")).alias("best"))
    hit = want.join(shuffled(best), "suffix").groupBy("module").agg(F.min(F.struct("turn", "best.inner", "best.file_path")).alias("m"))
    return hit.select("module", F.col("m.file_path").alias("resolved"))


def import_rows(files: DataFrame) -> DataFrame:
    """(file_path, at, module, names, line, is_relative, last): every import; last is the last part of its module, by which files can answer it."""
    rows = files.select("file_path", F.posexplode("imports").alias("at", "i")).select("file_path", "at", "i.*")
    return rows.withColumn("last", F.substring_index("module", ".", -1))


def answers(files: DataFrame, keep_path: bool = False) -> DataFrame:
    """(last) the last parts of the modules that files(file_path) can be meant by: the name of a .py file, the directory's of an __init__.py."""
    base, above = F.regexp_replace(X.base_name(F.col("file_path")), "[.]py$", ""), F.element_at(F.split(F.concat(F.lit("/"), "file_path"), "/"), -2)
    rows = files.where(F.col("file_path").endswith(".py")).select("file_path", F.explode(F.array(base, F.when(base == "__init__", above))).alias("last")).where("last is not null")
    return rows if keep_path else rows.select("last").distinct()


def resolve_imports(rows: DataFrame, files: DataFrame) -> DataFrame:
    """import_rows with the project file that each means among files(file_path), or null."""
    return rows.join(shuffled(module_files(rows, files)), "module", "left")


def file_imports(files: DataFrame) -> DataFrame:
    """(file_path, at, module, names, line, is_relative, last, resolved): every import with the project file it means, or null."""
    return resolve_imports(import_rows(files), files).select("file_path", "at", "module", "names", "line", "is_relative", "last", "resolved")


def imports_of(files: DataFrame, file_path: str, include_external: bool = False, stored: DataFrame | None = None) -> DataFrame:
    """The imports of a file; `stored` are the resolved imports of a stored graph."""
    own = (file_imports(files) if stored is None else stored).where(F.col("file_path") == file_path)
    return (own if include_external else own.where("resolved is not null")).withColumn("external", F.col("resolved").isNull()).orderBy("at")


def imported_by(files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(resolved, file_path, module, names): for each file the other files that import it, by their first such import."""
    rows = (file_imports(files) if stored is None else stored).where("resolved is not null and resolved <> file_path")
    return rows.groupBy("resolved", "file_path").agg(F.min(F.struct("at", "module", "names")).alias("i")).select("resolved", "file_path", "i.module", "i.names")


def dead_code(nodes: DataFrame, edges: DataFrame, file_path: str | None = None) -> DataFrame:
    """Functions and methods that no CALLS edge reaches and nothing outside is known to call, by file and line."""
    rows = nodes.where(F.col("kind").isin("function", "method"))
    if file_path:
        rows = rows.where(F.col("file_path") == file_path)
    name, path = F.col("name"), F.col("file_path")
    keep = ~name.isin(*ENTRY_NAMES, "constructor") & ~(name.startswith("__") & name.endswith("__"))
    for prefix in ENTRY_PREFIXES:
        keep = keep & ~name.startswith(prefix)
    keep = keep & ~X.is_uncalled_test(path) & ~path.endswith("conftest.py")
    framed = F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: X.any_part(d, FRAMEWORK_DECORATORS))
    called = edges.where("kind = 'CALLS'").select(F.col("target_qualified").alias("qualified_name")).distinct()
    return rows.where(keep & ~framed).join(shuffled(called), "qualified_name", "left_anti").select(*nodes.columns).orderBy("file_path", "line_start", "qualified_name")


def directory(path):
    return F.when(path.contains("/"), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.lit("./"))


def overview_structure(nodes: DataFrame, skip_tests: bool = True) -> DataFrame:
    """(directory, files, classes, functions)"""
    by_file = nodes.groupBy("file_path").agg(F.count_if(F.col("kind") == "class").alias("c"), F.count_if(F.col("kind").isin("function", "method")).alias("f"))
    out = by_file.groupBy(directory(F.col("file_path")).alias("directory")).agg(F.count("*").alias("files"), F.sum("c").alias("classes"), F.sum("f").alias("functions"))
    return out.where(~X.any_part(F.col("directory"), X.SKIPPED_DIRECTORIES)).orderBy("directory") if skip_tests else out.orderBy("directory")


def file_importance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, importance): edges into a file's symbols, and twice the IMPORTS edges whose target is the file itself."""
    into = edges.groupBy("target_qualified").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "IMPORTS").alias("imports"))
    inside = nodes.select("file_path", "qualified_name").join(shuffled(into), F.col("qualified_name") == F.col("target_qualified")).select("file_path", F.col("n").alias("s"))
    names = nodes.select("file_path").distinct()
    whole = names.join(shuffled(into), F.col("file_path") == F.col("target_qualified")).select("file_path", (2 * F.col("imports")).alias("s"))
    return inside.unionByName(whole).groupBy("file_path").agg(F.sum("s").alias("importance"))


def key_files(nodes: DataFrame, edges: DataFrame, show: int = 7, members: int = 5) -> DataFrame:
    """(file_path, importance, classes, functions) of the most depended-on files, with up to five classes and public functions."""
    top = file_importance(nodes, edges).where("importance > 0").orderBy(F.desc("importance"), "file_path").limit(show)
    listed = lambda keep: F.transform(F.slice(F.array_sort(F.collect_list(F.when(keep, F.struct("line_start", "name")))), 1, members), lambda x: x["name"])
    inside = nodes.join(top, "file_path").groupBy("file_path", "importance").agg(listed(F.col("kind") == "class").alias("classes"), listed((F.col("kind") == "function") & ~F.col("name").startswith("_")).alias("functions"))
    return inside.orderBy(F.desc("importance"), "file_path")


def entry_points(nodes: DataFrame, show: int = 5) -> DataFrame:
    """(file_path, symbol): the first symbol of a file that is named like an entry point."""
    named = nodes.where(F.col("name").isin(*OVERVIEW_ENTRIES) | F.col("name").startswith("@"))
    return named.groupBy("file_path").agg(F.min(F.struct("line_start", "name")).alias("x")).select("file_path", F.col("x.name").alias("symbol")).orderBy("file_path").limit(show)


def languages(nodes: DataFrame) -> DataFrame:
    return nodes.select(X.language(F.col("file_path")).alias("language")).where("language is not null").distinct().orderBy("language")


def overview_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total_files, total_symbols, total_edges, test_files, source_files."""
    by_file = nodes.groupBy("file_path").agg(F.count("*").alias("n"))
    test = X.is_counted_test(F.col("file_path"))
    left = by_file.agg(F.count("*").alias("total_files"), F.sum("n").alias("total_symbols"), F.count_if(test).alias("test_files"), F.count_if(~test).alias("source_files"))
    return left.join(edges.agg(F.count("*").alias("total_edges")), F.lit(True))
