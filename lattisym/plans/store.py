"""Stored graphs: snapshots of Parquet tables behind numbered pointers, built and kept fresh by content hash.

A snapshot has the tables nodes, edges, files and sources, and four that are made of them: postings for full-text search, grams for parts of names, pairs of neighbours for
reachability, and imports with the files that they mean. All are dealt into buckets by file path, sorted by what they are looked up by, with Bloom filters on names, so
a lookup opens few row groups. A manifest names for each bucket the snapshot folder that holds it and counts its rows; a refresh reads and writes only the buckets that
it touches and shares the others.

Each state is a file with the next number, put in place by a rename that replaces nothing. So readers see one state or the other, a failed write leaves the
old one, and of two writers that began from the same state the second gets ConflictingWrite; `update` then redoes its change on the new state. Folders that
neither the last state nor the one before needs are removed afterwards, but only such as earlier states name: never those of a writer that is still at work.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema
from ..functions import text as X
from ..functions.joins import shuffled
from ..operators import extract, relations, search
from ..operators.reach import both_ways, shared_folder
from ..operators.resolve import last_name, resolve_calls

#: What the rows of a bucket are sorted by: lookups by file, edge target, word, part and neighbour skip most row groups.
LAYOUT = {"nodes": "file_path", "edges": "target_qualified", "files": "file_path", "sources": "file_path", "postings": "token", "grams": "gram", "pairs": "a", "imports": "last"}
SCHEMAS = {"nodes": schema.NODES, "edges": schema.STORED_EDGES, "files": schema.FILES, "sources": schema.SOURCES, "postings": schema.POSTINGS, "grams": schema.GRAMS, "pairs": schema.PAIRS, "imports": schema.RESOLVED_IMPORTS}
#: Columns with a Bloom filter, so that buckets without a name are skipped though they aren't sorted by it.
BLOOM = {"nodes": ("name", "qualified_name"), "edges": ("callee", "target_qualified"), "postings": ("token",), "grams": ("gram",), "pairs": ("a",), "imports": ("last", "resolved")}
#: Bytes of a row group: small, as most lookups want few rows.
ROW_GROUP = 8 << 20
#: Files of a bucket when a graph is first stored, how many times as many make a refresh deal all anew, and the largest number of buckets.
BUCKET_FILES, GROWN, MOST_BUCKETS = 20_000, 4, 4096
#: Kinds of edges whose targets may be resolved.
CALLEES = ("CALLS", "TESTED_BY")


class ConflictingWrite(RuntimeError):
    """Another writer has changed the stored graph since this one loaded it."""


@dataclass
class Graph:
    """The tables of a code graph; a loaded one knows its place and manifest, a refreshed one its dirty buckets and their tables."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    sources: DataFrame | None = None
    postings: DataFrame | None = None
    pairs: DataFrame | None = None
    grams: DataFrame | None = None
    imports: DataFrame | None = None
    base: str | None = None
    place: str | None = None
    held: dict | None = None
    dirty: list[int] | None = None
    parts: dict[str, DataFrame] | None = None


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def build(sources: DataFrame, kinds: tuple[str, ...] = ("CALLS",), mirror: bool = False, keep=_cut) -> Graph:
    """Parse sources(file_path, source) and resolve calls. `keep` cuts the parsed rows' lineage, so each file is parsed once; a checkpoint by default."""
    parsed = keep(extract.parse_files(sources, mirror))
    nodes = extract.nodes_of(parsed)
    return Graph(nodes, resolve_calls(extract.edges_of(parsed), nodes, kinds), extract.files_of(parsed), sources)


def hashes(sources: DataFrame) -> DataFrame:
    return sources.select("file_path", X.content_hash(F.col("source")).alias("content_hash"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, status) of two (file_path, content_hash) states: added, changed, deleted or same."""
    a, b = old.select("file_path", F.col("content_hash").alias("before")), new.select("file_path", F.col("content_hash").alias("now"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("before") != F.col("now"), "changed").otherwise("same")
    return a.join(b, "file_path", "full_outer").select("file_path", status.alias("status"))


def replace_files(table: DataFrame, touched: DataFrame, new: DataFrame) -> DataFrame:
    """The table without the rows of touched(file_path), and with the new rows."""
    return table.join(shuffled(touched.select("file_path").distinct()), "file_path", "left_anti").unionByName(new.select(*table.columns))


def remove_files(graph: Graph, touched: DataFrame) -> Graph:
    """The graph without all rows of the files."""
    gone = touched.select("file_path").distinct()
    cut = lambda df: df.join(shuffled(gone), "file_path", "left_anti") if df is not None else None
    return Graph(cut(graph.nodes), cut(graph.edges), cut(graph.files), cut(graph.sources))


def refresh(graph: Graph, sources: DataFrame, kinds: tuple[str, ...] = ("CALLS",), mirror: bool = False, keep=_cut) -> Graph:
    """The graph of a new state of all sources: only added and changed files are parsed. The graph itself if nothing changed."""
    change = keep(diff(graph.files, hashes(sources)).where("status <> 'same'"))
    return graph if change.isEmpty() else apply(graph, change, sources, kinds, mirror, keep)


def apply(graph: Graph, change: DataFrame, sources: DataFrame, kinds: tuple[str, ...] = ("CALLS",), mirror: bool = False, keep=_cut) -> Graph:
    """The graph after change(file_path, status); sources has at least the added and changed files.

    How a call is resolved depends on the nodes of its name alone, besides its file. So of the edges of other files only those whose name a changed
    file has now or had before are resolved anew, against the nodes of those names. Likewise of the imports of other files only those whose last part an added or
    deleted file answers to. Of a stored graph only the buckets of changed files are read, and row groups that may hold such names.
    """
    new = sources.join(change.where("status in ('added', 'changed')"), "file_path", "left_semi")
    parsed = keep(extract.parse_files(new, mirror))
    fresh, own = extract.nodes_of(parsed), extract.edges_of(parsed)
    stored = graph.held is not None
    near = _buckets_of(change, graph.held["buckets"]) if stored else None
    before = _part(graph, "nodes", near)
    names = keep(before.join(change, "file_path", "left_semi").select("name").union(fresh.select("name")).distinct())
    # edges of other files that hang on these names
    others = _edges_named(graph, names, kinds).join(change.select("file_path"), "file_path", "left_anti")
    touched = keep(others.select(*_columns("edges")[:-1]))
    answered = relations.answers(change.where("status <> 'changed'").select("file_path"))
    moved = keep(_imports_named(graph, answered).join(change.select("file_path"), "file_path", "left_anti").select("file_path").distinct())
    dirty = change.select("file_path").union(touched.select("file_path")).union(moved).distinct()
    here = _buckets_of(dirty, graph.held["buckets"]) if stored else None
    nodes = replace_files(_part(graph, "nodes", here), change, fresh)
    kept = _part(graph, "edges", here).join(change.select("file_path"), "file_path", "left_anti")
    rest = kept.join(shuffled(touched), touched.columns, "left_anti") if stored else _without_names(kept, names, kinds)
    todo = keep(touched.unionByName(own))
    wanted = todo.where(F.col("kind").isin(*kinds)).select(last_name(F.col("raw_target")).alias("name")).distinct()
    imports = rest.where("kind = 'IMPORTS'").where(~X.is_bare(F.col("target_qualified"))).select("file_path", F.substring_index("target_qualified", "::", 1).alias("imported"))
    known = _nodes_named(graph, wanted).join(change.select("file_path"), "file_path", "left_anti").unionByName(fresh.join(shuffled(wanted), "name", "left_semi").select("name", "qualified_name", "file_path"))
    edges = rest.unionByName(resolve_calls(todo, known, kinds, imports))
    files = replace_files(_part(graph, "files", here), change, extract.files_of(parsed))
    texts = replace_files(_part(graph, "sources", here), change, new) if graph.sources is not None else sources
    if not stored:
        return Graph(nodes, edges, files, texts)
    parts = {"nodes": nodes, "edges": edges, "files": files, "sources": texts}
    away = [b for b in range(graph.held["buckets"]) if b not in set(here)]
    whole = {t: _part(graph, t, away).unionByName(df.select(*_part(graph, t, []).columns)) for t, df in parts.items()}
    # imports of files in dirty buckets: those that hang on added or deleted files, and those of changed files, are looked up among all files anew
    parts["imports"] = _resolved_again(graph, parts["files"], here, change, moved, whole["files"])
    return Graph(**whole, base=graph.base, place=graph.place, held=graph.held, dirty=here, parts=parts)


def _bucket(buckets: int):
    return F.expr(f"cast(pmod(xxhash64(file_path), {buckets}) as int)")


def _buckets_of(files: DataFrame, buckets: int) -> list[int]:
    """The buckets of files(file_path): at most MOST_BUCKETS numbers."""
    return sorted(x.b for x in files.select(_bucket(buckets).alias("b")).distinct().collect())


def _part(graph: Graph, table: str, buckets: list[int] | None) -> DataFrame:
    """The rows of some buckets of a stored graph, whose other buckets aren't opened; all rows of another graph."""
    if graph.held is None or buckets is None:
        return getattr(graph, table)
    spark = graph.nodes.sparkSession
    return _view(table, _table(spark, graph.place, graph.held, table, buckets))


def _view(table: str, rows: DataFrame) -> DataFrame:
    return rows.drop("callee") if table == "edges" else rows


#: Names up to which they're a filter that Parquet's statistics and Bloom filters answer.
FEW = 1000


def _narrow(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """The rows whose column is in names (one column): a few names are pushed to the scan, more are joined."""
    (name,) = names.columns
    some = [x[0] for x in names.where(F.col(name).isNotNull()).limit(FEW + 1).collect()]
    if len(some) <= FEW:
        return rows.where(F.col(column).isin(some))
    return rows.join(shuffled(names.withColumnRenamed(name, "__wanted")), F.col(column) == F.col("__wanted"), "left_semi")


def _edges_named(graph: Graph, names: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Edges of the kinds whose target ends with one of names(name)."""
    if graph.held is None:
        rows = graph.edges.where(F.col("kind").isin(*kinds)).withColumn("callee", last_name(F.col("raw_target")))
    else:
        rows = _table(graph.nodes.sparkSession, graph.place, graph.held, "edges").where(F.col("kind").isin(*kinds))
    return _narrow(rows, "callee", names)


def _without_names(edges: DataFrame, names: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    keyed = edges.withColumn("__name", F.when(F.col("kind").isin(*kinds), last_name(F.col("raw_target"))))
    return keyed.join(shuffled(names.withColumnRenamed("name", "__name")), "__name", "left_anti").select(*edges.columns)


def _nodes_named(graph: Graph, names: DataFrame) -> DataFrame:
    """name, qualified_name, file_path of the nodes with one of names(name)."""
    return _narrow(graph.nodes.select("name", "qualified_name", "file_path"), "name", names)


def _imports_named(graph: Graph, lasts: DataFrame) -> DataFrame:
    """Imports whose module ends with one of lasts(last), by file_path. Of a graph without stored imports none: it resolves them when asked."""
    if graph.imports is None:
        return graph.files.select("file_path").limit(0)
    return _narrow(graph.imports.select("file_path", "last"), "last", lasts)


def _resolved_again(graph: Graph, files: DataFrame, here: list[int], change: DataFrame, moved: DataFrame, every: DataFrame) -> DataFrame:
    """The imports of the files of dirty buckets. Only those of changed files, and of files with an import that may mean another file now, are looked up, among the files that can answer them."""
    again = change.select("file_path").union(moved).distinct()
    same = _part(graph, "imports", here).join(shuffled(again), "file_path", "left_anti")
    rows = relations.import_rows(files.join(shuffled(again), "file_path", "left_semi"))
    lasts = rows.select("last").distinct()
    paths = every.select("file_path")
    able = paths.join(shuffled(relations.answers(paths, keep_path=True).join(shuffled(lasts), "last", "left_semi").select("file_path").distinct()), "file_path", "left_semi")
    return same.unionByName(relations.resolve_imports(rows, able).select(*same.columns))


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    p = _path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file and rename it to path unless there is one: whether it took the place."""
    beside = f"{path}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, beside)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    target, none = _path(spark, path), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(p, target, none)
        return True
    except Py4JJavaError as e:
        found = str(e.java_exception)
        if "UnsupportedFileSystemException" in found and not fs.exists(target) and fs.rename(p, target):
            return True
        fs.delete(p, False)
        if fs.exists(target):
            return False
        raise


def _folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()] if fs.exists(p) else []


def _states(spark: SparkSession, place: str) -> list[int]:
    """The numbers of the stored states, ascending."""
    fs, p = _fs(spark, f"{place}/states")
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(x) for x in names if x.isdigit())


def current(spark: SparkSession, place: str) -> str | None:
    """The name of the current snapshot."""
    numbers = _states(spark, place)
    return _read(spark, f"{place}/states/{numbers[-1]:012d}") if numbers else _read(spark, f"{place}/CURRENT")


def manifest(spark: SparkSession, place: str, name: str) -> dict | None:
    """buckets: how many; tables: for each table the snapshot folder of each bucket that has rows; counts: rows of each bucket. None for snapshots of the first layout."""
    text = _read(spark, f"{place}/{name}/manifest.json")
    return json.loads(text) if text else None


def _stored_form(table: str, df: DataFrame) -> DataFrame:
    """The columns as they are written."""
    if table == "edges":
        df = df.withColumn("callee", F.when(F.col("kind").isin(*CALLEES), last_name(F.col("raw_target"))))
    return df.select(*_columns(table))


def _write(df: DataFrame, path: str, table: str, buckets: int, only: list[int] | None) -> None:
    rows = _stored_form(table, df).withColumn("bucket", _bucket(buckets))
    if only is not None:
        rows = rows.where(F.col("bucket").isin(only))
    rows = rows.repartition(buckets if only is None else max(1, len(only)), "bucket") if buckets > 1 else rows.coalesce(1)
    out = rows.sortWithinPartitions("bucket", LAYOUT[table]).write.partitionBy("bucket").option("parquet.block.size", ROW_GROUP)
    for column in BLOOM.get(table, ()):
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
    out.parquet(f"{path}/{table}")


def _columns(table: str) -> list[str]:
    return StructType.fromDDL(SCHEMAS[table]).names


def _table(spark: SparkSession, place: str, found: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
    held = found["tables"].get(table, {})
    keys = held if buckets is None else [str(b) for b in buckets if str(b) in held]
    paths = [f"{place}/{held[b]}/{table}/bucket={b}" for b in keys]
    return spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[table])


def save(spark: SparkSession, graph: Graph, place: str, root: str = "", buckets: int | None = None) -> str:
    """Write a snapshot below place and make it the current state; returns its name. A refreshed graph writes only the buckets that differ from its base.

    ConflictingWrite if another state has come since the graph's base was loaded, or since this write began.
    """
    name, before, number = f"snapshot-{uuid.uuid4().hex}", current(spark, place), (_states(spark, place) or [0])[-1] + 1
    if graph.base is not None and graph.place == place and graph.base != before:
        raise ConflictingWrite(f"{place} is at {before}, this graph was loaded at {graph.base}")
    old = graph.held if graph.dirty is not None and graph.base is not None and graph.base == before else None
    only = graph.dirty if old else None
    if only is not None:
        files = sum(old["counts"]["files"].values())
        if old["buckets"] < MOST_BUCKETS and files > GROWN * BUCKET_FILES * old["buckets"]:
            only = None  # grown: all are dealt anew
        else:
            buckets = old["buckets"]
    if buckets is None:
        buckets = max(1, min(MOST_BUCKETS, -(-graph.files.count() // BUCKET_FILES)))
    new: dict = {"buckets": buckets, "tables": {}, "counts": {}}

    def put(table: str, df: DataFrame | None) -> None:
        if df is not None:
            _write(df, f"{place}/{name}", table, buckets, only)
        made = {x.removeprefix("bucket="): name for x in _folders(spark, f"{place}/{name}/{table}") if x.startswith("bucket=")}
        kept = {} if only is None else {b: f for b, f in old["tables"][table].items() if int(b) not in only}
        new["tables"][table] = kept | made

    for table in ("nodes", "edges", "files", "sources"):
        put(table, graph.parts[table] if only is not None else getattr(graph, table))
    # made of what was just written, so of the same buckets
    own = {"buckets": buckets, "tables": {t: {b: f for b, f in x.items() if f == name} for t, x in new["tables"].items()}}
    read = lambda t: _table(spark, place, own, t)
    put("postings", search.postings(read("nodes")))
    put("grams", search.grams(read("nodes")))
    put("pairs", both_ways(read("edges"), "file_path"))
    put("imports", graph.parts["imports"] if only is not None else relations.file_imports(read("files")))
    counted = ("nodes", "edges", "files")
    for table in counted:
        kept = {} if only is None else {b: n for b, n in old["counts"][table].items() if int(b) not in only}
        new["counts"][table] = kept | {str(x.bucket): x["count"] for x in _counts(spark, f"{place}/{name}/{table}", own["tables"][table])}
    spark.createDataFrame([("schema_version", str(schema.VERSION)), ("project_root", root)], "key string, value string").coalesce(1).write.parquet(f"{place}/{name}/metadata")
    _overwrite(spark, f"{place}/{name}/manifest.json", json.dumps(new))
    if not _put(spark, f"{place}/states/{number:012d}", name):
        fs, p = _fs(spark, f"{place}/{name}")
        fs.delete(p, True)
        raise ConflictingWrite(f"another writer made state {number} of {place} first")
    clean(spark, place)
    return name


def _counts(spark: SparkSession, path: str, held: dict) -> list:
    return spark.read.parquet(path).groupBy("bucket").count().collect() if held else []


def _overwrite(spark: SparkSession, path: str, text: str) -> None:
    """A file in a folder that no reader knows yet."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def clean(spark: SparkSession, place: str, keep: int = 2) -> None:
    """Remove the states before the last ones, and snapshot folders that only those needed. Folders that no state names (of a writer at work) stay."""
    numbers = _states(spark, place)
    named = {k: _read(spark, f"{place}/states/{k:012d}") for k in numbers}

    def needs(name: str) -> set[str]:
        try:
            found = manifest(spark, place, name) or {"tables": {}}
        except (json.JSONDecodeError, UnicodeDecodeError):
            found = {"tables": {}}
        return {name} | {f for t in found["tables"].values() for f in t.values()}

    needed = set().union(*(needs(named[k]) for k in numbers[-keep:])) if numbers else set()
    for k in numbers[:-keep]:
        for folder in needs(named[k]) - needed:
            fs, p = _fs(spark, f"{place}/{folder}")
            fs.delete(p, True)
        fs, p = _fs(spark, f"{place}/states/{k:012d}")
        fs.delete(p, False)


def load(spark: SparkSession, place: str) -> Graph:
    """The current snapshot; FileNotFoundError without one. One of an older layout is read as it is, without the derived tables that it lacks."""
    name = current(spark, place)
    if name is None:
        raise FileNotFoundError(f"no stored graph at {place}")
    version = int(metadata(spark, place).get("schema_version", "0"))
    if version > schema.VERSION:
        raise ValueError(f"stored graph has layout {version}, newer than {schema.VERSION}")
    found = manifest(spark, place, name)
    if found is None:
        read = lambda t: spark.read.parquet(f"{place}/{name}/{t}")
        return Graph(read("nodes"), extract.dedupe_edges(read("edges")), read("files"), read("sources"))
    if version < schema.VERSION:
        return Graph(**{t: _view(t, _table(spark, place, found, t)) for t in ("nodes", "edges", "files", "sources")})
    return Graph(**{t: _view(t, _table(spark, place, found, t)) for t in LAYOUT}, base=name, place=place, held=found)


def totals(graph: Graph) -> dict[str, int]:
    """total_nodes, total_edges, total_files of a stored graph, from the counts that each refresh keeps: no table is read."""
    return {f"total_{t}": sum(n.values()) for t, n in graph.held["counts"].items()}


def update(spark: SparkSession, place: str, change: Callable[[Graph], Graph], root: str = "", attempts: int = 5) -> str | None:
    """Load, change and save; where another writer was faster, again on its state, so both land one after the other. The new snapshot's name; None if nothing changed."""
    for attempt in range(attempts):
        graph = load(spark, place)
        new = change(graph)
        if new is graph:
            return None
        try:
            return save(spark, new, place, root)
        except ConflictingWrite:
            if attempt == attempts - 1:
                raise
    return None


def metadata(spark: SparkSession, place: str) -> dict[str, str]:
    return {x.key: x.value for x in spark.read.schema("key string, value string").parquet(f"{place}/{current(spark, place)}/metadata").collect()}


def put_metadata(table: DataFrame, **values: str) -> DataFrame:
    """The key-value table with the given values put."""
    new = table.sparkSession.createDataFrame(list(values.items()), "key string, value string")
    return table.join(new.select("key"), "key", "left_anti").unionByName(new)


def migrate(spark: SparkSession, place: str) -> bool:
    """Bring a stored graph of an older layout to this one: equal edges become one, rows are dealt into buckets, derived tables are made. Whether there was anything to do."""
    name = current(spark, place)
    if name is None or (manifest(spark, place, name) is not None and int(metadata(spark, place).get("schema_version", "0")) == schema.VERSION):
        return False
    root = metadata(spark, place).get("project_root", "")
    save(spark, load(spark, place), place, root)
    # the old pointer and what it pointed to
    for path in ("CURRENT", name):
        fs, p = _fs(spark, f"{place}/{path}")
        fs.delete(p, True)
    return True


def load_or_build(spark: SparkSession, root: str, place: str) -> Graph:
    """The stored graph of a project, refreshed; built if there is none or it cannot be read. What changed is saved. A single-file index of older tools (index.json) is replaced by a build."""
    from ..sources.project import read_sources

    return load_or_build_from(spark, read_sources(spark, root), place, root)


def load_or_build_from(spark: SparkSession, sources: DataFrame, place: str, root: str = "") -> Graph:
    """The same of sources(file_path, source)."""
    legacy = _fs(spark, f"{place}/index.json")
    try:
        if current(spark, place) is not None:
            migrate(spark, place)
            update(spark, place, lambda old: refresh(old, sources), root)
            return load(spark, place)
    except (PySparkException, Py4JJavaError, FileNotFoundError, UnicodeDecodeError, json.JSONDecodeError, KeyError):
        # not readable: built anew, as the next state
        pointer = _fs(spark, f"{place}/CURRENT")
        pointer[0].delete(pointer[1], False)
    save(spark, build(sources), place, root)
    if legacy[0].exists(legacy[1]):
        legacy[0].delete(legacy[1], False)
    return load(spark, place)
