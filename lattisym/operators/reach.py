"""Bounded reachability by frontier joins: impact radius and transitive tests.

One hop is an equi-join of the frontier with the edges, distinct, and what has not been seen, so cycles end and walks don't
multiply. All seeds run together, told apart by a column. As long as what was reached is small (SMALL rows, counted at each hop), the driver keeps it and sends
the ends of the frontier to the edges, which then are not shuffled. Beyond, frontiers stay distributed and lineage is cut by a checkpoint per hop; names are numbers there, counted in
each task, so that they shrink when they are shuffled, and the pairs become one row of sorted neighbours per node, several for a hub, that each hop is joined with. Names come back at the end.
"""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructType

from ..functions.joins import shuffled

#: Rows of (seed, node) up to which a walk is kept on the driver; both ways are exact.
SMALL = 50_000
#: Distinct nodes up to which a frontier is also a filter on the stored pairs.
FEW = 100
#: Neighbours of a row of a wide walk; a node with more has several rows.
HUB = 1024


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, where checkpoints go. Where it is unset a temporary folder, on a single machine only."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not place and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(place or "file://" + tempfile.mkdtemp(prefix="lattisym-graph-"))
    return place or sc._jsc.sc().getCheckpointDir().get()


def reach(pairs: DataFrame, seeds: DataFrame, depth: int, small: int = SMALL) -> DataFrame:
    """(seed, node, depth): nodes within `depth` hops over pairs(a, b), a to b, with their least depth; seeds(seed, node) have depth 0."""
    spark = pairs.sparkSession
    start = seeds.select("seed", "node").distinct()
    kind = StructType([*start.schema.fields]).add("depth", IntegerType())
    arrow = to_arrow_schema(kind)

    def local(seen: dict[tuple, int]) -> DataFrame:
        columns = zip(*((*k, d) for k, d in seen.items()), strict=True) if seen else [[]] * 3
        return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow), kind)

    first, hop = start.limit(small + 1).collect(), 1
    if len(first) <= small:
        seen = {(x.seed, x.node): 0 for x in first}
        while hop <= depth:
            frontier = [k for k, d in seen.items() if d == hop - 1]
            ends = list({node for _, node in frontier})
            if len(ends) <= FEW:
                near = pairs.where(F.col("a").isin(ends))
            else:
                near = pairs.join(F.broadcast(spark.createDataFrame(pa.table({"a": pa.array(ends, arrow[1].type)}))), "a", "left_semi")
            got = near.select("a", "b").distinct().limit(small + 1).collect() if ends else []
            after: dict = {}
            for x in got:
                after.setdefault(x.a, set()).add(x.b)
            if len(got) > small or len(seen) + sum(len(after.get(node, ())) for _, node in frontier) > 4 * small:
                break
            for seed, node in frontier:
                for b in after.get(node, ()):
                    seen.setdefault((seed, b), hop)
            hop += 1
        if hop > depth:
            return local(seen)
        start = local(seen)
    else:
        start = start.withColumn("depth", F.lit(0))
    # too large for the driver: go on from here
    shared_folder(spark)
    return _wide(pairs, start.checkpoint(), hop, depth)


def _numbered(pairs: DataFrame, start: DataFrame) -> DataFrame:
    """(number, name) of all names of the walk."""
    names = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).union(start.select("node")).union(start.select("seed")).distinct().checkpoint()
    return names.select(F.monotonically_increasing_id().alias("number"), "name").checkpoint()


def _neighbours(pairs: DataFrame) -> DataFrame:
    """(a, near): the sorted neighbours of each node, in rows of about HUB."""
    pieces = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("pieces")).where("pieces > 1")
    cut = pairs.join(shuffled(pieces), "a", "left").withColumn("piece", F.pmod(F.xxhash64("b", F.lit(1)), F.coalesce("pieces", F.lit(1))))
    return cut.groupBy("a", "piece").agg(F.array_sort(F.collect_set("b")).alias("near")).select("a", "near").checkpoint()


def _wide(pairs: DataFrame, start: DataFrame, hop: int, depth: int) -> DataFrame:
    """reach from start(seed, node, depth), of which depths below `hop` are complete, without the driver."""
    names = _numbered(pairs, start)

    def swap(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
        return rows.join(shuffled(names.select(F.col(old).alias(column), F.col(new).alias("__new"))), column).drop(column).withColumnRenamed("__new", column)

    to_number = lambda rows, *columns: swap(to_number(rows, *columns[1:]), columns[0], "name", "number") if columns else rows
    near = _neighbours(to_number(pairs.select("a", "b"), "a", "b"))
    known = to_number(start, "seed", "node").select("seed", "node", "depth").checkpoint()
    edge = known.where(F.col("depth") == hop - 1).select("seed", "node")
    for n in range(hop, depth + 1):
        step = edge.join(shuffled(near), edge.node == near.a).select("seed", F.explode("near").alias("node")).distinct()
        edge = step.join(shuffled(known), ["seed", "node"], "left_anti").checkpoint()
        if edge.isEmpty():
            break
        known = known.unionByName(edge.withColumn("depth", F.lit(n)))
    return swap(swap(known, "node", "number", "name"), "seed", "number", "name").select("seed", "node", "depth")


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """(a, b) of every edge in both directions, of all kinds; `keep` names further columns."""
    there = edges.select(F.col("source_qualified").alias("a"), F.col("target_qualified").alias("b"), *keep)
    return there.union(there.select("b", "a", *keep).toDF("a", "b", *keep)).where("a <> b").distinct()


def impact_radius(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3, max_nodes: int | None = 200, pairs: DataFrame | None = None) -> DataFrame:
    """(seed, qualified_name, depth, kind, name, file_path, line_start) of nodes within depth of each seed (column `seed`), the seed left out.

    Seeds that are no nodes reach nothing. At most max_nodes per seed, nearest first, then by name. `pairs` are the stored pairs of the edges, if there are any.
    """
    start = seeds.select("seed").join(shuffled(nodes), F.col("seed") == F.col("qualified_name"), "left_semi").withColumn("node", F.col("seed"))
    found = reach(both_ways(edges) if pairs is None else pairs, start, depth).where("depth > 0")
    out = found.join(shuffled(nodes), found.node == nodes.qualified_name).select("seed", "qualified_name", "depth", "kind", "name", "file_path", "line_start")
    if max_nodes is None:
        return out
    # a ranked limit: Spark cuts each task's rows to max_nodes per seed before the shuffle
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "qualified_name"))
    return out.withColumn("__rank", rank).where(F.col("__rank") <= max_nodes).drop("__rank")


def transitive_tests(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, qualified_name, name, file_path, line_start, indirect) of the tests of each seed: those that test it (indirect false), or one of its callers within depth."""
    # edges are sorted by their targets, so a small frontier reads few of them; a walk doesn't mind a pair that comes twice
    up = edges.where("kind = 'CALLS'").select(F.col("target_qualified").alias("a"), F.col("source_qualified").alias("b")).where("a <> b")
    near = reach(up, seeds.select("seed", F.col("seed").alias("node")), depth)
    tests = edges.where("kind = 'TESTED_BY'").select(F.col("source_qualified").alias("test"), F.col("target_qualified").alias("subject"))
    hit = near.join(shuffled(tests), near.node == tests.subject).groupBy("seed", "test").agg(F.min(F.col("depth") > 0).alias("indirect"))
    return hit.join(shuffled(nodes), hit.test == nodes.qualified_name).select("seed", "qualified_name", "name", "file_path", "line_start", "indirect")


def blast_report(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3, test_depth: int = 2, max_nodes: int | None = 200, pairs: DataFrame | None = None) -> DataFrame:
    """(seed, part, item, distance): what a change of each seed can reach. Parts: affected (nodes, with their depth), file (with the least depth in it), test (0 if it tests the seed itself, else 1)."""
    found = impact_radius(nodes, edges, seeds, depth, max_nodes, pairs)
    near = found.select("seed", F.lit("affected").alias("part"), F.col("qualified_name").alias("item"), F.col("depth").alias("distance"))
    files = found.groupBy("seed", F.lit("file").alias("part"), F.col("file_path").alias("item")).agg(F.min("depth").alias("distance"))
    tests = transitive_tests(nodes, edges, seeds, test_depth).select("seed", F.lit("test").alias("part"), F.col("qualified_name").alias("item"), F.col("indirect").cast("int").alias("distance"))
    return near.unionByName(files).unionByName(tests)


def coverage(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, total_tests, direct_tests, covered) of every seed."""
    count = transitive_tests(nodes, edges, seeds, depth).groupBy("seed").agg(F.count("*").alias("n"), F.count_if(~F.col("indirect")).alias("d"))
    out = seeds.select("seed").distinct().join(shuffled(count), "seed", "left")
    return out.select("seed", F.coalesce("n", F.lit(0)).alias("total_tests"), F.coalesce("d", F.lit(0)).alias("direct_tests"), F.col("n").isNotNull().alias("covered"))
