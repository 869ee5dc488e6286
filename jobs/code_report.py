"""Report on the health of a code base: what is dead, what no test reaches, what most depends on, which calls lead nowhere.

    python jobs/code_report.py --config jobs/code_report.toml --tables FOLDER --output FOLDER --label NAME
    python jobs/code_report.py --tree FOLDER --output FOLDER --label NAME

Source files come from a tree of any file system (`--tree`), or are made of the tables region, nation, customer and supplier (`--tables`). They are parsed and resolved once,
into a graph; four reports are written below the output, partitioned by label and section: directory, item, value.

* dead: functions and methods that nothing calls, with their line.
* untested: functions and methods outside of test files that no test reaches over at most `depth` callers, with their line.
* used: files with the number of edges into them.
* unresolved: call targets that no symbol of the code base answers to, with the number of calls; the directory is the callers'.
* total: one row for each of the sections, with its number of rows, so each partition of a label is always written.

Running a label again overwrites its partitions, all of them: the result is that of the last run. Other labels stay, so reports can be compared over time.
"""

from __future__ import annotations

import argparse
import logging
import sys
import tomllib
from pathlib import Path

if (_root := str(Path(__file__).resolve().parent.parent)) not in sys.path:
    sys.path.insert(0, _root)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lattisym.functions import text as X  # noqa: E402
from lattisym.functions.joins import shuffled  # noqa: E402
from lattisym.operators import reach, relations  # noqa: E402
from lattisym.plans import corpus, store  # noqa: E402
from lattisym.sources.project import read_tree  # noqa: E402

log = logging.getLogger("jobs.code_report")

SCHEMA = "directory string, item string, value long, label string, section string"
SECTIONS = ("dead", "untested", "used", "unresolved")


def sections(graph: store.Graph, depth: int) -> DataFrame:
    """section, directory, item, value."""
    nodes, edges = graph.nodes, graph.edges
    place = relations.directory(F.col("file_path")).alias("directory")
    listed = lambda rows, name, item, value: rows.select(F.lit(name).alias("section"), place, F.col(item).alias("item"), F.col(value).cast("long").alias("value"))
    code = nodes.where(F.col("kind").isin("function", "method") & ~X.is_listed_test(F.col("file_path")))
    covered = reach.coverage(nodes, edges, code.select(F.col("qualified_name").alias("seed")), depth).where("covered").select(F.col("seed").alias("qualified_name"))
    open_calls = edges.where((F.col("kind") == "CALLS") & X.is_bare(F.col("target_qualified")))
    counted = open_calls.groupBy(place, F.col("target_qualified").alias("item")).agg(F.count("*").alias("value"))
    return (
        listed(relations.dead_code(nodes, edges), "dead", "qualified_name", "line_start")
        .unionByName(listed(code.join(shuffled(covered), "qualified_name", "left_anti"), "untested", "qualified_name", "line_start"))
        .unionByName(listed(relations.file_importance(nodes, edges), "used", "file_path", "importance"))
        .unionByName(counted.select(F.lit("unresolved").alias("section"), "directory", "item", "value"))
    )


def run(spark: SparkSession, sources: DataFrame, target: str, label: str, depth: int = 2) -> dict[str, int]:
    """Write the report of sources(file_path, source) under a label; the number of rows of each section."""
    graph = store.build(sources, kinds=("CALLS", "TESTED_BY"))
    # nodes and edges are each used by several sections: cut once, in the shared folder
    graph.nodes, graph.edges = store._cut(graph.nodes), store._cut(graph.edges)
    rows = sections(graph, depth)
    made = store._cut(rows)
    sizes = {x.section: x.n for x in made.groupBy("section").agg(F.count("*").alias("n")).collect()}
    totals = spark.createDataFrame([("total", "", s, sizes.get(s, 0)) for s in SECTIONS], "section string, directory string, item string, value long")
    # one row more in each section, so an empty one replaces what an earlier run of the label left
    kept = made.unionByName(totals).unionByName(totals.withColumn("section", F.col("item")).withColumn("item", F.lit(None).cast("string")))
    out = kept.withColumn("label", F.lit(label))
    out.repartitionByRange("section", "directory", "item").sortWithinPartitions("section", "directory", "item").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label", "section").parquet(target)
    log.info("read %d files; wrote %s under label %s of %s", graph.files.count(), ", ".join(f"{s} {sizes.get(s, 0)}" for s in SECTIONS), label, target)
    return {s: sizes.get(s, 0) for s in SECTIONS}


def report(spark: SparkSession, target: str, label: str | None = None) -> DataFrame:
    """label, section, directory, item, value of what was written."""
    rows = spark.read.schema(SCHEMA).parquet(target).where("item is not null").select("label", "section", "directory", "item", "value")
    return rows if label is None else rows.where(F.col("label") == label)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Report on a code base.")
    for name in ("--config", "--tables", "--tree", "--output", "--label"):
        parser.add_argument(name)
    args = parser.parse_args(argv)
    settings = tomllib.loads(Path(args.config).read_text()) if args.config else {}
    at = lambda name: getattr(args, name) or settings.get(name)
    if not at("output") or not at("label") or bool(at("tables")) == bool(at("tree")):
        parser.error("--output, --label and either --tables or --tree are needed")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("code_report").getOrCreate()
    try:
        sources = read_tree(spark, at("tree")) if at("tree") else corpus.source_files(spark, at("tables"))
        run(spark, sources, at("output"), at("label"), settings.get("depth", 2))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
