"""Where a name that a file uses is defined: the chain of imports that brings it there, followed to its end.

A module can pass on what it imports (`from .x import y` in an `__init__` file, star imports), over any number of files. All asks are followed together: a hop is an equi-join of the
files reached with what they define and with what they import; a file that an ask has seen is not entered again, so cycles end. Lineage is cut at each hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import shuffled
from .reach import shared_folder


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def definitions(nodes: DataFrame, imports: DataFrame, asks: DataFrame) -> DataFrame:
    """(file_path, name, qualified_name, hops) for each of asks(file_path, name): the definition of the name as the file sees it, and over how many imports; null where no chain ends in one.

    imports are resolved ones (file_path, at, names, resolved). What a file defines itself at its top comes first, then the last import that names it, then star imports, all of them; of
    several ends equally far the one that is first by file and line. Repeated asks are one; asks with a null are left out.
    """
    own = nodes.where("parent_name is null").groupBy("file_path", "name").agg(F.min(F.struct("line_start", "qualified_name")).alias("d"))
    own = own.select(F.col("file_path").alias("here"), "name", F.col("d.line_start").alias("line"), "d.qualified_name")
    brought = imports.where("resolved is not null").select(F.col("file_path").alias("here"), "at", F.col("resolved").alias("next"), F.explode("names").alias("name"))
    named = brought.where("name <> '*'").groupBy("here", "name").agg(F.max_by("next", "at").alias("next"))
    stars = brought.where("name = '*'").select("here", "next").distinct()
    # read at every hop, so made once
    own, named, stars = _cut(own), _cut(named), _cut(stars)
    start = asks.select("file_path", "name").where("file_path is not null and name is not null").distinct()
    frontier = _cut(start.withColumn("here", F.col("file_path")))
    seen, found, hops = frontier, None, 0
    while not frontier.isEmpty():
        hit = frontier.join(shuffled(own), ["here", "name"]).groupBy("file_path", "name").agg(F.min(F.struct("here", "line", "qualified_name")).alias("d"))
        hit = _cut(hit.select("file_path", "name", "d.qualified_name", F.lit(hops).alias("hops")))
        found = hit if found is None else found.unionByName(hit)
        left = frontier.join(shuffled(hit), ["file_path", "name"], "left_anti").join(shuffled(named), ["here", "name"], "left")
        by_name = left.where("next is not null").select("file_path", "name", F.col("next").alias("here"))
        by_star = left.where("next is null").select("file_path", "name", "here").join(shuffled(stars), "here").select("file_path", "name", F.col("next").alias("here"))
        frontier = _cut(by_name.union(by_star).distinct().join(shuffled(seen), ["file_path", "name", "here"], "left_anti"))
        seen, hops = seen.unionByName(frontier.select(*seen.columns)), hops + 1
    out = start.withColumns({"qualified_name": F.lit(None).cast("string"), "hops": F.lit(None).cast("int")}) if found is None else start.join(shuffled(found), ["file_path", "name"], "left")
    return out.select("file_path", "name", "qualified_name", "hops")


def definition(nodes: DataFrame, imports: DataFrame, candidates: DataFrame, asking_file: str, name: str) -> DataFrame:
    """The one of the candidates (nodes) that the asking file means by a name, if its imports lead to one of them; else the candidates."""
    ask = nodes.sparkSession.createDataFrame([(asking_file, name)], "file_path string, name string")
    meant = definitions(nodes, imports, ask).first()
    chosen = candidates.where(F.col("qualified_name") == F.lit(meant.qualified_name if meant else None))
    return candidates if chosen.isEmpty() else chosen
