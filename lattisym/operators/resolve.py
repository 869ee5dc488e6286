"""Resolution of bare call targets to qualified names.

A bare target `hint.name` or `name` is joined with the nodes of that name. Candidates are counted per distinct (target, file), not per
edge, and never gathered: each stage only needs how many candidates there are and one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.joins import shuffled
from .extract import dedupe_edges


def last_name(target: Column) -> Column:
    """The name that a target ends with: behind the last dot, or behind the file."""
    return F.substring_index(F.substring_index(target, "::", -1), ".", -1)


def resolve_calls(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("CALLS",), imports: DataFrame | None = None) -> DataFrame:
    """Edges with bare targets rewritten where one candidate is left.

    Of a hinted target's several candidates, those whose path contains the hint are preferred if there are any; of several that
    remain, those in files that the caller's file imports. `imports` (file_path, imported) adds to the qualified IMPORTS
    edges. Resolution starts from raw_target, so edges of a changed code base can be resolved anew. Without a single candidate an edge stays bare.
    """
    fresh = edges.withColumn("target_qualified", F.col("raw_target"))
    open_ = F.col("kind").isin(*kinds) & X.is_bare(F.col("target_qualified"))
    wanted = fresh.where(open_).select(F.col("raw_target").alias("target"), F.col("file_path").alias("caller")).distinct()
    wanted = wanted.withColumn("name", F.substring_index("target", ".", -1)).withColumn("hint", F.when(F.col("target").contains("."), F.expr("substr(target, 1, length(target) - length(name) - 1)")))
    found = nodes.select("name", F.col("qualified_name").alias("qn"), F.col("file_path").alias("home"))
    # most names are of one node: they need no candidates at all
    by_name = found.groupBy("name").agg(F.count("*").alias("n"), F.min("qn").alias("one"))
    single = wanted.join(shuffled(by_name), "name")
    unique = single.where("n = 1").select("target", "caller", F.col("one").alias("resolved"))
    many = single.where("n > 1").select("target", "caller", "name", "hint")
    # hints depend on the target alone: they meet the nodes once, not once per caller
    near = many.where("hint is not null").select("name", "hint").distinct().join(shuffled(found), "name").where(F.col("home").contains(F.col("hint")))
    near = near.groupBy("name", "hint").agg(F.count("*").alias("nh"), F.min("qn").alias("oneh"))
    known = fresh.where("kind = 'IMPORTS'").where(~X.is_bare(F.col("target_qualified"))).select(F.col("file_path").alias("caller"), F.substring_index("target_qualified", "::", 1).alias("home"))
    if imports is not None:
        known = known.unionByName(imports.select(F.col("file_path").alias("caller"), F.col("imported").alias("home")))
    # equi-joins from a caller to what it imports to the nodes there
    seen = many.join(shuffled(known.distinct()), "caller").join(shuffled(found), ["name", "home"]).withColumn("hinted", F.coalesce(F.col("home").contains(F.col("hint")), F.lit(False)))
    seen = seen.groupBy("target", "caller").agg(
        F.count("*").alias("ni"), F.min("qn").alias("onei"), F.count_if("hinted").alias("nhi"), F.min(F.when(F.col("hinted"), F.col("qn"))).alias("onehi")
    )
    count = many.join(shuffled(near), ["name", "hint"], "left").join(shuffled(seen), ["target", "caller"], "left")
    some = F.when(F.col("nh") == 1, F.col("oneh")).when(F.col("nh") > 1, F.when(F.col("nhi") == 1, F.col("onehi"))).when(F.col("ni") == 1, F.col("onei"))
    answer = unique.unionByName(count.select("target", "caller", some.alias("resolved")).where("resolved is not null"))
    keyed = fresh.join(shuffled(answer.withColumnRenamed("caller", "file_path").withColumnRenamed("target", "raw_target")), ["raw_target", "file_path"], "left")
    out = keyed.withColumn("target_qualified", F.when(open_, F.coalesce("resolved", "target_qualified")).otherwise(F.col("target_qualified")))
    return dedupe_edges(out.select(*edges.columns))
