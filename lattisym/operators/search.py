"""Ranked symbol search, full-text search over stemmed words, and search for parts of names by stored runs of three characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import shuffled
from ..functions.porter import stem

WORDS = r"[\p{L}\p{N}]+"


#: Fields that parts are looked for in, and the length of a run.
PART_FIELDS, GRAM = ("name", "qualified_name", "docstring"), 3
#: Files up to which what may match is a filter on the scan of the nodes.
FEW = 1000


def _runs(text):
    """The distinct runs of GRAM characters of a column."""
    n = F.length(text)
    return F.when(n >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda k: F.substring(text, k, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def grams(nodes: DataFrame) -> DataFrame:
    """The index for parts: (gram, field, file_path), each once for all nodes of a file. Stored with a graph, sorted by gram."""
    texts = nodes.groupBy("file_path").agg(*(F.collect_set(F.lower(F.coalesce(f, F.lit("")))).alias(f) for f in PART_FIELDS))
    # runs are made and made distinct within a file: nodes are shuffled, not their runs
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.array_distinct(F.flatten(F.transform(f, _runs))).alias("grams")) for f in PART_FIELDS))
    return texts.select("file_path", F.explode(fields).alias("f")).select(F.explode("f.grams").alias("gram"), "f.field", "file_path")


def _holding(index: DataFrame, part: str, fields: tuple[str, ...]) -> DataFrame | None:
    """(file_path) of files that have every run of the part in one field; None for a part too short to have runs."""
    wanted = sorted({part[k : k + GRAM] for k in range(len(part) - GRAM + 1)})
    if not wanted:
        return None
    rows = index.where(F.col("gram").isin(wanted) & F.col("field").isin(*fields))
    return rows.groupBy("file_path", "field").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("file_path").distinct()


def may_hold(nodes: DataFrame, parts: list[tuple[str, tuple[str, ...]]], index: DataFrame | None) -> DataFrame:
    """The nodes of files that may have every (part, fields), by the stored runs; the caller verifies. All nodes without an index, or if no part has runs."""
    found = None
    for part, fields in parts:
        files = None if index is None else _holding(index, part, fields)
        if files is not None:
            found = files if found is None else found.join(shuffled(files), "file_path", "left_semi")
    if found is None:
        return nodes
    some = [x.file_path for x in found.limit(FEW + 1).collect()]
    return nodes.where(F.col("file_path").isin(some)) if len(some) <= FEW else nodes.join(shuffled(found), "file_path", "left_semi")


def search(nodes: DataFrame, query: str, limit: int | None = 20, index: DataFrame | None = None) -> DataFrame:
    """Symbols by score: name equal 100, prefix 80, part of the name 60, part of the docstring 20; then file and line. `index` are the stored runs of the nodes."""
    q = query.lower()
    nodes, name = may_hold(nodes, [(q, ("name", "docstring"))], index), F.lower("name")
    score = F.when(name == q, 100).when(name.startswith(q), 80).when(name.contains(q), 60).when(F.lower(F.coalesce("docstring", F.lit(""))).contains(q), 20).otherwise(0)
    out = nodes.withColumn("score", score).where("score > 0").select("score", "file_path", "name", "kind", F.col("line_start").alias("line"), "signature", "docstring", F.col("parent_name").alias("parent"))
    out = out.orderBy(F.desc("score"), "file_path", "line", "name")
    return out if limit is None else out.limit(limit)


def tokens(text):
    """Lower-case words of a column."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stems(words: pa.Array) -> pa.Array:
    # each distinct word of a batch is stemmed once; the others stay in Arrow's memory and never become Python objects
    coded = words.flatten().dictionary_encode()
    stemmed = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, stemmed, mask=words.is_null() if words.null_count else None)


def stems(text):
    """Stemmed words of a column (the only step here outside the JVM; batches travel by Arrow)."""
    return _stems(tokens(text))


def _has_phrase(words, phrase: list[str]):
    """Whether the words of an array hold the phrase, in order and next to each other."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(" " + " ".join(phrase) + " ")


def postings(nodes: DataFrame) -> DataFrame:
    """The full-text index: (token, field, position, qualified_name, file_path). Stored with a graph, sorted by token."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), stems(F.col(f)).alias("words")) for f in ("name", "qualified_name", "file_path")))
    each = nodes.select("qualified_name", "file_path", F.explode(fields).alias("f"))
    return each.select("qualified_name", "file_path", "f.field", F.posexplode("f.words").alias("position", "token")).select("token", "field", "position", "qualified_name", "file_path")


def phrases(query: str, stemmed: bool = True) -> list[list[str]]:
    """The parts of each white-space word of a query."""
    import regex

    split = lambda w: [stem(x) if stemmed else x for x in regex.findall(WORDS, w.lower())]
    return [p for p in (split(w) for w in query.split()) if p]


def holders(index: DataFrame, query: str) -> DataFrame | None:
    """(qualified_name) of the nodes one of whose fields holds each word of the query, as a phrase of its parts; None for a query without words. Only rows of the query's words are read."""
    out = None
    for p in phrases(query):
        places = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for k, t in enumerate(p)))
        rows = index.where(F.col("token").isin(sorted(set(p)))).select("qualified_name", "field", "position", "token", F.explode(places).alias("x")).where("x.t = token")
        start = rows.groupBy("qualified_name", "field", (F.col("position") - F.col("x.k")).alias("start")).agg(F.count_distinct("x.k").alias("n"))
        hit = start.where(F.col("n") == len(p)).select("qualified_name").distinct()
        out = hit if out is None else out.join(shuffled(hit), "qualified_name", "left_semi")
    return out


def search_text(rows: DataFrame, query: str, fields: tuple[str, ...], stemmed: bool = True) -> DataFrame:
    """Rows in which every white-space word of the query occurs, as a phrase of its parts, in one of the fields."""
    wanted = phrases(query, stemmed)
    if not wanted:
        return rows.limit(0)
    keep = F.lit(True)
    for p in wanted:
        one = F.lit(False)
        for f in fields:
            one = one | F.coalesce(_has_phrase(stems(F.col(f)) if stemmed else tokens(F.col(f)), p), F.lit(False))
        keep = keep & one
    return rows.where(keep)


def search_like(nodes: DataFrame, query: str, index: DataFrame | None = None) -> DataFrame:
    """Nodes in whose name or qualified name every word occurs as a part. `index` are the stored runs of the nodes."""
    words = query.lower().split()
    keep = F.lit(bool(words))
    for w in words:
        keep = keep & (F.lower("name").contains(w) | F.lower("qualified_name").contains(w))
    return may_hold(nodes, [(w, ("name", "qualified_name")) for w in words], index).where(keep)


def search_fts(nodes: DataFrame, query: str, limit: int = 20, index: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """Full-text search; without a hit, words as parts of names. In order of file and line. `index` are the stored postings of the nodes, `parts` their runs; postings are made on the fly without."""
    order = ("file_path", "line_start", "qualified_name")
    hits = holders(postings(nodes) if index is None else index, query)
    if hits is None:
        return search_like(nodes, query, parts).orderBy(*order).limit(limit)
    found = nodes.join(shuffled(hits), "qualified_name", "left_semi").select(*nodes.columns).orderBy(*order).limit(limit)
    # at most `limit` names decide which of the two it is
    names = [x.qualified_name for x in found.select("qualified_name").collect()]
    if not names:
        return search_like(nodes, query, parts).orderBy(*order).limit(limit)
    return nodes.where(F.col("qualified_name").isin(names)).orderBy(*order)
