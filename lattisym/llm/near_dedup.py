"""MinHash near-duplicate detection with HyperMinHash registers.

Each register keeps the minimum of its own hash function over a document's shingles, compressed to the
number of leading zeros (6 bits) and the ten mantissa bits behind the leading one. (Slicing one hash into
buckets would leave most registers of a short document empty and lose its links.) Bands of registers
propose candidates, the share of equal registers, corrected for the accidental collisions that the
compression allows, drops hopeless ones, and the full shingle sets confirm the rest.

Candidates never number the square of a band's bucket: documents with equal sets are one representative;
a bucket is first compared with its least member only (round one), and only members that this leaves in
different components are compared with each other (round two), which loses no link between components; members
of a crowded bucket only if an exact prefix filter on their full sets leaves the pair possible.

Defined cases: a null or empty text, or one without words, has an empty set, is linked with nothing and stays.
Rows that repeat a doc_id each come back; they share a component if any of their sets is linked to it. A row with a null doc_id is linked with nothing, is its own component (null) and stays.
Extra columns of the input are ignored by `near_duplicates` and kept by `deduplicate`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, chunks, cut, mix, shingle_sets, signed, stored, texts_of
from .components import components

REGISTERS, ROWS, MANTISSA = 160, 5, 10
#: Estimates this far below the threshold are dropped before verification: over five standard deviations.
MARGIN = 0.18
#: Members of a bucket up to which its pairs are listed; larger ones go through an exact prefix filter.
SMALL = 32
#: Accidental collisions of two independent registers, per 2**-mantissa (the HyperMinHash paper's constant).
COLLISION = 0.169919487159739093975315012348630288992889


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0xA0761D6478BD642F)) | U64(1)


def compress(least: np.ndarray) -> np.ndarray:
    """Minimum hash values to 16-bit registers: leading zeros, then mantissa bits."""
    top = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # bits in use; rounding up to a power of two only moves a value to the next bin, alike for equal values
    zeros = np.clip(64 - top, 0, 63)
    shifted = least << zeros.astype(np.uint64)
    mantissa = (shifted >> U64(63 - MANTISSA)) & U64((1 << MANTISSA) - 1)
    return ((zeros << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16)


def registers(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for s in range(0, len(shingles), 2048):
        np.minimum(least, np.multiply.outer(factors, shingles[s : s + 2048]).min(axis=1), out=least)
    return compress(least)


def _digest(shingles: np.ndarray) -> int:
    """A hash of a sorted set of shingles."""
    return int(mix(mix(shingles).sum(dtype=np.uint64).reshape(1) + shingles[-1:])[0]) if len(shingles) else 0


def _sketcher(width: int):
    def sketch(batches):
        factors = multipliers(REGISTERS)
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array(digest, pa.binary()),
                        pa.array([registers(x, factors).tobytes() if len(x) else None for x in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "sketch"],
                )

    return sketch


def _bander(batches):
    bands = REGISTERS // ROWS
    mult = multipliers(bands * ROWS).reshape(bands, ROWS)
    for batch in batches:
        for s in range(0, batch.num_rows, 512):
            part = batch.slice(s, 512)
            sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, bands, ROWS)
            keys = mix((sketch.astype(np.uint64) * mult).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys.ravel())), pa.array(np.repeat(ids, bands))], names=["band", "doc_id"])


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, corrected for accidental collisions."""
    same = (a == b).mean(axis=1)
    accident = COLLISION * 2.0**-MANTISSA
    return (same - accident) / (1 - accident)


def _promising(threshold: float):
    def keep(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
                ok = pa.array(estimate(a, b) >= threshold - MARGIN)
                yield part.select(["a", "b"]).filter(ok)

    return keep


def _confirmer(width: int, percent: int):
    def confirm(batches):
        for batch in batches:
            for part in chunks(batch, "ta"):
                for piece in chunks(part, "tb"):
                    left, right = shingle_sets(piece.column("ta"), width), shingle_sets(piece.column("tb"), width)
                    ok = []
                    for x, y in zip(left, right, strict=True):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        ok.append(100 * both >= percent * (len(x) + len(y) - both))
                    yield piece.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return confirm


def _confirmed(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike enough."""
    size = lambda c: sketches.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    near = pairs.join(size("a"), "a").join(size("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    near = cut(near.select("a", "b", "sa", "sb").mapInArrow(_promising(percent / 100), "a long, b long"))
    some = texts_of(texts, near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct())
    text = lambda c: some.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    return near.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_confirmer(width, percent), "a long, b long")


def _exploder(width: int):
    def explode(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                size = np.array([len(x) for x in sets], np.int64)
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                take = pa.array(np.repeat(np.arange(len(sets)), size))
                number = np.repeat(np.array([_digest(x) for x in sets], dtype=np.uint64), size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("component").take(take), pa.array(signed(number)), pa.array(signed(every))], names=["doc_id", "component", "digest", "shingle"])

    return explode


def _prefix_pairs(crowd: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of crowd(doc_id, component), of different components, that can still be alike enough: an exact filter.

    Shingles are put in one order, the rarest among the crowd first. Two sets alike enough share a shingle among the first
    n - ceil(percent * n / 100) + 1 of each, and behind that place both still have room for the overlap they need. In a crowd of
    near copies the first places hold what is peculiar to a document, so this leaves few pairs where a bucket would give all.
    """
    rows = texts_of(texts, crowd.select("doc_id")).join(crowd, "doc_id").select("doc_id", "component", "text").mapInArrow(_exploder(width), "doc_id long, component long, digest long, shingle long")
    rows = stored(rows)
    rare = stored(rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"))
    order = rows.join(rare, "shingle", "left").select("doc_id", "component", "digest", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "shingle").alias("s"))
    order = order.groupBy("doc_id", "component", "digest").agg(F.sort_array(F.collect_list("s")).alias("s")).withColumn("n", F.size("s"))
    first = order.select("doc_id", "component", "n", F.posexplode(F.expr(f"slice(s, 1, cast(n - ceil(n * {percent} / 100) + 1 as int))")).alias("at", "s"))
    first = first.where("s.df > 1").select("doc_id", "component", "n", "at", F.col("s.shingle").alias("shingle"))
    mixed = first.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle")
    first = cut(first.join(cut(mixed), "shingle", "left_semi"))
    x, y = (first.select("shingle", F.col("doc_id").alias(c), F.col("component").alias(f"c{c}"), F.col("n").alias(f"n{c}"), F.col("at").alias(f"at{c}")) for c in "ab")
    room = f"least(na - ata, nb - atb) * {100 + percent} >= {percent} * (na + nb) and least(na, nb) * 100 >= greatest(na, nb) * {percent}"
    return x.join(y, "shingle").where(f"a < b and ca <> cb and {room}").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of `width`-word shingles
    (A-Z lower-cased); component_id is the least doc_id reachable over links; kept marks one per component.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut(rows.mapInArrow(_sketcher(width), "doc_id long, n_shingles long, digest binary, sketch binary"))
    usable = found.where("sketch is not null and doc_id is not null")
    # documents with equal sets (by a 128-bit BLAKE2 of the whole sorted set) are one; its least id stands for all of them
    first = usable.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"))
    sketches = usable.join(first, (usable.doc_id == first.rep) & (usable.digest == first.digest) & (usable.n_shingles == first.n_shingles), "left_semi")
    sketches = cut(sketches.select("doc_id", "n_shingles", "sketch").distinct())
    members = cut(sketches.select("doc_id", "sketch").mapInArrow(_bander, "band long, doc_id long"))
    # what is counted per key is cut off before it is joined: Spark splits a hot key of a join only if both sides come from a shuffle of their own
    full = cut(members.groupBy("band").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").select("band", "lead"))
    star = members.join(full, "band").where("doc_id > lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    texts = rows.where("doc_id is not null")
    links = cut(_confirmed(star, sketches, texts, width, percent))
    comp = components(links).select(F.col("node").alias("doc_id"), "component")
    # round two: buckets that still hold several components
    labelled = members.join(full.select("band"), "band", "left_semi").join(comp, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("doc_id").alias("lead"), F.count("*").alias("size")).where("lo < hi")
    open_ = cut(labelled.join(cut(split.select("band", "lead", "size")), "band"))
    x, y = (open_.where(F.col("size") <= SMALL).select("band", "lead", F.col("doc_id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    cross = x.join(y.drop("lead"), "band").where("a < b and ca <> cb and a <> lead").select("a", "b")
    crowd = cut(open_.where(F.col("size") > SMALL).select("doc_id", "component").distinct())
    cross = cross.union(_prefix_pairs(crowd, texts, width, percent)).distinct()
    more = cut(_confirmed(cross, sketches, texts, width, percent))
    label = (comp if more.isEmpty() else components(links.union(more)).withColumnRenamed("node", "doc_id")).withColumnRenamed("doc_id", "rep")
    by_set = cut(first.join(label, "rep", "left").select("digest", "n_shingles", F.coalesce("component", "rep").alias("component")))
    out = found.select("doc_id", "n_shingles", "digest", F.col("sketch").isNotNull().alias("some"))
    out = out.join(by_set, ["digest", "n_shingles"], "left").withColumn("component_id", F.when(F.col("some") & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of which one document of each group of near duplicates stays."""
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
