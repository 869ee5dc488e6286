"""Document fingerprints: threshold-scaled sketches.

The shingles of a document are its runs of SHINGLE bytes of UTF-8. Each has a hash, and the sketch keeps every distinct hash below
a fixed fraction (1 / SCALE) of the hash range, so a sketch is a uniform sample of the document's set whose size follows the
document's. Sketches of one scale can be merged by union and give estimates of containment and likeness between documents of very
different length, which a sketch of fixed size cannot.

A fingerprint is text: the number of distinct shingles, a 16-digit digest of the whole set, and the kept hashes in order, five characters each.
Equal texts have equal fingerprints. A text shorter than a shingle is one shingle; an empty or null text has none.
Two sketches without any hash (very short texts) are alike (1) if their digests are equal, else not (0).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, _powers, chunks, mix, partitions, prefix_hash, text_bytes

SHINGLE, SCALE = 12, 16
#: Kept hashes are below 2**28, a sixteenth of 32 bits: five characters of six bits, most significant first, in the order of ASCII.
DIGITS = 5
ALPHABET = np.frombuffer(b"-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", np.uint8)
_SHIFTS = np.arange(6 * (DIGITS - 1), -1, -6, dtype=np.uint64)
#: Rows of a run of neighbours that one task reads; of a small table fewer, so that there are up to so many runs.
BUCKET_ROWS, RUNS = 20_000, 64


def sketches(column: pa.Array) -> list[tuple[int, int, np.ndarray]]:
    """(distinct shingles, digest of the set, kept hashes) of each text."""
    data, at = text_bytes(column)
    sums = prefix_hash(data)
    n = len(data) - SHINGLE + 1
    inverse = _powers(len(sums))[1]
    hashes = mix((sums[SHINGLE:] - sums[:n]) * inverse[:n]) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s >= SHINGLE:
            found = np.unique(hashes[s : e - SHINGLE + 1])
        elif e > s:
            found = mix((sums[e : e + 1] - sums[s : s + 1]) * inverse[s : s + 1] + U64(e - s))
        else:
            found = np.zeros(0, np.uint64)
        short = found >> U64(32)
        out.append((len(found), int(found.sum(dtype=np.uint64)), np.unique(short[short < U64((1 << 32) // SCALE)])))
    return out


def text_of(sketch: tuple[int, int, np.ndarray]) -> str:
    size, digest, kept = sketch
    return f"{size}:{digest:016x}:" + ALPHABET[(kept.astype(np.uint64)[:, None] >> _SHIFTS) & U64(63)].tobytes().decode()


def parse(fingerprint: str) -> tuple[int, int, np.ndarray]:
    size, digest, kept = fingerprint.split(":")
    values = np.searchsorted(ALPHABET, np.frombuffer(kept.encode(), np.uint8)).astype(np.uint64).reshape(-1, DIGITS)
    return int(size), int(digest, 16), (values << _SHIFTS).sum(axis=1, dtype=np.uint64)


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """Estimate of |intersection| / |union| of the two sets."""
    if not len(a[2]) and not len(b[2]):
        return float(a[:2] == b[:2])
    both = len(np.intersect1d(a[2], b[2], assume_unique=True))
    return both / (len(a[2]) + len(b[2]) - both)


def containment(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    """Estimate of the share of a's set that b has too."""
    if not len(a[2]):
        return float(a[:2] == b[:2] or not a[0])
    return len(np.intersect1d(a[2], b[2], assume_unique=True)) / len(a[2])


def merge(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> np.ndarray:
    """The kept hashes of the union of the two sets."""
    return np.union1d(a[2], b[2])


def _sketcher(batches):
    for batch in batches:
        for part in chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([text_of(x) for x in sketches(part.column("text"))], pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, fingerprint."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sketcher, "doc_id long, fingerprint string")


def neighbours(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, runs: int = RUNS) -> DataFrame:
    """docs(doc_id, text) dealt so that each bucket is a run of consecutive doc_ids, in order, closed by a copy of the next bucket's first row.

    Buckets hold about bucket_rows rows, cut at quantiles of doc_id; their number follows from the rows alone, and only their edges (a few numbers per bucket) reach the driver.
    Rows of equal doc_id are in the order of a hash of their texts, then of the texts; a null doc_id comes last. So one doc_id (or null) on very many
    rows is divided too, by ranges of that hash: such ids are a small table that rows are joined with, however many they are.
    """
    spark = docs.sparkSession
    big = F.lit((1 << 63) - 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", big))
    # 2,048 neighbouring ids are one step: its number is exact as a double
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("step", F.shiftright("key", 11))
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), big).alias("key"))
    total = slim.count()
    n = max(2, min(total // 1000, runs), -(-total // bucket_rows))
    # keys on more rows than a bucket should have: fewer than there are buckets
    hot = sorted((x.key, x.n) for x in slim.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(1, 2 * total // n)).collect())
    cuts = set(slim.select(F.shiftright("key", 11).cast("double").alias("d")).approxQuantile("d", [k / n for k in range(1, n)], 1 / (4 * n)))
    steps: dict[int, list[tuple[int, int]]] = {}
    for k, m in hot:
        steps.setdefault(k >> 11, []).append((k, min(20, max(0, (m * n // max(1, total)).bit_length()))))
    cuts = sorted(cuts | {float(x + i) for x in steps for i in (0, 1)}) or [0.0]
    # a binary search per row, however many buckets there are
    search = Bucketizer(splits=[-math.inf, *(cuts if len(cuts) > 1 else [cuts[0], cuts[0] + 1]), math.inf], inputCol="__step", outputCol="__bucket")
    rows = search.transform(rows.withColumn("__step", F.col("step").cast("double")))
    part = F.lit(0).cast("long")
    if steps:
        # in a step with hot keys: how many of them are less, whether it is one of them, and if so the range of the hash
        divided = spark.createDataFrame([(x, [k for k, _ in v], [b for _, b in v]) for x, v in steps.items()], "step long, hots array<long>, bits array<int>")
        rows = rows.join(F.broadcast(divided), "step", "left")
        less, at = F.size(F.filter("hots", lambda h: h < F.col("key"))), F.array_position("hots", F.col("key"))
        top = F.expr("shiftrightunsigned(hash ^ shiftleft(-1L, 63), 64 - element_at(bits, cast(array_position(hots, key) as int)))")
        width = F.element_at("bits", at.cast("int"))
        inside = F.when(at > 0, (2 * less + 1).cast("long") * (1 << 20) + F.when(width > 0, top).otherwise(F.lit(0))).otherwise((2 * less).cast("long") * (1 << 20))
        part = F.when(F.col("hots").isNotNull(), inside).otherwise(part)
    rows = rows.withColumn("place", F.col("__bucket").cast("long") * (1 << 33) + part).select("doc_id", "text", "key", "hash", "place")
    heads = rows.groupBy("place").agg(F.min(F.struct("key", "hash")).alias("first")).collect()
    heads = sorted((x.place, x.first.key, x.first.hash) for x in heads)
    if not heads:
        return rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("extra"), "doc_id", "key", "hash", "text")
    numbers = F.broadcast(spark.createDataFrame([(x[0], k) for k, x in enumerate(heads)], "place long, bucket int"))
    edges = F.broadcast(spark.createDataFrame([((k - 1) % len(heads), x[0], x[1], x[2]) for k, x in enumerate(heads)], "home int, place long, key long, hash long"))
    first = rows.join(edges, ["place", "key", "hash"]).groupBy("home", "key", "hash").agg(F.min("text").alias("text"))
    first = first.select(F.col("home").alias("bucket"), F.lit(1).alias("extra"), F.lit(None).cast("long").alias("doc_id"), "key", "hash", "text")
    both = rows.join(numbers, "place").select("bucket", F.lit(0).alias("extra"), "doc_id", "key", "hash", "text").unionByName(first)
    return both.repartitionById(len(heads), F.col("bucket")).sortWithinPartitions("bucket", "extra", "key", "hash", "text")


def _editor(batches):
    """Sketches of every text and of its edited form, in which the next text's beginning replaces the last quarter."""

    def finish(rows, marks):
        """rows[k + 1] follows rows[k]; the last row only gives."""
        edited, keep = [], []
        for k in range(len(rows) - 1):
            if not rows[k][1]:
                text, after = rows[k][3], rows[k + 1][3]
                n = len(text) // 4
                edited.append(text[: len(text) - n] + after[:n] if n else text)
                keep.append(k)
        new = [x for part in chunks(pa.RecordBatch.from_arrays([pa.array(edited, pa.string())], names=["text"]), "text") for x in sketches(part.column("text"))] if edited else []
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][2] for k in keep], pa.int64()),
                pa.array([len(rows[k][3]) for k in keep], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array([text_of(marks[k]) for k in keep], pa.string()),
                pa.array([text_of(x) for x in new], pa.string()),
                pa.array([likeness(marks[k], x) for k, x in zip(keep, new, strict=True)], pa.float64()),
                pa.array([likeness(marks[k], marks[k + 1]) for k in keep], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    rows, marks = [], []
    for batch in batches:
        for part in chunks(batch, "text"):
            rows += zip(part.column("bucket").to_pylist(), part.column("extra").to_pylist(), part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)
            marks += sketches(part.column("text"))
            yield finish(rows, marks)
            rows, marks = rows[-1:], marks[-1:]


def compare_edited(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last floor(n_chars / 4) code points are replaced by the first as many (or all) of the next
    document in ascending doc_id (after the last: the first). A single document is its own next.
    """
    return neighbours(docs).select("bucket", "extra", "doc_id", "text").mapInArrow(_editor, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
